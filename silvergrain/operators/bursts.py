"""Burst clusters over one global time order, by time and distance with a bridge.

Neighbours in time join when they are close in time and place. One stray
position may still join a young run that already has two photos (the bridge),
so membership depends on the run built so far: a sequential rule.

At scale the order is cut into slices (see ``ordering``). A run's state at a
slice border is one of 13 values: a single photo, or a longer run aged 0..10
seconds, or an older one. Each slice is summarised as a map from incoming to
outgoing state. Maps compose, and composition is associative: neighbouring
slices are combined ``FAN`` at a time, level by level, until few are left, and
from the top the incoming state of every group, and in the end of every slice,
is handed down. So no task and no driver holds all slices. Every slice
is then resolved on its own. A run that spans many slices, even a
third of all photos in one second, never sits in one task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.functions import geo
from silvergrain.operators.ordering import before_each, ordered_slices
from silvergrain.session import cut_lineage, ship_package

BREAK, NEAR, BRIDGE = 0, 1, 2
OLD, SINGLE = 11, 12
STATES = 13
MAX_SPAN = 10
#: Rows that a task resolves at once; more where there would be over ``MOST_SLICES``, as the driver samples their borders.
SLICE_ROWS = 25_000
MOST_SLICES = 100_000
#: Slices, and groups of them, that are combined at once.
FAN = 256
#: One row per slice is broadcast up to this number of slices.
BROADCAST_SLICES = 20_000


def per_slice(rows: DataFrame, slices: int) -> DataFrame:
    """A table with a row per slice, broadcast where that is known to be small."""
    return F.broadcast(rows) if slices <= BROADCAST_SLICES else rows


def time_edges(sliced: DataFrame, gap: int, metres: float, bridge_gap: int, slices: int = 1, fan: int = FAN) -> DataFrame:
    """Adds ``edge`` (how a row relates to the row before it), its rank, and the time before the slice."""
    inside = Window.partitionBy("slice").orderBy("ts", "sha1")
    ends = sliced.groupBy("slice").agg(F.max(F.struct("ts", "sha1", "latitude", "longitude")).alias("last"))
    last = per_slice(before_each(ends, "slice", "last", "carried", slices, fan), slices)
    here = F.lag(F.struct("ts", "sha1", "latitude", "longitude")).over(inside)
    rows = (sliced.withColumn("here", here).withColumn("rn", F.row_number().over(inside))
            .join(last, "slice").withColumn("prev", F.coalesce("here", "carried")))
    lapse = F.col("ts") - F.col("prev.ts")
    apart = geo.distance_m(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    edge = (F.when(F.col("prev").isNull() | (lapse > gap), BREAK).when(apart <= metres, NEAR)
            .when(lapse <= bridge_gap, BRIDGE).otherwise(BREAK))
    return rows.select("slice", "sha1", "ts", "rn", edge.cast("byte").alias("edge"),
                       F.coalesce("carried.ts", F.lit(0)).alias("ts_before"))


def _next_starts(ts: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For a run that starts at each row, the row at which the next run starts (the length: none).

    The next run starts at the first break, at a bridge right after a single
    photo, or at the first bridge once the run is older than ``MAX_SPAN``.
    """
    n = len(ts)
    at = np.arange(n)
    upcoming = lambda kind: np.minimum.accumulate(np.append(np.where(edge == kind, at, n), n)[::-1])[::-1]
    bridge, broken = upcoming(BRIDGE), upcoming(BREAK)
    old = np.searchsorted(ts, ts + MAX_SPAN, "right") + 1  # the first row whose predecessor is too late
    late = bridge[np.minimum(np.maximum(old, at + 2), n)]
    single = np.where(bridge[np.minimum(at + 1, n)] == at + 1, at + 1, n)
    return np.minimum(np.minimum(late, single), broken[at + 1])


def _first_start(ts: np.ndarray, edge: np.ndarray, state: int, ts_before: int) -> int:
    """The first row that starts a run, when a run in ``state`` comes in from the slice before."""
    begun = ts_before if state == SINGLE else ts_before - (state if state < OLD else 1 << 40)
    before = np.append(ts_before, ts[:-1])
    opens = (edge == BREAK) | ((edge == BRIDGE) & (before - begun > MAX_SPAN))
    if state == SINGLE and edge[0] == BRIDGE:
        opens[0] = True
    return int(opens.argmax()) if opens.any() else len(ts)


def _state_after(ts: np.ndarray, start: int, state: int, ts_before: int) -> int:
    """The state that a slice hands on; ``start`` is its last start of a run (-1: none)."""
    if start < 0:
        since = ts_before - (0 if state == SINGLE else state if state < OLD else 1 << 40)
        return int(min(ts[-1] - since, OLD))  # the run that came in has two photos by now
    return SINGLE if start == len(ts) - 1 else int(min(ts[-1] - ts[start], OLD))


def run_starts(ts: np.ndarray, edge: np.ndarray, state: int, ts_before: int) -> tuple[np.ndarray, int]:
    """Index of the row each row's run starts at (-1: before the slice), and the state after the slice."""
    following, marks, start = _next_starts(ts, edge).tolist(), [], _first_start(ts, edge, state, ts_before)
    while start < len(ts):
        marks.append(start)
        start = following[start]
    starts = np.full(len(ts), -1)
    starts[marks] = marks
    return np.maximum.accumulate(starts), _state_after(ts, marks[-1] if marks else -1, state, ts_before)


def _state_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each incoming state makes of a slice. One pass finds the last run that follows from any start."""
    pdf = pdf.sort_values("rn")
    ts, edge, ids = pdf["ts"].to_numpy(), pdf["edge"].to_numpy(), pdf["sha1"].to_numpy()
    before, n = int(pdf["ts_before"].iloc[0]), len(pdf)
    following = _next_starts(ts, edge).tolist()
    last = list(range(n)) + [-1]
    for at in range(n - 1, -1, -1):
        if following[at] < n:
            last[at] = last[following[at]]
    out = []
    for state in range(STATES):
        start = last[_first_start(ts, edge, state, before)]
        out.append((int(pdf["slice"].iloc[0]), state, _state_after(ts, start, state, before), ids[start] if start >= 0 else None))
    return pd.DataFrame(out, columns=["slice", "state", "after", "start_sha1"])


def _slice_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """The map of one slice as one row: by incoming state, the outgoing one and the run opened last (None: none)."""
    rows = _state_map(pdf)
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "after": [rows["after"].tolist()], "opened": [rows["start_sha1"].tolist()]})


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The map of neighbouring slices as one: where each incoming state ends, and the last run opened on its way."""
    pdf = pdf.sort_values("slice")
    after, opened = list(range(STATES)), [None] * STATES
    for steps, starts in zip(pdf["after"], pdf["opened"]):
        opened = [starts[s] if starts[s] is not None else o for s, o in zip(after, opened)]
        after = [int(steps[s]) for s in after]
    return pd.DataFrame({"slice": [int(pdf["above"].iloc[0])], "after": [after], "opened": [opened]})


def _handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """State and open run before each of neighbouring slices, from those before the first."""
    pdf = pdf.sort_values("slice")
    state, run, out = int(pdf["state"].iloc[0]), pdf["open_run"].iloc[0], []
    for number, steps, starts in zip(pdf["slice"], pdf["after"], pdf["opened"]):
        out.append((int(number), state, run))
        run = starts[state] if starts[state] is not None else run
        state = int(steps[state])
    return pd.DataFrame(out, columns=["slice", "state", "open_run"])


MAP = "slice int, after array<int>, opened array<string>"


def incoming_states(maps: DataFrame, slices: int, fan: int = FAN) -> DataFrame:
    """``slice, state, open_run`` before each slice: maps are combined upwards and states handed down, ``fan`` at a time."""
    above = F.floor(F.col("slice") / fan).cast("int")
    levels, groups = [cut_lineage(maps)], slices
    while groups > fan:
        grouped = levels[-1].withColumn("above", above).groupBy("above")
        levels.append(cut_lineage(grouped.applyInPandas(_composed, MAP)))
        groups = -(-groups // fan)
    top = levels.pop().withColumns({"above": F.lit(0), "state": F.lit(SINGLE), "open_run": F.lit(None).cast("string")})
    schema = "slice int, state int, open_run string"
    states = top.groupBy("above").applyInPandas(_handed_down, schema)
    while levels:
        known = states.withColumnRenamed("slice", "above")
        states = levels.pop().withColumn("above", above).join(known, "above").groupBy("above").applyInPandas(_handed_down, schema)
    return cut_lineage(states)


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rn")
    ids = pdf["sha1"].to_numpy()
    starts, _ = run_starts(pdf["ts"].to_numpy(), pdf["edge"].to_numpy(), int(pdf["state"].iloc[0]),
                           int(pdf["ts_before"].iloc[0]))
    run = np.where(starts >= 0, ids[np.maximum(starts, 0)], pdf["open_run"].iloc[0])
    return pd.DataFrame({"cluster_id": run, "sha1": ids, "ts": pdf["ts"].to_numpy()})


def burst_members(rows: DataFrame, gap: int = 15, metres: float = 15.0, bridge_gap: int = 5,
                  min_size: int = 2, slice_rows: int = SLICE_ROWS, fan: int = FAN) -> DataFrame:
    """``cluster_id, sha1, ts, size``: members of all bursts of at least ``min_size`` photos.

    There are as many slices as make about ``slice_rows`` rows each, so a task
    holds no more of them however many photos there are.

    ``rows`` needs ``sha1, ts, latitude, longitude, has_gps``. A cluster is
    named by the id of its first photo.
    """
    ship_package(rows.sparkSession)
    located = cut_lineage(rows.where("has_gps AND ts IS NOT NULL").select("sha1", "ts", "latitude", "longitude"))
    rows_of_all = located.count()
    slices = max(1, -(-rows_of_all // max(slice_rows, -(-rows_of_all // MOST_SLICES))))
    edges = cut_lineage(time_edges(ordered_slices(located, "ts", "sha1", slices=slices), gap, metres, bridge_gap, slices, fan))
    breaks = edges.groupBy("slice").agg(F.max(F.when(F.col("edge") == BREAK, F.col("rn"))).alias("last_break"))
    tails = (edges.join(per_slice(breaks, slices), "slice").where("last_break IS NULL OR rn >= last_break")
             .select("slice", "sha1", "ts", "rn", "edge", "ts_before"))
    states = incoming_states(tails.groupBy("slice").applyInPandas(_slice_map, MAP), slices, fan)
    # Written once: the sizes and the callers all read the members again.
    members = cut_lineage(edges.join(per_slice(states, slices), "slice").groupBy("slice")
                          .applyInPandas(_resolve, "cluster_id string, sha1 string, ts long"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return members.join(sizes, "cluster_id")
