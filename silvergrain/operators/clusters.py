"""Cluster centres for place buckets (2-D) and capture times (1-D).

Only centres, at most sixteen per group, come out of this module; assigning
rows to their nearest centre is a column expression for the caller.

Places are whole millionths of a degree, times whole seconds, and all sums are
exact integers; a mean is one division of two of them. So the result doesn't
depend on how the work is cut up: groups up to ``GROUP_LIMIT`` pre-aggregated
rows are solved in one grouped pass, larger ones as rounds of Spark aggregations
over range slices, and both give the same centres to the last bit.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.operators.ordering import ordered_slices
from silvergrain.session import cut_lineage, ship_package

GROUP_LIMIT = 200000
PLACE_ROUNDS = 12
TIME_ROUNDS = 10
TIME_MOVE = 1.0
POINT = "struct<lat:bigint,lon:bigint>"


# --- whole units ----------------------------------------------------------------------

def micro(degrees: Column) -> Column:
    """Degrees as whole millionths."""
    return F.floor(degrees * 1_000_000 + 0.5)


def whole_mean(total: Column, count: Column) -> Column:
    """The mean of integers as an integer."""
    return F.floor(total / count + 0.5)


# --- nearest centre as a column -----------------------------------------------------

def squared(lat: Column, lon: Column, centre: Column) -> Column:
    return (lat - centre["lat"]) * (lat - centre["lat"]) + (lon - centre["lon"]) * (lon - centre["lon"])


def nearest_place(lat: Column, lon: Column, centres: Column) -> Column:
    """Index of the nearest centre; the lowest index wins a tie."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(squared(lat, lon, c).alias("d"), i.alias("i"))))["i"]


def nearest_time(ts: Column, centres: Column) -> Column:
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(ts - c).alias("d"), i.alias("i"))))["i"]


# --- one group in memory ------------------------------------------------------------

def place_centres(points: np.ndarray, weights: np.ndarray, first: int, k: int) -> np.ndarray:
    """Deterministic weighted 2-D clustering of an ordered point list."""
    chosen = [int(first)]
    gap = np.full(len(points), np.iinfo(np.int64).max)
    while len(chosen) < min(k, len(points)):
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        fits = int(gap.max()) * len(gap) < 1 << 62  # else sums need Python's integers
        reach = np.cumsum(gap if fits else gap.astype(object))
        if not reach[-1]:
            break
        chosen.append(int(np.searchsorted(reach, (reach[-1] + 1) // 2)))
    centres = points[chosen].copy()
    for _ in range(PLACE_ROUNDS):
        own = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        total, sums = np.zeros(len(centres), np.int64), np.zeros((len(centres), 2), np.int64)
        np.add.at(total, own, weights)
        np.add.at(sums, own, points * weights[:, None])
        moved, some = centres.copy(), total > 0
        moved[some] = np.floor(sums[some] / total[some, None] + 0.5).astype(np.int64)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def time_centres(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """1-D clustering of ascending distinct seconds with counts."""
    total = int(counts.sum())
    if total <= k:
        return values.astype(float)
    chosen = [float(values[np.searchsorted(np.cumsum(counts), total // 2 + 1)])]
    gap = np.abs(values - chosen[0])
    while len(chosen) < min(k, len(values)):
        far = int(gap.argmax())
        chosen.append(float(values[far]))
        gap = np.minimum(gap, np.abs(values - values[far]))
    centres = np.sort(np.array(chosen))
    for _ in range(TIME_ROUNDS):
        own = np.abs(values[:, None] - centres[None, :]).argmin(axis=1)
        weight, sums = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        np.add.at(weight, own, counts)
        np.add.at(sums, own, values * counts)
        moved = np.where(weight > 0, sums / np.maximum(weight, 1), centres)
        still = np.all(np.abs(moved - centres) < TIME_MOVE)
        centres = moved
        if still:
            break
    return centres


# --- groups of any size -------------------------------------------------------------

def _first_reaching(sliced: DataFrame, keys: list[str], weight: Column, goals: DataFrame, pick: Column,
                    order: str) -> DataFrame:
    """Per group, the first row (in ``order``) at which the running weight reaches ``goal``.

    The slice is found from slice sums; only that slice is then scanned.
    """
    weighed = sliced.withColumn("_w", weight)
    sums = weighed.groupBy(*keys, "slice").agg(F.sum("_w").alias("_s"))
    run = F.sum("_s").over(Window.partitionBy(*keys).orderBy("slice"))
    hit = (sums.withColumn("_run", run).join(goals, keys).where(F.col("_run") >= F.col("goal"))
           .groupBy(*keys).agg(F.min(F.struct("slice", (F.col("_run") - F.col("_s")).alias("before"),
                                              "goal")).alias("h")))
    hit = hit.select(*keys, F.col("h.slice").alias("slice"), F.col("h.before").alias("before"),
                     F.col("h.goal").alias("goal"))
    inside = F.sum("_w").over(Window.partitionBy(*keys, "slice").orderBy(order))
    rows = weighed.join(hit, [*keys, "slice"]).withColumn("_at", F.col("before") + inside)
    return (rows.where((F.col("_at") >= F.col("goal")) & (F.col("_w") > 0))
            .groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), pick.alias("p")))["p"].alias("picked")))


def _large_place_centres(large: DataFrame, keys: list[str], k: str) -> DataFrame:
    """Rounds over slices for big groups; ``large`` is as for :func:`region_centres`."""
    sliced = ordered_slices(large.withColumn("seen", F.struct("seen_at", "seen_id")), *keys, "seen")
    point = F.struct("lat", "lon")
    best = F.min_by(point, F.struct((-F.col("hero_score")).alias("h"), (-F.col("weight")).alias("w"), "seen"))
    state = cut_lineage(sliced.groupBy(*keys).agg(F.array(best).cast(f"array<{POINT}>").alias("centres"),
                                                  F.max(k).alias("k")))
    gap = F.array_min(F.transform("centres", lambda c: squared(F.col("lat"), F.col("lon"), c))).cast("decimal(38,0)")
    most = state.agg(F.max("k")).first()[0]  # one number, at most sixteen
    for _ in range(int(most) - 1):
        open_rows = sliced.drop(k).join(state.where(F.size("centres") < F.col("k")), keys).withColumn("gap", gap)
        goals = (open_rows.groupBy(*keys).agg(F.sum("gap").alias("total")).where("total > 0")
                 .select(*keys, F.ceil(F.col("total") / 2).alias("goal")))
        picked = _first_reaching(open_rows, keys, F.col("gap"), goals, point, "seen")
        state = cut_lineage(state.join(picked, keys, "left").select(
            *keys, "k", F.when(F.col("picked").isNull(), F.col("centres")).otherwise(
                F.array_append("centres", F.col("picked"))).alias("centres")))
    return _settled(sliced.drop(k), keys, state, F.col("weight"), PLACE_ROUNDS)


def _settled(sliced: DataFrame, keys: list[str], state: DataFrame, weight: Column, rounds: int) -> DataFrame:
    """Moves place centres to the weighted means of their rows until nothing moves."""
    for _ in range(rounds):
        owned = sliced.join(state, keys).withColumn("own", nearest_place(F.col("lat"), F.col("lon"), F.col("centres")))
        means = owned.groupBy(*keys, "own").agg(
            whole_mean(F.sum(F.col("lat") * weight), F.sum(weight)).alias("lat"),
            whole_mean(F.sum(F.col("lon") * weight), F.sum(weight)).alias("lon"))
        moved = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
            "own", F.struct("lat", "lon")))).alias("moved"))
        fresh = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at(F.col("moved"), i), c))
        step = cut_lineage(state.join(moved, keys).select(*keys, "k", F.col("centres").alias("old"),
                                                          fresh.alias("centres")))
        state = step.drop("old")
        if step.where(F.col("old") != F.col("centres")).isEmpty():
            break
    return state.select(*keys, "centres")


def _large_time_centres(large: DataFrame, keys: list[str], k: int) -> DataFrame:
    sliced = ordered_slices(large, *keys, "ts")
    half = F.floor(F.sum("n") / 2) + 1
    goals = sliced.groupBy(*keys).agg(half.alias("goal"))
    middle = _first_reaching(sliced, keys, F.col("n"), goals, F.col("ts").cast("double"), "ts")
    state = cut_lineage(middle.select(*keys, F.array("picked").alias("centres")))
    gap = F.array_min(F.transform("centres", lambda c: F.abs(F.col("ts") - c)))
    for _ in range(k - 1):
        far = (sliced.join(state, keys).groupBy(*keys)
               .agg(F.max(F.struct(gap.alias("gap"), (-F.col("ts")).alias("early"))).alias("far")))
        more = F.when(F.col("far.gap") > 0, F.array_append("centres", (-F.col("far.early")).cast("double")))
        state = cut_lineage(state.join(far, keys).select(*keys, F.coalesce(more, F.col("centres")).alias("centres")))
    state = state.select(*keys, F.array_sort("centres").alias("centres"), F.lit(False).alias("still"))
    for _ in range(TIME_ROUNDS):  # a group whose centres are still takes no further part
        owned = sliced.join(state.where(~F.col("still")), keys).withColumn("own", nearest_time(F.col("ts"),
                                                                                              F.col("centres")))
        means = owned.groupBy(*keys, "own").agg((F.sum(F.col("ts") * F.col("n")) / F.sum("n")).alias("mean"))
        moved = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("own", "mean"))).alias("moved"))
        fresh = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at(F.col("moved"), i), c))
        shift = F.array_max(F.zip_with("old", "centres", lambda x, y: F.abs(x - y)))
        step = state.join(moved, keys, "left").select(*keys, F.col("centres").alias("old"), fresh.alias("centres"))
        state = cut_lineage(step.select(*keys, "centres", (shift < TIME_MOVE).alias("still")))
        if state.where(~F.col("still")).isEmpty():
            break
    return state.select(*keys, "centres")


def _by_size(rows: DataFrame, keys: list[str], small: Callable[[DataFrame], DataFrame],
             large: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Sends groups to the grouped pass or to the sliced rounds by their row count."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_group")).where(
        F.col("rows_in_group") > limit).select(*keys)
    if sizes.isEmpty():
        return small(rows)
    sizes = cut_lineage(sizes)
    few = small(rows.join(sizes, keys, "left_anti"))
    return few.unionByName(large(rows.join(sizes, keys, "left_semi")))


def _key_schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keys)


def region_centres(buckets: DataFrame, keys: list[str], k: str = "k", limit: int = GROUP_LIMIT) -> DataFrame:
    """``keys, centres``: up to ``k`` place centres of each group of buckets.

    ``buckets`` needs the keys, ``lat, lon`` (whole millionths of a degree), ``weight, hero_score``, the encounter
    order ``seen_at, seen_id`` (unique in the group) and the column ``k``.
    """
    ship_package(buckets.sparkSession)
    columns = [*keys, "lat", "lon", "weight", "hero_score", "seen_at", "seen_id", k]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seen_at", "seen_id"])
        lead = pdf.assign(at=np.arange(len(pdf))).sort_values(["hero_score", "weight", "at"],
                                                             ascending=[False, False, True])["at"].iloc[0]
        found = place_centres(pdf[["lat", "lon"]].to_numpy(), pdf["weight"].to_numpy(), lead, int(pdf[k].iloc[0]))
        row = {key: pdf[key].iloc[0] for key in keys}
        row["centres"] = [{"lat": int(p[0]), "lon": int(p[1])} for p in found]
        return pd.DataFrame([row])

    schema = f"{_key_schema(buckets, keys)}, centres array<{POINT}>"
    return _by_size(buckets.select(*columns), keys,
                    lambda rows: rows.groupBy(*keys).applyInPandas(solve, schema),
                    lambda rows: _large_place_centres(rows, keys, k), limit)


def moment_centres(seconds: DataFrame, keys: list[str], k: int = 16, limit: int = GROUP_LIMIT) -> DataFrame:
    """``keys, centres``: up to ``k`` time centres per group of distinct seconds (``ts, n``)."""
    ship_package(seconds.sparkSession)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        row = {key: pdf[key].iloc[0] for key in keys}
        row["centres"] = [float(v) for v in time_centres(pdf["ts"].to_numpy(), pdf["n"].to_numpy(), k)]
        return pd.DataFrame([row])

    schema = f"{_key_schema(seconds, keys)}, centres array<double>"
    return _by_size(seconds.select(*keys, "ts", "n"), keys,
                    lambda rows: rows.groupBy(*keys).applyInPandas(solve, schema),
                    lambda rows: _large_time_centres(rows, keys, k), limit)
