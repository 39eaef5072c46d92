from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from silvergrain.operators import bursts, cull, ordering, sessions

PHOTO = "sha1 string, ts long, latitude double, longitude double, has_gps boolean"
NEAR, FAR = 0.00005, 0.01


def found(spark, photos, slice_rows=60, fan=bursts.FAN):
    rows = spark.createDataFrame([(s, t, la, lo, True) for s, t, la, lo in photos], PHOTO)
    groups: dict[str, set] = {}
    for r in bursts.burst_members(rows, slice_rows=slice_rows, fan=fan).collect():
        groups.setdefault(r["cluster_id"], set()).add(r["sha1"])
        assert r["size"] >= 2
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("gap,joined", [(15, True), (16, False)])
def test_gap_border(spark, gap, joined):
    got = found(spark, [("a", 100, 1.0, 1.0), ("b", 100 + gap, 1.0, 1.0)])
    assert got == ({frozenset("ab")} if joined else set())


def test_bridge_needs_two_photos(spark):
    assert found(spark, [("a", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("c", 5, 1.0 + FAR, 1.0)]) == {frozenset("abc")}
    assert found(spark, [("a", 0, 1.0, 1.0), ("c", 4, 1.0 + FAR, 1.0)]) == set()


@pytest.mark.parametrize("span,joined", [(10, True), (11, False)])
def test_bridge_span_border(spark, span, joined):
    photos = [("a", 0, 1.0, 1.0), ("b", span, 1.0, 1.0), ("c", span + 2, 1.0 + FAR, 1.0)]
    assert (frozenset("abc") in found(spark, photos)) == joined


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_over_many_slices(many_slices, seed):
    rng = random.Random(seed)
    photos, ts = [], 0
    for i in range(600):
        ts += rng.choice([0, 0, 1, 2, 3, 5, 6, 15, 16] if seed % 2 else [0, 0, 1, 1, 2, 4])
        photos.append((f"{rng.getrandbits(64):016x}", ts, 1.0 + rng.choice([0, 0, NEAR, FAR]), 2.0))
    assert found(many_slices, photos) == brute.bursts(photos)


@pytest.mark.parametrize("slice_rows,fan", [(20, 3), (7, 2), (600, 2)])
def test_states_pass_through_a_tree_of_any_shape(many_slices, monkeypatch, slice_rows, fan):
    """Several levels of groups, with and without broadcasts."""
    monkeypatch.setattr(bursts, "BROADCAST_SLICES", 5)
    rng = random.Random(fan)
    photos, ts = [], 0
    for i in range(200):
        ts += rng.choice([0, 0, 1, 2, 3, 5, 16])
        photos.append((f"{rng.getrandbits(64):016x}", ts, 1.0 + rng.choice([0, 0, NEAR, FAR]), 2.0))
    assert found(many_slices, photos, slice_rows, fan) == brute.bursts(photos)


def test_maps_compose_in_any_grouping():
    rng = np.random.default_rng(3)
    maps = [pd.DataFrame({"slice": [i], "above": [0], "after": [rng.integers(0, bursts.STATES, bursts.STATES).tolist()],
                          "opened": [[None if rng.random() < 0.5 else f"r{i}-{s}" for s in range(bursts.STATES)]]}) for i in range(9)]
    whole = bursts._composed(pd.concat(maps))
    for cut in range(1, 9):
        left, right = (bursts._composed(pd.concat(part)).assign(slice=n, above=0) for n, part in enumerate((maps[:cut], maps[cut:])))
        both = bursts._composed(pd.concat([left, right]))
        assert both["after"].tolist() == whole["after"].tolist() and both["opened"].tolist() == whole["opened"].tolist()


def test_the_row_before_over_levels(spark):
    rows = [(i, f"v{i}") for i in range(100) if i % 7 and not 30 < i < 60]
    got = ordering.before_each(spark.createDataFrame(rows, "n int, v string"), "n", "v", "p", 100, 3).collect()
    assert {r["n"]: r["p"] for r in got} == {n: (rows[i - 1][1] if i else None) for i, (n, _) in enumerate(rows)}


def test_one_second_holds_everything(many_slices):
    """A run that spans every slice: all photos in one second, some far away."""
    rng = random.Random(9)
    photos = [(f"{rng.getrandbits(64):016x}", 7, 1.0 + (FAR if i % 3 == 0 else 0), 2.0) for i in range(500)]
    assert found(many_slices, photos) == brute.bursts(photos)


@pytest.mark.parametrize("gap", [15, 20])
def test_time_clusters(spark, gap):
    rng = random.Random(gap)
    photos = [(rng.choice("xy"), f"p{i}", rng.choice([None, 86400 * rng.randrange(3) + rng.choice([0, 86380]) + rng.randrange(90)]))
              for i in range(300)]
    photos += [("x", "e1", 5000), ("x", "e2", 5000 + gap), ("x", "e3", 5001 + 2 * gap)]
    rows = spark.createDataFrame([(k, s, t, float(i), "") for i, (k, s, t) in enumerate(photos)],
                                 "k string, sha1 string, ts long, hero_score double, final_dt string")
    want = brute.time_clusters(photos, gap)
    got = sessions.time_clusters(rows, ["k"], gap).collect()
    rank = {s: i for i, (_, s, _) in enumerate(photos)}
    assert sorted((r["size"], r["best"]["sha1"]) for r in got) == sorted((len(c), max(c, key=rank.get)) for c in want)


@pytest.mark.parametrize("size,kept", [(4, 1), (5, 2)])
def test_keepers_by_size(spark, size, kept):
    members = spark.createDataFrame([("c", f"p{i}", i, size) for i in range(size)],
                                    "cluster_id string, sha1 string, ts long, size long")
    scored = spark.createDataFrame([(f"p{i}", float(i % 3), 0.0, 0.0, 0.0) for i in range(size)],
                                   "sha1 string, score double, face_score double, aesthetic_score double, technical_score double")
    plan = cull.cull_plan(members, scored)
    assert plan.where("keep = 1").count() == kept
    assert plan.where("keeper_rank = 1").first()["sha1"] == "p2"
    totals = cull.plan_totals(members, plan).first()
    assert totals["kept"] + totals["to_cull"] == totals["requested"] == size


def test_positions_over_slices(many_slices):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(5), i) for i in range(400)]
    df = many_slices.createDataFrame(rows, "g string, v int, id int")
    got = {(r["g"], r["id"]): r["pos"] for r in ordering.with_positions(df, ["g"], F.desc("v"), F.asc("id")).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[(g, r[2])] for r in ordered] == list(range(len(ordered)))


def test_moves_settle_clashes(spark):
    media = spark.createDataFrame([
        ("aaaaaaaa1", "d\\x.jpg", 0), ("bbbbbbbb2", "d/x.jpg", 0), ("cccccccc3", "_stash/d/x.jpg", 0),
        ("dddddddd4", "y.jpg", 0), ("eeeeeeee5", "y.jpg", 0), ("ffffffff6", "_trash/z.jpg", 1)],
        "sha1 string, rel_fqn string, is_deleted int")
    ask = spark.createDataFrame([("aaaaaaaa1", 0), ("bbbbbbbb2", 1), ("eeeeeeee5", 2), ("dddddddd4", 3),
                                 ("ffffffff6", 4), ("none", 5)], "sha1 string, pos long")
    moved = cull.soft_move(media, ask, "_stash")
    paths = {r["sha1"][0]: r["rel_fqn"] for r in moved.collect()}
    assert paths == {"a": "_stash\\d\\x__aaaaaaaa.jpg", "b": "_stash\\d\\x__bbbbbbbb.jpg", "c": "_stash/d/x.jpg",
                     "d": "_stash\\y__dddddddd.jpg", "e": "_stash\\y.jpg", "f": "_trash/z.jpg"}
    assert tuple(cull.move_counts(ask, moved).first()) == (6, 4, 2)


def walked(ts, edge, state, ts_before):
    """Row by row: the run each row belongs to, and the state handed on."""
    size, since = (1, ts_before) if state == bursts.SINGLE else (2, ts_before - (state if state < bursts.OLD else 1 << 40))
    start, before, out = -1, ts_before, []
    for i, (t, e) in enumerate(zip(ts, edge)):
        if e == bursts.BREAK or (e == bursts.BRIDGE and (size < 2 or before - since > bursts.MAX_SPAN)):
            start, size, since = i, 1, t
        else:
            size += 1
        before = t
        out.append(start)
    return out, bursts.SINGLE if size == 1 else min(before - since, bursts.OLD)


def test_slices_equal_a_walk_from_every_state():
    rng = random.Random(5)
    for _ in range(300):
        n, ts = rng.randint(1, 40), [100]
        for _ in range(n):
            ts.append(ts[-1] + rng.choice([0, 0, 1, 2, 4, 5, 9]))
        edge = np.array([rng.choice([0, 1, 1, 2, 2, 2]) for _ in range(n)])
        for state in range(bursts.STATES):
            starts, after = bursts.run_starts(np.array(ts[1:]), edge, state, ts[0])
            assert (starts.tolist(), after) == walked(ts[1:], edge, state, ts[0])
        frame = pd.DataFrame({"slice": 0, "sha1": [f"p{i}" for i in range(n)], "ts": ts[1:], "rn": range(n), "edge": edge,
                              "ts_before": ts[0]})
        for row, state in zip(bursts._state_map(frame).itertuples(), range(bursts.STATES)):
            starts, after = walked(ts[1:], edge, state, ts[0])
            assert (row.after, row.start_sha1) == (after, f"p{starts[-1]}" if starts[-1] >= 0 else None)


def test_a_million_bridges_take_seconds():
    n = 1_000_000
    ts, edge = np.arange(n) * 3, np.full(n, bursts.BRIDGE)
    begun = time.perf_counter()
    starts, _ = bursts.run_starts(ts, edge, bursts.SINGLE, -3)
    assert (starts == np.arange(n)).all() and time.perf_counter() - begun < 10
