"""Galleries of all nodes from the clusters of their leaves."""
from __future__ import annotations

import random

import pytest

from silvergrain.operators import places, sessions
from silvergrain.operators.places import PATH

ROW = ", ".join(f"{c} string" for c in PATH) + ", leaf_id string, sha1 string, final_dt string, ts long, hero_score double"


def photos(seed: int, n: int = 900) -> list[tuple]:
    """Photos of six leaves around two midnights, some of one second, some without a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        leaf = rng.randrange(6)
        ts = None if rng.random() < 0.1 else 86400 * rng.choice((1, 2)) + rng.randrange(-700, 700)
        rows.append((f"c{leaf // 4}", f"r{leaf // 3}", f"t{leaf // 2}", f"place::{leaf}", f"{i:04}",
                     "" if ts is None else f"{ts:09}", ts, rng.randrange(20) / 20))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_leaf_gallery_is_the_gallery_of_all_nodes(spark, seed):
    rows = spark.createDataFrame(photos(seed), ROW)
    members = rows.select(places.F.explode(places.node_ids()).alias("node_id"), *places.MEMBER)
    for limit in (3, 10**6):
        got, want = (sorted(map(tuple, g.collect())) for g in (places.leaf_gallery(rows, limit), places.gallery(members, limit)))
        assert got == want and len(got) > 20


def test_nodes_meet_fewer_rows_than_photos(spark):
    """A burst goes to the nodes above as one piece, however many seconds it has."""
    rows = spark.createDataFrame([("c", "r", "t", "p", f"{i:04}", "", 50 + 3 * i, 0.5) for i in range(500)], ROW)
    assert [tuple(r) for r in sessions.day_pieces(rows, ["leaf_id"], 20).select("first", "last", "n").collect()] == [(50, 1547, 500)]
