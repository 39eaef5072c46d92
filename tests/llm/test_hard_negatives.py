"""Hard negatives against all pairs, and the tree's own promises."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from silvergrain.llm import hyperplane_tree
from silvergrain.llm.hyperplane_tree import Settings, Tree, hard_negatives, whole_components

SCHEMA = "vec_id long, embedding array<float>, label int, score double, node long, q long, dims string"
SMALL = Settings(fanout=6, leaf=30, queries=7)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, la, 0.5, 1, 2, "x") for i, v, la in rows], SCHEMA)


def plain(rows, every):
    """All pairs in whole numbers; rows are (vec_id, label, vector)."""
    found = set()
    rows = list({(i, la, tuple(v)) for i, la, v in rows})
    for i, la, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, lb) for j, lb, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == la][:5]:
            inside = [(t, k) for t, k, lb in scored if lb != la and 80 * -s <= 100 * -t <= 100 * -s][:5]
            found |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside)}
    return found


def whole(rows):
    out = []
    for i, v, la in rows:
        if i is None or v is None or la is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, (la + 1) % 10 if i % 7 == 0 else la, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def result(frame):
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def mined(spark, rows, every=5, settings=SMALL):
    return result(hard_negatives(whole_components(embeddings(spark, rows)), F.col("vec_id") % every == 0, settings))


def clustered(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, (centres[i % 6] + 0.2 * rng.standard_normal(dims)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_equals_all_pairs_in_deep_trees(spark):
    rows = clustered(260, 5, 1)
    assert mined(spark, rows) == plain(whole(rows), 5)


def test_copies_ties_and_nodes_that_cannot_be_split(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(60)] + [(60 + i, [0.5, 0.25 + 0.01 * (i % 4)], i % 40) for i in range(90)]
    rows += [(200 + i, [-0.5, -0.25], 1) for i in range(20)] + [(300 + i, [0.0, 0.0], i % 2) for i in range(30)]
    assert mined(spark, rows) == plain(whole(rows), 5)


def test_rows_that_take_no_part(spark):
    rows = clustered(60, 3, 2)
    odd = [(None, [1.0, 0.0, 0.0], 1), (1000, None, 1), (1005, [1.0, 0.0, 0.0], None), (1010, [1.0, None, 0.0], 1), (1015, [float("nan"), 0.0, 0.0], 1),
           (1020, [float("inf"), 0.0, 0.0], 1), (1025, [], 1)]
    assert mined(spark, rows + odd) == plain(whole(rows), 5)
    other = [(2000 + i, [float(i), 1.0], i % 2) for i in range(8)]
    again = [rows[0], rows[0], (rows[0][0], [9.0, 9.0, 9.0], 2)]
    huge = [(3000, [1e18, 0.0, 0.0], 1)]
    assert mined(spark, rows + other + again + huge) == plain(whole(rows + other + again), 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 3e4 for x in v], la) for i, v, la in clustered(40, 3, 4)] + [(100, [3.0e6, 1.0, 1.0], 1), (105, [3.0e6, 2.0, 1.0], 0)]
    assert mined(spark, rows) == plain(whole(rows), 5)


def test_empty_tables(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()


def test_ranges_hold_and_rule_children_out(spark):
    points = whole_components(embeddings(spark, clustered(300, 3, 3))).select(
        F.size("vector").alias("dims"), "label", F.array("vec_id").alias("ids"), "vector")
    tree = Tree(points, SMALL)
    leaves = tree.leaves.collect()
    assert len(leaves) == 300 and len({r["node"] for r in leaves}) > 10 and len(tree.levels) > 1

    def under(node, root):
        while node > root:
            node = (node - 1) // SMALL.fanout
        return node == root

    for level in tree.levels:
        for node in level.collect():
            for child in node["children"]:
                own = np.array([r["vector"] for r in leaves if under(r["node"], child["node"])], float)
                norms = (own ** 2).sum(1)
                assert (norms.min(), norms.max()) == (child["norm_least"], child["norm_most"])
                for i, point in enumerate(node["points"]):
                    d = np.sqrt(((own - point) ** 2).sum(1))
                    assert child["ranges"][i]["least"] == pytest.approx(d.min()) and child["ranges"][i]["most"] == pytest.approx(d.max())
    asked = spark.createDataFrame([(0, 0, 1, 0, 3, leaves[0]["vector"], [int(np.dot(leaves[0]["vector"], leaves[0]["vector"]) * 0.999)],
                                    [1 << 62])], "q long, id long, label long, home long, dims int, vector array<long>, low array<long>, high array<long>")
    assert tree.visits(asked).count() < len({r["node"] for r in leaves}) / 2


def test_query_equals_all_pairs(spark, data_dir):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    assert result(entry.queries()["op11_gnat_hard_negatives"](spark, data_dir)) == plain(whole(rows), 100)
    assert hyperplane_tree.RESULT.count(",") == 5
