"""Refreshed leaves and scopes equal a rebuild, and only what lost its best photo is searched."""
from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from silvergrain.operators import places, refresh, scopes

SCHEMA = ("sha1 string, country_label string, region_label string, city_label string, coord_key string, use_lat double, "
          "use_lon double, hero_score double, final_dt string, place_label string")


def photo(i: int, place: int, score: float, label: str = "Spot", dt: str | None = "2001-01-01 00:00:00") -> tuple:
    return (f"p{i:03d}", "C", f"R{place % 2}", f"T{place % 3}", f"{place}.000,1.000", place + 0.1, 1 / 3, score, dt, label)


def refreshed(spark, before, after, path=None):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    gone, came = [r for r in before if r not in after], [r for r in after if r not in before]
    current = frame(after)
    if path:
        refresh.laid_out(current, 16).write.partitionBy(refresh.LAYOUT).parquet(path)
        current = spark.read.parquet(path)
    state = refresh.leaf_state(frame(before))
    touched = refresh.touched_leaves(state, refresh.changes(frame(gone), frame(came)), current, 16)
    return refresh.apply(state, touched, refresh.LEAF), touched, refresh.leaf_state(frame(after))


def same(left, right) -> bool:
    rows = lambda df: sorted(map(tuple, df.select(*refresh.LEAF, "photo_count", "lat_sum", "lon_sum", "best", "first").collect()))
    return rows(left) == rows(right)


@pytest.mark.parametrize("seed", range(3))
def test_random_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    score = lambda: rng.choice([0.25, 0.5, 0.75])  # many ties
    before = [photo(i, rng.randrange(9), score(), rng.choice("ab"), rng.choice([None, "2002-01-01 00:00:00"])) for i in range(120)]
    after = [r for r in before if rng.random() > 0.1]
    after = [photo(int(r[0][1:]), rng.randrange(9), score()) if rng.random() < 0.1 else r for r in after]
    after += [photo(i, rng.randrange(12), score()) for i in range(120, 130)]
    new, _, rebuilt = refreshed(spark, before, after, str(tmp_path / "photos"))
    assert same(new, rebuilt)
    tree = lambda state: sorted(map(tuple, places.tree_of(refresh.leaves_of(state)).collect()), key=repr)
    assert tree(new) == tree(rebuilt)


def test_leaves_that_go_come_or_lose_their_best(spark, tmp_path):
    before = [photo(1, 0, 0.9), photo(2, 0, 0.5, "Next"), photo(3, 1, 0.5), photo(4, 2, 0.5), photo(5, 2, 0.4)]
    after = [before[1], photo(6, 3, 0.1), photo(4, 2, 0.7), before[4]]
    new, touched, rebuilt = refreshed(spark, before, after, str(tmp_path / "photos"))
    assert same(new, rebuilt)
    seen = {r["coord_key"]: r for r in touched.collect()}
    assert {k: r["photo_count"] for k, r in seen.items()} == {"0.000,1.000": 1, "1.000,1.000": 0, "2.000,1.000": 2, "3.000,1.000": 1}
    assert seen["0.000,1.000"]["best"]["sha1"] == "p002" and seen["0.000,1.000"]["first"]["place_label"] == "Next"
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()


def test_no_search_where_something_as_good_came(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    state = refresh.leaf_state(frame(photo(1, 0, 0.5), photo(2, 0, 0.2)))
    nothing = spark.createDataFrame([], SCHEMA)  # a search here would find no photo
    change = refresh.changes(frame(photo(1, 0, 0.5)), frame(photo(1, 0, 0.6)))
    assert refresh.touched_leaves(state, change, nothing).first()["best"]["hero_score"] == 0.6
    assert refresh.touched_leaves(state, refresh.changes(nothing, nothing), nothing).count() == 0


def test_taking_back_too_much_fails(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    state = refresh.leaf_state(frame(photo(1, 0, 0.5)))
    change = refresh.changes(frame(photo(1, 0, 0.5), photo(2, 0, 0.2)), spark.createDataFrame([], SCHEMA))
    with pytest.raises(PySparkException, match="take back more"):
        refresh.touched_leaves(state, change, frame(photo(1, 0, 0.5))).collect()


def test_scopes_that_empty_go(spark):
    schema = ("sha1 string, decade string, year string, date_key string, folder_group string, web_path string, tags array<string>")
    row = lambda i, tags, path: (f"{i:040x}", "1990s", "1991", "1991-02-03", None, path, tags)
    before = [row(1, ["A"], "x/1.jpg"), row(2, ["A", "B"], "x/y/2.jpg"), row(15 * 16**39 + 3, [], "3.jpg")]
    after = [before[0], row(2, ["A"], "x/z/2.jpg"), before[2]]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = scopes.scope_sums(scopes.membership(frame(before)))
    touched = refresh.touched_scopes(state, refresh.changes(frame(before[1:2]), frame(after[1:2])))
    assert {(r["scope_type"], r["scope_key"]): r["photo_count"] for r in touched.where("photo_count = 0").collect()} == {
        ("tag", "B"): 0, ("folder", "x/y"): 0}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(scopes.signatures_of(refresh.apply(state, touched, refresh.SCOPE))) == rows(
        scopes.scope_signatures(scopes.membership(frame(after))))
