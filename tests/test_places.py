"""Ids of the place tree, and the counts that hang on them."""
from __future__ import annotations

from collections import Counter

from silvergrain.operators import heroes, places
from silvergrain.plans import places as plans
from silvergrain.sources.archive import Archive


def test_one_coordinate_in_two_cities_is_two_nodes(spark):
    columns = ["sha1", "country_label", "region_label", "city_label", "coord_key", "place_label", "use_lat", "use_lon",
               "hero_score", "final_dt", "ts"]
    rows = [(f"p{i}", "C", "R", city, "1.000,2.000", "Spot", 1.0, 2.0, 0.5, "2001-01-01 00:00:00", 978307200 + 100 * i)
            for i, city in enumerate(["A", "A", "B"])]
    records = spark.createDataFrame(rows, columns)
    ids = Counter(r["node_id"] for r in places.place_tree(records).collect())
    assert set(ids.values()) == {1} and {"place::C::R::A::1.000,2.000", "place::C::R::B::1.000,2.000"} <= set(ids)
    sizes = Counter()
    for r in places.gallery(places.node_members(records)).collect():
        sizes[r["node_id"]] += r["size"]
    assert sizes["place::C::R::A::1.000,2.000"] == 2 and sizes["place::C::R::B::1.000,2.000"] == 1


def test_galleries_and_mosaics_hold_what_the_tree_counts(spark, data_dir):
    records = plans.records(Archive(spark, data_dir)).cache()
    tree = {r["node_id"]: r["photo_count"] for r in places.place_tree(records).collect()}
    assert len(tree) == places.place_tree(records).count()
    members = places.node_members(records).cache()
    counted = {r["node_id"]: r["count"] for r in members.groupBy("node_id").count().collect()}
    assert counted == {k: v for k, v in tree.items() if k != "root"}
    whole = Counter()
    for r in places.gallery(members, limit=10**6).collect():
        whole[r["node_id"]] += r["size"]
    assert whole == counted
    mosaic = heroes.place_mosaic(members, ["node_id"])
    assert {r["node_id"]: r["photo_count"] for r in mosaic.select("node_id", "photo_count").distinct().collect()} == counted
