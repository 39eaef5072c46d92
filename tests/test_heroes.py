from __future__ import annotations

import random

import pytest

import brute
from silvergrain.operators import clusters, heroes, places
from silvergrain.plans.bursts import year_members
from silvergrain.plans.heroes import SCOPE
from silvergrain.plans.places import records
from silvergrain.plans.registry import PLANS
from silvergrain.sources.archive import Archive
from pyspark.sql import functions as F

MEMBER = ("scope string, sha1 string, final_dt string, ts long, hero_score double, has_gps boolean, latitude double, "
          "longitude double, lat3 double, lon3 double")


def bucket_rows(seed, n, groups=("a", "b")):
    rng = random.Random(seed)
    return [(g, rng.randrange(-60_000_000, 60_000_000), rng.randrange(-170_000_000, 170_000_000), rng.randrange(1, 9), round(rng.random(), 4), i, f"s{i}", 16)
            for g in groups for i in range(n)]


@pytest.mark.parametrize("limit", [1000, 5])
def test_place_centres_both_ways(many_slices, limit):
    """The grouped pass and the sliced rounds give the centres of the plain rule."""
    rows = bucket_rows(3, 40)
    df = many_slices.createDataFrame(rows, "g string, lat long, lon long, weight long, hero_score double, "
                                           "seen_at long, seen_id string, k int")
    got = {r["g"]: [(c["lat"], c["lon"]) for c in r["centres"]]
           for r in clusters.region_centres(df, ["g"], limit=limit).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[5])
        want = brute.place_regions([r[1:3] for r in mine], [r[3] for r in mine], [r[4] for r in mine], 16)
        assert len(got[g]) == len(want) == 16
        assert got[g] == want


@pytest.mark.parametrize("limit", [1000, 5])
def test_time_centres_both_ways(many_slices, limit):
    rng = random.Random(11)
    values = {g: [rng.randrange(0, 5_000_000) if rng.random() < 0.8 else 77 for _ in range(90)] for g in "ab"}
    values["few"] = [5, 5, 9]
    rows = [(g, v, vs.count(v)) for g, vs in values.items() for v in sorted(set(vs))]
    df = many_slices.createDataFrame(rows, "g string, ts long, n long")
    got = {r["g"]: r["centres"] for r in clusters.moment_centres(df, ["g"], 16, limit=limit).collect()}
    for g, vs in values.items():
        want = sorted(set(brute.moment_centres(vs, 16)))
        assert sorted(set(got[g])) == want


def test_time_centres_stop_group_by_group(many_slices):
    """Of two large groups, one is still after three rounds by a shift below a second, the other after eight."""
    rows = []
    for g, seed, top in (("early", 17, 120), ("late", 29, 300)):
        rng = random.Random(seed)
        rows += [(g, v, rng.randrange(1, 9)) for v in range(top)]
    df = many_slices.createDataFrame(rows, "g string, ts long, n long")
    one, many = ({r["g"]: r["centres"] for r in clusters.moment_centres(df, ["g"], 3, limit=n).collect()} for n in (10**9, 0))
    assert one == many
    for g in one:
        assert sorted(one[g]) == sorted(brute.moment_centres([v for h, v, n in rows if h == g for _ in range(n)], 3))


def members(spark, spec):
    """``(lat, hero)`` or ``(None, hero)`` photos of one scope, an hour apart."""
    rows = []
    for i, (lat, hero) in enumerate(spec):
        gps = lat is not None
        rows.append(("s", f"p{i:03d}", f"2001-01-01 {i % 24:02d}:00:00", 3600 * i, hero, gps, lat, 1.0 if gps else None,
                     round(lat, 3) if gps else None, 1.0 if gps else None))
    return spark.createDataFrame(rows, MEMBER)


def card(spark, spec, **kw):
    got = heroes.hero_selection(members(spark, spec), ["scope"], **kw).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(got)))
    return got


def test_ten_places_and_fillers(spark):
    got = card(spark, [(float(i % 10), i / 100) for i in range(30)])
    assert len(got) == 16 and [r["phase"] for r in got] == [1] * 10 + [2] * 6
    assert {int(r["sha1"][1:]) for r in got if r["phase"] == 1} == set(range(20, 30))


def test_loose_photo_takes_a_slot(spark):
    got = card(spark, [(float(i), 0.9) for i in range(15)] + [(None, 0.1), (None, 0.05)])
    assert [r["phase"] for r in got] == [0] + [1] * 15 and got[0]["sha1"] == "p015"


@pytest.mark.parametrize("places,phase1", [(16, 16), (17, 16)])
def test_cluster_border(spark, places, phase1):
    got = card(spark, [(float(i * i), i / 100) for i in range(places)])
    assert sum(r["phase"] == 1 for r in got) == phase1 and len(got) == 16


def test_cards_of_the_archive(spark, data_dir):
    a = Archive(spark, data_dir)
    rows = PLANS["hero16_geo"](a)
    per_scope = rows.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.countDistinct("sha1").alias("d"), F.max("pos").alias("p"))
    assert per_scope.where("n > 16 OR n <> d OR p <> n - 1").isEmpty()
    again = PLANS["hero16_geo"](Archive(spark, data_dir))
    assert rows.exceptAll(again).isEmpty() and again.exceptAll(rows).isEmpty()


def test_mosaic_matches_plain_rule(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        ts = None if i % 10 == 0 else rng.randrange(0, 10_000_000)
        rows.append(("s", f"p{i:03d}", "0000-00-00 00:00:00" if ts is None else f"{ts:012d}", ts, round(rng.random(), 5)))
    df = spark.createDataFrame(rows, "scope string, sha1 string, final_dt string, ts long, hero_score double")
    got = [r["sha1"] for r in heroes.place_mosaic(df, ["scope"]).orderBy("pos").collect()]
    dated = [r for r in rows if r[3] is not None]
    centres = brute.moment_centres([r[3] for r in dated], 16)
    groups = {}
    for r in dated:
        groups.setdefault(min(range(len(centres)), key=lambda i: abs(r[3] - centres[i])), []).append(r)
    key = lambda r: (r[4], r[2], r[1])
    want = [max(groups[i], key=key)[1] for i in sorted(groups, key=lambda i: centres[i])]
    rest = sorted((r for r in rows if r[1] not in want), key=key, reverse=True)
    want += [r[1] for r in rest if r[3] is None]
    want += [r[1] for r in rest if r[3] is not None]
    assert got == want[:16]


def test_sliced_rounds_give_the_same_cards(spark, data_dir):
    """Every group as sliced rounds, and every group in one pass: not one value differs."""
    a = Archive(spark, data_dir)
    members = year_members(a).where("year IN ('1990', '1991', '1992')").cache()
    one, many = (sorted(map(tuple, heroes.hero_selection(members, SCOPE, limit=n).collect())) for n in (10**9, 0))
    assert one == many and len(one) > 16


def test_sliced_rounds_give_the_same_mosaics(spark, data_dir):
    nodes = places.node_members(records(Archive(spark, data_dir))).where("node_id LIKE 'country%'").cache()
    one, many = (sorted(map(tuple, heroes.place_mosaic(nodes, ["node_id"], limit=n).collect())) for n in (10**9, 0))
    assert one == many and len(one) > 16
