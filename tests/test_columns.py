from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from silvergrain.functions import geo, text, time
from silvergrain.operators import ingest, places, ranking_scores, sidecars
from silvergrain.streaming import incremental


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw", ["o'neil trip-two 3rd day", "BEACH day", "a.b c_d", "élan-vital", ""])
def test_title_case_is_pythons(spark, raw):
    assert one(spark, text.title_case(F.col("t")), t=raw) == raw.title()


def test_browse_tags(spark):
    tags = text.browse_tags(F.col("p"), F.col("c"))
    assert one(spark, tags, p="Photos, 1997, trip-two, Trip-Two", c=None) == ["Trip-Two"]
    extra = text.browse_tags(F.col("p"), F.col("c"), ("OldDisk",))
    assert one(spark, extra, p="olddisk,x", c="12345") == ["12345", "X"]


@pytest.mark.parametrize("lat,lon,valid", [(0.0, 0.0, False), (0.0, 5.0, True), (None, 5.0, False)])
def test_gps_validity(spark, lat, lon, valid):
    df = spark.createDataFrame([(lat, lon)], "a double, b double")
    assert df.select(geo.has_gps(F.col("a"), F.col("b")).alias("v")).first()["v"] is valid


def test_coordinate_key_has_no_negative_zero(spark):
    df = spark.createDataFrame([(-0.0001, 12.3456)], "a double, b double")
    assert df.select(geo.coord_key(F.col("a"), F.col("b")).alias("v")).first()["v"] == "0.000,12.346"


@pytest.mark.parametrize("raw,want", [
    ("a photo   of a CLOSE up..", "A photo of a close up"), ("close up of x.", "Close-up of x"), ("", ""), ("x" * 300, "X" + "x" * 239)])
def test_caption(spark, raw, want):
    assert one(spark, text.clean_caption(F.col("t")), t=raw) == want


@pytest.mark.parametrize("name,want", [
    ("IMG_20190203_040506.jpg", "2019-02-03 04:05:06"), ("x2019-02-03_04-05-06.jpg", "2019-02-03 04:05:06"),
    ("x_20191303_040506 2019-02-03_04-05-06.jpg", "2019-02-03 04:05:06"), ("20300105_101112-2019_02_03_04_05_06", "2019-02-03 04:05:06"),
    ("20191303_040506 20190203_040506.jpg", None), ("2019020_3040506.jpg", None), ("", None), ("20190203_0405061.jpg", None),
    ("120190203_040506.jpg", None), ("IMG_20191303_040506.jpg", None), ("20270101_000000.jpg", None)])
def test_file_name_dates(spark, name, want):
    assert one(spark, time.stamp_text(time.from_filename(F.col("t"))), t=name) == want


def test_zero_date_is_undated(spark):
    assert one(spark, time.stamp_seconds(F.col("t")), t=time.ZERO_DATE) is None


def test_keyword_is_a_substring_test(spark):
    assert one(spark, text.contains_any(F.col("t"), text.CULL_PET_WORDS), t="A CARPET") is True


def test_hero_score_without_any_signal(spark):
    columns = ["technical_score", "overall_aesthetic_score", "aesthetic_score", "subject_prominence_score", "semantic_score",
               "largest_face_area_ratio"]
    ints = ["face_count", "prominent_face_count", "contains_people", "contains_animals", "is_landscape_like", "is_food_like",
            "is_document_like", "is_screenshot_like"]
    row = spark.range(1).select(F.lit("x").alias("sha1"), F.lit(None).cast("string").alias("summary_text"),
                                *[F.lit(None).cast("double").alias(c) for c in columns],
                                *[F.lit(None).cast("int").alias(c) for c in ints])
    got = ranking_scores.hero_scores(row).first()
    assert got["hero_score"] == 0 and got["note"] == "low_tech_penalty"
    for score, name, make in ((0.249, "hero_score", ranking_scores.hero_scores), (0.199, "cull_score", ranking_scores.cull_scores)):
        low, ok = (make(row.withColumn("technical_score", F.lit(s))).first() for s in (score, score + 0.001))
        assert "low_tech_penalty" in low["note"] and "low_tech_penalty" not in ok["note"] and ok[name] > low[name]


def test_expression_best_is_the_weighted_first(spark):
    faces = spark.createDataFrame([("p", 0, 0.9, 0.01, 0.7, 0.6), ("p", 1, 0.5, 0.06, 0.1, 0.1)],
                                  "sha1 string, face_index int, expression_score double, area_ratio double, "
                                  "smile_score double, eyes_open_score double")
    got = ranking_scores.expression_summary(faces).first()
    assert got["best_face_expression_score"] == 0.5
    assert got["people_moment_score"] == pytest.approx(0.5 + 0.9 * 0.7 * 0.2)


def test_sibling_places_merge(spark):
    rows = [("a", "C", "R", "T", "k1", "Big  Park"), ("b", "C", "R", "T", "k2", "big park"), ("c", "C", "R", "T", "k2", "big park"),
            ("d", "C", "R", "U", "k3", "Big Park")]
    df = spark.createDataFrame([(*r, 1.0, 2.0, 0.5, "d") for r in rows],
                               "sha1 string, country_label string, region_label string, city_label string, coord_key string, "
                               "place_label string, use_lat double, use_lon double, hero_score double, final_dt string")
    tree = {r["node_id"]: r for r in places.place_tree(df).collect()}
    assert tree["place::C::R::T::k2"]["photo_count"] == 3 and "place::C::R::T::k1" not in tree and tree["root"]["photo_count"] == 4
    for r in tree.values():
        kids = [c["photo_count"] for c in tree.values() if c["parent_id"] == r["node_id"]]
        assert not kids or sum(kids) == r["photo_count"]


def test_flatten_against_probing(many_slices):
    rng = random.Random(4)
    names = ["a.jpg", "a(1).jpg", "a(2).jpg", "a(4).jpg", "b.jpg", "a(1)(1).jpg"]
    files = [(rng.choice("xy"), "a.jpg" if rng.random() < 0.4 else rng.choice(names), f"{i:04d}") for i in range(150)]
    df = many_slices.createDataFrame(files, "dest_dir string, file_name string, path string")
    got = {r["path"]: r["target_name"] for r in ingest.flattened(df).collect()}
    assert got == brute.flattened(files)


def test_tree_scan(spark, tmp_path):
    for name in ("a/x.jpg", "a/_private/y.jpg", "z.png", "b/c/w.JPEG"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    files = ingest.scan_tree(spark, str(tmp_path)).withColumn("kind", ingest.file_kind(F.col("rel_path")))
    assert {r["rel_path"]: (r["kind"], r["file_size"]) for r in files.collect()} == {
        "a/x.jpg": ("photo", 4), "z.png": ("other_image", 4), "b/c/w.JPEG": ("photo", 4)}
    assert one(spark, ingest.file_kind(F.col("t")), t="a/_private/y.jpg") == "private"


def test_keyed_writes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "sha1 string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "sha1 string, v int")
    assert sorted(map(tuple, sidecars.upsert(old, new, "sha1").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, sidecars.insert_ignore(old, new, "sha1").collect())) == [("a", 1), ("b", 2), ("c", 4)]
    same = sidecars.upsert(sidecars.upsert(old, new, "sha1"), new, "sha1")
    assert same.count() == 3


def test_summary_export_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", " hi ", "m", "v", None, "")],
                                 "sha1 string, caption string, model_name string, model_version string, scored_at string, warnings string")
    sidecars.write_jsonl(sidecars.summary_export(rows), str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line == '{"sha1":"a","summary":"hi","model":"m","model_version":"v","timestamp":null,"warnings":""}'
    with pytest.raises(ValueError):
        sidecars.summary_export(rows.drop("caption"))


def test_missing_table_is_empty(spark, tmp_path):
    assert sidecars.optional_table(spark, str(tmp_path / "none"), "sha1 string, v int").columns == ["sha1", "v"]


def test_ingest_batch_can_run_twice(spark, tmp_path):
    """A retried batch overwrites its own partition and does not see itself."""
    rows = spark.createDataFrame([("c1", 0, "a.jpg", 1, 600, 400), ("c1", 1, "b.jpg", 2, 600, 400), ("c2", 0, "t.jpg", 3, 10, 10)],
                                 "content_sha1 string, source_rank int, rel_path string, file_id long, width int, height int")
    rows.write.parquet(str(tmp_path / "in"))
    for state in ("s1", "s2"):
        stream = incremental.file_stream(spark, str(tmp_path / "in"), rows.schema)
        incremental.ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / state)).awaitTermination()
    assert [r["file_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def stream_in(spark, tmp_path, batches):
    """Runs one batch after the other; the sessions as (key, size, first, last, best)."""
    base = str(tmp_path)
    for rows in batches:
        df = spark.createDataFrame(rows, "k string, ts long, hero_score double, final_dt string, sha1 string")
        df.write.mode("append").parquet(f"{base}/in")
        stream = incremental.file_stream(spark, f"{base}/in", df.schema)
        incremental.burst_stream(stream, ["k"], f"{base}/t", f"{base}/c").awaitTermination()
    got = incremental.current_sessions(spark.read.parquet(f"{base}/t"), ["k"]).collect()
    return {(r["k"], r["size"], r["first_taken"], r["last_taken"], r["best"]["sha1"]) for r in got}


@pytest.mark.parametrize("gap,count", [(15, 1), (16, 2)])
def test_stream_session_border(spark, tmp_path, gap, count):
    rows = [("k", 1000, 0.5, "", "a"), ("k", 1000 + gap, 0.6, "", "b")]
    assert len(stream_in(spark, tmp_path, [rows])) == count


def test_photos_in_reverse_order_one_to_a_batch(spark, tmp_path):
    """Late photos join, extend and bridge stored sessions; none is dropped."""
    times = [100, 110, 140, 125, 125, 300, 285, 5]
    rows = [("k", t, t / 1000, "", f"p{i}") for i, t in enumerate(times)] + [("z", 7, 0.1, "", "q")]
    got = stream_in(spark, tmp_path, [[r] for r in sorted(rows, key=lambda r: -r[1])])
    assert got == {("k", 1, 5, 5, "p7"), ("k", 5, 100, 140, "p2"), ("k", 2, 285, 300, "p5"), ("z", 1, 7, 7, "q")}


def test_sessions_merge_over_many_slices(many_slices):
    rng = random.Random(4)
    spans = []
    for i in range(400):
        first = rng.randrange(0, 30_000)
        spans.append((rng.choice("ab"), rng.randrange(1, 4), first, first + rng.choice([0, 3, 40]), (0.5, "", f"s{i}")))
    df = many_slices.createDataFrame(spans, "k string, size long, first_taken long, last_taken long, "
                                            "best struct<hero_score:double,final_dt:string,sha1:string>")
    got = {(r["k"], r["size"], r["first_taken"], r["last_taken"]) for r in incremental.merged_sessions(df, ["k"], 15).collect()}
    want = set()
    for key in "ab":
        open_one = None
        for k, size, first, last, _ in sorted((s for s in spans if s[0] == key), key=lambda s: s[2]):
            if open_one and first - open_one[3] <= 15:
                open_one = (k, open_one[1] + size, open_one[2], max(open_one[3], last))
            else:
                want |= {open_one} if open_one else set()
                open_one = (k, size, first, last)
        want.add(open_one)
    assert got == want


def test_distinct_events_drop_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), rows.schema)
    incremental.append_to(incremental.distinct_events(stream, "k", "t"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
