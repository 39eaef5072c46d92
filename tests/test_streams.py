"""Keyed state of streaming bursts, and the filter in front of the ingest's join."""
from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import bloom
from silvergrain.session import drop_folder
from silvergrain.streaming import incremental
from silvergrain.streaming.session_state import merged

PHOTO = "k string, ts long, hero_score double, final_dt string, sha1 string"
FILE = "content_sha1 string, source_rank int, rel_path string, file_id long, width int, height int"


def send(spark, base, rows):
    """One batch; the query's progress."""
    df = spark.createDataFrame(rows, PHOTO)
    df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    query = incremental.burst_stream(incremental.file_stream(spark, f"{base}/in", df.schema), ["k"], f"{base}/t", f"{base}/c")
    query.awaitTermination()
    return query.recentProgress


def sessions(spark, base):
    got = incremental.current_sessions(spark.read.parquet(f"{base}/t"), ["k"]).collect()
    return {(r["k"], r["size"], r["first_taken"], r["last_taken"], r["best"]["sha1"]) for r in got}


def test_sessions_merge_like_a_walk():
    rng = random.Random(2)
    for _ in range(50):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 30))]
        photos = [(1, t, t, rng.choice([None, 0.5, 0.7]), "", f"p{i}") for i, t in enumerate(times)]
        cut = rng.randrange(len(photos) + 1)
        groups = []
        for p in sorted(photos, key=lambda p: p[1]):
            if groups and p[1] - groups[-1][-1][1] <= 15:
                groups[-1].append(p)
            else:
                groups.append([p])
        best = lambda g: max(g, key=lambda p: (p[3] is not None, p[3] or 0, p[5]))[5]
        want = [(len(g), g[0][1], g[-1][1], best(g)) for g in groups]
        assert [(s[0], s[1], s[2], s[5]) for s in merged(merged(photos[:cut], 15) + photos[cut:], 15)] == want


def test_batches_read_state_and_not_what_was_written(spark, tmp_path):
    base = str(tmp_path)
    send(spark, base, [("k", 86_390, 0.9, "", "a"), ("k", 86_395, 0.1, "", "b"), ("z", 5, 0.2, "", "q")])
    drop_folder(f"{base}/t/batch=0")  # nobody reads it
    last = send(spark, base, [("k", 86_399, 0.2, "", "c"), ("k", 86_402, 0.3, "", "d"), ("k", 86_402, None, "", "e")])
    assert sum(p["numInputRows"] for p in last) == 3
    assert sessions(spark, base) == {("k", 5, 86_390, 86_402, "a")}
    stored = spark.read.parquet(f"{base}/t")
    assert {(r["day"], r["size"]) for r in stored.collect()} == {(0, 3), (1, 2)}


def test_a_batch_that_failed_runs_again_on_the_state_before_it(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    send(spark, base, [("k", 100, 0.5, "", "a")])
    start = incremental._per_batch

    def broken(stream, checkpoint, step, mode="append"):
        def twice(rows, batch):
            step(rows, batch)
            raise OSError("lost")
        return start(stream, checkpoint, twice, mode)

    monkeypatch.setattr(incremental, "_per_batch", broken)
    with pytest.raises(Exception, match="lost"):
        send(spark, base, [("k", 110, 0.6, "", "b")])
    monkeypatch.setattr(incremental, "_per_batch", start)
    send(spark, base, [("k", 120, 0.1, "", "c")])
    assert sessions(spark, base) == {("k", 3, 100, 120, "b")}


def test_a_filter_never_misses(spark):
    ids = spark.range(3000).select(F.concat(F.lit("id"), "id").alias("x"))
    known = bloom.united(bloom.filter_of(ids.where("length(x) % 2 = 0"), "x", 64).unionByName(
        bloom.filter_of(ids.where("length(x) % 2 = 1"), "x", 64)))
    assert known.count() <= 64
    assert bloom.with_seen(ids, "x", known, 64).where("NOT seen").count() == 0
    wide = bloom.filter_of(ids, "x", 4096)
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("x")).unionByName(spark.createDataFrame([(None,)], "x string"))
    assert bloom.with_seen(others, "x", wide, 4096).where("seen").count() < 100
    assert bloom.with_seen(others, "x", wide.limit(0), 4096).where("seen").count() == 0


def ingest(spark, base, rows, blocks=1 << 10):
    df = spark.createDataFrame(rows, FILE)
    df.write.mode("append").parquet(f"{base}/in")
    stream = incremental.file_stream(spark, f"{base}/in", df.schema)
    incremental.ingest_stream(stream, f"{base}/t", f"{base}/c", blocks).awaitTermination()


def files(ids, start):
    return [(f"c{c}", 0, f"p/{start + i}.jpg", start + i, 600, 400) for i, c in enumerate(ids)]


@pytest.mark.parametrize("blocks", [1, 1 << 10], ids=["nearly all seem known", "few seem known"])
def test_repeats_over_batches(spark, tmp_path, blocks):
    base = str(tmp_path)
    batches = [files(range(0, 300), 0), files(range(200, 500), 1000), files([*range(0, 40), *range(480, 520), 519], 2000)]
    for rows in batches:
        ingest(spark, base, rows, blocks)
    got = {r["content_sha1"]: r["file_id"] for r in spark.read.parquet(f"{base}/t").collect()}
    want = {}
    for rows in batches:
        for c, _, _, file_id, _, _ in rows:
            want.setdefault(c, file_id)
    assert got == want
    assert [d for d in os.listdir(f"{base}/t/_known-{blocks}") if d.startswith("batch=")].__len__() == 2


def test_only_possible_repeats_meet_the_join(spark, tmp_path, monkeypatch):
    base, asked = str(tmp_path), []
    real = incremental.repeats

    def watched(possible, earlier):
        asked.append(possible.count())
        return real(possible, earlier)

    monkeypatch.setattr(incremental, "repeats", watched)
    ingest(spark, base, files(range(200), 0), 1 << 14)
    ingest(spark, base, files(range(200, 400), 1000), 1 << 14)
    assert asked == []
    drop_folder(f"{base}/t/_known-{1 << 14}/batch=1")  # a lost filter is made anew
    ingest(spark, base, files([3, 4, 5, *range(400, 500)], 2000), 1 << 14)
    assert asked == [3] and spark.read.parquet(f"{base}/t").count() == 500
