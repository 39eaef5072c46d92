"""Mixing and sharding against plain versions."""
from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, empty, words_of

import __spark_entry__ as entry
from silvergrain.llm import mixing, sharding
from silvergrain.llm.prefix_sums import running_sums


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Shares by weight; what exceeds a source's limit goes round again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    return target


def check_mix(rows, source_of, size_of):
    sizes, taken = defaultdict(int), Counter()
    for r in rows:
        sizes[source_of[r["doc_id"]]] += r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
        assert r["size"] == size_of[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    target = plain_targets(sizes)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and np.isclose(r["target"], target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(r["size"] for r in rows if source_of[r["doc_id"]] == s)


def test_mix_query(spark, many_slices, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    rows = entry.queries()["op4_systematic_mix"](spark, data_dir).collect()
    assert len(rows) == len(docs)
    check_mix(rows, {r["doc_id"]: r["source"] for r in docs}, {r["doc_id"]: len(words_of(r["text"])) for r in docs})
    again = entry.queries()["op4_systematic_mix"](spark, data_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_is_the_same_for_any_partitions(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    a = sorted(map(tuple, mixing.mix(docs).collect()))
    assert a == sorted(map(tuple, mixing.mix(docs.repartition(5, "n_chars")).collect()))


def test_mix_of_a_hot_source_and_missing_values(spark, many_slices):
    rows = [(i, "w " * (i % 13), None, "hot" if i % 3 else (None, "a", "é", "z")[i % 4]) for i in range(600)] + [(1000, None, None, "nothing")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == 601
    check_mix(got, {i: s for i, _, _, s in rows}, {i: len(words_of(t)) for i, t, _, _ in rows})
    hot = [r for r in got if r["doc_id"] != 1000 and rows[r["doc_id"]][3] == "hot"]
    want = hot[0]["target"]
    assert abs(sum(r["taken"] for r in hot) - want) <= 24


def test_mixed_documents_repeat_rows(spark):
    docs = awkward(spark)
    decided = Counter()
    for r in mixing.mix(docs).collect():
        decided[r["doc_id"]] += r["copies"]
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({k: n for k, n in decided.items() if n})
    assert mixing.mix(empty(spark)).collect() == [] and mixing.mixed_documents(empty(spark)).collect() == []


def test_words_of_blanks(spark):
    texts = ["", " ", "a", " a b \n c\x0b\x0c\r", "a" * 10_000 + " b", None, "\x1c \x1d"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F
    got = {r["i"]: r["n"] for r in frame.select("i", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert [got[i] or 0 for i in range(len(texts))] == [len(words_of(t)) for t in texts]


def test_running_sums(spark, many_slices):
    rows = [(k % 3, n, n * n) for k, n in enumerate(range(500))]
    frame = spark.createDataFrame(rows, "g long, n long, v long")
    sums, want = Counter(), {}
    for g, n, v in rows:
        want[n] = sums[g]
        sums[g] += v
    assert {r["n"]: r["before"] for r in running_sums(frame, ["g"], ["n"], {"before": "v"}).collect()} == want


def plain_shards(rows, limit):
    bits = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    out = {}

    def split(own, depth, prefix):
        if sum(n for _, n in own) <= limit or depth == 60:
            out.update({i: "s" + prefix for i, _ in own})
            return
        for bit in "01":
            split([x for x in own if (bits[x[0]] >> (59 - depth) & 1) == int(bit)], depth + 1, prefix + bit)

    split(rows, 0, "")
    return out


@pytest.mark.parametrize("limit", [1, 40, 333, 5_000, 10**9])
def test_shards_equal_recursive_splits(spark, limit):
    rows = [(i, (i * 37) % 29) for i in range(300)]
    docs = documents(spark, [(i, "x" * n, None, None) for i, n in rows])
    got = {r["doc_id"]: r for r in sharding.shard(docs, limit).collect()}
    want = plain_shards([(i, n) for i, n in rows], limit)
    for i, n in rows:
        if n <= limit and not got[i]["page"]:
            assert got[i]["shard"] == want[i]
        assert got[i]["n_bytes"] == n and (got[i]["shard_bytes"] <= limit or n > limit)
    sums = Counter()
    for r in got.values():
        sums[r["shard"]] += r["n_bytes"]
    assert all(sums[r["shard"]] == r["shard_bytes"] for r in got.values())


def test_repeated_ids_overflow_into_pages(spark, many_slices):
    docs = documents(spark, [(7, "x" * 10, None, None)] * 50 + [(7, "y" * 60, None, None)] * 3 + [(8, "z" * 500, None, None), (None, None, None, None)])
    rows = sharding.shard(docs, 100).collect()
    assert len(rows) == 55
    assert all(r["shard_bytes"] <= 100 for r in rows if r["doc_id"] != 8)
    assert [r["oversized"] for r in rows if r["doc_id"] == 8] == [True]
    assert sharding.shard(empty(spark)).collect() == [] and len(sharding.shard(awkward(spark)).collect()) == 13
