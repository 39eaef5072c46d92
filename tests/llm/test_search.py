"""Nearest neighbours and near-duplicates against brute force."""
from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
from helpers import awkward, documents, empty
from pyspark.sql import functions as F

import __spark_entry__ as entry
from silvergrain.llm import adaptive_scan, near_duplicates
from silvergrain.llm.components import components


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            scores = sorted(((-float((v * w).sum()), j) for j, w in zip(ids, x) if j != i))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def results(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, 20)
    got = results(entry.queries()["op7_adaptive_dimension_scan"](spark, folder))
    assert set(got) == set(want)
    place = dict(zip(ids, x))
    for q, hits in got.items():
        assert len(hits) == 20 and q not in dict(hits)
        assert np.allclose([s for _, s in hits], [place[q] @ place[v] for v, _ in hits], rtol=0, atol=1e-12)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(hits, hits[1:]))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_clustered_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24)) * 3
    x = np.repeat(centers, 100, 0) + rng.normal(size=(1200, 24))
    x *= rng.uniform(0.5, 2, size=(1200, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = results(adaptive_scan.nearest(frame, F.col("vec_id") % 20 == 0)), brute(range(1200), x, 20)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_small_chunks_give_the_same_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    whole = results(adaptive_scan.nearest(rows, F.col("vec_id") % 20 == 0))
    parts = results(adaptive_scan.nearest(rows, F.col("vec_id") % 20 == 0, adaptive_scan.Settings(candidates=7, queries=2)))
    assert whole == parts


def test_copies_ties_and_unusable_vectors(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.5]
    rows = [(i, one) for i in range(100)] + [(i, other) for i in range(100, 130)] + [(40, one)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 0.0]), (260, [float("nan"), 1.0, 1.0]),
             (280, [float("inf"), 1.0, 1.0]), (300, [1.0]), (None, one), (320, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, q int, list int")
    got = results(adaptive_scan.nearest(frame, F.col("vec_id") % 20 == 0))
    ids = [*range(130)]
    assert got == brute(ids, np.array([one if i < 100 else other for i in ids]), 20)


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert results(adaptive_scan.nearest(frame, F.col("vec_id") % 20 == 0)) == {0: [(1, 4.0), (2, 1.5)]}
    single = frame.where("vec_id = 0")
    assert adaptive_scan.nearest(single, F.col("vec_id") % 20 == 0).collect() == []
    nothing = adaptive_scan.nearest(frame.where("false"), F.col("vec_id") % 20 == 0)
    assert nothing.collect() == [] and nothing.columns == ["query_id", "rank", "vec_id", "score"]


def test_column_blocks_keep_what_lies_within_the_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 40))
    index = adaptive_scan.Index(x[:500], [[i] for i in range(500)], float(np.sqrt((x * x).sum(1)).max()), 3000, adaptive_scan.Settings())
    q = rng.normal(size=(30, 40))
    bound = np.sort(q @ x.T, 1)[:, -20]
    at_q, at_c = index.scan(x, q, bound)
    want = {(a, b) for a, b in zip(*np.nonzero(q @ x.T >= bound[:, None]))}
    assert len(want & set(zip(at_q, at_c))) >= 0.97 * len(want)
    assert len(at_q) <= len(want) * 1.05


def test_an_outlier_leaves_the_scan_bounded():
    """One vector 1,000 times as long as the rest keeps all pairs within the bound; they are never held at once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x[7] *= 1000
    q = rng.normal(size=(1000, 64))
    index = adaptive_scan.Index(x[:500], [[i] for i in range(500)], float(np.sqrt((x * x).sum(1)).max()), 2000, adaptive_scan.Settings())
    bound, _, _ = index.first_results(q)
    tracemalloc.start()
    at_q, at_c, scores = index.best(x, q, bound)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # the 2,000,000 pairs take 1 GB for one side's vectors alone
    k = index.settings.neighbours + 1
    want = np.argsort(-(q @ x.T), axis=1)[:, :k]
    assert [at_c[at_q == i].tolist() for i in range(len(q))] == want.tolist()
    assert np.allclose(scores, (x[at_c] * q[at_q]).sum(1))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_components(texts):
    """All pairs, then the smallest id that can be reached."""
    sets, label = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in texts}


def test_near_duplicate_query(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = entry.queries()["op10_tensored_minhash"](spark, data_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == plain_components(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_edited_copies(spark, many_slices, seed):
    rnd = random.Random(seed)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(3, 160))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            texts[n] = " ".join(words)
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(30):
        texts[n] = passage + " " + " ".join(f"u{rnd.randrange(10**7)}" for _ in range(rnd.randint(10, 60)))
        n += 1
    chain = [f"c{i}" for i in range(200)]
    for k in range(8):  # each links with the next, the ends do not
        texts[n] = " ".join(chain[k * 12:k * 12 + 100])
        n += 1
    ids = list(texts)
    rnd.shuffle(ids)
    texts = {i: texts[k] for i, k in enumerate(ids)}
    docs = documents(spark, [(i, t, None, None) for i, t in texts.items()])
    assert {r["doc_id"]: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs).collect()} == plain_components(texts)


def test_texts_of_one_template_are_not_paired(spark):
    template = [f"t{i}" for i in range(80)]
    rnd = random.Random(3)
    texts = {i: " ".join(template + [f"u{i}_{k}" for k in range(rnd.randint(18, 24))]) for i in range(300)}
    docs = documents(spark, [(i, t, None, None) for i, t in texts.items()])
    assert {r["doc_id"]: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs).collect()} == plain_components(texts)
    late = [(s, i, i, n, n - 75 + s) for i in range(4000) for n in (95 + i % 6,) for s in range(4)]
    first = spark.createDataFrame(late, "shingle long, node long, label long, n int, rank long")
    assert near_duplicates._prospects(first).count() == 0


def test_prospects_keep_every_possible_pair(spark):
    rnd = random.Random(8)
    rows = []
    for node in range(160):
        n = rnd.randint(8, 40)
        for shingle in rnd.sample(range(12), 4):
            rows.append((shingle, node, node % 90, n, rnd.randint(1, n - -(-75 * n // 100) + 1)))

    def pairs(rows):
        return {(a[0], a[1], b[1]) for a in rows for b in rows
                if a[0] == b[0] and a[2] != b[2] and 100 * min(a[3], b[3]) >= 75 * max(a[3], b[3])
                and 175 * (1 + min(a[3] - a[4], b[3] - b[4])) >= 75 * (a[3] + b[3])}

    first = spark.createDataFrame(rows, "shingle long, node long, label long, n int, rank long")
    kept = {(r["shingle"], r["node"]) for r in near_duplicates._prospects(first).collect()}
    assert pairs(rows) and pairs(rows) == pairs([r for r in rows if r[:2] in kept])
    assert len(kept) < len(rows)


def test_near_duplicates_of_awkward_rows(spark):
    rows = near_duplicates.near_duplicates(awkward(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == 0
    assert all(r["component_id"] == r["doc_id"] for r in rows)
    kept = near_duplicates.deduplicated(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == 11
    assert near_duplicates.near_duplicates(empty(spark)).collect() == []
    assert near_duplicates.deduplicated(empty(spark)).collect() == []


def test_two_texts_of_one_doc_id_are_two_documents(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(5, a, None, None), (5, b, None, None), (7, a + " more", None, None), (8, b + " more", None, None),
            (3, b + " other", None, None), (5, a, None, None), (5, None, None, None), (9, "alone", None, None)]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == [(3, 57, 3, True), (5, 0, 5, True), (5, 56, 3, False), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False),
                   (8, 57, 3, False), (9, 1, 9, True)]
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(3, b + " other"), (5, ""), (5, a), (9, "alone")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    rnd = random.Random(0)
    rnd.shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
