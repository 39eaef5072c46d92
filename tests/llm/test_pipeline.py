"""The pipeline stage by stage, and its place in the entry."""
from __future__ import annotations

from collections import Counter

import corpus_pipeline
from helpers import awkward, empty, ids_of

import __spark_entry__ as entry
from silvergrain.session import cut_lineage


def staged(spark, docs, folder):
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(cut_lineage(stage(spark, found[-1], folder)))
    return found


def test_stages_keep_columns_and_whole_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    found = staged(spark, docs, data_dir)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for kept in found[1:-1]:
        assert kept.columns == docs.columns
        assert all(text[r["doc_id"]] == r["text"] for r in kept.collect())
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in found[:-1]]
    for before, after in zip(ids[:3], ids[1:4]):
        assert not after - before
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    lengths = Counter()
    for r in found[-1].collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: n * (len(ids_of(text[i])) + 1) for i, n in ids[4].items()}
    whole = sorted(map(tuple, entry.queries()["pipeline"](spark, data_dir).collect()))
    assert whole == sorted(map(tuple, found[-1].collect()))


def test_clean_labelled_documents_pass_the_filters(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.judge_quality):
        docs = cut_lineage(stage(spark, docs, folder))
    share = lambda q: docs.join(labels.where(f"quality = {q}"), "doc_id").count() / labels.where(f"quality = {q}").count()
    assert share(1) > 0.95 and share(0) < 0.2


def test_awkward_and_empty_documents(spark, data_dir):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data_dir)
            assert name == "pack" or out.columns == docs.columns
            out.collect()


def test_entry_lists_every_operator_and_the_pipeline():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "pack"]
