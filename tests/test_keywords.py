"""Keyword automaton against the column test."""
from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.operators import keywords

LISTS = {"hero": text.HERO_PET_WORDS, "cull": text.CULL_PET_WORDS, "landmark": text.LANDMARK_WORDS}


def test_lists_agree_with_the_column_test(spark):
    rnd = random.Random(5)
    parts = [*text.HERO_PET_WORDS, *text.LANDMARK_WORDS, "car", "in", "ing", "Dog", "GOLDEN", " retriever", "\u00dcber", "\U0001f436"]
    rows = [(i, " ".join(rnd.choices(parts, k=rnd.randint(0, 4))), rnd.choice([None, "", "Castle", "pup"])) for i in range(400)]
    rows += [(400, None, None), (401, "carpet", None), (402, "pup", "py"), (403, "x" * 300_000 + "Temple", None)]
    frame = spark.createDataFrame(rows, "id long, a string, b string").withColumn("words", F.lit(1))
    hits = keywords.with_hits(frame, ["a", "b"], LISTS)
    assert hits.columns == ["id", "a", "b", "words", "lists"]
    for name, words in LISTS.items():
        tested = text.contains_any(F.col("a"), words) | text.contains_any(F.col("b"), words)
        assert hits.where(F.array_contains("lists", name) != tested).count() == 0
    found = {r["id"]: r["words"] for r in hits.where("id >= 400").collect()}
    assert found == {400: [], 401: ["pet"], 402: [], 403: ["temple"]}


def test_no_rows_no_words_and_wrong_words(spark):
    frame = spark.createDataFrame([], "id long, a string")
    assert keywords.with_hits(frame, ["a"], LISTS).collect() == []
    one = spark.createDataFrame([(1, "dog")], "id long, a string")
    assert [tuple(r) for r in keywords.with_hits(one, ["a"], {}).collect()] == [(1, "dog", [], [])]
    assert {tuple(r) for r in keywords.word_usage(one, ["a"], {"x": ["dog", "cat"], "y": ["dog"]}, "id").collect()} == {
        ("x", "dog", 1, 1), ("x", "cat", 0, None), ("y", "dog", 1, 1)}
    for word in ("", "Dog", "a\0b"):
        with pytest.raises(ValueError):
            keywords.with_hits(one, ["a"], {"x": [word]})


def test_hundreds_of_words_cost_no_more_than_a_few(spark):
    frame = spark.range(40_000).select("id", F.concat_ws(" ", F.lit("a long caption of no known word"), F.col("id"),
                                                         F.repeat(F.lit("zzzz "), 60)).alias("a"))

    def seconds(n):
        lists = {"x": [f"word{i}q" for i in range(n)]}
        keywords.with_hits(frame, ["a"], lists).agg(F.sum(F.size("words"))).collect()
        began = time.time()
        keywords.with_hits(frame, ["a"], lists).agg(F.sum(F.size("words"))).collect()
        return time.time() - began

    assert seconds(2000) < 2.5 * seconds(10) + 1
