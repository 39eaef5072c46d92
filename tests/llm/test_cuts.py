"""Texts cut together: the ids and counts are the library's, and Python sees distinct pieces alone."""
from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from helpers import PROSE, ids_of

from silvergrain.llm import prefix_counts
from silvergrain.llm.word_bpe import grouped, word_bpe

SIGNS = ["The", "the", "THE,", "don't", "'tis", "\"'s", "!!", "a1²b", "éÀ", "<|endoftext|>", "<|", "日本", "İx", "\x0b", "\x00", "\xa0", " ", "\n", "\t", "…"]


def mixed(n):
    rnd = random.Random(5)
    return ["".join(rnd.choice(SIGNS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_texts_encoded_together_equal_the_library():
    texts = ["skipped", *mixed(500), "", PROSE[2] * 3]
    encoder = word_bpe("word_bpe_49k.json")
    encoder.pieces.forget()
    for some in (pa.array(texts)[1:], pa.array(texts[1:], pa.large_string()), pa.array([], pa.string())):
        ids, bounds = encoder.encode_all(some)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in some.to_pylist()]


def test_a_piece_is_looked_up_once_for_many_texts():
    """Whatever its case, the signs around it and its texts."""
    cut = word_bpe("word_bpe_49k.json").cut(pa.array([f"Fox, fox FOX. fox's \"Fox\" {i % 7}" for i in range(1000)]))
    assert len(cut.text_chunks) == 6000 and sorted(p for p in cut.pieces if p) == [*'"', "'s", *",.0123456", "fox"]


def test_counts_within_a_budget_equal_the_prefixes():
    counter = prefix_counts.prefix_counter("word_bpe_49k.json")
    texts = mixed(200)
    for budget in (0, 2, 5):
        totals, chars = counter.within_all(pa.array(texts), budget)
        assert totals.tolist() == [len(ids_of(t)) for t in texts]
        assert chars.tolist() == [int(np.flatnonzero(counter.prefixes(t) <= budget)[-1]) for t in texts]


def test_groups_are_bounded_and_whole():
    texts = ["x" * n for n in (3, 0, 50, 4, 4, 4, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = [b.column(1).to_pylist() for b in grouped([batch, batch.slice(0, 0)], 8)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 8 for p in parts)
