"""Repetition rules from suffix arrays over the words of each document.

Documents of a batch are sorted in one suffix array: prefix doubling over word
numbers, where a document's number is part of every key, so that no repeat spans
two documents. Neighbouring suffixes with a common prefix bound the intervals of
longest common prefixes; for every position the longer common prefix with its two
neighbours is the longest repeated run of words that starts there, and the
maximal ones among these runs cover what all repeated runs cover. Their spans are
united, and a document passes while the covered fraction and the longest
repeat stay within limits. Both limits are apart from the base rule's: only runs
longer than its windows count for the fraction, which is lower, and the longest
repeat has a bound that doesn't grow with the text.

Missing, empty and wordless texts have no words, fail the base rule and are not
kept. Repeated rows are judged row by row. An empty table gives an empty result.
Further columns are left out.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, record

#: Words that go into one suffix array at once; a longer document has one of its own.
BATCH_WORDS = 400_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Limits:
    """A base rule by five-word windows, then the rule by maximal repeats.

    Repeats count from ``min_repeat`` words on. They may cover ``max_covered_percent`` of
    a document's words, and the longest may have ``max_longest_percent`` of them, or
    ``free_covered`` and ``free_longest`` words if that is more: quoting a sentence twice is no fault.
    The longest may never have more than ``most_longest`` words, however long the text.
    """
    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    min_repeat: int = 10
    max_covered_percent: int = 15
    free_covered: int = 50
    max_longest_percent: int = 5
    free_longest: int = 25
    most_longest: int = 200


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the longest run of words from there that recurs in its document.

    ``words`` numbers the words, ``doc`` the documents (ascending). Ranks are
    first positions of equal prefixes, so a rank of its own is final; each round
    doubles the prefix and sorts only positions that still share a rank.
    """
    n = len(words)
    levels: list[np.ndarray] = []
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    keys = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_keys = keys[order]
    starts = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    levels.append(rank.astype(np.int32))
    shared = ~(starts & np.concatenate([starts[1:], [True]]))
    active = order[shared]  # positions in suffix order that share their rank
    place = np.flatnonzero(shared)
    suffix = order.copy()
    step = 1
    while len(active):
        after = active + step
        inside = after < n
        second = np.zeros(len(active), np.int64)
        same = np.zeros(len(active), bool)
        same[inside] = doc[after[inside]] == doc[active[inside]]
        second[same] = rank[after[same]] + 1
        first = rank[active]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        active, first, second = active[by], first[by], second[by]
        suffix[place] = active
        old = np.concatenate([[True], first[1:] != first[:-1]])
        new = old | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        renewed = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        rank[active] = renewed
        levels.append(rank.astype(np.int32))
        shared = ~(new & np.concatenate([new[1:], [True]]))
        active, place = active[shared], place[shared]
        step *= 2
    # common prefix of suffix neighbours: the largest equal powers of two, one after the other
    left, right = suffix[:-1], suffix[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[near].copy(), right[near].copy()
    common = np.zeros(len(near), np.int64)
    alive = np.ones(len(near), bool)
    for level in range(len(levels) - 1, -1, -1):
        alive[:] = (a < n) & (b < n)
        pick = np.flatnonzero(alive)
        equal = pick[(levels[level][a[pick]] == levels[level][b[pick]])]
        common[equal] += 1 << level
        a[equal] += 1 << level
        b[equal] += 1 << level
    np.maximum.at(out, left[near], common)
    np.maximum.at(out, right[near], common)
    return out


def covered(lengths: np.ndarray, spans: np.ndarray, least: int) -> np.ndarray:
    """Whether a position lies in a run that starts at a repeat of ``least`` words or more; ``spans`` are run lengths."""
    n = len(lengths)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + spans[at], n), -1)
    return np.cumsum(edge[:n]) > 0


def _measure(texts: list[str | None], limits: Limits) -> dict[str, np.ndarray]:
    vocabulary: dict[bytes, int] = {}
    numbers, counts = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # splits at ASCII white space
        numbers.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        counts.append(len(words))
    n_words = np.array(counts, np.int64)
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    lengths = repeat_lengths(words, doc)
    window = covered(lengths, np.full(len(lengths), limits.window, np.int64), limits.window)
    spans = covered(lengths, lengths, limits.min_repeat)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths)
    return {"n_words": n_words, "n_repeat_words": np.bincount(doc, window, len(texts)).astype(np.int64),
            "covered_words": np.bincount(doc, spans, len(texts)).astype(np.int64), "longest_repeat": longest}


def _lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat``.

    A scan with no shuffle; whole texts are judged where they are read.
    """
    def judge(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            at, size = 0, 0
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)) // 5
            for end in range(len(column)):
                size += int(sizes[end])
                if size < BATCH_WORDS and end + 1 < len(column):
                    continue
                texts = column.slice(at, end + 1 - at).to_pylist()
                m = _measure(texts, limits)
                texts = [t or "" for t in texts]
                n = m["n_words"]
                base = (n < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_window_percent * n)
                allowed = np.minimum(limits.most_longest, np.maximum(limits.free_longest, limits.max_longest_percent * n // 100))
                passed = (m["longest_repeat"] <= allowed) & (
                    m["covered_words"] <= np.maximum(limits.free_covered, limits.max_covered_percent * n // 100))
                yield record(
                    doc_id=ids.slice(at, end + 1 - at), n_words=n,
                    word_chars=([len(t) - sum(map(t.count, BLANKS)) for t in texts], pa.int64()),
                    n_symbols=([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
                    n_dup_lines=([_lines(t) for t in texts], pa.int64()),
                    n_repeat_words=m["n_repeat_words"], base_failed=base, kept=~base & passed,
                    covered_words=m["covered_words"], longest_repeat=m["longest_repeat"])
                at, size = end + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_batch(rows, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long")
