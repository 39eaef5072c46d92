"""Repeated byte strings against a plain count of all strings, and the sorting against sorted()."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from helpers import awkward, documents, empty

import __spark_entry__ as entry
from silvergrain.llm import shared_passages
from silvergrain.llm.shared_passages import Settings, digests, repeated_offsets, sorted_suffixes, without_repeats

#: Short strings, so that small texts have many borders; the second one deals every group anew.
SMALL = Settings(length=40, reach=20, widths=(20, 5, 1))
NARROW = Settings(length=40, reach=20, widths=(20, 5, 1), limit=1)


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(spark, texts, settings):
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    rows = sorted(tuple(r) for r in digests(without_repeats(docs, settings)).collect())
    assert [r[0] for r in rows] == list(range(len(texts)))
    return [r[1:] for r in rows]


def mosaics(seed, n):
    """Texts of shared passages cut at random, random letters, periods and accents."""
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(30, 130))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            at = rnd.randrange(len(p))
            kind = rnd.random()
            parts.append(p if kind < 0.3 else p[at:] if kind < 0.5 else p[:at] + "#" + p[at + 1:] if kind < 0.7
                         else "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) if kind < 0.9 else "xyz" * rnd.randint(5, 40))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("settings", [SMALL, NARROW], ids=["sorted", "dealt anew"])
def test_equals_a_count_of_all_strings(spark, settings):
    texts = mosaics(5, 150) + ["", None, "a" * 39, "b" * 40, "c" * 41, "d" * 500, "ab" * 100, "word " * 60]
    texts += [texts[3]] * 3
    want = plain(texts, 40)
    assert 20 < sum(w[1] > 0 for w in want) < len(texts) - 10 and any(w[2] > 1 for w in want)
    assert removed(spark, texts, settings) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    texts = ["".join(mosaics(8, 60)), "".join(mosaics(9, 60)) + "".join(mosaics(8, 60))[100:900]]
    found = []
    for size in (64, 1 << 18):
        monkeypatch.setattr(shared_passages, "HASHED", size)
        stretches = []
        for t in texts:
            data = shared_passages.np.frombuffer(t.encode(), "u1")
            for a, first, last in shared_passages.anchors(data, SMALL):
                assert (first <= a).all() and (a <= first + 19).all() and (a < last + 20).all()
                stretches += [(x, s) for x, f, e in zip(a.tolist(), first.tolist(), last.tolist()) for s in range(f, e + 1)]
        found.append(stretches)
    assert found[0] == found[1]
    assert removed(spark, texts, SMALL) == plain(texts, 40)


def test_suffixes_are_sorted_deep_and_shallow():
    rnd = random.Random(1)
    for n in (1, 2, 30, 300):
        stem = [bytes(rnd.choice(b"ab") for _ in range(90)) for _ in range(3)]
        rows = [rnd.choice(stem)[:rnd.randint(66, 90)] + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 9))) for _ in range(n)]
        order, common = [], {}
        for part, intervals in sorted_suffixes(rows):
            for start, end, depth, above in intervals:
                assert above <= depth
                common |= {(len(order) + i): max(depth, common.get(len(order) + i, 0)) for i in range(start, end)}
            order += part
        assert sorted(order) == list(range(n)) and [rows[i] for i in order] == sorted(rows)
        for at, i in enumerate(order):
            near = max((shared_passages.common_prefix(rows[i], rows[j]) for j in order[max(0, at - 1):at] + order[at + 1:at + 2]), default=0)
            assert common.get(at, 0) == near or near < shared_passages.SHALLOW


def test_offsets_equal_all_pairs():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"ab") for _ in range(60))
    contexts, low, high = [], [], []
    for _ in range(60):
        text = bytearray(base)
        for _ in range(rnd.randint(0, 2)):
            text[rnd.choice([*range(19), *range(41, 60)])] = 99
        lo, hi = 0, rnd.randint(0, 19)
        contexts.append(bytes(text[20 - hi - 1 + 1:60 - lo]))
        low.append(lo)
        high.append(hi)
    got = {(i, o) for i, first, last in repeated_offsets(contexts, low, high, 40) for o in range(first, last + 1)}
    strings = {(i, o): c[h - o:h - o + 40] for i, (c, h) in enumerate(zip(contexts, high)) for o in range(h + 1)}
    many = Counter((o, s) for (i, o), s in strings.items())
    assert got == {(i, o) for (i, o), s in strings.items() if many[o, s] > 1}


def test_awkward_and_empty(spark):
    rows = awkward(spark).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), w) for r, w in zip(rows, plain([r["text"] for r in rows], 400)))
    got = digests(without_repeats(awkward(spark))).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tuple(r)[1:]) for r in got) == want
    assert digests(without_repeats(empty(spark))).collect() == []
    assert without_repeats(awkward(spark)).columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"]


def test_query_equals_a_count_of_all_strings(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, plain([r["text"] for r in docs], 400))}
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op12_deep_shallow_passages"](spark, data_dir)
           .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == want
