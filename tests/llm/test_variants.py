"""Spelling variants against all pairs of words."""
from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from helpers import awkward, documents, empty

import __spark_entry__ as entry
from silvergrain.llm import spelling_variants
from silvergrain.llm.spelling_variants import Settings, occurrences, variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def plain_variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


def result(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def sample_rows():
    rnd = random.Random(3)
    stems = ["station", "language", "mountain", "Éclairage", "wonderful", "repeated", "aaaaaaa", "aaaaaaaa", "÷×abcdefg"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rnd.choice(stems[:3] if rnd.random() < 0.8 else stems)
            if rnd.random() < 0.2:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + rnd.choice("éyzA") + w[at + 1:]])
            words.append(w)
        rows.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


def test_variants_equal_all_pairs(spark):
    rows = sample_rows()
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    want = plain_variants(plain_words(rows))
    assert len(want) > 50 and any(r[1] for r in want)
    assert result(variants(occurrences(docs))) == want


def test_filters_that_let_nearly_all_through_and_several_passes(spark):
    rows = sample_rows()
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    want = plain_variants(plain_words(rows))
    assert result(variants(occurrences(docs), Settings(bits=1, filter_bytes=16))) == want


def test_filters_keep_every_word_and_rule_out_most_others(spark):
    known = spelling_variants.vocabulary(occurrences(documents(spark, [(i, t, None, None) for i, t in sample_rows()])), Settings())
    filters = spelling_variants._filters(known, Settings())
    spelling_variants._fill(filters, known, 0)
    for length, rows, letters in spelling_variants.by_length([r["word"] for r in known.collect()]):
        h = spelling_variants.hashes(letters)
        assert len(filters.positives(rows, h, length)[0]) == len(rows)
        assert len(filters.positives(rows, h ^ spelling_variants.np.uint64(0x1234567890ABCDEF), length)[0]) <= 0.2 * len(rows) + 1


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdefgh": 2000, "abcdefg": 200, "bcdefgx": 20}
    counts |= {"abcdefgx": 20, "abcdefgxy": 2}
    assert any(r[2] != r[1] and r[1] for r in plain_variants(counts))
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    assert result(variants(words)) == plain_variants(counts)


def test_awkward_long_and_empty(spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    assert result(variants(occurrences(awkward(spark)))) == plain_variants(plain_words(rows))
    assert result(variants(occurrences(empty(spark)))) == set()
    long = "ab" * 1500
    rows = [(i, t) for i, t in enumerate([long, long, long[1:], long[1:], long[:700] + "é" + long[701:], long[:700] + "é" + long[701:]])]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert result(variants(occurrences(docs))) == plain_variants(plain_words(rows))


def test_query_on_the_small_table(spark, data_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    words = plain_words(rows)
    near = Counter()
    by_rest = {}
    for w in words:
        for i in range(len(w)):
            by_rest.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    for w in words:
        others = {o for i in range(len(w)) for o in by_rest[(i, w[:i] + w[i + 1:])] if o != w}
        shorter = {w[:i] + w[i + 1:] for i in range(len(w))} & words.keys()
        near[w] += len(others) + len(shorter)
        for s in shorter:
            near[s] += 1
    got = entry.queries()["op13_bloom_spelling_variants"](spark, data_dir).collect()
    assert {r["word"]: (r["n"], r["n_near"]) for r in got} == {w: (n, near[w]) for w, n in words.items()}
