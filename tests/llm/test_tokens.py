"""Token files, packing and prefix counts against the tokenizer library itself."""
from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import TOKENIZER, awkward, empty, ids_of

import __spark_entry__ as entry
from silvergrain.llm import packing, prefix_counts, token_files
from silvergrain.llm.word_bpe import word_bpe
from silvergrain.session import shared_folder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


ODD = ["don't we'll 're'd 'l 'll x'r", "<|endoftext|>a<|startoftext|>", "<|endofte", "́a é ΑΣ İx ǅ", "日本語 漢字 " * 3,
       "a\x0bb\x1cc\x85d\xa0e f", "!!!???!!--''s", "12345 x12y3", "👍🏽👍", "", " ", "\n\t ", "a" * 300, "!" * 500, "\x00\x01 \x7f\x80"]


def test_encoder_and_prefixes_equal_the_library():
    rnd = random.Random(3)
    alphabet = "aeinrst'sdlm. !?-0123éßΣİ日́ \n<|>"
    cases = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    encoder, counter = word_bpe("word_bpe_49k.json"), prefix_counts.prefix_counter("word_bpe_49k.json")
    for text in cases:
        ids = ids_of(text)
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids
        assert counter.count(text) == len(ids)
    for text in cases[:120]:
        want = [len(ids_of(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want
        for budget in (0, 1, 3, 10_000):
            total, chars = counter.within(text, budget)
            assert total == len(ids_of(text)) and chars == max(i for i, c in enumerate(want) if c <= budget)


def test_prefixes_of_composed_and_special_text_equal_the_library():
    """Runs without blanks that the library composes, drops or cuts at special strings."""
    rnd = random.Random(1)
    parts = ["a", "'s", "'re", "'", "<|endoftext|>", "<|startoftext|>", "<|", "<", "!", "!!", "日", "本", "語", "é", "e\u0301", "A\u0315\u0300",
             "\u1112\u1161\u11ab", "한", "1", "²", "İ", "ß", "\x00", "\xad", "ﬁ", "🙂", "\u200d", "ก", "ำ", "\x0b", "\xa0", "\u3000"]
    counter = prefix_counts.prefix_counter("word_bpe_49k.json")
    for _ in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        assert counter.prefixes(text).tolist() == [len(ids_of(text[:i])) for i in range(len(text) + 1)]


def test_long_runs_without_blanks_are_counted_in_one_pass():
    rnd = random.Random(2)
    counter = prefix_counts.prefix_counter("word_bpe_49k.json")
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(30_000))
    special = "<|endoftext|>" * 20_000
    for text in (han, special, "x" + special + han[:50], "한" * 20_000):
        counts = counter.prefixes(text)
        for at in (1, len(text) // 3, len(text) - 5, len(text)):
            assert counts[at] == len(ids_of(text[:at]))
        total, chars = counter.within(text, 2048)
        assert total == counts[-1] and counts[chars] <= 2048 and (counts[chars + 1:] > 2048).all()


def test_memo_forgets_without_changing_results():
    from silvergrain.llm.word_bpe import Memo
    memo = Memo(lambda k: k * 2, 3)
    for n in range(5):
        assert [memo[k] for k in "abcdefga"] == [k * 2 for k in "abcdefga"]
        assert len(memo) <= 3 and len(memo.old) <= 3


def test_token_file_query(spark, data_dir, texts):
    rows = {r["doc_id"]: r for r in entry.queries()["op1_token_files"](spark, data_dir).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*ids_of(texts[doc_id]), 2]
        assert tuple(rows[doc_id]) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(texts)


def test_token_files_of_awkward_rows(spark, many_slices):
    folder = shared_folder(spark, "tokens")
    docs = awkward(spark)
    token_files.write_token_files(docs, folder)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"])
                 for r in token_files.read_documents(spark, folder).collect())
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
        ids = [*ids_of(r["text"]), 2]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    part = token_files.read_manifest(spark, folder).orderBy("part").first()
    mapped = token_files.TokenPart(folder, part["name"], part["n_docs"])
    assert len(mapped) == part["n_docs"] and int(mapped[0][-1]) == 2 and mapped.tokens.dtype == np.uint16


def test_empty_tables(spark):
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(empty(spark), folder)
    assert token_files.read_documents(spark, folder).collect() == []
    assert packing.pack(empty(spark)).collect() == []
    assert prefix_counts.token_counts(empty(spark)).collect() == []


def check_packing(rows, wanted, window=2048):
    """Each id in one piece, windows without gaps; returns the number of windows."""
    from collections import Counter, defaultdict
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for at, own in windows.items():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= window
    assert set(windows) == set(range(len(windows)))
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    for doc_id, docs in wanted.items():
        total = sum(len(ids) for ids in docs)
        assert sum(r["length"] for r in pieces[doc_id]) == total
        for r in pieces[doc_id]:
            assert any(crc(ids[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] and len(ids) == r["doc_tokens"] for ids in docs)
    assert got.total() == len(rows)
    return len(windows)


def test_packing_query(spark, data_dir, texts):
    wanted = {i: [[*ids_of(t), 1]] for i, t in texts.items()}
    rows = entry.queries()["op2_bin_slack_packing"](spark, data_dir).collect()
    total = sum(len(d[0]) for d in wanted.values())
    assert check_packing(rows, wanted) == -(-total // 2048)


@pytest.mark.parametrize("window", [16, 64])
def test_packing_of_awkward_rows(spark, many_slices, window):
    docs, wanted = awkward(spark), {}
    for r in docs.collect():
        wanted.setdefault(r["doc_id"], []).append([*ids_of(r["text"]), 1])
    packed = packing.pack(docs, window=window)
    n = check_packing(packed.collect(), wanted, window)
    total = sum(len(ids) for d in wanted.values() for ids in d)
    assert n == -(-total // window)
    whole = packing.sequences(packed, window)
    assert whole.count() == n and whole.agg({"n_tokens": "sum"}).first()[0] == total


def test_plan_fills_windows_when_one_length_dominates():
    for counts in ({1500: 20_000, 7: 3}, {2048: 4}, {1025: 1, 1024: 1}, {5: 1000}, {1: 1}, {}):
        plan = packing.Plan(counts, 2048)
        assert plan.sequences == -(-sum(k * n for k, n in counts.items()) // 2048)


def test_subset_sums_are_the_best(spark):
    rnd = random.Random(1)
    for _ in range(100):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}
        capacity = rnd.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.closest_to(capacity, counts)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_prefix_count_query(spark, data_dir, texts):
    rows = entry.queries()["op5_prefix_token_counts"](spark, data_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(ids_of(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
        assert len(ids_of(text[:r["cut_chars"]])) <= 2048
        if n > 2048:
            assert len(ids_of(text[:r["cut_chars"] + 1])) > 2048


def test_prefix_counts_of_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(tuple(r)[:4] for r in prefix_counts.token_counts(docs).where("doc_id IS NOT NULL").collect())
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(ids_of(r["text"])), len(ids_of(r["text"])) > 2048)
                  for r in docs.collect() if r["doc_id"] is not None)
    assert got == want
    assert TOKENIZER.get_vocab_size() < 1 << 16
