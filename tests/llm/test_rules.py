"""Repetition, quality and language against plain versions and held-out labels."""
from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import zstandard
from helpers import PROSE, awkward, documents, empty, words_of

import __spark_entry__ as entry
from silvergrain.llm import compression_quality, language_id, repetition


def plain_repetition(text):
    """Longest repeats by comparing all pairs of positions."""
    words = words_of(text)
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    windows = Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    in_window, covered = [False] * n, [False] * n
    for i in range(n - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            in_window[i:i + 5] = [True] * 5
    for i in range(n):
        if longest[i] >= 10:
            covered[i:i + longest[i]] = [True] * longest[i]
    return n, sum(in_window), sum(covered), max(longest, default=0)


def plain_base(text):
    text = text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    return sum(map(len, words_of(text))), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))


def check_repetition(rows, texts, full):
    for r, text in zip(rows, texts):
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == plain_base(text)
        if full:
            want = plain_repetition(text)
            assert (r["n_words"], r["n_repeat_words"], r["covered_words"], r["longest_repeat"]) == want
        n = r["n_words"]
        failed = n < 10 or 100 * r["n_repeat_words"] > 20 * n
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["covered_words"] <= max(50, 15 * n // 100)
                             and r["longest_repeat"] <= min(200, max(25, n // 20)))


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += [" ".join(rnd.choice("abcd") for _ in range(14)) + f" x{i} " for i in range(30)]
    texts += [" ".join([*texts[i].split(), *map(str, range(i)), *texts[i].split()]) for i in range(120, 150)]
    texts += ["a " * 50, "", " x", None, "a b c d e f\na b c d e f\n\n \n# * <>", "é é é é é é\x0bü"]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    rows = sorted(repetition.repetition(docs).collect(), key=lambda r: r["doc_id"])
    check_repetition(rows, texts, full=True)


def test_repetition_query(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = sorted(entry.queries()["op3_suffix_array_repetition"](spark, data_dir).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(texts)
    check_repetition(rows, [texts[i] for i in sorted(texts)], full=False)
    short = [r for r in rows if r["n_words"] < 400]
    check_repetition(short, [texts[r["doc_id"]] for r in short], full=True)


def test_each_limit_of_repeats_decides(spark):
    own = lambda a, b: [f"w{i}" for i in range(a, b)]
    cases = {
        1: own(0, 20_000) + own(0, 199) + own(20_000, 20_100),    # a long text may repeat 199 words
        2: own(0, 20_000) + own(100, 1_000) + own(20_000, 20_100),  # but not 900, though they are 5 % of it
        3: own(0, 22) + ["x"] + own(22, 250) + own(0, 22),        # a sentence twice
        4: own(0, 200) + [w for i in range(0, 40, 10) for w in [f"y{i}", *own(i, i + 10)]],  # four of ten words: 80 of 244
        5: own(0, 100) + [w for i in range(0, 21, 7) for w in [f"y{i}", *own(i, i + 6)]],    # shorter runs are for the base rule
        6: own(0, 290) + [w for i in range(0, 30, 10) for w in [f"y{i}", *own(i, i + 10)]],  # three of ten words: 60 of 323
        7: own(0, 290) + [w for i in range(0, 20, 10) for w in [f"y{i}", *own(i, i + 10)]]}  # two: 40 of 312
    docs = documents(spark, [(i, " ".join(w), None, None) for i, w in cases.items()])
    rows = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    assert {i: r["base_failed"] for i, r in rows.items()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    assert {i: r["kept"] for i, r in rows.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    assert (rows[6]["covered_words"], rows[6]["longest_repeat"]) == (60, 10)  # only the covered fraction speaks against it


def test_repetition_of_awkward_rows(spark):
    rows = repetition.repetition(awkward(spark)).collect()
    assert len(rows) == 13 and sum(r["n_words"] == 0 for r in rows) == 3
    assert repetition.repetition(empty(spark)).collect() == []


def test_a_long_passage_twice_is_not_kept(spark):
    rnd = random.Random(5)
    clean = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(600))
    passage = " ".join(clean.split()[:60])
    docs = documents(spark, [(1, clean, None, None), (2, f"{clean} {passage}", None, None)])
    assert {r["doc_id"]: r["kept"] for r in repetition.repetition(docs).collect()} == {1: True, 2: False}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in entry.queries()["op8_compression_quality"](spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows.values():
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.9
    good, bad = [[rows[i]["score"] for i in held if labels[i] == k] for k in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_equals_a_plain_version(spark, data_dir):
    """Dictionaries, curve and scores from their definitions, for every document."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    marks: dict[int, list] = {}
    for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect():
        if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            marks.setdefault(r["doc_id"], []).append(r["quality"])
    good = {i: int(sum(m) / len(m) >= 0.5) for i, m in marks.items()}
    chosen = {k: [docs[i] for i in sorted(docs) if good.get(i) == k] for k in (0, 1)}
    assert 1 < min(map(len, chosen.values())) and max(map(len, chosen.values())) <= 2_000
    assert max(len(t) for texts in chosen.values() for t in texts) <= 20_000  # so that all of each is trained on
    cut = lambda text: [text.encode()[i:i + 512] for i in range(0, len(text.encode()), 512)]
    made = []
    for k in (0, 1):
        samples = [b for t in chosen[k][::2] for b in cut(t)]
        size = min(512 << 10, max(sum(map(len, samples)) // 8, 1 << 10))
        made.append(zstandard.ZstdCompressionDict(zstandard.train_dictionary(size, samples).as_bytes()))

    def size(text, k):  # a new compressor for every block
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=made[k], write_checksum=False, write_content_size=False,
                                                write_dict_id=False).compress(b)) for b in cut(text))

    def difference(text):
        bad, good = size(text, 0), size(text, 1)
        return (bad - good) / (bad + good) if text else 0.0

    unseen = [(difference(t), k) for k in (0, 1) for t in chosen[k][1::2]]
    x, y = np.array(unseen).T
    slope, level = compression_quality.fit_curve(x, y)
    # at the best curve the slopes of its penalised log likelihood are nought
    scale = float(np.std(x))
    miss = y - 1 / (1 + np.exp(-(slope * x + level)))
    assert abs((miss * x / scale).sum() - 1e-2 * slope * scale) < 1e-6 and abs(miss.sum() - 1e-3 * level) < 1e-6
    counts = [sum(v == k for v in good.values()) for k in (0, 1)]
    level += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    rows = entry.queries()["op8_compression_quality"](spark, data_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = 1 / (1 + np.exp(-(slope * difference(docs[r["doc_id"]]) + level)))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_ignores_labels_of_the_held_out_fold(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (compression_quality.train(docs, x) for x in (labels, turned))
    assert (a.bad, a.good, a.curve) == (b.bad, b.good, b.curve)


def test_quality_without_labels_or_text(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(5, 1), (7, 1), (7, None), (None, 0)], "doc_id long, quality int")
    for labels in (none, one):
        model = compression_quality.train(awkward(spark), labels)
        rows = compression_quality.quality_scores(awkward(spark), model).collect()
        assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert compression_quality.quality_scores(empty(spark), model).collect() == []
    assert compression_quality.accepted(awkward(spark), model).columns == awkward(spark).columns


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in entry.queries()["op9_marginal_unigram_language"](spark, folder).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(rows) == set(lang)
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert np.mean([rows[i]["lang_pred"] == lang[i] for i in rows if rows[i]["held_out"]]) > 0.97


def test_forward_sum_equals_all_segmentations():
    vocabulary = {p: n for n, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"])}
    rnd = np.random.default_rng(1)
    table = rnd.dirichlet(np.ones(len(vocabulary) + 1), 2)
    lookup = language_id.PieceTable(vocabulary)

    def cuts(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in vocabulary or k == 1:
                for rest in cuts(word[k:]):
                    yield (vocabulary.get(word[:k], -1), *rest)

    for word in ("a", "abab", "bcaab", "ccc"):
        for k in range(2):
            want = sum(np.prod([table[k][p] for p in c]) for c in cuts("▁" + word))
            got = language_id.forward_sums([word, "x" * len(word)], lookup, table.T)[0][k]
            assert np.isclose(got, np.log(want))


def test_language_of_awkward_rows(spark):
    rows = [(i, PROSE[i % 3] + f" {i}", ("en", "fr", "de")[i % 3], "s") for i in range(40)]
    model = language_id.train(documents(spark, rows))
    assert model.languages == ["de", "en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.languages(awkward(spark), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert (got[5][0], got[6][0], got[7][0]) == ("en", "fr", "de")
    kept = language_id.accepted(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    nothing = language_id.train(documents(spark, [(1, "abc", None, None), (2, None, "en", None)]))
    assert {r["lang_pred"] for r in language_id.languages(awkward(spark), nothing).collect()} == {"und"}
    assert language_id.languages(empty(spark), model).collect() == []


def test_long_words_keep_finite_scores():
    model = language_id.Model(["x"], np.full((1, len(language_id.pieces("piece_bpe_32k.model")) + 1), 1e-5), language_id.Settings())
    names, scores = model.predict(["z" * 5000 + " 日" * 50, None, "123"])
    assert np.isfinite(language_id.forward_sums(["z" * 100], language_id.piece_table("piece_bpe_32k.model"), model.probability.T)).all()
    assert names == ["x", "und", "und"] and scores.tolist() == [1.0, 0.0, 0.0]


def test_language_of_long_documents_only_is_learned(spark):
    rows = [(i, " ".join([PROSE[0]] * (1 + 400 * (i % 2))) if i % 2 else PROSE[1], ("fr", "en")[i % 2], "s") for i in range(24)]
    assert min(len(t) for _, t, lang, _ in rows if lang == "en") > language_id.Settings().train_chars
    model = language_id.train(documents(spark, rows))
    assert model.languages == ["en", "fr"] and model.predict(["the dog runs into the forest"])[0] == ["en"]


def test_language_learns_all_parts_of_a_long_run(spark):
    rows = [(i, "ab" * 50 + ("mo", "ki")[i % 2] * 100, ("x", "y")[i % 2], "s") for i in range(24)]
    model = language_id.train(documents(spark, rows))
    assert model.predict(["mo" * 20, "ki" * 20])[0] == ["x", "y"]


def test_quality_learns_from_long_documents(spark):
    rows = [(i, " ".join([PROSE[0]] * 400) + f" {i}" if i % 2 else f"buy now {i} " * 40, "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = compression_quality.train(documents(spark, rows), labels)
    assert model.bad and model.good
    good, bad = model.score(np.array([model.difference(t) for t in (PROSE[0] * 5, "buy now " * 40)]))
    assert good > bad
