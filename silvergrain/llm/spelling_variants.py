"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced
letter. Each word generates its edits as 64-bit hashes, and probes them against
blocked Bloom filters of the vocabulary, one for each word length. Only positives
leave the task: as pairs of hashes that meet the vocabulary in an exact join. What
the filter let through in error finds no word there, and every pair is confirmed on its letters.

A hash is the exclusive or of a number per place and letter, so that the hash of
an edit follows from the word's own by two of them. Nearness is symmetric: a
deletion is found from the longer word and a replacement from the word whose
letter comes first in the alphabet; insertions are the same pairs as deletions. A word has at
most some 2,000 edits of each ten letters, so no word gathers an unbounded number of pairs.

The filters are built by Spark, one row per block, and broadcast. All of one
pass take at most ``filter_bytes``; a larger vocabulary is cut by hash into
several passes, each with filters of its own.

Missing text has no words; a missing doc_id counts as an empty one in the text of
the checksum. Rows that repeat a document count again. An empty table gives an
empty result. Further columns are left out.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, record
from silvergrain.session import cut_lineage

LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that a lower-cased word may hold.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
#: Rows of a batch; words are short.
WORDS_AT_ONCE = 10_000
#: Hashes that are probed at once.
PROBED = 1 << 20
#: Lengths from here on share filters, so that the number of filters is bounded.
LONG = 64
#: Odd numbers that choose a bit in each of the eight lanes of a block.
LANE_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


@dataclass(frozen=True)
class Settings:
    """A form occurs at least ``ratio`` times as often as its variant; filters have ``bits`` for each word."""
    min_letters: int = 7
    min_count: int = 2
    ratio: int = 10
    bits: int = 16
    filter_bytes: int = 64 << 20


def occurrences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``: every run of letters with A-Z lower-cased; one in 31, by checksum, with one letter less."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{settings.min_letters},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return (hashed.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
            .where(F.char_length("word") >= settings.min_letters))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits for each number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_numbers(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return mixed((places.astype(np.uint64) << np.uint64(32)) | letters.astype(np.uint64))


@lru_cache(maxsize=2 * LONG)
def alphabet_numbers(place: int) -> np.ndarray:
    return place_numbers(np.full(len(ALPHABET), place), ALPHABET)


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of equally long words, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(place_numbers(np.arange(letters.shape[1]), letters), axis=1)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and letters of the words of each length, in bounded pieces."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for piece in np.array_split(rows, -(-len(rows) * int(length) // PROBED)):
            yield int(length), piece, letters_of([words[i] for i in piece])


def deletions(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of each distinct word with one letter less."""
    places = np.arange(letters.shape[1])
    here = np.bitwise_xor.accumulate(place_numbers(places, letters), axis=1)
    moved = place_numbers(np.maximum(places - 1, 0), letters)
    after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
    zero = np.zeros((len(letters), 1), np.uint64)
    found = np.concatenate([zero, here[:, :-1]], 1) ^ np.concatenate([after[:, 1:], zero], 1)
    fresh = np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((len(letters), 1), bool)], 1)
    row, place = np.nonzero(fresh)
    yield row, found[row, place]


def replacements(letters: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of each word with one letter replaced by a later one of the alphabet."""
    step = max(1, PROBED // len(ALPHABET))
    for place in range(letters.shape[1]):
        numbers = alphabet_numbers(place) if place < LONG else alphabet_numbers.__wrapped__(place)
        for at in range(0, len(letters), step):
            column = letters[at:at + step, place].astype(np.uint64)
            rest = own[at:at + step] ^ place_numbers(np.full(len(column), place), column)
            row, letter = np.nonzero(ALPHABET[None, :] > column[:, None])
            yield row + at, rest[row] ^ numbers[letter]


class Filters:
    """Blocked Bloom filters, one for each shard of lengths, and the pass that they belong to."""

    def __init__(self, words_of_shard: dict[int, int], bits: int, passes: int):
        self.passes, self.first, self.blocks = passes, {}, {}
        total = 0
        for shard, words in sorted(words_of_shard.items()):
            self.first[shard], self.blocks[shard] = total, max(1, -(-words * bits // (512 * passes)))
            total += self.blocks[shard]
        self.total, self.lanes, self.turn = total, None, 0

    @staticmethod
    def shard(length: int) -> int:
        return length if length < LONG else LONG + length % LONG

    def pass_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) % np.uint64(self.passes)

    def block(self, h: np.ndarray, length: int) -> np.ndarray:
        shard = self.shard(length)
        inside = ((h >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)
        return inside.astype(np.int64) + self.first[shard]

    @staticmethod
    def bit(h: np.ndarray, lane: int) -> np.ndarray:
        low = (h & np.uint64(0xFFFFFFFF)) * LANE_SALTS[lane] & np.uint64(0xFFFFFFFF)
        return np.uint64(1) << (low >> np.uint64(26))

    def positives(self, row: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes that the filter of the length doesn't rule out."""
        if self.shard(length) not in self.first:
            return row[:0], h[:0]
        if self.passes > 1:
            mine = self.pass_of(h) == self.turn
            row, h = row[mine], h[mine]
        block = self.block(h, length)
        for lane in range(8):
            bit = self.bit(h, lane)
            hit = self.lanes[block, lane] & bit != 0
            row, h, block = row[hit], h[hit], block[hit]
        return row, h


def vocabulary(words: DataFrame, settings: Settings) -> DataFrame:
    """``word, n, length, h`` of the words that occur often enough."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.min_count)

    def hashed(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            length, h = np.zeros(len(found), np.int32), np.zeros(len(found), np.uint64)
            for size, rows, letters in by_length(found):
                length[rows], h[rows] = size, hashes(letters)
            yield record(word=batch.column(0), n=batch.column(1), length=length, h=h.view(np.int64))

    return cut_lineage(by_batch(counted, hashed, "word string, n long, length int, h long", WORDS_AT_ONCE))


def _filters(words: DataFrame, settings: Settings) -> Filters:
    shard = F.when(F.col("length") < LONG, F.col("length")).otherwise(F.col("length") % LONG + LONG)
    sizes = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = max(1, -(-sum(sizes.values()) * settings.bits // (8 * settings.filter_bytes)))
    return Filters(sizes, settings.bits, passes)


def _fill(filters: Filters, words: DataFrame, turn: int) -> None:
    """Sets the bits of the words of one pass: blocks are combined by Spark and their rows read."""
    filters.turn, filters.lanes = turn, None

    def bits(batches):
        for batch in batches:
            h, lengths = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            mine = filters.pass_of(h) == turn
            h, lengths = h[mine], lengths[mine]
            block = np.zeros(len(h), np.int64)
            for length in np.unique(lengths):
                block[lengths == length] = filters.block(h[lengths == length], int(length))
            yield record(block=block, **{f"l{i}": Filters.bit(h, i).view(np.int64) for i in range(8)})

    lanes = [f"l{i}" for i in range(8)]
    rows = by_batch(words.select("h", "length"), bits, "block long, " + ", ".join(f"{x} long" for x in lanes), WORDS_AT_ONCE)
    found = rows.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toArrow()
    table = np.zeros((filters.total, 8), np.uint64)
    at = found["block"].to_numpy()
    for i, lane in enumerate(lanes):
        table[at, i] = found[lane].to_numpy().view(np.uint64)
    filters.lanes = table


def near_pairs(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, n, other, other_n``: every pair of near words once in each direction."""
    spark = words.sparkSession
    filters, found = _filters(words, settings), []
    for turn in range(filters.passes):
        _fill(filters, words, turn)
        shared = spark.sparkContext.broadcast(filters)

        def probe(batches):
            for batch in batches:
                own = batch.column(1).to_numpy().view(np.uint64)
                for length, rows, letters in by_length(batch.column(0).to_pylist()):
                    edits = ((length - 1, deletions(letters)), (length, replacements(letters, own[rows])))
                    for target, made in edits:
                        for row, h in made:
                            row, h = shared.value.positives(row, h, target)
                            if len(row):
                                yield record(of=own[rows[row]].view(np.int64), edit=h.view(np.int64))

        found.append(cut_lineage(by_batch(words.select("word", "h"), probe, "of long, edit long", WORDS_AT_ONCE)))
        shared.unpersist()
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    other = words.select(F.col("h").alias("edit"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    known = positives.join(other, "edit").select("of", "other", "other_n")
    pairs = known.join(words.select(F.col("h").alias("of"), "word", "n"), "of")
    exact = pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    exact = cut_lineage(exact)
    return exact.unionByName(exact.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for each ``word, form``: forms are followed to the last, twice as far in each round."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(links.join(onward, "root", "left"))
        links = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next IS NOT NULL").isEmpty():
            return links


def variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` from one row per occurrence of a word."""
    known = vocabulary(words, settings)
    best = (near_pairs(known, settings).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")))
    frequent = -F.col("best.less") >= settings.ratio * F.col("n")
    formed = cut_lineage(known.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    roots = last_forms(formed.where("form IS NOT NULL"))
    return (formed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


#: DuckDB has no crc32, so it is spelled out bit by bit.
ORACLE = """
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run
  FROM documents
), lowered AS (
  SELECT head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs
), hexed AS (
  SELECT run, hex(encode(head || run)) AS x FROM lowered
), hashed AS (
  SELECT run, xor(list_reduce(
    list_transform(range(1, length(x) + 1, 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1),
    lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295), 4294967295) AS h
  FROM hexed
), kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
         ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, count(*) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), paths AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT p.word, f.form, p.steps + 1 FROM paths p JOIN formed f ON p.root = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, first(root ORDER BY steps DESC) AS root FROM paths GROUP BY word
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""
