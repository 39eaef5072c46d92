"""Language identification with unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language their
probabilities are estimated by expectation maximisation on the words of a sample:
forward and backward sums over every segmentation of a word give the expected
count of each piece. A word's probability in a language is the forward sum over
all ways to cut it into pieces; a text's is the product over its words. The
prediction is the language with the largest posterior under equal priors, and the
posterior is the score.

Words are maximal runs of letters in lower case; runs of over 100 letters are cut
into parts of 100, of which all count. A letter that no piece covers has a small fixed probability. Text without
a letter, or missing text, is ``und`` with score 0, and so is everything if no
language could be learned. Repeated rows are predicted row by row; an empty table
gives an empty result. Further columns are left out of predictions.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from silvergrain.llm.common import by_batch, hold, id_bucket, record, stretch, texts
from silvergrain.session import ship_package

NONE = "und"
RUNS = regex.compile(r"\p{L}{1,100}")
#: Marks the start of a word in the vocabulary.
START = "▁"
#: A fixed gain per letter keeps sums of products near 1 while training; it cancels.
GAIN = 8.0
#: Letters of texts that are scored together, and chunks whose scores a worker keeps.
BATCH_CHARS, CHUNK_ENTRIES = 1_000_000, 120_000
#: Numbers of forward sums that are held at once, whatever the languages; tasks that fit languages.
SUMS, FITS = 4_000_000, 64
#: Fixed odd numbers of the substring hash, and marks of its lookups.
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BEGINS, NOTHING = -2, -3
#: One row per language may be broadcast up to so many rows; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


@dataclass(frozen=True)
class Settings:
    """``train_docs`` documents of each language (by hash of the id, in expectation) train, each with up to ``train_chars`` characters."""
    vocabulary: str = "piece_bpe_32k.model"
    train_docs: int = 300
    train_chars: int = 20_000
    rounds: int = 3
    smooth: float = 0.05
    accept: float = 0.5


def held_out(column: str = "doc_id") -> Column:
    """The fold whose languages are never seen."""
    return id_bucket(3, column) == 1


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> dict[str, int]:
    """The vocabulary's ordinary pieces, numbered."""
    model = SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {piece: n for n, piece in enumerate(usable)}


def edges(word: str, vocabulary: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces inside a word; -1 for a letter that has none."""
    marked, out = START + word, []
    n = len(marked)
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = vocabulary.get(marked[start:end])
            if piece is not None:
                out.append((start, end, piece))
            elif end == start + 1:
                out.append((start, end, -1))
    return out


def learn(words: list[str], counts: np.ndarray, vocabulary: dict[str, int], settings: Settings) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation; the last one is that of an unknown letter."""
    longest = max(map(len, vocabulary))
    n = len(vocabulary) + 1
    lattices = [np.array(edges(w, vocabulary, longest), np.int32) for w in words]  # a tenth of the lists' size
    # the first round's probabilities: pieces by their occurrences, longer ones no rarer than short ones
    expected = np.zeros(n)
    for lattice, count in zip(lattices, counts):
        np.add.at(expected, lattice[:, 2], count)
    for _ in range(settings.rounds):
        probability = ((expected + settings.smooth) / (expected.sum() + settings.smooth * n)).tolist()
        gained = np.zeros(n)
        for word, packed, count in zip(words, lattices, counts):
            lattice = packed.tolist()
            size = len(word) + 1
            forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
            forward[0] = backward[size] = 1.0
            values = [probability[p] * GAIN ** (e - s) for s, e, p in lattice]
            for (s, e, _), v in zip(lattice, values):
                forward[e] += forward[s] * v
            for (s, e, _), v in zip(reversed(lattice), reversed(values)):
                backward[s] += v * backward[e]
            whole = forward[size]
            if whole > 0:
                for (s, e, p), v in zip(lattice, values):
                    gained[p] += count * forward[s] * v * backward[e] / whole
        expected = gained
    return (expected + settings.smooth) / (expected.sum() + settings.smooth * n)


class PieceTable:
    """Pieces and their beginnings by hash, for lookups of many substrings at once."""

    def __init__(self, vocabulary: dict[str, int]):
        found = {}
        for piece, number in vocabulary.items():
            value = np.uint64(0)
            for k, letter in enumerate(piece):
                value = step(value, np.uint64(ord(letter)))
                if k < len(piece) - 1:
                    found.setdefault(int(value), BEGINS)
            found[int(value)] = number
        self.hashes = np.array(sorted(found), np.uint64)
        self.numbers = np.array([found[int(h)] for h in self.hashes], np.int32)

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        """A piece's number, BEGINS for the beginning of one, NOTHING else."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], NOTHING)


def step(value, letter):
    """The hash of a string, extended by a letter; 64 bits, so that chance matches don't matter."""
    with np.errstate(over="ignore"):
        return (value * FACTOR) ^ ((letter + np.uint64(1)) * SPREAD)


@lru_cache(maxsize=2)
def piece_table(vocabulary: str) -> PieceTable:
    return PieceTable(pieces(vocabulary))


def forward_sums(words: list[str], table: PieceTable, probability: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations, one row per word and one column per language.

    ``words`` have one length. ``probability`` has a row for each piece and a
    last one for a letter without piece. Sums that become small are scaled up.
    """
    n, kinds = len(words[0]) + 1, probability.shape[1]
    letters = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
    sums, scale = np.zeros((n + 1, len(words), kinds)), np.zeros(len(words))
    sums[0] = 1.0
    for start in range(n):
        low = sums[start].max(1) < 1e-100
        if low.any():
            sums[start:, low] *= 1e100
            scale[low] -= 100 * math.log(10)
        open_rows, value = np.arange(len(words)), np.zeros(len(words), np.uint64)
        for end in range(start + 1, n + 1):
            value = step(value, letters[open_rows, end - 1])
            number = table.numbers_of(value)
            if end == start + 1:  # a letter by itself can always be passed
                sums[end, open_rows] += sums[start, open_rows] * probability[np.where(number >= 0, number, -1)]
            else:
                piece = number >= 0
                rows = open_rows[piece]
                sums[end, rows] += sums[start, rows] * probability[number[piece]]
            alive = number != NOTHING
            if not alive.any():
                break
            open_rows, value = open_rows[alive], value[alive]
    return np.log(np.maximum(sums[n], 1e-300)) + scale[:, None]


class Model:
    """Piece probabilities of each language, and a bounded memo of scored chunks of text."""

    def __init__(self, languages: list[str], probability: np.ndarray, settings: Settings):
        self.languages, self.probability, self.settings = languages, probability, settings
        self._rows, self._vectors = {}, None

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_vectors": None}

    def release(self) -> None:
        self._rows, self._vectors = {}, None

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Forward sums of each word; words of one length are scored together."""
        table, out = piece_table(self.settings.vocabulary), np.zeros((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            most = max(1, SUMS // (int(size + 2) * len(self.languages)))
            for part in np.array_split(own, -(-len(own) // most)):
                out[part] = forward_sums([words[i] for i in part], table, self.probability.T)
        return out

    def _learn_chunks(self, chunks: set[str]) -> None:
        """Adds the vectors of new chunks: sums over their letter runs, and the number of letters."""
        if self._vectors is None or len(self._rows) > CHUNK_ENTRIES:
            self._rows, self._vectors = {}, np.zeros((0, len(self.languages) + 1))
        new = [c for c in chunks if c not in self._rows]
        runs = [[c.lower()] if c.isalpha() and len(c) <= 50 else RUNS.findall(c.lower()) for c in new]
        flat = [r for own in runs for r in own]
        place = {r: i for i, r in enumerate(dict.fromkeys(flat))}
        vectors = np.column_stack([self.word_vectors(list(place)), np.fromiter(map(len, place), float, len(place))])
        added = np.zeros((len(new), len(self.languages) + 1))
        owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, runs), np.int64, len(runs)))
        np.add.at(added, owner, vectors[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))])
        self._rows.update(zip(new, range(len(self._vectors), len(self._vectors) + len(new))))
        self._vectors = np.concatenate([self._vectors, added])

    def predict(self, found: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predictions and posteriors of whole texts."""
        names, scores = [NONE] * len(found), np.zeros(len(found))
        if not self.languages:
            return names, scores
        at = 0
        while at < len(found):  # texts of about BATCH_CHARS together
            size, end = 0, at
            while end < len(found) and (end == at or size + len(found[end] or "") <= BATCH_CHARS):
                size += len(found[end] or "")
                end += 1
            split = [(t or "").split() for t in found[at:end]]
            self._learn_chunks(set().union(*split))
            for i, chunks in enumerate(split, at):
                if not chunks:
                    continue
                total = self._vectors[np.fromiter(map(self._rows.__getitem__, chunks), np.int64, len(chunks))].sum(0)
                if total[-1] > 0:
                    logs = total[:-1] - total[:-1].max()
                    best = int(logs.argmax())
                    names[i], scores[i] = self.languages[best], 1 / np.exp(logs).sum()
            at = end
        return names, scores


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on a bounded sample of rows outside the held-out fold that name their language.

    The sample is chosen by ids before any text is read: a hash of the id below
    a language's share; of a long text, a stretch whose place is a hash as well. Word counts and maximisation run as Spark groups, one
    language to a task, each bounded by the sample.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    share = known.groupBy("lang").agg((F.lit(float(settings.train_docs)) / F.count(F.lit(1))).alias("_share"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    small = share.count() <= BROADCAST_LANGUAGES
    sample = (known.select("doc_id", "lang", "text")
              .join(F.broadcast(share) if small else share, "lang").where(spot < F.col("_share")))
    runs = F.regexp_extract_all(F.lower(stretch(settings.train_chars)), F.lit(f"({RUNS.pattern})"))
    words = sample.select("lang", F.explode(runs).alias("word")).groupBy("lang", "word").count()
    schema = "lang string, piece int, probability double"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        found = learn(rows["word"].tolist(), rows["count"].to_numpy(float), pieces(settings.vocabulary), settings)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "piece": np.arange(len(found), dtype=np.int32), "probability": found})

    ship_package(docs.sparkSession)
    found = words.repartition(FITS, "lang").groupBy("lang").applyInPandas(fit, schema).toPandas()  # languages times vocabulary
    languages = sorted(found["lang"].unique())
    table = [found[found["lang"] == k].sort_values("piece")["probability"].to_numpy() for k in languages]
    return Model(languages, np.array(table), settings)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; a scan with no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times vocabulary

    def predict(batches):
        hold(sent.value)
        for batch in batches:
            names, scores = sent.value.predict(batch.column(1).to_pylist())
            yield record(doc_id=batch.column(0), lang_pred=(names, pa.string()), score=scores)

    return by_batch(texts(docs), predict, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents themselves, without those that have no letters or no clear language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, least = docs.columns.index("text"), model.settings.accept

    def keep(batches):
        hold(sent.value)
        for batch in batches:
            names, scores = sent.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != NONE and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return by_batch(docs, keep, docs.schema)
