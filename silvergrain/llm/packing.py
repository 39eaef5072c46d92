"""Packing documents into fixed windows by minimum bin slack.

Documents become token pieces: whole windows, and one remainder each. How many
remainders have which length is a table of at most one window's rows, whatever
the input. From it the plan is made: a window starts with the longest remaining
length, and subset sums over the others, held in a bitset, tell which total comes
closest to the capacity; tracking back gives the counts of each length. The same
choice is repeated while its lengths last. Where no choice fills a window, one
more piece is cut to fill it and its tail goes back to the lengths, so that only
the very last window keeps slack.

Pieces find their place by their rank among the pieces of their length: the rank
inside their slice (the partition that encoded them) plus the pieces of that
length in earlier slices.

Missing text is empty: a document of its end id alone. Rows that repeat a doc_id
are packed as separate documents. An empty table gives an empty result. Further
columns are left out.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, hold, record, texts
from silvergrain.llm.word_bpe import GROUP_ROWS, grouped, word_bpe
from silvergrain.session import cut_lineage

PIECES = "slice int, rank long, doc_id long, start long, length int, doc_tokens long, ids binary"
#: Rows of a batch that leaves a task.
OUT_ROWS = 2_000


class Plan:
    """Where the pieces of each length go, by rank.

    For a length, ``segments`` hold: first rank, pieces per window, first
    sequence, offset of the first piece, ids cut off here (0: the whole piece),
    and the rank that the first tail gets among pieces of the tail's length.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.sequences = window, 0
        self.segments: dict[int, list[tuple[int, ...]]] = {}
        self._left = {length: n for length, n in counts.items() if n}
        self._next = dict.fromkeys(self._left, 0)  # first rank not yet placed
        self._ever = dict(self._left)  # pieces of a length, tails included
        while self._left:
            self._fill()
        self.segments = {k: np.array(v, np.int64) for k, v in self.segments.items()}

    def _fill(self) -> None:
        first = max(self._left)
        used = {first: 1}
        for length, n in closest_to(self.window - first, {k: n - (k == first) for k, n in self._left.items()}).items():
            used[length] = used.get(length, 0) + n
        slack = self.window - sum(k * n for k, n in used.items())
        times = min(self._left[k] // n for k, n in used.items())
        cut = max((k for k, n in self._left.items() if n > used.get(k, 0)), default=0) if slack else 0
        if cut:
            times = min(times, self._left[cut] // (used.get(cut, 0) + 1))
        offset = 0
        for length in sorted(used, reverse=True):
            self._place(length, used[length], times, offset, 0, 0)
            offset += length * used[length]
        if cut:
            tail = cut - slack
            self._place(cut, 1, times, offset, slack, self._ever.get(tail, 0))
            self._ever[tail] = self._ever.get(tail, 0) + times
            self._left[tail] = self._left.get(tail, 0) + times
            self._next.setdefault(tail, 0)
        self.sequences += times

    def _place(self, length: int, each: int, times: int, offset: int, head: int, tail_rank: int) -> None:
        self.segments.setdefault(length, []).append((self._next[length], each, self.sequences, offset, head, tail_rank))
        self._next[length] += each * times
        self._left[length] -= each * times
        if not self._left[length]:
            del self._left[length]

    def places(self, length: int, rank: int):
        """(ids from the piece's start, ids taken, sequence, offset) for each part of a piece."""
        done = 0
        while True:
            rows = self.segments[length]
            first, each, sequence, offset, head, tail_rank = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].tolist()
            window, slot = divmod(rank - first, each)
            if not head:
                yield done, length, sequence + window, offset + slot * length
                return
            yield done, head, sequence + window, offset
            done, length, rank = done + head, length - head, tail_rank + window


def closest_to(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest up to ``capacity``.

    Bit s of ``sums`` tells that s can be reached. Counts are split into powers
    of two, so that a length costs the logarithm of its count.
    """
    sums, mask, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            part = min(part, left)
            more = (sums | sums << length * part) & mask
            if more != sums:
                steps.append((length, part, sums))
                sums = more
            left, part = left - part, part * 2
        if sums >> capacity:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Encoded pieces, written once; ``rank`` counts pieces of the same length inside the slice."""
    def encode(batches):
        part, encoder, seen = TaskContext.get().partitionId(), word_bpe(tokenizer), {}
        rows = []
        hold(encoder)

        def out():
            columns = list(zip(*rows))
            rows.clear()
            return record(slice=([part] * len(columns[0]), pa.int32()), rank=(columns[0], pa.int64()),
                          doc_id=(columns[1], pa.int64()), start=(columns[2], pa.int64()), length=(columns[3], pa.int32()),
                          doc_tokens=(columns[4], pa.int64()), ids=(columns[5], pa.binary()))

        for batch in grouped(batches):
            tokens, bounds = encoder.encode_all(batch.column(1))
            tokens = np.insert(tokens, bounds[1:], end_id).tobytes()
            bounds = (bounds + np.arange(len(bounds))).tolist()  # an end id after each document
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                total = last - first
                for start in range(0, total, window):
                    length = min(window, total - start)
                    ids = tokens[2 * (first + start):2 * (first + start + length)]
                    rows.append((seen.get(length, 0), doc_id, start, length, total, ids))
                    seen[length] = seen.get(length, 0) + 1
                if len(rows) >= OUT_ROWS:
                    yield out()
        if rows:
            yield out()

    return cut_lineage(by_batch(texts(docs), encode, PIECES, GROUP_ROWS))


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` for every piece.

    Two passes over the encoded pieces: one for the table of lengths, one that
    joins each piece with its slice's first rank and reads its place off the plan.
    """
    pieces = _pieces(docs, tokenizer, end_id, window)
    sizes = cut_lineage(pieces.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n")))
    plan = Plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    sent = docs.sparkSession.sparkContext.broadcast(plan)  # rows by length and choice; independent of the documents' number
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("slice", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def place(batches):
        plan = sent.value
        for batch in batches:
            rows = []
            for doc_id, start, length, total, rank, first_rank, ids in zip(*[c.to_pylist() for c in batch.columns]):
                for done, taken, sequence, offset in plan.places(length, first_rank + rank):
                    own = ids[2 * done:2 * (done + taken)]
                    crc = zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes())
                    rows.append((doc_id, start + done, taken, crc, total, sequence, offset, own))
            columns = list(zip(*rows)) or [[]] * 8
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
            yield record(**{n: (list(c), pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)})

    # One row per slice and length grows with the documents: it is shuffled, never broadcast.
    joined = pieces.join(first.hint("merge"), ["slice", "length"]).select("doc_id", "start", "length", "doc_tokens", "rank", "first", "ids")
    return by_batch(joined, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                   "sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, window: int = 2048) -> DataFrame:
    """The windows themselves: ``sequence_id, n_tokens, pieces``; a sequence has at most ``window`` pieces."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
