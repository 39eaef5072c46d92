"""Removal of repeated byte strings by a sparse suffix array, sorted deep and shallow.

Every byte covered by a string of ``length`` bytes that also starts elsewhere, in
the same document or another, is removed. All strings are judged on the input.

Not every suffix is sorted. Each string (of ``length`` bytes) has an anchor: the place of the
smallest hash of 16 bytes among its first ``reach`` places, the leftmost of equals. It
depends on the string alone, so equal strings have their anchors at one and the
same offset, and suffixes at anchors decide about all strings. An anchor stands for a
stretch of neighbouring strings that share it; its context is the bytes that they cover.

Spark counts anchors by the hash of the bytes that all strings of a stretch may share. What
occurs once is settled, and so is a context that occurs twice as a whole: all its
strings repeat. Where contexts differ, the suffixes at the anchors are sorted: by multikey quicksort, eight bytes at a
time, to a shallow depth; groups that still agree are ordered by blind tries. The
inner nodes of a trie are the intervals of the suffix array with a common
prefix: below a node of depth d, strings that start o bytes before their anchor
need ``length`` - o <= d, and repeat if the bytes before some other anchor below the node agree with them on the last o.

Groups with more contexts than ``limit`` are not sorted in one task: their strings are dealt anew by narrower
classes of offsets, whose strings share more bytes, and in the end one by one.

Hashes have 64 bits for anchors and two times 64 for contexts; equal hashes of a context count as
equal bytes. Missing text is empty. Each row is a document of its own, also if it repeats a doc_id or lacks one, so
repeated rows of ``length`` bytes or more lose all bytes. An empty table gives an empty result. Further columns
are left out.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, record
from silvergrain.session import cut_lineage, drop_cut

GRAM = 16
#: Bytes hashed at once.
HASHED = 1 << 18
#: Rows of a batch that tasks return.
ROWS = 1 << 15
#: Bytes that the multikey quicksort looks at; a multiple of eight.
SHALLOW = 64
#: ``times`` neighbours have one and the same context; the last string of the last starts ``more`` behind that of the first.
ANCHORS = "tid binary, a int, low short, high short, key long, cid long, times int, more int"
STRETCHES = "tid binary, first int, last int"


@dataclass(frozen=True)
class Settings:
    """``widths``: offsets in a class, at first and for groups with more than ``limit`` contexts; the last must be 1."""
    length: int = 400
    reach: int = 200
    widths: tuple[int, ...] = (200, 25, 1)
    limit: int = 4_096


def gram_order(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place, in the upper 44 bits."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    n = len(data) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:8 + n] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h & ~np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first, last): each anchor of a text and the starts of the strings that it stands for, piece by piece."""
    strings, reach = len(data) - settings.length + 1, settings.reach
    for start in range(0, max(0, strings), HASHED):
        end = min(start + HASHED, strings)
        order = gram_order(data[start:end + reach + GRAM - 2])
        least, span = order | np.arange(len(order), dtype=np.uint64), 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[:end - start], least[reach - span:reach - span + end - start])
        at = (least[:end - start] & np.uint64((1 << 20) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], change]), np.concatenate([change, [end - start]]) - 1
        yield at[first] + start, first + start, last + start


def hashes_of(text, a: int, low: int, high: int, width: int, length: int) -> tuple[int, int]:
    """Of offsets low..high before anchor ``a``, all in one class: the class's hash and that of the context."""
    floor = low // width * width
    key = xxhash.xxh3_64_intdigest(text[a - floor:a + length - floor - width + 1], floor + 1)
    return key, xxhash.xxh3_64_intdigest(text[a - high:a - low + length], high << 16 | low)


def found_rows(rows: list) -> pa.RecordBatch:
    """A batch of ``ANCHORS``; hashes become signed."""
    tid, a, low, high, key, cid, times, more = zip(*rows)
    numbers = {"a": (a, pa.int32()), "low": (low, pa.int16()), "high": (high, pa.int16())}
    hashed = {name: (np.array(h, np.uint64).view(np.int64),) for name, h in (("key", key), ("cid", cid))}
    return record(tid=(tid, pa.binary()), **numbers, **hashed, times=(times, pa.int32()), more=(more, pa.int32()))


def all_anchors(texts: DataFrame, settings: Settings) -> DataFrame:
    """``ANCHORS`` of every text."""
    width, length = settings.widths[0], settings.length
    def find(batches):
        for batch in batches:
            rows = []
            for tid, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(scalar.as_buffer(), np.uint8)
                text = memoryview(data)
                for found in anchors(data, settings):
                    before = None
                    for a, first, last in zip(*[x.tolist() for x in found]):
                        low, high = a - last, a - first
                        hashed = hashes_of(text, a, low, high, width, length)
                        if hashed == before:  # a text of one word gives the same context again and again
                            rows[-1][6] += 1
                            rows[-1][7] = last - rows[-1][1] + rows[-1][2]
                        else:
                            rows.append([tid, a, low, high, *hashed, 1, 0])
                        before = hashed
                    if len(rows) >= ROWS:
                        yield found_rows(rows)
                        rows = []
            if rows:
                yield found_rows(rows)

    return by_batch(texts, find, ANCHORS)


def once(texts: DataFrame) -> DataFrame:
    """One row of each text; copies are combined before they move."""
    return texts.groupBy("tid").agg(F.first("text").alias("text"))


def narrower(texts: DataFrame, hot: DataFrame, width: int, settings: Settings) -> DataFrame:
    """``ANCHORS`` of the anchors ``tid, a, low, high``, cut at the borders of classes of ``width`` offsets."""
    wanted = hot.groupBy("tid").agg(F.collect_list(F.struct("a", "low", "high")).alias("wanted"))
    def cut(batches):
        for batch in batches:
            rows = []
            for tid, scalar, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = memoryview(scalar.as_buffer())
                for x in wanted:
                    for floor in range(x["low"] // width * width, x["high"] + 1, width):
                        part = x["a"], max(x["low"], floor), min(x["high"], floor + width - 1)
                        rows.append([tid, *part, *hashes_of(text, *part, width, settings.length), 1, 0])
                    if len(rows) >= ROWS:
                        yield found_rows(rows)
                        rows = []
            if rows:
                yield found_rows(rows)

    return by_batch(once(texts).join(wanted, "tid"), cut, ANCHORS)


def quicksorted(rows: list[bytes], depth: int) -> list[list[int]]:
    """Multikey quicksort: row numbers in the order of their first ``depth`` bytes, equals in one group."""
    keys = np.array([int.from_bytes(r[at:at + 8].ljust(8, b"\0"), "big") for r in rows for at in range(0, depth, 8)], np.uint64)
    keys = keys.reshape(len(rows), depth // 8)
    done, todo = [], [(np.arange(len(rows)), 0)]
    while todo:
        part, at = todo.pop()
        if len(part) == 1 or at == keys.shape[1]:
            done.append(part.tolist())
            continue
        word = keys[part, at]
        pivot = np.partition(word, len(word) // 2)[len(word) // 2]
        for mask, deeper in ((word > pivot, 0), (word == pivot, 1), (word < pivot, 0)):
            if mask.any():
                todo.append((part[mask], at + deeper))
    return done


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Trie:
    """A blind trie: inner nodes know their depth and first letters only, a search compares one whole row.

    A node is [depth, {byte: child}]; a leaf is the list of the rows that equal it. The end of a row sorts first, as -1.
    """

    def __init__(self, rows: list[bytes], members: list[int]):
        self.rows = rows
        self.root = [0, {}]
        for i in members:
            self._insert(i)

    def _letter(self, i: int, depth: int) -> int:
        row = self.rows[i]
        return row[depth] if depth < len(row) else -1

    def _insert(self, i: int) -> None:
        node = self.root
        if not node[1]:
            node[1][self._letter(i, 0)] = (i, [i])
            return
        while isinstance(node, list):  # blind: some leaf, by branching letters alone
            node = node[1].get(self._letter(i, node[0])) or next(iter(node[1].values()))
        row, other = self.rows[i], self.rows[node[0]]
        shared = common_prefix(row, other)
        if shared == len(row) == len(other):
            node[1].append(i)
            return
        parent, node = None, self.root
        while isinstance(node, list) and node[0] <= shared:
            parent, node = node, node[1].get(self._letter(i, node[0]))
        if parent[0] == shared:
            parent[1][self._letter(i, shared)] = (i, [i])
        else:  # the edge is split
            letter = self._letter(i, parent[0])
            below = parent[1][letter]
            member = below
            while isinstance(member, list):
                member = next(iter(member[1].values()))
            parent[1][letter] = [shared, {self._letter(member[0], shared): below, self._letter(i, shared): (i, [i])}]

    def walk(self) -> tuple[list[int], list[tuple[int, int, int, int]]]:
        """Rows in order, and the intervals of that order with a common prefix: (from, to, depth, depth of the next wider)."""
        order, intervals, todo = [], [], [(self.root, 0, None)]
        while todo:
            node, above, opened = todo.pop()
            if opened is not None:
                intervals.append((opened, len(order), node[0], above))
            elif isinstance(node, tuple):
                if len(node[1]) > 1:
                    intervals.append((len(order), len(order) + len(node[1]), len(self.rows[node[0]]), above))
                order += node[1]
            else:
                if len(node[1]) > 1:
                    todo.append((node, above, len(order)))
                depth = node[0] if len(node[1]) > 1 else above
                todo += [(node[1][x], depth, None) for x in sorted(node[1], reverse=True)]
        return order, intervals


def sorted_suffixes(rows: list[bytes], shallow: int = SHALLOW) -> Iterator[tuple[list[int], list[tuple[int, int, int, int]]]]:
    """Deep and shallow: groups that agree on the first bytes, in order, each with its own order and intervals.

    Only rows of one group are compared further, and no row may be shorter than ``shallow``.
    """
    for group in quicksorted(rows, shallow):
        if len(group) == 1:
            yield group, []
        else:
            yield Trie(rows, group).walk()


def repeated_offsets(contexts: list[bytes], low: list[int], high: list[int], length: int) -> list[tuple[int, int, int]]:
    """(row, first offset, last offset) of strings that start in another row, too, at the same offset before its anchor.

    Row i has the bytes from ``high[i]`` before its anchor to ``length - low[i]`` behind it.
    """
    after = [c[h:] for c, h in zip(contexts, high)]
    before = [c[:h][::-1] for c, h in zip(contexts, high)]
    found, farthest = [], max(high)
    for order, intervals in sorted_suffixes(after, min(SHALLOW, (length - farthest) // 8 * 8)):
        if not intervals:
            continue
        ranked = sorted(order, key=before.__getitem__)
        place = {i: r for r, i in enumerate(ranked)}
        agree = np.array([common_prefix(before[x], before[y]) for x, y in zip(ranked, ranked[1:])] + [0])
        for start, end, depth, above in intervals:
            if length - depth > farthest:
                continue
            members = np.sort(np.array([place[i] for i in order[start:end]]))
            between = np.minimum.reduceat(agree, members)[:-1] if len(members) > 1 else agree[:0]
            best = np.zeros(len(members), np.int64)
            best[1:] = between
            best[:-1] = np.maximum(best[:-1], between)
            for r, most in zip(members.tolist(), best.tolist()):
                i = ranked[r]
                first, last = max(length - depth, low[i]), min(length - above - 1, most, high[i])
                if first <= last:
                    found.append((i, first, last))
    return found


def sorted_groups(texts: DataFrame, open_rows: DataFrame, settings: Settings) -> DataFrame:
    """``STRETCHES`` that repeat within groups of different contexts, from rows ``tid, a, low, high, key, n``."""
    length = settings.length
    wanted = open_rows.groupBy("tid").agg(F.collect_list(F.struct("a", "low", "high", "key", "n")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            for tid, scalar, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = scalar.as_buffer().to_pybytes()
                for at in range(0, len(wanted), 4096):
                    part = wanted[at:at + 4096]
                    yield record(tid=([tid] * len(part), pa.binary()), **{c: ([x[c] for x in part], t) for c, t in
                                 (("a", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.int64()), ("n", pa.int64()))},
                                 context=([text[x["a"] - x["high"]:x["a"] - x["low"] + length] for x in part], pa.binary()))

    contexts = by_batch(once(texts).join(wanted, "tid"), fetch, "tid binary, a int, low int, high int, key long, n long, context binary")
    dealt = contexts.repartition("key").sortWithinPartitions("key", "tid", "a")

    def solve(batches):
        held = []
        for batch in batches:
            for key, group in grouped(held, batch):
                if key is None:
                    held = group
                else:
                    yield from answers(group)
        yield from answers(held)

    def grouped(held, batch):
        """Whole keys of what was held and the batch; the last key, which may go on, comes with the key None."""
        rows = held + batch.to_pylist()
        at = max(i for i in range(len(rows)) if i == 0 or rows[i]["key"] != rows[i - 1]["key"])
        yield 0, rows[:at]
        yield None, rows[at:]

    def answers(rows):
        hits = repeated_offsets([r["context"] for r in rows], [r["low"] for r in rows], [r["high"] for r in rows], length) if rows else []
        hits = [(rows[i], first, last) for i, first, last in hits if rows[i]["n"] == 1]
        if hits:
            yield record(tid=([r["tid"] for r, _, _ in hits], pa.binary()), first=([r["a"] - x for r, _, x in hits], pa.int32()),
                         last=([r["a"] - x for r, x, _ in hits], pa.int32()))

    return by_batch(dealt, solve, STRETCHES)


def repeated(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``STRETCHES``: starts of the strings of ``tid, text`` that repeat; those of equal texts may come several times."""
    found = []
    rows = cut_lineage(all_anchors(texts, settings))
    for width in (*settings.widths[1:], None):
        keys = rows.groupBy("key").agg(F.sum("times").alias("all")).where("all > 1").select("key")
        shared = cut_lineage(rows.join(keys, "key"))
        drop_cut(rows)  # the largest table; what occurs once is settled
        contexts = cut_lineage(shared.groupBy("key", "cid").agg(
            F.sum("times").alias("n"), F.min(F.struct("tid", "a", "low", "high")).alias("one"))
            .select("key", "cid", "n", "one.*"))
        many = contexts.where("n > 1").select("key", "cid")
        last = F.col("a") - F.col("low") + F.col("more")
        found.append(shared.join(many, ["key", "cid"]).select("tid", (F.col("a") - F.col("high")).alias("first"), last.alias("last")))
        sizes = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
        fits = F.col("contexts") <= settings.limit
        sized = cut_lineage(contexts.join(sizes, "key"))
        found.append(sorted_groups(texts, sized.where(fits), settings))
        hot = sized.where(~fits)
        if width is None or hot.isEmpty():
            break
        rows = cut_lineage(narrower(texts, hot, width, settings))
    stretches = found[0]
    for more in found[1:]:
        stretches = stretches.unionByName(more)
    return stretches


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text, kept, n_bytes, n_removed, n_spans``: texts as bytes, before and after."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    long = rows.where(F.octet_length("text") >= settings.length)
    stretches = cut_lineage(repeated(long.select("tid", "text"), settings))
    copies = long.groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("tid", F.lit(True).alias("copied"))
    # Combined before they move, so that the stretches of a text with many copies don't meet in one task.
    own = (stretches.groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("starts"))
           .join(copies, "tid", "left_anti"))
    marks = cut_lineage(own.withColumn("copied", F.lit(False)).unionByName(copies.withColumn(
        "starts", F.array().cast("array<struct<first:int,last:int>>"))))
    length = settings.length

    def cut(batches):
        for batch in batches:
            kept, removed, spans = [], [], []
            for scalar, starts, copied in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                text = scalar.as_buffer().to_pybytes()
                runs = [[0, len(text)]] if copied else []
                for x in (starts.as_py() or []) if copied is False else []:
                    if runs and x["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["last"] + length)
                    else:
                        runs.append([x["first"], x["last"] + length])
                at, pieces = 0, []
                for start, end in runs:
                    pieces.append(text[at:start])
                    at = end
                kept.append(b"".join(pieces) + text[at:])
                removed.append(sum(end - start for start, end in runs))
                spans.append(len(runs))
            yield record(doc_id=batch.column(0), text=batch.column(1), kept=(kept, pa.binary()),
                         n_bytes=([len(t) for t in batch.column(1).to_pylist()], pa.int64()),
                         n_removed=(removed, pa.int64()), n_spans=(spans, pa.int64()))

    marked = rows.join(marks, "tid", "left").select("doc_id", "text", "starts", "copied")
    return by_batch(marked, cut, "doc_id long, text binary, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(removed: DataFrame) -> DataFrame:
    """The columns of the query, from the result of :func:`without_repeats`."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
