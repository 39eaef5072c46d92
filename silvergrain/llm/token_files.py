"""Token ids of all documents as flat binary files with 64-bit document offsets.

Layout below a folder: ``data/<part>.bin`` holds the ids of one part's documents,
one after the other, as unsigned 16-bit little-endian integers. ``data/<part>.idx``
holds, as signed 64-bit little-endian integers, the n + 1 offsets of its n
documents (in ids, from the part's start) and then their n document ids (the
smallest integer stands for a missing id). ``manifest`` is a small Parquet table
with one row per part: its number, file name, documents, ids, and the ids before
it, by prefix sums. All files can be mapped into memory.

Parts ascend in doc_id. A part's file name is new for every task attempt and
enters the manifest only with the attempt that Spark commits, so a lost executor
or a speculative copy leaves an unread file, never a wrong one.

Missing text is empty; an empty document is its end id alone. Rows that repeat a
doc_id are separate documents, ordered by text. An empty table gives no part.
"""
from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, crc_of_ids, hold, record, texts
from silvergrain.llm.word_bpe import GROUP_ROWS, bounds_of, grouped, word_bpe

NO_ID = np.iinfo(np.int64).min
PART_SCHEMA = "part int, name string, n_docs long, n_tokens long"
#: Documents per batch of the reader.
READ_DOCS = 5_000


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files below ``folder``.

    One shuffle: texts are ranged by doc_id (and a hash of the text, which splits
    repeated ids). Parts are as many as Spark makes of the range.
    """
    def write_part(batches):
        part, encoder = TaskContext.get().partitionId(), word_bpe(tokenizer)
        name, out, store = f"{part:06d}-{uuid.uuid4().hex}", None, None
        ids, lengths = [], []
        hold(encoder)
        for batch in grouped(batches):
            if out is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(f"{path}/data", recursive=True)
                out = store.open_output_stream(f"{path}/data/{name}.bin")
            tokens, bounds = encoder.encode_all(batch.column(1))
            out.write(np.insert(tokens, bounds[1:], end_id).tobytes())
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy())
            lengths.append(np.diff(bounds) + 1)
        if out is None:
            return
        out.close()
        ids, offsets = np.concatenate(ids), bounds_of(np.concatenate(lengths)).astype("<i8")
        with store.open_output_stream(f"{path}/data/{name}.idx") as index:
            index.write(offsets.tobytes() + ids.astype("<i8").tobytes())
        yield record(part=([part], pa.int32()), name=[name], n_docs=([len(ids)], pa.int64()),
                     n_tokens=([int(offsets[-1])], pa.int64()))

    ordered = (texts(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    by_batch(ordered, write_part, PART_SCHEMA, GROUP_ROWS).write.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row per part
    parts = docs.sparkSession.read.schema(PART_SCHEMA).parquet(f"{folder}/parts")
    (parts.withColumn("token_base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
     .withColumn("doc_base", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
     .write.parquet(f"{folder}/manifest"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PART_SCHEMA + ", token_base long, doc_base long").parquet(f"{folder}/manifest")


def map_file(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped where the store is a mounted one, read as a whole (one part) where it is not."""
    store, path = fs.FileSystem.from_uri(folder)
    full = f"{path}/data/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(full, dtype, "r") if os.path.getsize(full) else np.empty(0, dtype)
    with store.open_input_file(full) as file:
        return np.frombuffer(file.read(), dtype)


class TokenPart:
    """One part, mapped: ``part[i]`` gives the ids of its i-th document."""

    def __init__(self, folder: str, name: str, n_docs: int):
        index = map_file(folder, f"{name}.idx", "<i8")
        self.offsets, self.doc_ids = index[:n_docs + 1], index[n_docs + 1:]
        self.tokens = map_file(folder, f"{name}.bin", "<u2")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i]:self.offsets[i + 1]]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; one task opens a part at a time."""
    manifest = read_manifest(spark, folder)
    n_parts = max(1, manifest.count())

    def read_parts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(folder, row["name"], row["n_docs"])
                for at in range(0, len(part), READ_DOCS):
                    some = range(at, min(at + READ_DOCS, len(part)))
                    ids = np.array(part.doc_ids[some.start:some.stop])
                    yield record(doc_id=pa.array(ids, pa.int64(), mask=ids == NO_ID),
                                 start=np.array(part.offsets[some.start:some.stop]) + row["token_base"],
                                 n_tokens=np.diff(part.offsets[some.start:some.stop + 1]),
                                 ids_crc32=([crc_of_ids(part[i]) for i in some], pa.int64()))

    spread = manifest.repartitionByRange(n_parts, "part")
    return by_batch(spread, read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
