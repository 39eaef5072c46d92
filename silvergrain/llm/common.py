"""Small helpers shared by the operators of this folder."""
from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.session import ship_package

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, so that further columns can't clash; a missing text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stretch(chars: int) -> Column:
    """The text; of a longer one, ``chars`` characters from a place that a hash of the id sets."""
    beyond = F.greatest(F.length("text") - chars, F.lit(0))
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), beyond + 1) + 1
    return F.when(beyond > 0, F.substr("text", start.cast("int"), F.lit(chars))).otherwise(F.col("text"))


#: Rows that a function gets at once; wide results of a batch stay small.
BATCH_ROWS = 1_000


def by_batch(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
             size: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers, in small batches.

    Workers live on after a task, so it gives back what Arrow and the C library keep.
    """
    ship_package(rows.sparkSession)

    def small(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield batch.slice(at, size)

    def tidy(batches):
        try:
            yield from fn(small(batches))
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def record(**columns) -> pa.RecordBatch:
    """A batch from arrays or (values, type) pairs."""
    arrays = [pa.array(*v) if isinstance(v, tuple) else v if isinstance(v, pa.Array) else pa.array(v)
              for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_bucket(buckets: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``buckets``: fixed folds for held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


_HOLDER: list = [None]


def hold(owner) -> None:
    """Lets ``owner`` keep its memo in this worker; the one before it gives its own up (``release``).

    Workers live on from stage to stage, so without this the memos of all
    operators of a pipeline would add up.
    """
    before = _HOLDER[0]
    if before is not owner and before is not None:
        before.release()
    _HOLDER[0] = owner
