"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of doc_id. A bucket whose
bytes exceed the limit splits on its next bit; all others stay. So a shard is the
shortest prefix that fits, while every shorter one is too large. Sums over a fine
prefix give all its ancestors at once; only prefixes that are still too large are
looked at again, deeper.

Documents with one and the same hash can't be told apart by more bits. Where they
exceed the limit together, their bucket gets numbered overflow pages within the
limit; a document larger than the limit has a page of its own (``oversized``).

Missing text has 0 bytes; a missing id hashes as empty text. Repeated rows are
separate documents. An empty table gives no shard. Further columns don't matter.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.prefix_sums import running_sums
from silvergrain.session import cut_lineage

#: Bits of the hash; the directory can't grow deeper.
HASH_BITS = 60
#: Bits that a round looks below the depth at which buckets fit on average.
SLACK_BITS = 3


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id's decimal text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _prefix(depth) -> Column:
    return F.expr(f"shiftright(_hash, {HASH_BITS} - {depth})")


def _settle(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """For each prefix of ``depth`` bits: ``_leaf``, and the depth from ``top`` on at which it fits (null: none).

    ``_stuck`` tells that all its documents have one hash.
    """
    leaves = cut_lineage(rows.groupBy(_prefix(depth).alias("_leaf")).agg(
        F.sum("n_bytes").alias("_bytes"), (F.min("_hash") == F.max("_hash")).alias("_stuck")))
    above = leaves.withColumn("_depth", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn(
        "_node", F.expr(f"shiftright(_leaf, {depth} - _depth)"))
    fits = above.groupBy("_depth", "_node").agg(F.sum("_bytes").alias("_sum")).where(F.col("_sum") <= limit)
    first = above.join(fits, ["_depth", "_node"]).groupBy("_leaf").agg(F.min("_depth").alias("_fit"))
    return cut_lineage(leaves.select("_leaf", "_stuck").join(first, "_leaf", "left"))


def shard(docs: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, page, shard_bytes, oversized`` for every document.

    ``shard`` spells the prefix in bits after a letter, with its page where the
    bucket overflows. The texts are scanned once; ids, hashes and sizes are
    written and carry the rest. Rounds: one, and one more for each
    few bits by which hot or huge documents exceed the average.
    """
    rows = cut_lineage(docs.select(F.col("doc_id"), hash_bits(F.col("doc_id")).alias("_hash"),
                                   F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, depth = 0, min(HASH_BITS, math.ceil(math.log2(max(1, total / limit_bytes))) + SLACK_BITS)
    pending, placed = rows, []
    while True:
        settled = _settle(pending, top, depth, limit_bytes)
        mapped = pending.withColumn("_leaf", _prefix(depth)).join(settled, "_leaf")
        placed.append(mapped.where("_fit IS NOT NULL").select(
            "doc_id", "n_bytes", "_hash", F.col("_fit").alias("depth"), F.lit(0).cast("long").alias("page")))
        last = depth == HASH_BITS
        stuck = mapped.where("_fit IS NULL AND _stuck")
        placed.append(_pages(stuck, depth, limit_bytes))
        open_leaves = settled.where("_fit IS NULL AND NOT _stuck")
        if last or open_leaves.isEmpty():
            break
        pending = cut_lineage(pending.withColumn("_leaf", _prefix(depth)).join(open_leaves.select("_leaf"), "_leaf", "left_semi")
                              .drop("_leaf"))
        top, depth = depth + 1, min(HASH_BITS, depth + SLACK_BITS + 4)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    bits = F.expr(f"lpad(bin(shiftright(_hash, {HASH_BITS} - depth)), depth, '0')")
    name = F.concat(F.lit("s"), F.when(F.col("depth") > 0, bits).otherwise(""),
                    F.when(F.col("page") > 0, F.concat(F.lit("-"), F.col("page"))).otherwise(""))
    named = cut_lineage(out.withColumn("shard", name).drop("_hash"))
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return (named.join(sums, "shard").withColumn("oversized", F.col("shard_bytes") > limit_bytes)
            .select("doc_id", "n_bytes", "shard", "depth", "page", "shard_bytes", "oversized"))


def _pages(stuck: DataFrame, depth: int, limit: int) -> DataFrame:
    """Overflow pages, from 1, of buckets whose documents share one hash.

    Documents up to half the limit fill a page for each half limit of their
    running sum, so that no page exceeds the limit; larger ones stand alone.
    """
    rows = (stuck.select("doc_id", "n_bytes", "_hash")
            .withColumn("_large", (F.col("n_bytes") > limit // 2).cast("long")).withColumn("_small", F.when(F.col("_large") == 0, F.col("n_bytes")).otherwise(0)))
    summed = running_sums(rows, ["_hash", "_large"], ["n_bytes"], {"_before": "_small", "_count": "_large"})
    page = F.expr(f"CASE WHEN _large = 1 THEN 2 * _count + 2 ELSE 2 * (_before div {max(1, limit // 2)}L) + 1 END")
    return summed.select("doc_id", "n_bytes", "_hash", F.lit(depth).cast("int").alias("depth"), page.alias("page"))


#: The same directory in SQL: every depth's sums, and each document's first fitting prefix.
ORACLE = f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
     d AS (SELECT r.*, CAST(k AS INTEGER) AS depth, h >> ({HASH_BITS} - k) AS node FROM r, range(0, 31) t(k)),
     s AS (SELECT depth, node, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM d GROUP BY ALL HAVING sum(n_bytes) <= {64 << 20}),
     f AS (SELECT d.doc_id, d.n_bytes, d.h, min(d.depth) AS depth FROM d JOIN s USING (depth, node) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes,
       's' || CASE WHEN f.depth > 0 THEN lpad(bin(f.h >> ({HASH_BITS} - f.depth)), f.depth, '0') ELSE '' END AS shard,
       f.depth, CAST(0 AS BIGINT) AS page, s.shard_bytes, false AS oversized
FROM f JOIN s ON s.depth = f.depth AND s.node = f.h >> ({HASH_BITS} - f.depth)
"""
