"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target in words: a share of the whole by its weight, never
more than ``most`` times its size; what a full source leaves over goes to the
others by weight. A document expects target / size copies of itself. Inside a
source, documents stand in order of size, their expected copies are summed up,
one random offset is added, and a document is emitted once for each whole number
that its stretch of the sum crosses. Neighbours in the order are alike in size,
so the words taken come within about one document of the target.

Sums are exact integers (billionths of a copy), so reruns agree whatever the
partitions. A source may hold any part of the rows: its order is cut into slices.

Missing text has size 0; a missing source is a source of its own, the last. Rows
that repeat a doc_id are separate documents. An empty table gives an empty
result. Sources of size 0 have target 0. Further columns don't matter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import WORD
from silvergrain.llm.prefix_sums import running_sums
from silvergrain.session import cut_lineage

#: Parts of one expected copy; sums stay below 2^63 for four billion documents of two copies in a source.
UNIT = 1_000_000_000
SOURCE = ["_no_source", "_source"]


def word_count(text: Column) -> Column:
    """Number of words: each word with the white space around it becomes one letter."""
    letters = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*" + WORD + r"[\x20\x09-\x0D]*", "x"))
    return F.when(text.rlike(WORD), letters).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: ``_no_source, _source, source_size, target``.

    The water level: sources in order of size per weight are full as long as an
    equal level for the rest reaches them; the others get level times weight.
    """
    sources = sizes.groupBy(*SOURCE).agg(F.sum("_size").alias("source_size"))
    ranked = running_sums(sources.withColumn("_one", F.lit(1).cast("long")), [], SOURCE, {"_rank": "_one"})
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = ranked.withColumn("_weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    weighed = cut_lineage(weighed.withColumn("_fill", F.col("source_size") / F.col("_weight"))
                          .select(*SOURCE, "source_size", "_weight", "_fill"))
    whole = weighed.agg(F.sum("source_size").alias("_all_sizes"), F.sum("_weight").alias("_all_weights"))
    filling = running_sums(weighed, [], ["_fill", *SOURCE], {"_full_size": "source_size", "_full_weight": "_weight"})
    budget = share * F.col("_all_sizes")
    level = (budget - most * F.col("_full_size")) / (F.col("_all_weights") - F.col("_full_weight"))
    judged = cut_lineage(filling.crossJoin(F.broadcast(whole))  # one row
                         .withColumn("_is_full", most * F.col("_fill") <= level))
    full = judged.where("_is_full").agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_s"),
                                        F.coalesce(F.sum("_weight"), F.lit(0)).alias("_w"))
    rest = (budget - most * F.col("_s")) / (F.col("_all_weights") - F.col("_w"))
    return (judged.crossJoin(F.broadcast(full))  # one row
            .withColumn("target", F.when(F.col("_is_full"), most * F.col("source_size")).otherwise(rest * F.col("_weight")))
            .select(*SOURCE, "source_size", "target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2),
        seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every document, and its ``keys``.

    ``share`` times all words are shared out by ``weights``, which repeat over
    the sources in code point order. One scan of the texts; from there on only
    sizes move.
    """
    sizes = cut_lineage(docs.select(
        F.col("doc_id"), *keys, F.col("source").isNull().alias("_no_source"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("_size")))
    targets = source_targets(sizes, share, most, weights)
    expected = F.when(F.col("source_size") > 0, F.least(
        F.round(F.col("target") / F.col("source_size") * UNIT), F.lit(float(most * UNIT)))).otherwise(0).cast("long")
    rows = sizes.join(targets, SOURCE).withColumn("_expected", expected).withColumn(
        "_shuffle", F.xxhash64(F.lit(seed), "doc_id"))
    summed = running_sums(rows, SOURCE, ["_size", "_shuffle", "doc_id", *keys], {"_before": "_expected"})
    start = f"(_before + pmod(xxhash64({seed}, _no_source, _source), {UNIT}L))"
    crossed = F.expr(f"({start} + _expected) div {UNIT}L - {start} div {UNIT}L")
    return (summed.withColumn("copies", crossed)
            .select("doc_id", *keys, F.col("_size").alias("size"), "source_size", "target", "copies",
                    (F.col("copies") * F.col("_size")).alias("taken")))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.

    Decisions come back to the texts by doc_id and a hash of the row; rows alike
    in all columns share their copies evenly.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    keyed = keyed.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-1)))
    taken = (mix(keyed, keys=("_id", "_row"), **settings).groupBy("_id", "_row")
             .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    same = "row_number() OVER (PARTITION BY _id, _row ORDER BY _row)"
    share = F.expr(f"_copies div _rows + CASE WHEN {same} <= _copies % _rows THEN 1 ELSE 0 END").cast("int")
    spread = keyed.join(taken, ["_id", "_row"]).withColumn("_share", share)
    return (spread.where("_share > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_share"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
