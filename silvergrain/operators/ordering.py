"""Total orders over data that no single task could hold.

``ordered_slices`` range-partitions rows by an order that ends in a unique key,
so even one hot value is spread over many slices, and freezes the slice number
with a checkpoint. Work inside a slice is local; only per-slice summaries
(one small row each) are ever ordered globally.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.session import cut_lineage


def ordered_slices(rows: DataFrame, *order: Column | str, slices: int | None = None) -> DataFrame:
    """Adds ``slice``: slices are contiguous and increasing in ``order``.

    Their number is Spark's choice by the size of the data, or ``slices``.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(slices, *columns) if slices else rows.repartitionByRange(*columns)
    return cut_lineage(ranged.withColumn("slice", F.spark_partition_id()))


def with_positions(rows: DataFrame, group: list[str], *order: Column | str, name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in its group, exact at any group size.

    A row's position is its rank inside its slice plus the sizes of the earlier
    slices of the same group. Groups of any size are split over slices. ``order``
    names columns (``F.desc("v")``), since the rows are read back from a table.
    """
    sliced = ordered_slices(rows, *group, *order)
    inside = Window.partitionBy("slice", *group).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("slice", *group).agg(F.count(F.lit(1)).alias("size"))
               .withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size"))
    ranked = sliced.withColumn("rank_inside", F.row_number().over(inside))
    return (ranked.join(offsets, ["slice", *group])
            .withColumn(name, (F.col("offset") + F.col("rank_inside") - 1).cast("long"))
            .drop("slice", "rank_inside", "offset"))


def top_rows(rows: DataFrame, group: list[str], limit: int, *order: Column, name: str = "rank") -> DataFrame:
    """First ``limit`` rows of each group, 1-based rank.

    ``row_number() <= k`` is planned with a group limit on the map side, so a
    hot group sends at most ``k`` rows per input partition over the shuffle.
    """
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(name) <= limit)


def running_max(sliced: DataFrame, group: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Adds the largest ``value`` among the earlier rows of the group, over rows of :func:`ordered_slices`.

    It is the largest inside the slice or in the group's earlier slices, of
    which there is one small row per slice and group.
    """
    inside = Window.partitionBy("slice", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    most = (sliced.groupBy("slice", *group).agg(F.max(value).alias("most"))
            .select("slice", *group, F.max("most").over(earlier).alias("carried")))
    local = sliced.withColumn("local", F.max(value).over(inside))
    return local.join(most, ["slice", *group]).withColumn(name, F.greatest("local", "carried")).drop("local", "carried")


def before_each(ends: DataFrame, by: str, value: str, name: str, most: int, fan: int) -> DataFrame:
    """``by`` and ``name``: the ``value`` of the row before, in the order of the whole numbers ``by`` (unique, below ``most``).

    Numbers are taken ``fan`` at a time; the last value of each such group is handed on by the same
    rule one level up, so no task holds more than about ``fan`` rows however many there are.
    """
    if most <= fan:
        return ends.select(by, F.lag(value).over(Window.orderBy(by)).alias(name))
    up = f"{by}_up"
    grouped = ends.select(by, value, F.floor(F.col(by) / fan).cast("int").alias(up))
    groups = grouped.groupBy(up).agg(F.max_by(value, by).alias("end"))
    carried = before_each(groups, up, "end", f"{up}_end", -(-most // fan), fan)
    inside = F.lag(value).over(Window.partitionBy(up).orderBy(by))
    return grouped.withColumn("inside", inside).join(carried, up).select(by, F.coalesce("inside", f"{up}_end").alias(name))
