"""Exact running sums inside groups of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvergrain.operators.ordering import ordered_slices


def running_sums(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column`` of ``sums``, the column's sum over the earlier rows of the group.

    Rows are ranged by (group, order) into slices and written there, so that a
    group that holds a third of all rows is spread over many tasks. A running
    sum is the sum inside the slice plus the sums of the group's earlier slices,
    of which there is one small row per slice and group. ``order`` should end in
    a unique key; group columns must not be null. Sums of integers are exact.
    """
    sliced = ordered_slices(rows, *group, *order)
    inside = Window.partitionBy("slice", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("slice", *group).agg(*[F.sum(c).alias(f"{n}_total") for n, c in sums.items()])
    offsets = totals.select("slice", *group, *[F.coalesce(F.sum(f"{n}_total").over(earlier), F.lit(0)).alias(f"{n}_offset")
                                               for n in sums])
    local = sliced.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = local.join(offsets, ["slice", *group])
    return (joined.withColumns({n: F.col(n) + F.col(f"{n}_offset") for n in sums})
            .drop("slice", *[f"{n}_offset" for n in sums]))
