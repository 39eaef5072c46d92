"""Time-gap clusters inside a key.

Rows are first aggregated to distinct seconds per key, which bounds every
window: one (key, day) partition holds at most 86,400 rows however many photos
share a second, and one key holds one summary row per day.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.session import cut_lineage

DAY = 86400
UNDATED = 1 << 40  # after every time, in browse order


def representative(hero: str = "hero_score") -> Column:
    """Best photo: highest score, then latest date text, then highest id."""
    return F.max(F.struct(hero, "final_dt", "sha1"))


def encounter() -> Column:
    """Place of a photo in browse order: newest first, undated last."""
    return F.struct(F.coalesce(-F.col("ts"), F.lit(UNDATED)).alias("o"), "sha1")


def cluster_starts(rows: DataFrame, keys: list[str], gap: int, aggs: dict[str, Column]) -> DataFrame:
    """Per (key, second): the aggregates of that second and its cluster start.

    ``rows`` needs the keys and a non-null ``ts`` in seconds. Two neighbouring
    seconds of a key share a cluster when they are at most ``gap`` apart.
    """
    seconds = rows.groupBy(*keys, "ts").agg(*[c.alias(n) for n, c in aggs.items()])
    return piece_starts(seconds.withColumns({"first": F.col("ts"), "last": F.col("ts")}), keys, gap).drop("first", "last")


def piece_starts(pieces: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Adds ``cluster_start`` to pieces of clusters (``first, last`` in seconds, both of one day; they may overlap).

    A piece opens a cluster when it starts more than ``gap`` after the latest end before it.
    """
    pieces = pieces.withColumn("day", F.floor(F.col("first") / DAY))
    in_day = Window.partitionBy(*keys, "day").orderBy("first")
    reached = F.max("last").over(in_day.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("reached", reached)
    pieces = pieces.withColumn("opens", F.when(F.col("first") - F.col("reached") > gap, F.col("first")))

    days = pieces.groupBy(*keys, "day").agg(
        F.min("first").alias("day_first"), F.max("last").alias("day_last"), F.max("opens").alias("last_open"))
    by_day = Window.partitionBy(*keys).orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("first_opens", F.coalesce(
        F.col("day_first") - F.lag("day_last").over(by_day) > gap, F.lit(True)))
    days = days.withColumn("day_open", F.coalesce(
        "last_open", F.when(F.col("first_opens"), F.col("day_first"))))
    days = days.withColumn("carried", F.when(~F.col("first_opens"),
                                             F.last("day_open", ignorenulls=True).over(before)))
    days = days.select(*keys, "day", F.coalesce("carried", "day_first").alias("day_start"))

    upto = in_day.rowsBetween(Window.unboundedPreceding, 0)
    return (pieces.withColumn("open_upto", F.max("opens").over(upto))
            .join(days, [*keys, "day"])
            .withColumn("cluster_start", F.coalesce("open_upto", "day_start"))
            .drop("day", "reached", "opens", "open_upto", "day_start"))


def day_pieces(rows: DataFrame, keys: list[str], gap: int, aggs: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Clusters inside each day of a key: ``first, last`` and ``n, best``, or what ``aggs`` names.

    ``aggs`` holds aggregates of the photos of a second, and of such aggregates by their name. The pieces are pieces of the clusters of the key and of every group of keys, as more
    photos only narrow gaps. So groups that hold each other are clustered from the
    pieces of the smallest, which are fewer than seconds wherever there are bursts.
    """
    aggs = aggs or {"n": (F.count(F.lit(1)), F.sum("n")), "best": (representative(), F.max("best"))}
    seconds = (rows.groupBy(*keys, "ts").agg(*[photos.alias(name) for name, (photos, _) in aggs.items()])
               .withColumn("day", F.floor(F.col("ts") / DAY)))
    in_day = Window.partitionBy(*keys, "day").orderBy("ts")
    seconds = seconds.withColumn("prev", F.lag("ts").over(in_day))
    seconds = seconds.withColumn("opens", F.when(F.col("prev").isNull() | (F.col("ts") - F.col("prev") > gap), F.col("ts")))
    opened = F.max("opens").over(in_day.rowsBetween(Window.unboundedPreceding, 0))
    return (seconds.withColumn("first", opened).groupBy(*keys, "day", "first")
            .agg(F.max("ts").alias("last"), *[merged.alias(name) for name, (_, merged) in aggs.items()]).drop("day"))


def joined_pieces(pieces: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Clusters of a key, as :func:`time_clusters` gives them for dated rows, from :func:`day_pieces` of its parts."""
    return piece_starts(pieces, keys, gap).groupBy(*keys, "cluster_start").agg(
        F.sum("n").alias("size"), F.max("last").alias("cluster_end"), F.max("best").alias("best"))


def time_clusters(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """One row per cluster: size, first and last second, best photo.

    Rows without a timestamp are clusters of their own.
    """
    seconds = cluster_starts(rows.where("ts IS NOT NULL"), keys, gap,
                             {"n": F.count(F.lit(1)), "best": representative()})
    dated = seconds.groupBy(*keys, "cluster_start").agg(
        F.sum("n").alias("size"), F.max("ts").alias("cluster_end"), F.max("best").alias("best"))
    single = rows.where("ts IS NULL").select(
        *keys, F.lit(None).cast("long").alias("cluster_start"), F.lit(1).cast("long").alias("size"),
        F.lit(None).cast("long").alias("cluster_end"), F.struct("hero_score", "final_dt", "sha1").alias("best"))
    return dated.unionByName(single)


def reduced_candidates(rows: DataFrame, keys: list[str], gap: int = 15) -> DataFrame:
    """Burst reduction: the best photo of every GPS burst, and all photos without GPS.

    ``rows`` needs the keys, ``sha1, final_dt, ts, hero_score, has_gps`` and the
    place bucket ``lat3, lon3``. Output: keys, ``sha1, final_dt, hero_score,
    has_gps, lat3, lon3`` of the survivors; latitude and longitude ride along.
    """
    placed = rows.where("has_gps")
    best_full = F.max(F.struct("hero_score", "final_dt", "sha1", "latitude", "longitude"))
    buckets = [*keys, "lat3", "lon3"]
    seconds = cluster_starts(placed.where("ts IS NOT NULL"), buckets, gap, {"best": best_full})
    reps = seconds.groupBy(*buckets, "cluster_start").agg(F.max("best").alias("best")).select(*buckets, "best.*")
    columns = [*buckets, "hero_score", "final_dt", "sha1", "latitude", "longitude"]
    undated = placed.where("ts IS NULL").select(*columns)
    loose = rows.where(~F.col("has_gps")).select(*columns)
    return (reps.select(*columns).unionByName(undated).withColumn("has_gps", F.lit(True))
            .unionByName(loose.withColumn("has_gps", F.lit(False))))


def reduced_of_scopes(rows: DataFrame, leaf_rows: Callable[[DataFrame], DataFrame], leaf: list[str],
                      members: Callable[[DataFrame], DataFrame], keys: list[str], gap: int = 15) -> tuple[DataFrame, DataFrame]:
    """As :func:`reduced_candidates` of ``members(rows)``, and ``keys, lat3, lon3, met``: whom each place meets first.

    ``leaf_rows`` gives each photo once per family of scopes that hold each other, with that
    family's columns ``leaf`` alone. Bursts are clustered there, and only their pieces become ``members``.
    """
    columns = ["hero_score", "final_dt", "sha1", "latitude", "longitude"]
    buckets = [*keys, "lat3", "lon3"]
    dated = F.col("has_gps") & F.col("ts").isNotNull()
    pieces = cut_lineage(day_pieces(leaf_rows(rows.where(dated)), [*leaf, "lat3", "lon3"], gap, {
        "best": (F.max(F.struct(*columns)), F.max("best")), "met": (F.min(encounter()), F.min("met"))}))
    reps = (piece_starts(members(pieces).select(*buckets, "first", "last", "best"), buckets, gap)
            .groupBy(*buckets, "cluster_start").agg(F.max("best").alias("best")).select(*buckets, "best.*"))
    single = members(rows.where(~dated))
    met = members(pieces).select(*buckets, "met").unionByName(
        members(rows.where(F.col("has_gps") & ~dated)).select(*buckets, encounter().alias("met")))
    return reps.withColumn("has_gps", F.lit(True)).unionByName(single.select(*buckets, *columns, "has_gps")), met
