"""Reads the base tables and exposes the archive tables as DataFrames."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.functions import geo
from silvergrain.operators import library, ranking_scores
from silvergrain.session import cut_lineage
from silvergrain.sources import derive


class Archive:
    """Lazy access to one archive; nothing is read until an action runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._dialect = derive.SparkDialect
        self._derived = derive.derived_tables(self._dialect)
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A base table, as its files lie; its footer is read once per archive."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._base[name]

    def derived(self, name: str) -> DataFrame:
        spec = self._derived[name]
        rows = self.base(spec.base).withColumnRenamed("event_id", "n")
        if spec.where:
            rows = rows.where(spec.where)
        if spec.per_face:
            rows = rows.withColumn("face_index", F.explode(F.sequence(F.lit(0), (F.col("n") % 5 - 1).cast("int"))))
        return rows.selectExpr(*[f"{sql} AS {col}" for col, sql in spec.columns])

    def signals(self, name: str) -> DataFrame:
        """A table of about one row per photo, or of a photo's faces.

        Spark judges it by its files, which may hold a hundredth of what the rows
        need in memory, and would broadcast several such tables through the driver;
        their joins sort and merge at any size.
        """
        return self.derived(name).hint("merge")

    @cached_property
    def media(self) -> DataFrame:
        return self.derived("media")

    @cached_property
    def technical(self) -> DataFrame:
        return self.signals("image_scores")

    @cached_property
    def face_summary(self) -> DataFrame:
        return self.signals("image_face_summary")

    @cached_property
    def faces(self) -> DataFrame:
        return self.signals("image_faces")

    @cached_property
    def expression(self) -> DataFrame:
        return self.signals("face_expression")

    @cached_property
    def aesthetic(self) -> DataFrame:
        return self.signals("aesthetic_scores")

    @cached_property
    def semantic(self) -> DataFrame:
        return self.signals("semantic_scores")

    @cached_property
    def summaries(self) -> DataFrame:
        return self.signals("ai_summaries")

    @cached_property
    def photo_geo(self) -> DataFrame:
        return self.derived("photo_geo")

    @cached_property
    def geo_cache(self) -> DataFrame:
        """One row per geocoded coordinate: an aggregate over the linked photos.

        Written once, so that its joins know its size and not that of the photos.
        """
        columns = dict(self._derived["media"].columns)
        geo = self._derived["photo_geo"]
        grouped = (
            self.base("events").withColumnRenamed("event_id", "n").where(geo.where)
            .selectExpr(f"{dict(geo.columns)['coord_key']} AS coord_key",
                        "(n div 8) % 60 AS p", "CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS o",
                        f"round({columns['latitude']}, 3) AS lat_r", f"round({columns['longitude']}, 3) AS lon_r")
            .groupBy("coord_key")
            .agg(F.min("p").alias("p"), F.min("o").alias("o"),
                 F.min("lat_r").alias("lat_rounded"), F.min("lon_r").alias("lon_rounded"))
        )
        return cut_lineage(grouped.selectExpr(
            "coord_key", "lat_rounded", "lon_rounded",
            *[f"{sql} AS {col}" for col, sql in derive.geocoded_columns(self._dialect)]))

    @cached_property
    def active(self) -> DataFrame:
        """Active photos with all browse columns."""
        return library.with_browse_columns(library.active_media(self.media))

    @cached_property
    def star(self) -> DataFrame:
        """Active photos joined to their five signal tables."""
        return ranking_scores.signal_star(
            library.active_media(self.media), self.technical, self.face_summary,
            self.aesthetic, self.semantic, self.summaries)

    @cached_property
    def scored(self) -> DataFrame:
        """Active browse rows with their hero score: the browse columns ride through the star join."""
        star = ranking_scores.signal_star(self.active, self.technical, self.face_summary, self.aesthetic, self.semantic,
                                          self.summaries)
        columns = self.active.columns
        return ranking_scores.hero_scores(star, *[c for c in columns if c != "sha1"]).select(*columns, "hero_score")

    @cached_property
    def placed(self) -> DataFrame:
        """The scored rows with place buckets.

        A plan that reads them once leaves unused columns and rows out before the joins;
        one that reads them several times cuts the lineage at the columns that it needs.
        """
        rows = self.scored.withColumns({
            "lat3": F.when(F.col("has_gps"), geo.bucket(F.col("latitude"), 3)),
            "lon3": F.when(F.col("has_gps"), geo.bucket(F.col("longitude"), 3))})
        return rows.select(
            "sha1", "final_dt", "ts", "hero_score", "has_gps", "latitude", "longitude", "lat3", "lon3", "undated",
            "decade", "year", "date_key", "folder_group", "web_path", "tags")

    @cached_property
    def ranked(self) -> DataFrame:
        """What card selections read of the placed rows, written once per query.

        They read this set several times (bursts, buckets, fillers); the
        lineage cut keeps the six-way join from running once per use.
        """
        return cut_lineage(self.placed.drop("decade", "folder_group", "web_path", "tags"))
