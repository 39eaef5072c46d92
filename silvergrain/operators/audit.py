"""Archive audits: totals, source counts, raw tags and date anomalies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.functions.time import ZERO_DATE

AUDIT_COLUMNS = ["sha1", "rel_fqn", "original_filename", "path_tags", "final_dt", "dt_source", "is_deleted",
                 "custom_notes", "custom_tags"]


def undated_hint() -> Column:
    def says(column: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("undated"))
    return says("rel_fqn") | says("path_tags")


def totals(media: DataFrame) -> DataFrame:
    hint, zero = undated_hint(), F.col("final_dt") == ZERO_DATE
    return media.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("is_deleted") == 0).alias("active_rows"),
        F.count_if(F.col("is_deleted") != 0).alias("deleted_rows"), F.count_if(zero).alias("zero_date_rows"),
        F.count_if(hint).alias("rows_with_undated_hint"),
        F.count_if(hint & zero).alias("undated_hint_and_zero_date"),
        F.count_if(hint & ~zero).alias("undated_hint_but_nonzero_date"))


def source_counts(media: DataFrame) -> DataFrame:
    return media.groupBy("dt_source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dt_source")


def raw_tag_counts(media: DataFrame) -> DataFrame:
    """Counts of all raw tags of active photos; case kept, nothing excluded."""
    tags = F.explode(text.split_tags(F.col("path_tags"), F.col("custom_tags")))
    return media.where("is_deleted = 0").select(tags.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def dated_with_hint(media: DataFrame) -> DataFrame:
    """All active photos that have a date although their path says they have none."""
    rows = media.where((F.col("is_deleted") == 0) & undated_hint() & (F.col("final_dt") != ZERO_DATE))
    return rows.select(*AUDIT_COLUMNS)


def zero_date_without_hint(media: DataFrame) -> DataFrame:
    """All active photos without a date whose path doesn't say so."""
    rows = media.where((F.col("is_deleted") == 0) & ~undated_hint() & (F.col("final_dt") == ZERO_DATE))
    return rows.select(*AUDIT_COLUMNS)


def sample(media: DataFrame, rows: int) -> DataFrame:
    """The latest ``rows`` photos, deleted ones included."""
    return media.select(*AUDIT_COLUMNS).orderBy(F.desc("final_dt"), "rel_fqn", "sha1").limit(rows)


def report(media: DataFrame, sample_rows: int) -> DataFrame:
    """The audit as ``section, line`` JSON rows, ready for a JSON lines sink; only the sample has a size."""
    def section(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("line"))

    return (section("summary", totals(media)).unionByName(section("dt_source_breakdown", source_counts(media)))
            .unionByName(section("top_tags", raw_tag_counts(media)))
            .unionByName(section("undated_anomalies", dated_with_hint(media)))
            .unionByName(section("zero_date_without_hint", zero_date_without_hint(media)))
            .unionByName(section("sample", sample(media, sample_rows))))
