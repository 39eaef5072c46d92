"""The working set of the browser: active photos with their derived columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import geo, text, time


def active_media(media: DataFrame) -> DataFrame:
    return media.where("is_deleted = 0")


def with_browse_columns(active: DataFrame, extra_excluded: tuple[str, ...] = ()) -> DataFrame:
    """Path, tag, date and place columns; every one is a row expression."""
    web_path = F.translate("rel_fqn", "\\", "/")
    folder_parts = F.split("web_path", "/")
    undated = time.is_undated(F.col("final_dt"))
    dated_ts = F.when(~undated, F.try_to_timestamp(F.col("final_dt"), F.lit(time.STAMP)))
    return (
        active.withColumn("web_path", web_path)
        .withColumns({
            "tags": text.browse_tags(F.col("path_tags"), F.col("custom_tags"), extra_excluded),
            "undated": undated.cast("int"),
            "ts": F.unix_timestamp(dated_ts),
            "folder_group": F.when(undated, F.when(F.size(folder_parts) > 1, F.try_element_at(folder_parts, F.lit(-2)))
                                   .otherwise("Root")),
            "year": F.when(~undated, F.substring("final_dt", 1, 4)),
            "month": F.when(~undated, F.substring("final_dt", 6, 2)),
            "month_name": F.date_format(dated_ts, "MMMM"),
            "day": F.when(~undated, F.substring("final_dt", 9, 2)),
            "date_key": F.when(~undated, F.substring("final_dt", 1, 10)),
            "decade": F.when(~undated, F.concat(F.substring("final_dt", 1, 3), F.lit("0s"))),
            "has_gps": geo.has_gps(F.col("latitude"), F.col("longitude")),
        })
    )


def dated(rows: DataFrame) -> DataFrame:
    return rows.where("undated = 0")


def undated(rows: DataFrame) -> DataFrame:
    return rows.where("undated = 1")


def in_timeline_scope(rows: DataFrame, decade: str | None = None, year: str | None = None,
                      month: str | None = None, day: str | None = None) -> DataFrame:
    """Dated rows of one timeline node; only the given levels filter."""
    out = dated(rows)
    for column, wanted in (("decade", decade), ("year", year), ("month", month), ("day", day)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out


def in_folder_scope(rows: DataFrame, folder: str) -> DataFrame:
    """Rows under a folder, flagged as direct files or as part of a sub-folder."""
    prefix = f"{folder}/" if folder else ""
    inside = rows.where(F.col("web_path").startswith(prefix))
    rest = F.col("web_path").substr(F.lit(len(prefix) + 1), F.length("web_path"))
    return (inside.withColumn("remainder", rest)
            .withColumn("sub_folder", F.when(F.instr("remainder", "/") > 0, F.substring_index("remainder", "/", 1))))


def in_tag_scope(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.array_contains("tags", tag))


def in_undated_folder(rows: DataFrame, folder: str) -> DataFrame:
    return undated(rows).where(F.col("folder_group") == folder)


def requested(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of an ordered request (``sha1, pos``), keeping the request position."""
    return rows.join(ids, "sha1")


def special_selection(rows: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """Requested rows whose date comes from the file system, or that have no position."""
    if mode == "filesystem_date":
        test = time.is_file_date(F.col("dt_source"))
    elif mode == "no_gps":
        test = ~geo.has_gps(F.col("latitude"), F.col("longitude"))
    else:
        raise ValueError(f"unknown selection mode: {mode}")
    return requested(rows.where(test), ids)


def manifest(rows: DataFrame) -> DataFrame:
    return rows.select("sha1", F.col("web_path").alias("path"), F.col("original_filename").alias("filename"))
