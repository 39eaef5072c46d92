"""Photo-grid order: sort keys per photo and exact positions per page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.functions.score import zero, zero_int
from silvergrain.operators.ordering import with_positions

MODES = ("default", "selected", "quality", "size", "time", "location", "animals", "faces", "indoor", "text", "outdoor",
         "landmark", "closeup")


def enriched(rows: DataFrame, semantic: DataFrame, face_summary: DataFrame, summaries: DataFrame) -> DataFrame:
    """Page rows with the semantic, face and caption columns the sort keys read.

    Landmark words hold no blanks, so each text is searched where it lies and only the finding is joined.
    """
    def landmark(*texts: str) -> Column:
        return text.contains_any(F.concat_ws(" ", *texts), text.LANDMARK_WORDS)

    sem = semantic.select("sha1", landmark("top_labels_json", "ai_tags_json").alias("labels_landmark"), "contains_animals",
                          "is_indoor_like", "contains_text", "is_outdoor_like")
    return (rows.join(sem, "sha1", "left")
            .join(face_summary.select("sha1", "face_count", "largest_face_area_ratio"), "sha1", "left")
            .join(summaries.select("sha1", landmark("summary_text").alias("summary_landmark")), "sha1", "left"))


def location_text() -> Column:
    place = F.format_string("%+011.6f|%+011.6f", F.col("latitude"), F.col("longitude"))
    return F.when(F.col("has_gps"), place).otherwise("")


def key_columns() -> dict[str, Column]:
    """Sort keys by mode; every flag is 1.0 or 0.0."""
    def flag(name: str) -> Column:
        return F.when(zero_int(F.col(name)) == 1, 1.0).otherwise(0.0)

    landmark = F.coalesce("labels_landmark", F.lit(False)) | F.coalesce("summary_landmark", F.lit(False))
    return {
        "sort_quality": zero(F.col("hero_score")), "sort_size": zero(F.col("file_size")),
        "sort_time": F.coalesce("final_dt", F.lit("")), "sort_location": location_text(),
        "sort_animals": flag("contains_animals"), "sort_faces": zero(F.col("face_count")),
        "sort_indoor": flag("is_indoor_like"), "sort_text": flag("contains_text"),
        "sort_outdoor": flag("is_outdoor_like"),
        "sort_landmark": landmark.cast("double"),
        "sort_closeup": zero(F.col("largest_face_area_ratio")),
    }


def mode_order(mode: str) -> list[Column]:
    """Leading sort columns of a mode; the page's own order breaks ties."""
    if mode == "default":
        return []
    if mode == "selected":
        return [F.desc("selected")]
    if mode in ("quality", "size"):
        return [F.asc(f"sort_{mode}")]
    if mode == "location":
        return [F.desc("located"), F.asc("sort_location")]
    if mode in MODES:
        return [F.desc(f"sort_{mode}")]
    raise ValueError(f"unknown sort mode: {mode}")


def grid_positions(rows: DataFrame, page: str, mode: str) -> DataFrame:
    """``page, sha1, pos`` for one sort mode, over all pages at once.

    ``rows`` needs the page, ``sha1, final_dt`` and the keys of the mode.
    """
    columns = [page, "sha1", "final_dt"]
    if mode == "location":
        rows = rows.withColumn("located", (F.col("sort_location") != "").cast("int"))
        columns += ["located", "sort_location"]
    elif mode == "selected":
        columns.append("selected")
    elif mode not in ("default", "time"):
        columns.append(f"sort_{mode}")
    if mode == "time":
        rows = rows.withColumn("sort_time", F.coalesce("final_dt", F.lit("")))
        columns.append("sort_time")
    order = [*mode_order(mode), F.desc("final_dt"), F.asc("sha1")]
    return with_positions(rows.select(*columns), [page], *order).select(page, "sha1", "pos")


def saved_order_positions(rows: DataFrame, page: str, saved: DataFrame) -> DataFrame:
    """Saved photos first in their saved order, the rest after them in page order."""
    joined = rows.select(page, "sha1", "final_dt").join(saved.select("sha1", "saved_pos"), "sha1", "left")
    return with_positions(joined, [page], F.asc_nulls_last("saved_pos"), F.desc("final_dt"), F.asc("sha1")).select(
        page, "sha1", "pos")
