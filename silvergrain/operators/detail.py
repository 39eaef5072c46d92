"""The detail record of a photo: all that the archive knows of it, laid out for display.

Each section is a struct: measures are text with fixed decimals, missing text is
blank, counts and flags stay numbers. A photo without a row in a section's table has
a null struct there, and a column that an older table lacks is blank, or null where
it is a number. Tables are keyed by ``sha1``, so every join is one to one; faces are
folded into arrays first, and all tables meet in one partitioning by ``sha1``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import geo, text

TEXT = "text"
NUMBER = "number"
_STAMPS = {"model_version": TEXT, "scored_at": TEXT}
_MODEL = {"scorer_name": TEXT, "model_name": TEXT, **_STAMPS, "warnings": TEXT}

#: Fields of each section and how they are shown: text, a number, or a measure with that many decimals.
SECTIONS: dict[str, dict[str, str | int]] = {
    "technical": {"width": NUMBER, "height": NUMBER, "sharpness": 2, "contrast": 2, "brightness": 2, "edge_density": 4,
                  "resolution_score": 4, "technical_score": 4, **_STAMPS},
    "faces": {"width": NUMBER, "height": NUMBER, "face_count": NUMBER, "prominent_face_count": NUMBER,
              "largest_face_area_ratio": 4, "has_prominent_face": NUMBER, **_STAMPS},
    "aesthetic": {"aesthetic_score": 4, "composition_score": 4, "subject_prominence_score": 4, "interest_score": 4,
                  "saliency_score": 4, "overall_aesthetic_score": 4, **_MODEL},
    "semantic": {"semantic_score": 4, "scene_type": TEXT, "contains_people": NUMBER, "contains_animals": NUMBER,
                 "contains_text": NUMBER, "is_document_like": NUMBER, "is_screenshot_like": NUMBER,
                 "is_landscape_like": NUMBER, "is_food_like": NUMBER, "is_indoor_like": NUMBER, "is_outdoor_like": NUMBER,
                 **_MODEL},
    "summary": {"summary_text": TEXT, "model_name": TEXT, **_STAMPS, "warnings": TEXT},
}
LOCALITIES = ("city", "town", "village", "hamlet", "suburb")
ADDRESS = ("formatted", "place_name", "road", "county", "state", "country")
BOX = ("face_index", "x", "y", "w", "h", "x_norm", "y_norm", "w_norm", "h_norm", "area_ratio", "img_width", "img_height")


def shown(rows: DataFrame, name: str, kind: str | int = TEXT) -> Column:
    if name not in rows.columns:
        return F.lit(None).cast("int").alias(name) if kind == NUMBER else F.lit("").alias(name)
    value = F.col(name)
    if kind == NUMBER:
        return value.alias(name)
    if kind != TEXT:
        value = F.when(value.isNotNull(), F.format_string(f"%.{kind}f", value.cast("double")))
    return F.coalesce(value.cast("string"), F.lit("")).alias(name)


def overview(media: DataFrame) -> DataFrame:
    """``sha1, overview``; a photo's size in pixels is known if both sides are."""
    wide, high = F.col("width"), F.col("height")
    return media.select("sha1", F.struct(
        shown(media, "original_filename"),
        F.replace(F.coalesce("rel_fqn", F.lit("")), F.lit("\\"), F.lit("/")).alias("rel_fqn"),
        shown(media, "final_dt"), shown(media, "dt_source"), shown(media, "path_tags"), shown(media, "custom_tags"),
        F.array_join(text.browse_tags(F.col("path_tags"), F.col("custom_tags")), ", ").alias("tags"),
        shown(media, "custom_notes"), shown(media, "is_deleted", NUMBER),
        F.coalesce(F.concat(wide.cast("string"), F.lit(" x "), high.cast("string")), F.lit("")).alias("dimensions"),
        shown(media, "latitude", 6), shown(media, "longitude", 6), shown(media, "altitude_meters", 1),
        F.when(geo.has_gps(F.col("latitude"), F.col("longitude")), "Yes").otherwise("No").alias("has_valid_gps"),
        F.coalesce("extension", F.lit("")).alias("file_extension"), shown(media, "file_size")).alias("overview"))


def place(links: DataFrame, cache: DataFrame) -> DataFrame:
    """``sha1, place``: the address of a photo's coordinate; of several links the smallest key counts."""
    joined = links.select("sha1", "coord_key", "source_lat", "source_lon").join(cache, "coord_key")
    known = [F.nullif(F.col(c), F.lit("")) for c in LOCALITIES]
    return joined.groupBy("sha1").agg(F.min_by(F.struct(
        *[shown(joined, c) for c in (*ADDRESS, *LOCALITIES)], F.coalesce(*known, F.lit("")).alias("locality"),
        "coord_key", shown(joined, "source_lat", 6), shown(joined, "source_lon", 6),
        shown(joined, "lat_rounded"), shown(joined, "lon_rounded")), "coord_key").alias("place"))


def section(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """``sha1`` and the section's struct with ``more`` fields at its end."""
    return rows.select("sha1", F.struct(*[shown(rows, c, kind) for c, kind in SECTIONS[name].items()], *more).alias(name))


def label_fields(semantic: DataFrame) -> list[Column]:
    """The stored label and tag lists as they are, and as one line; a text that is no list shows nothing."""
    labels, tags = F.col("top_labels_json"), F.col("ai_tags_json")
    raw = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("[]"))
    return [raw(labels).alias("top_labels_json"), raw(tags).alias("ai_tags_json"),
            text.label_display(text.parse_labels(labels)).alias("top_labels_display"),
            F.array_join(text.parse_strings(tags), ", ").alias("ai_tags_display")]


def in_order(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``sha1`` and an array of its faces by index."""
    first = ["face_index", *[c for c in columns if c != "face_index"]]
    return rows.groupBy("sha1").agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))


def detail_record(media: DataFrame, links: DataFrame, cache: DataFrame, technical: DataFrame, face_summary: DataFrame,
                  boxes: DataFrame, expression_summary: DataFrame, expression: DataFrame, aesthetic: DataFrame,
                  semantic: DataFrame, summaries: DataFrame) -> DataFrame:
    """``sha1, overview, place, technical, faces, boxes, expression, looks, aesthetic, semantic, summary`` of every photo.

    Deleted photos have a record, too. ``boxes`` and ``looks`` are arrays by face index; ``expression`` and ``looks``
    hold the stored values.
    """
    scores = [c for c in expression_summary.columns if c != "sha1"]
    parts = [
        place(links, cache), section(technical, "technical"), section(face_summary, "faces"),
        in_order(boxes, "boxes", [c for c in BOX if c in boxes.columns]),
        expression_summary.select("sha1", F.struct(*scores).alias("expression")),
        in_order(expression, "looks", [c for c in expression.columns if c != "sha1"]),
        section(aesthetic, "aesthetic"), section(semantic, "semantic", *label_fields(semantic)),
        section(summaries, "summary")]
    record = overview(media)
    for part in parts:  # each about as long as the record, whatever a plan guesses
        record = record.join(part.hint("merge"), "sha1", "left")
    return record
