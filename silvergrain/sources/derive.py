"""Archive tables stated as projections of the base tables.

The archive's own inputs (media rows and per-photo signal tables) are derived
from ``events``, ``documents`` and ``nation`` with integer arithmetic and one
final division, so Spark and any other SQL engine produce identical values.
Every table is one narrow projection: it grows with its base table and never
shuffles. Denominator 997 keeps scores off decimal rounding ties.
"""
from __future__ import annotations

from dataclasses import dataclass


class SparkDialect:
    name = "spark"

    @staticmethod
    def div(a, b):
        return f"(({a}) div ({b}))"

    @staticmethod
    def ts_text(seconds):
        return f"date_format(timestamp_seconds({seconds}), 'yyyy-MM-dd HH:mm:ss')"

    @staticmethod
    def coord_text(lat, lon):
        return f"format_string('%.3f,%.3f', round({lat}, 3) + 0D, round({lon}, 3) + 0D)"


class DuckDialect:
    name = "duck"

    @staticmethod
    def div(a, b):
        return f"(({a}) // ({b}))"

    @staticmethod
    def ts_text(seconds):
        return f"strftime(make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"

    @staticmethod
    def coord_text(lat, lon):
        return f"printf('%.3f,%.3f', round({lat}, 3) + 0, round({lon}, 3) + 0)"


def pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE CAST(({expr}) AS INT) {arms} END)"


def frac(k: int, salt: int = 0) -> str:
    return f"((n * {k} + {salt}) % 997) / 997"


@dataclass(frozen=True)
class Derived:
    """One derived table: base table, projection and row filter."""

    base: str
    columns: list[tuple[str, str]]
    where: str = ""
    per_face: bool = False


EPOCH_1988 = 567993600
ZERO_DATE = "0000-00-00 00:00:00"
SCENES = ["portrait", "group_photo", "landscape", "nature", "city", "food", "animal", "document",
          "screenshot", " Object  Closeup "]
LABEL_WORDS = ["people", "dog", "beach", "mountain", "museum", "food", "Sunset ", "text", "garden", "tower", "cat"]
DT_SOURCES = ["EXIF: DateTimeOriginal", "XMP", "File Modification", "file_modified", "mtime",
              "Filename Pattern", "Fallback"]
CAPTION_WORDS = ["a dog on the  beach", "two people at a table", "an old castle by the river",
                 "a CARPET close up.", "golden retriever running", "mountain lake at dusk...",
                 "a plate of pasta", "the city at night", "a puppy and a kitten"]


def derived_tables(d) -> dict[str, Derived]:
    """All derived tables in dialect ``d``."""
    div = d.div
    n = "n"
    burst = div(n, 8)
    seconds = (f"({burst} * 7919 % 13000) * 86400 + ({burst} * 613 % 86400) + (n % 8) * ({burst} % 6)"
               f" + (CASE WHEN {burst} % 4 = 1 AND n % 8 >= 5 THEN 20 ELSE 0 END)")
    dated = f"{EPOCH_1988} + {seconds}"
    lat = (f"CASE WHEN n % 23 = 0 THEN NULL WHEN n % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE"
           f" (({burst} % 60 * 29) % 130 - 60) * 1.0e0 + ((n % 3) * 7) / 99991"
           f" + (CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END) / 97 END")
    lon = (f"CASE WHEN n % 23 = 0 THEN NULL WHEN n % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE"
           f" (({burst} % 60 * 53) % 340 - 170) * 1.0e0 + ((n % 2) * 7) / 99991 END")
    raw_path = (
        "CASE WHEN n % 41 = 0 THEN '' ELSE "
        "(CASE WHEN n % 31 = 0 THEN '_trash/' WHEN n % 37 = 0 THEN '_stash/' WHEN n % 53 = 0 THEN 'Undated/' ELSE '' END)"
        " || 'Family-' || CAST(user_id % 5 AS STRING) || '/' || 'trip_' || event_type || '/'"
        f" || (CASE WHEN n % 3 = 0 THEN CAST(1988 + {burst} % 36 AS STRING) || '/' ELSE '' END) END"
        " || 'IMG_' || CAST(n % 5000 AS STRING) || '.jpg'")
    path = f"CASE WHEN n % 43 = 0 THEN replace({raw_path}, '/', chr(92)) ELSE {raw_path} END"
    def label_item(k, salt):
        word = pick(f"(n * {k} + {salt}) % 11", LABEL_WORDS)
        score = f"'0.' || lpad(CAST(((n * {k} + {salt}) % 997 + 1) * 10 + 3 AS STRING), 5, '0')"
        return f"'{{\"label\": \"' || {word} || '\", \"score\": ' || {score} || '}}'"

    def tag_item(k, salt):
        return f"'\"' || {pick(f'(n * {k} + {salt}) % 11', LABEL_WORDS)} || '\"'"

    place = f"{burst} % 60"
    # Two of three base places are geocoded; the key must match the photo key.
    key = d.coord_text(f"({lat})", f"({lon})")
    version = "CASE WHEN n % 7 = 0 THEN '{0}_v0' ELSE '{0}_v1' END"
    scored_at = d.ts_text("1700000000 + n % 86400")
    face_frac = "((n * {0} + face_index * {1}) % 997) / 997"

    def ff(a, b):
        return face_frac.format(a, b)

    has_gps = "n % 23 <> 0 AND n % 101 <> 0"
    return {
        "media": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("rel_fqn", path),
            ("original_filename", "'IMG_' || CAST(n % 5000 AS STRING) || '.jpg'"),
            ("path_tags", "'Photos, ' || event_type || ',family_' || CAST(user_id % 5 AS STRING) || ', '"
                          f" || CAST(1988 + {burst} % 36 AS STRING)"
                          " || CASE WHEN n % 59 = 0 THEN ', Topaz-undated, undated box' ELSE '' END"),
            ("final_dt", f"CASE WHEN n % 19 = 0 THEN '{ZERO_DATE}' ELSE {d.ts_text(dated)} END"),
            ("dt_source", pick("n % 7", DT_SOURCES)),
            ("custom_notes", "CASE WHEN n % 10 = 0 THEN 'note ' || CAST(n AS STRING) END"),
            ("custom_tags", "CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN ' trip-two,, Beach day' "
                            "ELSE 'o' || chr(39) || 'neil, 3rd CLICK, ' || event_type END"),
            ("extension", "CASE WHEN n % 6 = 0 THEN 'JPEG' ELSE 'JPG' END"),
            ("mtime_utc", d.ts_text("1600000000 + n") + " || '+00:00'"),
            ("is_deleted", "CAST(CASE WHEN n % 29 = 0 THEN 1 ELSE 0 END AS INT)"),
            ("width", "CAST(CASE WHEN n % 97 = 0 THEN NULL ELSE 400 + (n * 37) % 3600 END AS INT)"),
            ("height", "CAST(CASE WHEN n % 97 = 0 THEN NULL ELSE 250 + (n * 53) % 2750 END AS INT)"),
            ("file_size", "CAST((n * 7919) % 9000000 + 1000 AS BIGINT)"),
            ("latitude", lat),
            ("longitude", lon),
            ("altitude_meters", "CASE WHEN n % 5 = 0 THEN NULL ELSE (n % 3000) / 7 END"),
        ]),
        "image_scores": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("width", "CAST(400 + (n * 37) % 3600 AS INT)"),
            ("height", "CAST(250 + (n * 53) % 2750 AS INT)"),
            ("sharpness", "((n * 37) % 1499) * 1.0e0"),
            ("contrast", "((n * 53) % 997) / 11"),
            ("brightness", "((n * 71) % 2549) / 10"),
            ("edge_density", "((n * 17) % 401) / 1009"),
            ("resolution_score", frac(211)),
            ("technical_score", frac(389)),
            ("model_version", version.format("technical")),
            ("scored_at", scored_at),
        ], "n % 11 <> 0"),
        "image_face_summary": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("width", "CAST(400 + (n * 37) % 3600 AS INT)"),
            ("height", "CAST(250 + (n * 53) % 2750 AS INT)"),
            ("face_count", "CAST(n % 5 AS INT)"),
            ("prominent_face_count", "CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE (n * 3) % 3 % (n % 5 + 1) END AS INT)"),
            ("has_prominent_face", "CAST(CASE WHEN n % 5 > 0 AND (n * 3) % 3 > 0 THEN 1 ELSE 0 END AS INT)"),
            ("largest_face_area_ratio", "CASE WHEN n % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE ((n * 31) % 79) / 997 END"),
            ("model_version", version.format("face")),
            ("scored_at", scored_at),
        ], "n % 13 <> 5"),
        "image_faces": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("face_index", "CAST(face_index AS INT)"),
            ("img_width", "CAST(400 + (n * 37) % 3600 AS INT)"),
            ("img_height", "CAST(250 + (n * 53) % 2750 AS INT)"),
            ("x", "CAST((n * 3 + face_index * 41) % 700 AS INT)"),
            ("y", "CAST((n * 5 + face_index * 23) % 500 AS INT)"),
            ("w", "CAST((n * 7 + face_index * 11) % 300 + 1 AS INT)"),
            ("h", "CAST((n * 11 + face_index * 7) % 300 + 1 AS INT)"),
            ("area_ratio", "((n * 31 + face_index * 17) % 79) / 997"),
            ("confidence", ff(61, 5)),
        ], "n % 5 > 0 AND n % 13 <> 5", per_face=True),
        "face_expression": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("face_index", "CAST(face_index AS INT)"),
            ("area_ratio", "((n * 31 + face_index * 17) % 79) / 997"),
            ("confidence", ff(61, 5)),
            ("smile_left", ff(101, 7)), ("smile_right", ff(103, 11)),
            ("blink_left", ff(107, 13)), ("blink_right", ff(109, 17)),
            ("squint_left", ff(113, 19)), ("squint_right", ff(127, 23)),
            ("brow_up_left", ff(131, 29)), ("brow_up_right", ff(137, 31)),
            ("mouth_upper_left", ff(139, 37)), ("mouth_upper_right", ff(149, 41)),
            ("smile_score", ff(151, 43)), ("eyes_open_score", ff(157, 47)),
            ("expression_score", ff(163, 53)),
            ("asymmetry_score", f"CASE WHEN (n + face_index) % 9 = 0 THEN NULL ELSE {ff(167, 59)} / 4 END"),
            ("model_version", version.format("expression")),
            ("scored_at", scored_at),
        ], "n % 5 > 0 AND n % 13 <> 5 AND n % 17 <> 3", per_face=True),
        "aesthetic_scores": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("aesthetic_score", frac(401)),
            ("composition_score", frac(409)),
            ("subject_prominence_score", frac(419)),
            ("interest_score", frac(421)),
            ("saliency_score", frac(431)),
            ("overall_aesthetic_score", f"CASE WHEN n % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE {frac(433)} END"),
            ("model_version", version.format("aesthetic")),
            ("scored_at", scored_at),
            ("warnings", "CASE WHEN n % 15 = 0 THEN '[\"clip_inference_failed: oom\"]' "
                         "WHEN n % 15 = 1 THEN '[\"slow\"]' ELSE '[]' END"),
        ], "n % 9 <> 0"),
        "semantic_scores": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("semantic_score", frac(439)),
            ("scene_type", pick("n % 10", SCENES)),
            ("top_labels_json", "CASE WHEN n % 47 = 0 THEN 'not json' WHEN n % 49 = 0 THEN '[]' ELSE '[' || "
                                + " || ', ' || ".join(label_item(k, s) for k, s in
                                                      [(3, 1), (5, 2), (7, 4), (13, 3), (17, 9), (19, 5), (23, 8)])
                                + " || ']' END"),
            ("ai_tags_json", "CASE WHEN n % 47 = 0 THEN NULL ELSE '[' || "
                             + " || ', ' || ".join(tag_item(k, s) for k, s in [(3, 1), (5, 2), (7, 4)]) + " || ']' END"),
            ("contains_people", "CAST(CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS INT)"),
            ("contains_animals", "CAST(CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END AS INT)"),
            ("contains_text", "CAST(CASE WHEN n % 6 = 2 THEN 1 ELSE 0 END AS INT)"),
            ("is_document_like", "CAST(CASE WHEN n % 12 = 7 THEN 1 ELSE 0 END AS INT)"),
            ("is_screenshot_like", "CAST(CASE WHEN n % 18 = 8 THEN 1 ELSE 0 END AS INT)"),
            ("is_landscape_like", "CAST(CASE WHEN n % 7 = 3 THEN 1 ELSE 0 END AS INT)"),
            ("is_food_like", "CAST(CASE WHEN n % 14 = 9 THEN 1 ELSE 0 END AS INT)"),
            ("is_indoor_like", "CAST(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS INT)"),
            ("is_outdoor_like", "CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS INT)"),
            ("model_version", version.format("semantic")),
            ("scored_at", scored_at),
            ("warnings", "CASE WHEN n % 21 = 0 THEN 'people_from_face_override' "
                         "WHEN n % 22 = 0 THEN 'open_failed' ELSE '' END"),
        ], "n % 10 <> 3"),
        "ai_summaries": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("summary_text", f"CASE WHEN n % 33 = 0 THEN '' ELSE '  ' || {pick('n % 9', CAPTION_WORDS)} || ' ' END"),
            ("model_name", "'captioner'"),
            ("model_version", version.format("caption")),
            ("scored_at", scored_at),
            ("warnings", "CASE WHEN n % 26 = 0 THEN 'open_failed' ELSE '' END"),
        ], "n % 12 <> 5"),
        "photo_geo": Derived("events", [
            ("sha1", "sha1(CAST(n AS STRING))"),
            ("coord_key", key),
            ("source_lat", f"CASE WHEN n % 71 = 0 THEN CAST(0 AS DOUBLE) ELSE {lat} END"),
            ("source_lon", lon),
            ("linked_at", scored_at),
        ], f"{has_gps} AND {place} % 3 <> 2 AND n % 9 <> 4"),
        **_ingest_tables(d),
    }


def _ingest_tables(d) -> dict[str, Derived]:
    """File listings and export sidecars as the ingest reads them."""
    two = lambda expr: f"lpad(CAST(({expr}) AS STRING), 2, '0')"
    stem = ("CASE n % 4 WHEN 0 THEN 'IMG_20' || " + two("10 + n % 15") + " || " + two("n % 14") + " || " + two("n % 30 + 1")
            + " || '_' || " + two("n % 26") + " || " + two("n % 60") + " || " + two("n % 58")
            + " WHEN 1 THEN 'PXL-20' || " + two("n % 25") + " || '-' || " + two("n % 12 + 1") + " || '_' || "
            + two("n % 28 + 1") + " || '-' || " + two("n % 24") + " || '-' || " + two("n % 60") + " || '-' || "
            + two("n % 59") + " WHEN 2 THEN CASE n % 24 WHEN 2 THEN 'C' || CAST(n AS STRING) || '_20300105_101112'"
            " WHEN 14 THEN 'D' || CAST(n AS STRING) || '_20191399_000000 2020-01-02_03-04-05'"
            " ELSE 'DSC' || CAST(n AS STRING) END ELSE 'photo_' || CAST(n % 900 AS STRING) END")
    ext = pick("n % 8", [".jpg", ".JPG", ".jpeg", ".png", ".jpg", ".heic", ".jpg", ".txt"])
    folder = ("CASE WHEN n % 11 = 0 THEN '' WHEN n % 17 = 0 THEN '_private/x/' WHEN n % 13 = 0 THEN 'Undated stuff/' "
              "ELSE 'trip_' || CAST(n % 7 AS STRING) || '/day-' || CAST(n % 5 AS STRING) || '/' END")
    source = pick("n % 3", ["takeout", "camera", "phone"])
    stamp = lambda k: d.ts_text(f"900000000 + n * {k}")
    iso = lambda k, zone: f"replace({stamp(k)}, ' ', 'T') || '{zone}'"
    return {
        "ingest_files": Derived("events", [
            ("file_id", "n"),
            ("source", source),
            ("source_rank", "CAST(n % 3 AS INT)"),
            ("rel_path", f"{folder} || ({stem}) || {ext}"),
            ("width", "CAST(CASE WHEN n % 97 = 0 THEN NULL ELSE 300 + (n * 37) % 3000 END AS INT)"),
            ("height", "CAST(CASE WHEN n % 97 = 0 THEN NULL ELSE 200 + (n * 53) % 2000 END AS INT)"),
            ("file_size", "n * 13 % 100000 + 500"),
            ("exif_original", f"CASE WHEN n % 35 = 0 THEN '0000:00:00 00:00:00' WHEN n % 5 = 0 THEN "
                              f"replace(substring({stamp(40009)}, 1, 10), '-', ':') || substring({stamp(40009)}, 11, 9) "
                              "WHEN n % 43 = 1 THEN '1949:01:01 10:00:00' END"),
            ("exif_digitized", f"CASE WHEN n % 7 = 0 THEN ' ' || {stamp(40013)} || ' ' END"),
            ("exif_plain", f"CASE WHEN n % 18 = 0 THEN {iso(39983, 'Z')} WHEN n % 9 = 0 THEN {iso(39983, '+02:00')} END"),
            ("xmp", f"CASE WHEN n % 12 = 0 THEN '<d xmp:ModifyDate = \"bad\" photoshop:DateCreated=\"' || {iso(39979, 'Z')} "
                    f"|| '\" />' WHEN n % 6 = 0 THEN '<x><xmp:CreateDate>' || {iso(39971, 'Z')} "
                    "|| '</xmp:CreateDate></x>' END"),
            ("mtime", "1400000000 + n * 37"),
            ("content_sha1", "sha1('c' || CAST(n - (CASE WHEN n % 10 = 9 THEN 9 ELSE 0 END) AS STRING))"),
            ("lat_deg", "n % 90"), ("lat_min", "n % 60"), ("lat_sec", "n % 5999"),
            ("lat_den", "CASE WHEN n % 31 = 0 THEN 0 ELSE 100 END"),
            ("lat_ref", pick("n % 4", ["N", "S", "n", "s"])),
            ("alt_num", "n % 8000"), ("alt_ref", "CAST(n % 2 AS INT)"),
        ]),
        "takeout_sidecars": Derived("events", [
            ("json_path", f"{source} || '/' || {folder} || ({stem}) || CASE WHEN n % 2 = 0 THEN {ext} ELSE '' END || '.json'"),
            ("json_text", "CASE WHEN n % 15 = 0 THEN '{\"title\": 1}' WHEN n % 12 = 0 THEN '{\"creationTime\": {\"timestamp\": \"'"
                          " || CAST(1100000000 + n AS STRING) || '\"}}' WHEN n % 9 = 0 THEN '{\"timestamp\": ' ||"
                          " CAST(1200000000 + n AS STRING) || '}' ELSE '{\"photoTakenTime\": {\"timestamp\": \"'"
                          " || CAST(1000000000 + n * 7919 AS STRING) || '\"}}' END"),
        ], "n % 3 = 0 AND n % 21 <> 6"),
    }


def geocoded_columns(d) -> list[tuple[str, str]]:
    """Address columns of the geocoder cache, by place number ``p`` and outlier flag ``o``."""
    return [
        ("country", "CASE WHEN p % 20 = 7 THEN '' ELSE 'Country ' || CAST(p % 7 AS STRING) END"),
        ("state", "CASE WHEN p % 5 = 0 THEN '' ELSE 'State ' || CAST(p % 4 AS STRING) END"),
        ("county", "CASE WHEN p % 10 = 0 THEN '' ELSE 'County ' || CAST(p % 3 AS STRING) END"),
        ("city", "CASE WHEN p % 4 = 0 THEN 'City ' || CAST(p % 6 AS STRING) ELSE '' END"),
        ("town", "CASE WHEN p % 4 = 1 THEN 'Town ' || CAST(p % 5 AS STRING) ELSE '' END"),
        ("village", "''"),
        ("hamlet", "''"),
        ("suburb", "CASE WHEN p % 4 = 2 THEN ' Suburb ' ELSE '' END"),
        ("road", "CASE WHEN p % 6 = 1 THEN 'Road ' || CAST(p % 2 AS STRING) ELSE '' END"),
        ("place_name", "CASE WHEN p % 6 = 1 THEN '' WHEN o = 1 THEN 'big  park ' ELSE 'Big Park' END"),
        ("formatted", "'Addr ' || CAST(p AS STRING)"),
        ("status", "CASE WHEN p % 20 = 13 THEN 'error' ELSE 'ok' END"),
    ]
