"""The detail record at its borders: photos without rows, older tables, blanks and texts that are no lists."""
from __future__ import annotations

import pytest

from silvergrain.operators import detail


@pytest.fixture(scope="module")
def records(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    media = table("sha1 string, original_filename string, rel_fqn string, final_dt string, dt_source string, path_tags string, "
                  "custom_tags string, custom_notes string, is_deleted int, width int, height int, latitude double, "
                  "longitude double, altitude_meters double, extension string, file_size long",
                  ("a", "x.jpg", "t\\x.jpg", "2001-01-01 00:00:00", "XMP", "photos, lake como,2001", " lake como ,,b", "n", 0, 40, 30,
                   1.0, -2.5, -3.04, "JPG", 12),
                  ("b", None, None, None, None, None, None, None, 1, 40, None, 0.0, 0.0, None, None, None))
    links = table("sha1 string, coord_key string, source_lat double, source_lon double",
                  ("a", "2.000,2.000", 2.0, 2.0), ("a", "1.000,-2.500", 1.0, None), ("b", "9.000,9.000", 9.0, 9.0))
    address = ", ".join(f"{c} string" for c in (*detail.ADDRESS, *detail.LOCALITIES))
    blank = {c: "" for c in (*detail.ADDRESS, *detail.LOCALITIES)}
    cached = lambda key, **held: tuple([key, *{**blank, **held}.values(), 1.0, None])
    cache = table(f"coord_key string, {address}, lat_rounded double, lon_rounded double",
                  cached("1.000,-2.500", village="Dorf", suburb="Ost", country=None), cached("2.000,2.000", city="Stadt"))
    technical = table("sha1 string, width int, sharpness double, technical_score double", ("a", None, 3.14159, None))
    faces = table("sha1 string, face_count int, largest_face_area_ratio double", ("a", 2, 0.5))
    boxes = table("sha1 string, x int, face_index int", ("a", 5, 1), ("a", 9, 0))
    looks = table("sha1 string, smile_score double, face_index int", ("a", 0.5, 1), ("a", None, 0))
    scores = table("sha1 string, people_moment_score double", ("a", 0.25))
    aesthetic = table("sha1 string, aesthetic_score double, warnings string", ("a", 0.5, None))
    semantic = table("sha1 string, scene_type string, top_labels_json string, ai_tags_json string, contains_people int",
                     ("a", None, '[{"label": "dog", "score": 0.5}, {"label": "", "score": 1}, {"label": "cat"}]', "", 1),
                     ("b", "x", "no list", None, None))
    summaries = table("sha1 string, summary_text string", ("b", None))
    rows = detail.detail_record(media, links, cache, technical, faces, boxes, scores, looks, aesthetic, semantic, summaries)
    return {r["sha1"]: r for r in rows.collect()}


def test_overview(records):
    seen = records["a"]["overview"].asDict()
    assert seen["rel_fqn"] == "t/x.jpg" and seen["tags"] == "B, Lake Como" and seen["dimensions"] == "40 x 30"
    assert (seen["latitude"], seen["longitude"], seen["altitude_meters"]) == ("1.000000", "-2.500000", "-3.0")
    assert seen["has_valid_gps"] == "Yes" and seen["file_size"] == "12" and seen["is_deleted"] == 0
    bare = records["b"]["overview"].asDict()
    assert bare.pop("is_deleted") == 1 and bare.pop("has_valid_gps") == "No"
    assert (bare.pop("latitude"), bare.pop("longitude")) == ("0.000000", "0.000000") and set(bare.values()) == {""}


def test_place_of_the_smallest_key(records):
    seen = records["a"]["place"].asDict()
    assert seen["coord_key"] == "1.000,-2.500" and seen["locality"] == "Dorf" and seen["country"] == ""
    assert seen["source_lat"] == "1.000000" and seen["source_lon"] == "" and seen["lon_rounded"] == ""
    assert records["b"]["place"] is None  # its key was never resolved


def test_tables_without_a_row_or_a_column(records):
    a, b = records["a"], records["b"]
    assert a["technical"]["sharpness"] == "3.14" and a["technical"]["technical_score"] == "" == a["technical"]["model_version"]
    assert a["technical"]["width"] is None is a["technical"]["height"]
    assert a["faces"]["largest_face_area_ratio"] == "0.5000" and a["aesthetic"]["warnings"] == ""
    assert [x["face_index"] for x in a["boxes"]] == [0, 1] == [x["face_index"] for x in a["looks"]]
    assert a["looks"][0]["smile_score"] is None and a["expression"]["people_moment_score"] == 0.25
    assert all(b[part] is None for part in ("technical", "faces", "boxes", "expression", "looks", "aesthetic"))
    assert b["summary"]["summary_text"] == "" and a["summary"] is None


def test_label_lines(records):
    seen = records["a"]["semantic"]
    assert seen["top_labels_display"] == "dog (0.50), cat (0.00)" and seen["ai_tags_json"] == "[]" and seen["ai_tags_display"] == ""
    assert seen["contains_people"] == 1 and seen["scene_type"] == ""
    odd = records["b"]["semantic"]
    assert odd["top_labels_json"] == "no list" and odd["top_labels_display"] == "" == odd["ai_tags_display"]
