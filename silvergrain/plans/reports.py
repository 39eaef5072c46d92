"""Label frequencies, audits, work lists and table maintenance."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import audit, detail, frequency, ranking_scores, sidecars
from silvergrain.plans.oracle import view
from silvergrain.plans.registry import query
from silvergrain.session import shared_folder
from silvergrain.sources.tables import VersionedTable

_FLAG_ARMS = " UNION ALL ".join(
    f"SELECT '{f}' AS flag, '{f.replace('contains_', '').replace('is_', '').replace('_like', '').title()}' AS title,"
    f" {i} AS nth, count(*) FILTER ({f} = 1) AS flag_count, count(*) AS total FROM semantic_scores"
    for i, f in enumerate(frequency.FLAGS))
view("o_flags", _FLAG_ARMS)


@query("flag_counts", "AGG6", "PRJ20", oracle="""
SELECT flag, title, flag_count, round(100.0::DOUBLE * flag_count / total, 6) AS percent FROM o_flags""")
def flag_counts(a) -> DataFrame:
    return frequency.flag_counts(a.semantic)


view("o_scenes", r"""
SELECT lower(trim(regexp_replace(scene_type, '\s+', ' ', 'g'))) AS scene_type, count(*) AS image_count
FROM semantic_scores WHERE trim(scene_type) <> '' GROUP BY 1""")


@query("scene_stats", "AGG7", "PRJ19", oracle="""
SELECT * FROM o_scenes WHERE image_count >= 10 ORDER BY image_count DESC, scene_type DESC LIMIT 20""")
def scene_stats(a) -> DataFrame:
    return frequency.scene_frequency(a.semantic)


view("o_label_rows", r"""
WITH p AS (SELECT sha1, from_json(CASE WHEN json_valid(top_labels_json) THEN top_labels_json ELSE '[]' END,
                                  '[{"label":"VARCHAR","score":"DOUBLE"}]') AS l FROM semantic_scores),
u AS (SELECT sha1, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM p)
SELECT sha1, pos, lower(trim(regexp_replace(item.label, '\s+', ' ', 'g'))) AS label, item.score AS score FROM u""")

view("o_label_stats", """
SELECT label, count(DISTINCT sha1) AS image_count, count(*) AS occurrence_count, count(*) FILTER (pos = 1) AS top1_count,
  round(avg(score), 6) AS avg_score, max(score) AS max_score FROM o_label_rows GROUP BY label""")


@query("label_stats", "AGG8", oracle="SELECT * FROM o_label_stats")
def label_stats(a) -> DataFrame:
    return frequency.label_stats(a.semantic).withColumn("avg_score", F.round("avg_score", 6))


view("o_tag_stats", r"""
WITH u AS (SELECT sha1, lower(trim(unnest(from_json(ai_tags_json, '["VARCHAR"]')))) AS tag FROM semantic_scores
           WHERE ai_tags_json IS NOT NULL)
SELECT tag, count(*) AS occurrence_count, count(DISTINCT sha1) AS image_count,
  round(100.0::DOUBLE * count(DISTINCT sha1) / (SELECT count(*) FROM semantic_scores), 6) AS coverage FROM u GROUP BY tag""")


@query("ai_tag_stats", "AGG9", oracle="SELECT * FROM o_tag_stats")
def ai_tag_stats(a) -> DataFrame:
    return frequency.tag_stats(a.semantic)


@query("config_lists", "AGG10", oracle="""
SELECT 'label' AS kind, row_number() OVER (ORDER BY image_count DESC, top1_count DESC, avg_score DESC, label DESC) AS rank,
  label AS name FROM o_label_stats WHERE image_count >= 10 QUALIFY rank <= 20
UNION ALL SELECT 'tag', row_number() OVER (ORDER BY image_count DESC, tag DESC) AS r, tag FROM o_tag_stats
WHERE image_count >= 10 QUALIFY r <= 20
UNION ALL SELECT 'scene', row_number() OVER (ORDER BY image_count DESC, scene_type DESC) AS r, scene_type FROM o_scenes
WHERE image_count >= 10 QUALIFY r <= 20
UNION ALL SELECT 'flag', row_number() OVER (ORDER BY nth), flag FROM o_flags WHERE flag_count >= 10""")
def config_lists(a) -> DataFrame:
    return frequency.config_lists(a.semantic)


HINT = "(contains(lower(coalesce(rel_fqn, '')), 'undated') OR contains(lower(coalesce(path_tags, '')), 'undated'))"
ZERO = "final_dt = '0000-00-00 00:00:00'"
AUDIT = ", ".join(audit.AUDIT_COLUMNS)
#: Size of the plain sample, an argument of the report.
SAMPLE_ROWS = 5000

view("o_totals", f"""
SELECT count(*) AS total_rows, count(*) FILTER (is_deleted = 0) AS active_rows, count(*) FILTER (is_deleted <> 0) AS deleted_rows,
  count(*) FILTER ({ZERO}) AS zero_date_rows, count(*) FILTER ({HINT}) AS rows_with_undated_hint,
  count(*) FILTER ({HINT} AND {ZERO}) AS undated_hint_and_zero_date,
  count(*) FILTER ({HINT} AND NOT {ZERO}) AS undated_hint_but_nonzero_date FROM media""")


@query("audit_summary", "SUM1", oracle="SELECT * FROM o_totals")
def audit_summary(a) -> DataFrame:
    return audit.totals(a.media)


@query("dt_source_counts", "SUM2", oracle="SELECT dt_source, count(*) AS n FROM media GROUP BY 1")
def dt_source_counts(a) -> DataFrame:
    return audit.source_counts(a.media)


view("o_tag_counts", "SELECT tag, count(*) AS n FROM o_raw_tags GROUP BY 1")


@query("raw_tag_counts", "SUM3", oracle="SELECT * FROM o_tag_counts")
def raw_tag_counts(a) -> DataFrame:
    return audit.raw_tag_counts(a.media)


view("o_anomalies", f"""
SELECT {AUDIT} FROM media WHERE is_deleted = 0 AND {HINT} AND NOT {ZERO}""")
view("o_zero_no_hint", f"""
SELECT {AUDIT} FROM media WHERE is_deleted = 0 AND NOT {HINT} AND {ZERO}""")
view("o_sample", f"SELECT {AUDIT} FROM media ORDER BY final_dt DESC, rel_fqn, sha1 LIMIT {SAMPLE_ROWS}")


@query("undated_anomalies", "FIL8", oracle="SELECT * FROM o_anomalies")
def undated_anomalies(a) -> DataFrame:
    return audit.dated_with_hint(a.media)


@query("zero_date_no_hint", "FIL9", oracle="SELECT * FROM o_zero_no_hint")
def zero_date_no_hint(a) -> DataFrame:
    return audit.zero_date_without_hint(a.media)


@query("archive_sample", "FIL10", oracle="SELECT * FROM o_sample")
def archive_sample(a) -> DataFrame:
    return audit.sample(a.media, SAMPLE_ROWS)


def _json_line(section: str, source: str) -> str:
    """Section rows as the JSON text Spark writes: compact, null fields left out."""
    return f"SELECT '{section}' AS section, to_json(t)::VARCHAR AS line FROM {source} t"


_AUDIT_JSON = ("'{' || concat_ws(',', " + ", ".join(
    f"'\"{c}\":' || " + ("is_deleted::VARCHAR" if c == "is_deleted" else f"to_json({c})::VARCHAR")
    for c in audit.AUDIT_COLUMNS) + ") || '}'")


@query("debug_report", "SNK8", oracle=" UNION ALL ".join(
    [_json_line("summary", "o_totals"), _json_line("dt_source_breakdown",
     "(SELECT dt_source, count(*) AS n FROM media GROUP BY 1)"), _json_line("top_tags", "o_tag_counts")]
    + [f"SELECT '{s}', {_AUDIT_JSON} FROM {v}" for s, v in
       [("undated_anomalies", "o_anomalies"), ("zero_date_without_hint", "o_zero_no_hint"), ("sample", "o_sample")]]))
def debug_report(a) -> DataFrame:
    return audit.report(a.media, SAMPLE_ROWS)


# --- work lists ------------------------------------------------------------------

@query("todo_version", "JON2", oracle="""
SELECT sha1, rel_fqn FROM o_active WHERE sha1 NOT IN (SELECT sha1 FROM image_scores WHERE model_version = 'technical_v1')""")
def todo_version(a) -> DataFrame:
    return sidecars.todo_by_version(a.active, a.technical, "technical_v1")


@query("todo_presence", "JON3", oracle="""
SELECT sha1, rel_fqn FROM o_active WHERE sha1 NOT IN (SELECT sha1 FROM face_expression)
  AND sha1 IN (SELECT sha1 FROM image_faces)""")
def todo_presence(a) -> DataFrame:
    return sidecars.todo_by_presence(a.active, a.faces, a.expression)


@query("todo_warnings", "JON4", "SRC4", oracle="""
SELECT m.sha1, m.rel_fqn FROM o_active m LEFT JOIN semantic_scores s ON s.sha1 = m.sha1 AND s.model_version = 'semantic_v1'
WHERE s.sha1 IS NULL OR s.warnings <> ''""")
def todo_warnings(a) -> DataFrame:
    return sidecars.todo_by_warnings(a.active, a.semantic, "semantic_v1")


@query("todo_no_retry", "JON4", oracle="""
SELECT m.sha1, m.rel_fqn FROM o_active m LEFT JOIN ai_summaries s ON s.sha1 = m.sha1 AND s.model_version = 'caption_v1'
WHERE s.sha1 IS NULL""")
def todo_no_retry(a) -> DataFrame:
    return sidecars.todo_by_warnings(a.active, a.summaries, "caption_v1", retry=False)


@query("todo_patterns", "JON5", oracle="""
SELECT m.sha1, m.rel_fqn FROM o_active m LEFT JOIN aesthetic_scores s USING (sha1)
WHERE s.sha1 IS NULL OR s.model_version <> 'aesthetic_v1' OR s.warnings LIKE '%clip_inference_failed%'""")
def todo_patterns(a) -> DataFrame:
    return sidecars.todo_by_patterns(a.active, a.aesthetic, "aesthetic_v1")


# --- joined records ----------------------------------------------------------------

@query("wide_record", "JON7", oracle="""
WITH b AS (SELECT sha1, string_agg(printf('%d:%d,%d,%d,%d', face_index, x, y, w, h), ';' ORDER BY face_index) AS boxes
           FROM image_faces GROUP BY 1),
l AS (SELECT sha1, string_agg(printf('%d:%.4f', face_index, expression_score), ';' ORDER BY face_index) AS looks
      FROM face_expression GROUP BY 1)
SELECT m.sha1, m.original_filename, coalesce(printf('%.4f', t.technical_score), '') AS technical_text,
  coalesce(f.face_count, 0) AS face_count, coalesce(b.boxes, '') AS boxes, coalesce(l.looks, '') AS looks,
  round(e.people_moment_score, 6) AS people_moment_score, round(a.overall_aesthetic_score, 6) AS overall_aesthetic_score,
  round(s.semantic_score, 6) AS semantic_score, coalesce(s.scene_type, '') AS scene_type, coalesce(c.summary_text, '') AS summary_text
FROM o_active m LEFT JOIN image_scores t USING (sha1) LEFT JOIN image_face_summary f USING (sha1) LEFT JOIN b USING (sha1)
LEFT JOIN l USING (sha1) LEFT JOIN o_expr_summary e USING (sha1) LEFT JOIN aesthetic_scores a USING (sha1)
LEFT JOIN semantic_scores s USING (sha1) LEFT JOIN ai_summaries c USING (sha1)""")
def wide_record(a) -> DataFrame:
    rows = sidecars.wide_record(a.active, a.technical, a.face_summary, a.faces, a.expression,
                                ranking_scores.expression_summary(a.expression), a.aesthetic, a.semantic, a.summaries)
    box = lambda s: F.format_string("%d:%d,%d,%d,%d", s["face_index"], s["x"], s["y"], s["w"], s["h"])
    look = lambda s: F.format_string("%d:%.4f", s["face_index"], s["expression_score"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "sha1", "original_filename",
        F.when(F.col("technical_score").isNull(), "").otherwise(F.format_string("%.4f", "technical_score"))
        .alias("technical_text"),
        F.coalesce("face_count", F.lit(0)).alias("face_count"),
        blank(F.array_join(F.transform("boxes", box), ";")).alias("boxes"),
        blank(F.array_join(F.transform("looks", look), ";")).alias("looks"),
        F.round("people_moment_score", 6).alias("people_moment_score"),
        F.round("overall_aesthetic_score", 6).alias("overall_aesthetic_score"),
        F.round("semantic_score", 6).alias("semantic_score"), blank(F.col("scene_type")).alias("scene_type"),
        blank(F.col("summary_text")).alias("summary_text"))


def _fixed(table: str, **places: int) -> str:
    """Oracle columns: measures as text with so many decimals, blank where there is none."""
    return ", ".join(f"CASE WHEN {table}.sha1 IS NOT NULL THEN coalesce(printf('%.{n}f', {table}.{c}::DOUBLE), '') END"
                     f" AS {table}_{c}" for c, n in places.items())


def _plain(table: str, *columns: str) -> str:
    return ", ".join(f"CASE WHEN {table}.sha1 IS NOT NULL THEN coalesce({table}.{c}::VARCHAR, '') END AS {table}_{c}"
                     for c in columns)


def _numbers(table: str, *columns: str) -> str:
    return ", ".join(f"{table}.{c} AS {table}_{c}" for c in columns)


_SCORERS = ["*", "CASE WHEN sha1 < '8' THEN 'blend' END AS scorer_name", "'model ' || substr(sha1, 1, 1) AS model_name"]
_NORMS = ["*", "x / img_width AS x_norm", "y / img_height AS y_norm", "w / img_width AS w_norm", "h / img_height AS h_norm"]
_SHARES = ("x_norm", "y_norm", "w_norm", "h_norm", "area_ratio")
_LOOKS = ("smile_score", "eyes_open_score", "expression_score", "confidence")
_EXPRESSION = ("best_face_expression_score", "avg_top2_face_expression_score", "prominent_face_expression_score",
               "people_moment_score")
_EXPRESSION_COUNTS = ("face_count_scored", "smiling_face_count", "eyes_open_face_count", "good_expression_face_count")


@query("detail_record", "PRJ31", "JON7", oracle=rf"""
WITH tags AS (
  SELECT sha1, string_agg(tag, ', ' ORDER BY tag) AS tags FROM (
    SELECT DISTINCT sha1, array_to_string(list_transform(regexp_extract_all(lower(tag), '(\p{{L}}+|\P{{L}}+)'),
        lambda r: upper(r[1]) || r[2:]), '') AS tag
    FROM (SELECT sha1, trim(unnest(string_split(coalesce(path_tags, '') || ',' || coalesce(custom_tags, ''), ','))) AS tag
          FROM media)
    WHERE tag <> '' AND NOT regexp_full_match(tag, '\d{{4}}')
      AND lower(tag) NOT IN ('pictures', 'photos', 'photographs', 'media', 'images', 'topaz-undated')) GROUP BY 1),
links AS (SELECT sha1, min(coord_key) AS coord_key, min_by(source_lat, coord_key) AS source_lat,
            min_by(source_lon, coord_key) AS source_lon FROM photo_geo JOIN geo_cache USING (coord_key) GROUP BY 1),
place AS (SELECT *, CASE WHEN city <> '' THEN city WHEN town <> '' THEN town WHEN village <> '' THEN village
            WHEN hamlet <> '' THEN hamlet ELSE suburb END AS locality FROM links JOIN geo_cache USING (coord_key)),
boxes AS (
  SELECT sha1, string_agg(printf('%d:%d,%d,%d,%d/%d,%d', face_index, x, y, w, h, img_width, img_height)
    || printf(' %.12f %.12f %.12f %.12f %.12f', x_norm, y_norm, w_norm, h_norm, area_ratio), ';' ORDER BY face_index) AS boxes
  FROM (SELECT {', '.join(_NORMS)} FROM image_faces) GROUP BY 1),
looks AS (
  SELECT sha1, string_agg(printf('%d %.9f %.9f %.9f %.9f ', face_index, {', '.join(_LOOKS)}) || model_version, ';'
    ORDER BY face_index) AS looks FROM face_expression GROUP BY 1),
aesthetic AS (SELECT {', '.join(_SCORERS)} FROM aesthetic_scores),
semantic AS (
  SELECT {', '.join(_SCORERS)}, CASE WHEN json_valid(top_labels_json) THEN coalesce(array_to_string(list_transform(
      from_json(top_labels_json, '[{{"label":"VARCHAR","score":"DOUBLE"}}]')[1:6],
      lambda x: x.label || ' (' || printf('%.2f', x.score) || ')'), ', '), '') ELSE '' END AS top_labels_display,
    CASE WHEN ai_tags_json IS NULL THEN '' ELSE array_to_string(from_json(ai_tags_json, '["VARCHAR"]'), ', ') END
      AS ai_tags_display FROM semantic_scores)
SELECT overview.sha1, {_plain('overview', 'original_filename', 'final_dt', 'dt_source', 'path_tags', 'custom_tags', 'custom_notes',
                              'file_size')},
  replace(overview.rel_fqn, chr(92), '/') AS overview_rel_fqn, coalesce(tags.tags, '') AS overview_tags,
  overview.is_deleted AS overview_is_deleted, coalesce(overview.extension, '') AS overview_file_extension,
  CASE WHEN overview.width IS NULL OR overview.height IS NULL THEN '' ELSE printf('%d x %d', overview.width, overview.height) END
    AS overview_dimensions,
  {_fixed('overview', latitude=6, longitude=6, altitude_meters=1)},
  CASE WHEN coalesce(abs(overview.latitude) > 0.000001 OR abs(overview.longitude) > 0.000001, FALSE) THEN 'Yes' ELSE 'No' END
    AS overview_has_valid_gps,
  {_plain('place', 'formatted', 'place_name', 'road', 'county', 'state', 'country', 'city', 'town', 'village', 'hamlet',
          'suburb', 'locality', 'coord_key', 'lat_rounded', 'lon_rounded')}, {_fixed('place', source_lat=6, source_lon=6)},
  {_numbers('technical', 'width', 'height')}, {_plain('technical', 'model_version', 'scored_at')},
  {_fixed('technical', sharpness=2, contrast=2, brightness=2, edge_density=4, resolution_score=4, technical_score=4)},
  {_numbers('faces', 'width', 'height', 'face_count', 'prominent_face_count', 'has_prominent_face')},
  {_fixed('faces', largest_face_area_ratio=4)}, {_plain('faces', 'model_version', 'scored_at')},
  boxes.boxes, looks.looks, {', '.join(f'expression.{c}::BIGINT AS expression_{c}' for c in _EXPRESSION_COUNTS)},
  {', '.join(f'round(expression.{c}, 9) AS expression_{c}' for c in _EXPRESSION)},
  {_fixed('aesthetic', aesthetic_score=4, composition_score=4, subject_prominence_score=4, interest_score=4, saliency_score=4,
          overall_aesthetic_score=4)},
  {_plain('aesthetic', 'scorer_name', 'model_name', 'model_version', 'scored_at', 'warnings')},
  {_fixed('semantic', semantic_score=4)},
  {_plain('semantic', 'scene_type', 'scorer_name', 'model_name', 'model_version', 'scored_at', 'warnings', 'top_labels_display',
          'ai_tags_display')},
  CASE WHEN semantic.sha1 IS NOT NULL THEN coalesce(semantic.top_labels_json, '[]') END AS semantic_top_labels_json,
  CASE WHEN semantic.sha1 IS NOT NULL THEN coalesce(semantic.ai_tags_json, '[]') END AS semantic_ai_tags_json,
  {_numbers('semantic', *frequency.FLAGS)},
  {_plain('summary', 'summary_text', 'model_name', 'model_version', 'scored_at', 'warnings')}
FROM media overview LEFT JOIN tags USING (sha1) LEFT JOIN place ON place.sha1 = overview.sha1
LEFT JOIN image_scores technical ON technical.sha1 = overview.sha1 LEFT JOIN image_face_summary faces ON faces.sha1 = overview.sha1
LEFT JOIN boxes ON boxes.sha1 = overview.sha1 LEFT JOIN looks ON looks.sha1 = overview.sha1
LEFT JOIN o_expr_summary expression ON expression.sha1 = overview.sha1 LEFT JOIN aesthetic ON aesthetic.sha1 = overview.sha1
LEFT JOIN semantic ON semantic.sha1 = overview.sha1 LEFT JOIN ai_summaries summary ON summary.sha1 = overview.sha1""")
def detail_record(a) -> DataFrame:
    """Every field of every photo's record, one column each; faces as text."""
    record = detail.detail_record(
        a.media, a.photo_geo, a.geo_cache, a.technical, a.face_summary, a.faces.selectExpr(*_NORMS),
        ranking_scores.expression_summary(a.expression), a.expression, a.aesthetic.selectExpr(*_SCORERS),
        a.semantic.selectExpr(*_SCORERS), a.summaries)
    box = lambda s: F.format_string("%d:%d,%d,%d,%d/%d,%d" + " %.12f" * 5, *[s[c] for c in (
        "face_index", "x", "y", "w", "h", "img_width", "img_height", *_SHARES)])
    look = lambda s: F.format_string("%d" + " %.9f" * 4 + " %s", s["face_index"], *[s[c] for c in _LOOKS], s["model_version"])
    flat = [F.col(f"{part}.{field}").alias(f"{part}_{field}")
            for part in ("overview", "place", "technical", "faces", "aesthetic", "semantic", "summary")
            for field in record.schema[part].dataType.names]
    return record.select(
        "sha1", *flat, F.array_join(F.transform("boxes", box), ";").alias("boxes"),
        F.array_join(F.transform("looks", look), ";").alias("looks"),
        *[F.col(f"expression.{c}").cast("long").alias(f"expression_{c}") for c in _EXPRESSION_COUNTS],
        *[F.round(F.col(f"expression.{c}"), 9).alias(f"expression_{c}") for c in _EXPRESSION])


@query("faces_by_area", "JON9", oracle="""
SELECT sha1, rel_fqn, string_agg(face_index::VARCHAR, ',' ORDER BY area_ratio DESC, face_index) AS face_order
FROM o_active JOIN image_faces USING (sha1) GROUP BY 1, 2""")
def faces_by_area(a) -> DataFrame:
    return sidecars.faces_by_area(a.active, a.faces).select(
        "sha1", "rel_fqn", F.array_join(F.transform("faces", lambda s: s["face_index"].cast("string")), ",")
        .alias("face_order"))


@query("people_override", "JON10", oracle="""
SELECT s.sha1, CASE WHEN f.face_count > 0 THEN 1 ELSE s.contains_people END AS contains_people
FROM semantic_scores s LEFT JOIN image_face_summary f USING (sha1)""")
def people_override(a) -> DataFrame:
    return sidecars.people_override(a.semantic, a.face_summary).select("sha1", "contains_people")


# --- table maintenance -----------------------------------------------------------------

def committed(a, first: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Commits a table, then its next version, and reads that back."""
    table = VersionedTable(a.spark, shared_folder(a.spark, "table"))
    table.commit(first)
    table.commit(change(table.current()))
    return table.current()


def _fresh_scores(a) -> DataFrame:
    """A later scoring run: every photo of the old model version, now rescored."""
    return (a.technical.where("model_version = 'technical_v0'")
            .withColumns({"technical_score": F.round(F.col("technical_score") / 2, 9),
                          "model_version": F.lit("technical_v1")})
            .unionByName(a.media.where("is_deleted = 1").select(
                "sha1", F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(0.0).alias("sharpness"),
                F.lit(0.0).alias("contrast"), F.lit(0.0).alias("brightness"), F.lit(0.0).alias("edge_density"),
                F.lit(0.0).alias("resolution_score"), F.lit(0.5).alias("technical_score"),
                F.lit("technical_v1").alias("model_version"), F.lit("").alias("scored_at"))))


view("o_fresh", """
SELECT sha1, technical_score / 2 AS technical_score, 'technical_v1' AS model_version FROM image_scores
WHERE model_version = 'technical_v0' AND sha1 NOT IN (SELECT sha1 FROM media WHERE is_deleted = 1)
UNION ALL SELECT sha1, 0.5, 'technical_v1' FROM media WHERE is_deleted = 1""")


@query("upsert", "SNK1", "SNK3", oracle="""
SELECT sha1, round(technical_score, 6) AS technical_score, model_version FROM (
  SELECT sha1, technical_score, model_version FROM o_fresh UNION ALL
  SELECT sha1, technical_score, model_version FROM image_scores WHERE sha1 NOT IN (SELECT sha1 FROM o_fresh))""")
def upsert(a) -> DataFrame:
    new = _fresh_scores(a)
    # A photo that appears twice in the run keeps its placeholder row.
    out = committed(a, a.technical, lambda old: sidecars.upsert(old, new, "sha1", order=F.asc("width")))
    return out.select("sha1", F.round("technical_score", 6).alias("technical_score"), "model_version")


@query("insert_ignore", "SNK2", oracle="""
SELECT sha1, model_version FROM image_scores UNION ALL
SELECT DISTINCT sha1, model_version FROM o_fresh WHERE sha1 NOT IN (SELECT sha1 FROM image_scores)""")
def insert_ignore(a) -> DataFrame:
    new = sidecars.upsert(_fresh_scores(a).limit(0), _fresh_scores(a), "sha1", order=F.asc("width"))
    return committed(a, a.technical, lambda old: sidecars.insert_ignore(old, new, "sha1")).select("sha1", "model_version")


@query("replace_children", "SNK4", oracle="""
WITH p AS (SELECT sha1 FROM image_face_summary WHERE model_version = 'face_v0')
SELECT sha1, face_index, area_ratio, 'old' AS origin FROM image_faces WHERE sha1 NOT IN (SELECT sha1 FROM p)
UNION ALL SELECT sha1, face_index, area_ratio / 2, 'new' FROM image_faces
WHERE sha1 IN (SELECT sha1 FROM p) AND face_index < 2""")
def replace_children(a) -> DataFrame:
    parents = a.face_summary.where("model_version = 'face_v0'").select("sha1")
    fresh = (a.faces.join(parents, "sha1", "left_semi").where("face_index < 2")
             .select("sha1", "face_index", (F.col("area_ratio") / 2).alias("area_ratio"), F.lit("new").alias("origin")))
    old = a.faces.select("sha1", "face_index", "area_ratio", F.lit("old").alias("origin"))
    return committed(a, old, lambda rows: sidecars.replace_children(rows, parents, fresh))


@query("schema_upgrade", "SNK5", oracle="""
SELECT sha1, model_version, '' AS candidate_hash, 'v1' AS selection_version FROM image_scores""")
def schema_upgrade(a) -> DataFrame:
    return sidecars.with_new_columns(a.technical.select("sha1", "model_version"), {
        "candidate_hash": F.lit(""), "selection_version": F.lit("v1"), "model_version": F.lit("never used")})


@query("run_history", "SNK6", oracle="""
WITH r AS (SELECT 'technical' AS model_name, model_version, min(scored_at) AS started_at, max(scored_at) AS completed_at,
    count(*) AS images_attempted, count(*) AS images_scored, 0 AS images_failed, 1 AS turn FROM image_scores GROUP BY 2
  UNION ALL SELECT 'semantic', model_version, min(scored_at), max(scored_at), count(*),
    count(*) FILTER (NOT contains(warnings, 'failed')), count(*) FILTER (contains(warnings, 'failed')), 2
  FROM semantic_scores GROUP BY 2)
SELECT row_number() OVER (ORDER BY turn, model_version) AS run_id, started_at, completed_at, model_name, model_version,
  images_attempted, images_scored, images_failed, 'rebuilt from stored scores' AS notes FROM r""")
def run_history(a) -> DataFrame:
    """The scoring runs of two signal tables, each appended to one ledger."""
    ledger = VersionedTable(a.spark, shared_folder(a.spark, "ledger"))
    technical = a.technical.withColumn("warnings", F.lit(""))
    for rows, model in ((technical, "technical"), (a.semantic, "semantic")):
        runs = sidecars.ledger_rows(rows, model, "rebuilt from stored scores")
        ledger.commit(sidecars.appended_runs(ledger.current() if ledger.log().count() else None, runs))
    return ledger.current()


@query("run_ledger", "SNK6", oracle="""
SELECT count(*) AS images_attempted, count(*) FILTER (NOT contains(warnings, 'failed')) AS images_scored,
  count(*) FILTER (contains(warnings, 'failed')) AS images_failed, 'semantic' AS model_name FROM semantic_scores""")
def run_ledger(a) -> DataFrame:
    return sidecars.run_ledger(a.semantic, "semantic")


@query("summary_export", "SNK7", oracle="""
SELECT sha1, trim(summary_text) AS summary, model_name AS model, model_version, scored_at AS timestamp, warnings
FROM ai_summaries WHERE summary_text <> ''""")
def summary_export(a) -> DataFrame:
    return sidecars.summary_export(a.summaries)


@query("optional_sidecar", "SRC3", oracle="""
SELECT m.sha1, 0 AS in_missing, (t.technical_score IS NOT NULL)::INT AS in_present, count(*) OVER () AS rows_joined
FROM o_active m LEFT JOIN image_scores t USING (sha1)""")
def optional_sidecar(a) -> DataFrame:
    """One table that was never written, and one that was, with blank and missing keys in it."""
    schema = "sha1 string, score double"
    missing = sidecars.optional_table(a.spark, f"{a.root}/no_such_table.parquet", schema, "sha1")
    path = shared_folder(a.spark, "sidecar")
    written = a.technical.select("sha1", F.col("technical_score").alias("score"))
    blank = written.select(F.when(F.col("score") > 0.5, "").alias("sha1"), "score")
    written.unionByName(blank).write.parquet(path)
    present = sidecars.optional_table(a.spark, path, schema, "sha1").withColumnRenamed("score", "found")
    rows = a.active.select("sha1").join(missing, "sha1", "left").join(present, "sha1", "left").select(
        "sha1", F.col("score").isNotNull().cast("int").alias("in_missing"), F.col("found").isNotNull().cast("int").alias("in_present"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows_joined"))))  # one row
