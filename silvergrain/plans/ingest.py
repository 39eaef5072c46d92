"""Ingest, naming, zero-shot and grid queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import time
from silvergrain.operators import grids, ingest, library
from silvergrain.plans.browse import _request
from silvergrain.plans.oracle import view
from silvergrain.plans.registry import query
from silvergrain.session import shared_folder
from silvergrain.sources import listing


def files(a) -> DataFrame:
    return a.derived("ingest_files")


view("o_files", r"""
SELECT *, regexp_extract(rel_path, '[^/]*$') AS file_name,
  CASE WHEN contains(rel_path, '/') THEN source || '/' || regexp_replace(rel_path, '/[^/]*$', '') ELSE source END AS archive_dir,
  source || '/' || rel_path AS rel_fqn, lower(regexp_extract(rel_path, '\.[^./]*$')) AS ext,
  CASE WHEN regexp_matches(rel_path, '(^|/)_') THEN 'private' WHEN regexp_matches(lower(rel_path), '\.(jpg|jpeg)$') THEN 'photo'
    WHEN regexp_matches(lower(rel_path), '\.(png|heic)$') THEN 'other_image' ELSE 'ignored' END AS kind
FROM ingest_files""")


@query("file_manifest", "SRC2", "PRJ3", "PRJ17", oracle="""
SELECT file_id, rel_fqn, replace(replace(replace(archive_dir, '_', ' '), '-', ' '), '/', ', ') AS path_tags,
  upper(ext[2:]) AS extension, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS mtime_utc
FROM o_files WHERE kind = 'photo'""")
def file_manifest(a) -> DataFrame:
    return ingest.manifest(files(a)).select("file_id", "rel_fqn", "path_tags", "extension", "mtime_utc")


@query("tree_listing", "SRC2", oracle="""
SELECT DISTINCT source, rel_path, length(rel_path) AS file_size, kind FROM o_files WHERE kind <> 'private'""")
def tree_listing(a) -> DataFrame:
    """The files of the three sources, written as folder trees and listed again."""
    base = shared_folder(a.spark, "tree")
    rows = files(a).select("source", "rel_path").distinct()
    listing.write_tree(rows.select(F.concat_ws("/", "source", "rel_path").alias("rel_path"), F.col("rel_path").alias("content")),
                       base)
    found = listing.list_tree(a.spark, {name: f"{base}/{name}" for name in ("takeout", "camera", "phone")}, tasks=8)
    return found.select("source", "rel_path", "file_size", ingest.file_kind(F.col("rel_path")).alias("kind"))


@query("listing_counts", "SRC2", "SUM4", oracle="""
SELECT source, count(*) AS examined, count(*) FILTER (kind = 'photo') AS photos,
  count(*) FILTER (kind = 'other_image') AS other_images, count(*) FILTER (kind = 'ignored') AS ignored
FROM (SELECT DISTINCT source, rel_path, kind FROM o_files WHERE kind <> 'private') GROUP BY 1""")
def listing_counts(a) -> DataFrame:
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return tree_listing(a).groupBy("source").agg(F.count(F.lit(1)).alias("examined"), count("photo").alias("photos"),
                                                 count("other_image").alias("other_images"), count("ignored").alias("ignored"))


def _good(ts: str) -> str:
    return f"CASE WHEN year({ts}) BETWEEN 1950 AND 2026 THEN {ts} END"


def _camera(column: str) -> str:
    bare = f"trim({column})"
    return (f"coalesce({_good(f'''try_strptime({bare}, '%Y:%m:%d %H:%M:%S')''')}, "
            f"{_good(f'''try_strptime({bare}, '%Y-%m-%d %H:%M:%S')''')}, "
            f"{_good(f'''CAST(try_cast({bare} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)''')})")


@query("exif_dates", "PRJ11", oracle=f"""
SELECT file_id, strftime({_camera('exif_original')}, '%Y-%m-%d %H:%M:%S') AS original,
  strftime({_camera('exif_digitized')}, '%Y-%m-%d %H:%M:%S') AS digitized,
  strftime({_camera('exif_plain')}, '%Y-%m-%d %H:%M:%S') AS plain FROM ingest_files""")
def exif_dates(a) -> DataFrame:
    shown = lambda c: time.stamp_text(time.camera_timestamp(F.col(c)))
    return files(a).select("file_id", shown("exif_original").alias("original"),
                           shown("exif_digitized").alias("digitized"), shown("exif_plain").alias("plain"))


_NAMES = "|".join(time.XMP_DATE_NAMES)
# Attributes come before elements, each kind in the order of the packet; the first value that is a date counts.
view("o_xmp", f"""
WITH f AS (SELECT file_id, kind, hit, pos FROM ingest_files,
    LATERAL (SELECT 0 AS kind, unnest(regexp_extract_all(xmp, '({_NAMES})\\s*=\\s*"[^"]+"')) AS hit,
                    generate_subscripts(regexp_extract_all(xmp, '({_NAMES})\\s*=\\s*"[^"]+"'), 1) AS pos
             UNION ALL
             SELECT 1, unnest(regexp_extract_all(xmp, '<({_NAMES})>[^<]+</')),
                    generate_subscripts(regexp_extract_all(xmp, '<({_NAMES})>[^<]+</'), 1))),
v AS (SELECT file_id, kind, pos, CASE kind WHEN 0 THEN split_part(hit, '"', 2) ELSE split_part(split_part(hit, '>', 2), '<', 1) END AS t
      FROM f)
SELECT file_id, arg_min(ts, (kind, pos)) AS xmp_ts FROM (SELECT file_id, kind, pos, {_camera('t')} AS ts FROM v)
WHERE ts IS NOT NULL GROUP BY file_id""")


@query("xmp_dates", "PRJ13", oracle="""
SELECT file_id, strftime(xmp_ts, '%Y-%m-%d %H:%M:%S') AS xmp_dt FROM o_xmp""")
def xmp_dates(a) -> DataFrame:
    return files(a).select("file_id", time.stamp_text(time.xmp_timestamp(F.col("xmp"))).alias("xmp_dt")).where(
        "xmp_dt IS NOT NULL")


def _name_date(*runs: int) -> str:
    """The first place of a layout, its neighbours taken along: RE2 has no look-around."""
    digits = "[-_]".join([f"20[0-9]{{{runs[0] - 2}}}", *[f"[0-9]{{{n}}}" for n in runs[1:]]])
    found = f"regexp_extract(file_name, '(?:^|[^0-9])({digits})(?:[^0-9]|$)', 1)"
    return _good(f"try_strptime(nullif(translate({found}, '-_', ''), ''), '%Y%m%d%H%M%S')")


view("o_name_dates", f"SELECT file_id, coalesce({_name_date(8, 6)}, {_name_date(4, 2, 2, 2, 2, 2)}) AS name_ts FROM o_files")


@query("filename_dates", "PRJ14", oracle="""
SELECT file_id, strftime(name_ts, '%Y-%m-%d %H:%M:%S') AS name_dt FROM o_name_dates""")
def filename_dates(a) -> DataFrame:
    return files(a).select("file_id", time.stamp_text(time.from_filename(F.substring_index("rel_path", "/", -1)))
                           .alias("name_dt"))


view("o_takeout", r"""
WITH t AS (SELECT json_path, try_cast(coalesce(json_text ->> '$.photoTakenTime.timestamp',
             json_text ->> '$.creationTime.timestamp', json_text ->> '$.timestamp') AS BIGINT) AS s FROM takeout_sidecars),
v AS (SELECT json_path, make_timestamp(s * 1000000) AS ts FROM t WHERE year(make_timestamp(s * 1000000)) BETWEEN 1950 AND 2026),
c AS (SELECT file_id, 0 AS p, rel_fqn || '.json' AS json_path FROM o_files WHERE kind = 'photo'
      UNION ALL SELECT file_id, 1, regexp_replace(rel_fqn, '\.[^./]*$', '') || '.json' FROM o_files WHERE kind = 'photo')
SELECT file_id, arg_min(ts, p) AS takeout_ts, regexp_extract(arg_min(json_path, p), '[^/]*$') AS takeout_name
FROM c JOIN v USING (json_path) GROUP BY file_id""")


@query("takeout_join", "PRJ15", "JON12", oracle="""
SELECT file_id, strftime(takeout_ts, '%Y-%m-%d %H:%M:%S') AS takeout_dt, takeout_name FROM o_takeout""")
def takeout_join(a) -> DataFrame:
    times = ingest.sidecar_times(ingest.manifest(files(a)), a.derived("takeout_sidecars"))
    return times.select("file_id", time.stamp_text(F.col("takeout_ts")).alias("takeout_dt"), "takeout_name")


@query("date_cascade", "PRJ16", "PRJ11", "PRJ13", "PRJ14", "PRJ15", "PRJ17", oracle=f"""
WITH j AS (SELECT f.*, x.xmp_ts, t.takeout_ts, t.takeout_name, d.name_ts, {_camera('exif_original')} AS e1,
    {_camera('exif_digitized')} AS e2, {_camera('exif_plain')} AS e3
  FROM o_files f LEFT JOIN o_xmp x USING (file_id) LEFT JOIN o_takeout t USING (file_id)
  LEFT JOIN o_name_dates d USING (file_id) WHERE kind = 'photo')
SELECT file_id, CASE WHEN contains(lower(archive_dir), 'undated') THEN '0000-00-00 00:00:00'
    ELSE strftime(coalesce(e1, e2, e3, xmp_ts, takeout_ts, name_ts, make_timestamp(mtime * 1000000)), '%Y-%m-%d %H:%M:%S') END
    AS final_dt,
  CASE WHEN contains(lower(archive_dir), 'undated') THEN 'Path Override: Undated' WHEN e1 IS NOT NULL THEN 'EXIF: DateTimeOriginal'
    WHEN e2 IS NOT NULL THEN 'EXIF: DateTimeDigitized' WHEN e3 IS NOT NULL THEN 'EXIF: DateTime' WHEN xmp_ts IS NOT NULL THEN 'XMP'
    WHEN takeout_ts IS NOT NULL THEN 'Google Takeout JSON: ' || takeout_name WHEN name_ts IS NOT NULL THEN 'Filename Pattern'
    ELSE 'File Modification' END AS dt_source FROM j""")
def date_cascade(a) -> DataFrame:
    photos = ingest.manifest(files(a))
    times = ingest.sidecar_times(photos, a.derived("takeout_sidecars"))
    return ingest.resolved_dates(photos, times).select("file_id", "final_dt", "dt_source")


@query("dms_to_degrees", "PRJ12", oracle="""
SELECT file_id, round(CASE WHEN lat_den <> 0 THEN (lat_deg + lat_min / 60 + lat_sec / lat_den / 3600)
    * CASE WHEN upper(lat_ref) = 'S' THEN -1 ELSE 1 END END, 9) AS latitude,
  round(alt_num / 10 * CASE WHEN alt_ref = 1 THEN -1 ELSE 1 END, 3) AS altitude_meters FROM ingest_files""")
def dms_to_degrees(a) -> DataFrame:
    return ingest.positions_from_exif(files(a)).select("file_id", F.round("latitude", 9).alias("latitude"),
                                                       F.round("altitude_meters", 3).alias("altitude_meters"))


def _known(a) -> DataFrame:
    """Contents the archive holds already."""
    return files(a).where("file_id % 14 = 0").select(F.col("content_sha1").alias("sha1"))


view("o_known", "SELECT DISTINCT content_sha1 AS sha1 FROM ingest_files WHERE file_id % 14 = 0")
view("o_good", """
SELECT * FROM o_files WHERE kind = 'photo' AND width >= 500 AND height >= 300""")
view("o_new", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_sha1 ORDER BY source_rank, rel_path, file_id) AS rn FROM o_good
  WHERE content_sha1 NOT IN (SELECT sha1 FROM o_known)) WHERE rn = 1""")


@query("ingest_dedupe", "JON11", "FIL11", "SNK2", oracle="SELECT file_id, content_sha1, rel_fqn FROM o_new")
def ingest_dedupe(a) -> DataFrame:
    photos = ingest.manifest(files(a))
    good = photos.where(ingest.admitted(photos).isNull())
    return ingest.first_of_each(good, _known(a)).select("file_id", "content_sha1", "rel_fqn")


@query("ingest_counters", "SUM4", "FIL11", oracle="""
SELECT count(*) AS examined, (SELECT count(*) FROM o_new WHERE file_id % 5 <> 0) AS new_added,
  (SELECT count(*) FROM o_new WHERE rel_fqn IN (SELECT rel_fqn FROM o_files WHERE file_id % 5 = 0)) AS healed,
  (SELECT count(*) FROM o_good) - (SELECT count(*) FROM o_new) AS duplicates,
  count(*) FILTER (kind = 'other_image') AS non_jpeg,
  count(*) FILTER (kind = 'photo' AND (width < 500 OR height < 300)) AS tiny,
  count(*) FILTER (kind = 'photo' AND width IS NULL) AS unreadable FROM o_files""".replace(
    "(SELECT count(*) FROM o_new WHERE file_id % 5 <> 0) AS new_added",
    "(SELECT count(*) FROM o_new WHERE rel_fqn NOT IN (SELECT rel_fqn FROM o_files WHERE file_id % 5 = 0)) AS new_added"))
def ingest_counters(a) -> DataFrame:
    archive = files(a).where("file_id % 5 = 0").select(F.concat_ws("/", "source", "rel_path").alias("rel_fqn"))
    return ingest.counters(files(a), _known(a), archive)


@query("heal_moved", "OPT4", oracle="""
WITH m AS (SELECT content_sha1 AS sha1, min(CASE WHEN file_id % 4 = 0 THEN 'gone/' ELSE '' END || rel_fqn) AS rel_fqn
           FROM o_good GROUP BY 1),
s AS (SELECT content_sha1 AS sha1, rel_fqn FROM o_good WHERE file_id % 3 <> 1)
SELECT m.sha1, coalesce(CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.sha1 = m.sha1 AND s.rel_fqn = m.rel_fqn)
                             THEN (SELECT min(rel_fqn) FROM s WHERE s.sha1 = m.sha1) END, m.rel_fqn) AS rel_fqn FROM m""")
def heal_moved(a) -> DataFrame:
    photos = ingest.manifest(files(a))
    good = photos.where(ingest.admitted(photos).isNull())
    stored = F.concat(F.when(F.col("file_id") % 4 == 0, "gone/").otherwise(""), F.col("rel_fqn"))
    media = good.groupBy(F.col("content_sha1").alias("sha1")).agg(F.min(stored).alias("rel_fqn"))
    return ingest.healed_paths(media, good.where("file_id % 3 <> 1"))


@query("folder_years", "OPT3", "OPT8", oracle=r"""
WITH f AS (SELECT *, regexp_extract_all(regexp_replace(web_path, '[^/]*$', ''), '(?:^|\D)((?:19|20)\d{2})(?:\D|$)', 1)[-1] AS fy
           FROM o_browse)
SELECT sha1, CASE WHEN fy IS NOT NULL AND final_dt[1:4] <> fy AND NOT has_gps THEN fy || '-01-01 00:00:00' ELSE final_dt END
    AS checked_dt,
  array_to_string(list_filter(list_transform(string_split(path_tags, ','), lambda t: trim(regexp_replace(
    regexp_replace(t, '(^|\D)\d{4}(\D|$)', '\1 \2', 'g'), '\s+', ' ', 'g'))), lambda t: t <> ''), ', ') AS bare_tags FROM f""")
def folder_years(a) -> DataFrame:
    folders = F.regexp_replace("web_path", "[^/]*$", "")
    return a.active.select(
        "sha1", ingest.date_with_folder_year(F.col("final_dt"), F.col("has_gps"), folders).alias("checked_dt"),
        ingest.tags_without_years(F.col("path_tags")).alias("bare_tags"))


def _flatten_input(a) -> DataFrame:
    """Trash and stash files by target folder; some names already look numbered."""
    name = F.when(F.col("file_size") % 7 == 0, F.concat(F.lit("a("), (F.col("file_size") % 9).cast("string"), F.lit(").jpg"))
                  ).otherwise(F.concat(F.lit("a"), F.when(F.col("file_size") % 3 == 0, "").otherwise(
                      (F.col("file_size") % 5).cast("string")), F.lit(".jpg")))
    return a.media.select(F.col("dt_source").alias("dest_dir"), name.alias("file_name"),
                          F.concat_ws("/", F.translate("rel_fqn", "\\", "/"), "sha1").alias("path"))


@query("flatten_manifest", "SNK11", oracle=r"""
WITH i AS (SELECT dt_source AS dest_dir, replace(rel_fqn, chr(92), '/') || '/' || sha1 AS path,
    CASE WHEN file_size % 7 = 0 THEN 'a(' || (file_size % 9) || ').jpg'
         ELSE 'a' || CASE WHEN file_size % 3 = 0 THEN '' ELSE (file_size % 5)::VARCHAR END || '.jpg' END AS file_name FROM media),
r AS (SELECT *, row_number() OVER (PARTITION BY dest_dir, file_name ORDER BY path) - 1 AS copy,
        file_name[1:-5] AS stem FROM i),
t AS (SELECT DISTINCT dest_dir, regexp_extract(stem, '^(.+)\([1-9]\d*\)$', 1) AS stem,
             try_cast(regexp_extract(stem, '\(([1-9]\d*)\)$', 1) AS BIGINT) AS n FROM r WHERE regexp_matches(stem, '^.+\([1-9]\d*\)$')),
free AS (SELECT d.dest_dir, d.stem, g.n, row_number() OVER (PARTITION BY d.dest_dir, d.stem ORDER BY g.n) AS k
         FROM (SELECT dest_dir, stem, max(copy) AS top FROM r WHERE copy > 0 GROUP BY 1, 2) d, LATERAL (SELECT unnest(range(1, d.top + 12)) AS n) g
         WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.dest_dir = d.dest_dir AND t.stem = d.stem AND t.n = g.n))
SELECT r.dest_dir, path, file_name, CASE WHEN copy = 0 THEN file_name ELSE r.stem || '(' || free.n || ').jpg' END AS target_name
FROM r LEFT JOIN free ON free.dest_dir = r.dest_dir AND free.stem = r.stem AND free.k = r.copy""")
def flatten_manifest(a) -> DataFrame:
    return ingest.flattened(_flatten_input(a))


_MEDIA_NAME = ("'clip_' || CAST(file_id AS STRING) || (CASE CAST(file_id % 5 AS INT) WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' "
               "WHEN 2 THEN '.jpg' WHEN 3 THEN '.txt' ELSE '.mkv' END)")
_TAKEN_NAME = ("'clip_' || CAST(file_id AS STRING) || (CASE WHEN k > 0 THEN '_' || CAST(k AS STRING) ELSE '' END)"
               " || (CASE CAST(file_id % 5 AS INT) WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' ELSE '.mkv' END)")


@query("media_routing", "SNK12", oracle=f"""
WITH f AS (SELECT file_id, 'd/' || {_MEDIA_NAME} AS rel_path, file_id % 5 AS r FROM ingest_files)
SELECT file_id, 'video' AS kind, CASE WHEN file_id % 3 = 0 THEN regexp_replace(rel_path, '(\\.[^.]*)$',
    '_' || CASE WHEN file_id % 4 = 2 THEN 1 ELSE file_id % 4 + 1 END || '\\1') ELSE rel_path END AS target_path
FROM f WHERE r IN (0, 1, 4)""")
def media_routing(a) -> DataFrame:
    """Videos to their target; a third of the targets is taken, some with numbered copies too."""
    rows = files(a).select("file_id")
    listed = rows.selectExpr("file_id", f"concat('d/', {_MEDIA_NAME}) AS rel_path")
    numbers = F.expr("CASE WHEN file_id % 4 = 2 THEN array(0L, 2L) ELSE sequence(0L, file_id % 4) END")
    there = (rows.where("file_id % 3 = 0 AND file_id % 5 IN (0, 1, 4)").withColumn("k", F.explode(numbers))
             .selectExpr(f"concat('d/', {_TAKEN_NAME}) AS rel_path"))
    return ingest.routed(listed, there).select("file_id", "kind", "target_path")


@query("media_routing_all", "SNK12", oracle=f"""
WITH f AS (SELECT file_id, 'd/' || {_MEDIA_NAME} AS rel_path, file_id % 5 AS r FROM ingest_files)
SELECT file_id, CASE WHEN r = 2 THEN 'image' ELSE 'video' END AS kind,
  CASE WHEN r = 2 AND file_id % 2 = 0 THEN replace(rel_path, '.jpg', '_1.jpg') ELSE rel_path END AS target_path
FROM f WHERE r <> 3""")
def media_routing_all(a) -> DataFrame:
    """Images and videos to their targets; half of the images find theirs taken."""
    rows = files(a).select("file_id")
    listed = rows.selectExpr("file_id", f"concat('d/', {_MEDIA_NAME}) AS rel_path")
    there = listed.where("file_id % 5 = 2 AND file_id % 2 = 0").select("rel_path")
    return ingest.routed(listed, there, move_images=True).select("file_id", "kind", "target_path")


# --- grid orders ---------------------------------------------------------------------

view("o_grid", """
SELECT b.sha1, b.year, b.final_dt, b.hero_score AS sort_quality, b.file_size::DOUBLE AS sort_size, b.final_dt AS sort_time,
  CASE WHEN b.has_gps THEN printf('%+011.6f|%+011.6f', b.latitude, b.longitude) ELSE '' END AS sort_location,
  coalesce(s.contains_animals, 0)::DOUBLE AS sort_animals, coalesce(f.face_count, 0)::DOUBLE AS sort_faces,
  coalesce(s.is_indoor_like, 0)::DOUBLE AS sort_indoor, coalesce(s.contains_text, 0)::DOUBLE AS sort_text,
  coalesce(s.is_outdoor_like, 0)::DOUBLE AS sort_outdoor,
  regexp_matches(lower(concat_ws(' ', coalesce(s.top_labels_json, ''), coalesce(s.ai_tags_json, ''), coalesce(c.summary_text, ''))),
    'landmark|monument|temple|church|cathedral|castle|bridge|tower|statue|ruin|palace|shrine|memorial|pagoda|mosque|synagogue|capitol|courthouse|museum')::INT::DOUBLE AS sort_landmark,
  coalesce(f.largest_face_area_ratio, 0)::DOUBLE AS sort_closeup, (q.sha1 IS NOT NULL)::INT AS selected
FROM o_scored b LEFT JOIN semantic_scores s USING (sha1) LEFT JOIN image_face_summary f USING (sha1)
LEFT JOIN ai_summaries c USING (sha1) LEFT JOIN o_request q ON q.sha1 = b.sha1 WHERE b.undated = 0""")


def _page_rows(a, mode: str) -> DataFrame:
    """Dated rows with only the joins a mode needs."""
    scored = mode in ("quality", "all")
    rows = library.dated(a.scored if scored else a.active.withColumn("hero_score", F.lit(0.0)))
    keys = grids.key_columns()
    if mode == "selected":
        chosen = a.media.where("substring(sha1, 1, 1) IN ('0', '3', '6', '9', 'c')").select(
            "sha1", F.lit(1).alias("selected"))
        return rows.join(chosen, "sha1", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    if mode in ("default", "time"):
        return rows
    if mode in ("quality", "size", "location"):
        return rows.withColumn(f"sort_{mode}", keys[f"sort_{mode}"])
    full = grids.enriched(rows, a.semantic, a.face_summary, a.summaries)
    return full.withColumns(keys) if mode == "all" else full.withColumn(f"sort_{mode}", keys[f"sort_{mode}"])


@query("grid_keys", "PRJ22", "JON8", "PRJ21", oracle="SELECT * EXCLUDE (final_dt, selected) FROM o_grid")
def grid_keys(a) -> DataFrame:
    return _page_rows(a, "all").select("sha1", "year", *grids.key_columns())


_ORDERS = {"default": "", "selected": "selected DESC,", "quality": "sort_quality,", "size": "sort_size,",
           "location": "(sort_location <> '') DESC, sort_location,"}


def _register_grid(mode: str) -> None:
    order = _ORDERS.get(mode, f"sort_{mode} DESC,")

    @query(f"grid_sort_{mode}", "SRT1", oracle=f"""
SELECT year, sha1, row_number() OVER (PARTITION BY year ORDER BY {order} final_dt DESC, sha1) - 1 AS pos FROM o_grid""")
    def grid_sort(a) -> DataFrame:
        return grids.grid_positions(_page_rows(a, mode), "year", mode)


for _mode in grids.MODES:
    _register_grid(_mode)


@query("saved_order", "SRT2", oracle="""
SELECT b.year, b.sha1, row_number() OVER (PARTITION BY b.year ORDER BY q.pos DESC NULLS LAST, final_dt DESC, b.sha1) - 1 AS pos
FROM o_browse b LEFT JOIN o_request q USING (sha1) WHERE undated = 0""")
def saved_order(a) -> DataFrame:
    saved = _request(a).select("sha1", (-F.col("pos")).alias("saved_pos"))
    return grids.saved_order_positions(library.dated(a.active), "year", saved)
