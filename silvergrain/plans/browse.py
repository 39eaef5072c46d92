"""Browse columns and timeline, folder, tag and calendar views."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import geo, text, time
from silvergrain.operators import library, ordering, places, refresh, scopes
from silvergrain.plans.oracle import view
from silvergrain.plans.registry import query
from silvergrain.session import cut_lineage


@query("active_media", "SRC1", "PRJ1", "PRJ32", oracle="""
SELECT sha1, replace(rel_fqn, chr(92), '/') AS path, original_filename AS filename FROM media WHERE is_deleted = 0""")
def active_media(a) -> DataFrame:
    return library.manifest(a.active)


@query("media_dims", "PRJ1", "PRJ4", "PRJ5", "FIL1", oracle="""
SELECT sha1, web_path, undated, folder_group, year, month, month_name, day, date_key, decade, ts FROM o_browse""")
def media_dims(a) -> DataFrame:
    return a.active.select("sha1", "web_path", "undated", "folder_group", "year", "month", "month_name", "day",
                           "date_key", "decade", "ts")


@query("tag_list", "PRJ2", oracle="""
SELECT m.sha1, coalesce(t.tags, '') AS tags FROM o_active m LEFT JOIN o_tag_text t USING (sha1)""")
def tag_list(a) -> DataFrame:
    return a.active.select("sha1", F.array_join("tags", ",").alias("tags"))


@query("path_tags", "PRJ3", oracle="""
WITH parts AS (
  SELECT sha1, list_filter(string_split(CASE WHEN contains(web_path, '/') THEN regexp_replace(web_path, '/[^/]*$', '')
                                             ELSE '' END, '/'), lambda p: p <> '') AS p FROM o_browse)
SELECT sha1, array_to_string(list_filter(list_transform(p, lambda x: replace(replace(trim(x), '_', ' '), '-', ' ')),
                                         lambda x: x <> ''), ', ') AS ingest_tags,
  array_to_string(list_filter(list_transform(list_filter(p, lambda x: NOT starts_with(x, '_')),
                  lambda x: replace(replace(trim(x), '_', ' '), '-', ' ')), lambda x: x <> ''), ', ') AS rebuild_tags
FROM parts""")
def path_tags(a) -> DataFrame:
    folder = F.when(F.instr("web_path", "/") > 0, F.regexp_replace("web_path", "/[^/]*$", "")).otherwise("")
    return a.active.select("sha1", text.path_tag_text(folder).alias("ingest_tags"),
                           text.path_tag_text(folder, keep_private=False).alias("rebuild_tags"))


@query("gps_valid", "PRJ6", "PRJ7", "PRJ8", oracle="""
SELECT sha1, has_gps::INT AS has_gps, CASE WHEN has_gps THEN round(latitude, 3) END AS lat3,
  CASE WHEN has_gps THEN round(longitude, 3) END AS lon3, CASE WHEN has_gps THEN round(latitude, 4) END AS lat4,
  CASE WHEN has_gps THEN round(longitude, 4) END AS lon4,
  CASE WHEN has_gps THEN printf('%.3f,%.3f', round(latitude, 3) + 0, round(longitude, 3) + 0) END AS coord_key,
  CASE WHEN has_gps THEN printf('%.2f,%.2f', round(latitude, 2) + 0, round(longitude, 2) + 0) END AS coarse_key
FROM o_browse""")
def gps_valid(a) -> DataFrame:
    lat, lon, ok = F.col("latitude"), F.col("longitude"), F.col("has_gps")
    return a.active.select(
        "sha1", ok.cast("int").alias("has_gps"), F.when(ok, geo.bucket(lat, 3)).alias("lat3"),
        F.when(ok, geo.bucket(lon, 3)).alias("lon3"), F.when(ok, geo.bucket(lat, 4)).alias("lat4"),
        F.when(ok, geo.bucket(lon, 4)).alias("lon4"), F.when(ok, geo.coord_key(lat, lon)).alias("coord_key"),
        F.when(ok, geo.coord_key(lat, lon, 2)).alias("coarse_key"))


@query("file_date_sources", "PRJ28", "PRJ29", oracle="""
SELECT sha1, coalesce(name IN ('filesystem', 'file system', 'file modification', 'file modified', 'mtime',
    'modified time') OR (contains(name, 'file') AND (contains(name, 'modification') OR contains(name, 'modified'))),
    FALSE)::INT AS file_date,
  strftime(try_strptime(final_dt, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed,
  CASE WHEN altitude_meters IS NULL THEN '' ELSE printf('%.1f', altitude_meters) END AS altitude_text,
  CASE WHEN latitude IS NULL THEN '' ELSE printf('%.6f', latitude) END AS latitude_text,
  CASE WHEN is_deleted = 1 THEN 'Yes' ELSE 'No' END AS deleted_text
FROM (SELECT *, replace(replace(lower(trim(dt_source)), '-', ' '), '_', ' ') AS name FROM media)""")
def file_date_sources(a) -> DataFrame:
    def fixed(column: str, places: int):
        return F.when(F.col(column).isNull(), "").otherwise(F.format_string(f"%.{places}f", F.col(column)))

    return a.media.select(
        "sha1", time.is_file_date(F.col("dt_source")).cast("int").alias("file_date"),
        time.stamp_text(time.lenient_timestamp(F.nullif(F.col("final_dt"), F.lit(time.ZERO_DATE)))).alias("parsed"),
        fixed("altitude_meters", 1).alias("altitude_text"), fixed("latitude", 6).alias("latitude_text"),
        F.when(F.col("is_deleted") == 1, "Yes").otherwise("No").alias("deleted_text"))


_DIGIT = "substr(sha1, 1, 1)"


@query("lenient_dates", "PRJ29", oracle=f"""
SELECT sha1, CASE WHEN {_DIGIT} IN ('f', '0') THEN NULL
  ELSE strftime(try_strptime(final_dt, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS parsed FROM media""")
def lenient_dates(a) -> DataFrame:
    """The same dates in several layouts, chosen by the first digit of the id; two digits have none that parses."""
    digit, date = F.substring("sha1", 1, 1), F.col("final_dt")
    iso, camera = F.replace(date, F.lit(" "), F.lit("T")), F.concat(F.translate(F.substring(date, 1, 10), "-", ":"), F.substring(date, 11, 9))
    written = (F.when(digit.isin("1", "2", "3"), camera).when(digit.isin("4", "5"), iso)
               .when(digit.isin("6", "7"), F.concat(iso, F.lit("Z"))).when(digit.isin("8", "9"), F.concat(F.lit("  "), date, F.lit(" ")))
               .when(digit == "f", "12 May").when(digit == "0", "").otherwise(date))
    found = F.when(~time.is_undated(date), time.lenient_timestamp(written))
    return a.media.select("sha1", time.stamp_text(found).alias("parsed"))


@query("timeline_day_rows", "FIL2", oracle="""
SELECT sha1, 'month' AS scope FROM o_browse WHERE undated = 0 AND decade = '1990s' AND year = '1995' AND month = '07'
UNION ALL SELECT sha1, 'day' FROM o_browse WHERE undated = 0 AND month = '03' AND day = '09'
UNION ALL SELECT sha1, 'place' FROM o_place_records WHERE substr(final_dt, 1, 4) = '2001'""")
def timeline_day_rows(a) -> DataFrame:
    """Month and day scopes, and the located photos of a year."""
    month = library.in_timeline_scope(a.active, decade="1990s", year="1995", month="07").select("sha1", F.lit("month").alias("scope"))
    day = library.in_timeline_scope(a.active, month="03", day="09").select("sha1", F.lit("day").alias("scope"))
    records = places.place_records(a.placed, a.photo_geo, a.geo_cache)
    place = library.in_timeline_scope(records, year="2001").select("sha1", F.lit("place").alias("scope"))
    return month.unionByName(day).unionByName(place)


view("o_months", """
SELECT decade, year, month, max(month_name) AS month_name, count(*) AS n FROM o_browse WHERE undated = 0
GROUP BY 1, 2, 3""")


@query("timeline_rollup", "AGG1", "FIL2", oracle="""
WITH cards AS (
  SELECT 'decade' AS level, '' AS parent, decade AS title, decade, CAST(NULL AS VARCHAR) AS year, CAST(NULL AS VARCHAR) AS month, sum(n)::BIGINT AS c
  FROM o_months GROUP BY decade
  UNION ALL SELECT 'year', decade, year, decade, year, NULL, sum(n)::BIGINT FROM o_months GROUP BY decade, year
  UNION ALL SELECT 'month', year, month_name, decade, year, month, n FROM o_months)
SELECT level, parent, title, decade, year, month, c AS photo_count,
  row_number() OVER (PARTITION BY level, parent ORDER BY CASE WHEN level <> 'month' THEN title END DESC, month) - 1 AS pos
FROM cards""")
def timeline_rollup(a) -> DataFrame:
    return scopes.timeline_cards(library.dated(a.active))


@query("timeline_scope_rows", "FIL2", "FIL4", "SET1", oracle="""
SELECT sha1, 'year' AS scope FROM o_browse WHERE undated = 0 AND decade = '1990s' AND year = '1995'
UNION ALL SELECT b.sha1, 'tag' FROM o_browse b JOIN o_tags t ON t.sha1 = b.sha1 AND t.tag = 'Beach Day'
UNION ALL SELECT sha1, 'undated' FROM o_browse WHERE undated = 1 AND folder_group = 'trip_click'""")
def timeline_scope_rows(a) -> DataFrame:
    year = library.in_timeline_scope(a.active, decade="1990s", year="1995").select("sha1", F.lit("year").alias("scope"))
    tag = library.in_tag_scope(a.active, "Beach Day").select("sha1", F.lit("tag").alias("scope"))
    loose = library.in_undated_folder(a.active, "trip_click").select("sha1", F.lit("undated").alias("scope"))
    return year.unionByName(tag).unionByName(loose)


@query("folder_scope", "FIL3", "FIL5", oracle="""
SELECT sha1, CASE WHEN contains(rest, '/') THEN string_split(rest, '/')[1] END AS sub_folder FROM (
  SELECT sha1, substr(web_path, 10) AS rest FROM o_browse WHERE starts_with(web_path, 'Family-1/'))""")
def folder_scope(a) -> DataFrame:
    return library.in_folder_scope(a.active, "Family-1").select("sha1", "sub_folder")


@query("undated_folders", "AGG3", "FIL5", oracle="""
SELECT folder_group, count(*) AS photo_count, count(*)::VARCHAR || ' items' AS subtitle
FROM o_browse WHERE undated = 1 GROUP BY 1""")
def undated_folders(a) -> DataFrame:
    return scopes.undated_cards(library.undated(a.active))


@query("folder_cards", "AGG4", oracle="""
WITH f AS (SELECT string_split(web_path, '/') AS p, len(string_split(web_path, '/')) AS k FROM o_browse),
up AS (SELECT p, unnest(range(1, k)) AS d FROM f)
SELECT array_to_string(p[1:d - 1], '/') AS parent, p[d] AS child, count(*) AS photo_count, 'folder' AS kind
FROM up GROUP BY 1, 2
UNION ALL SELECT array_to_string(p[1:k - 1], '/'), '', count(*), 'files' FROM f GROUP BY 1""")
def folder_cards(a) -> DataFrame:
    return scopes.folder_cards(a.active)


@query("tag_cards", "AGG5", oracle="""
SELECT tag, count(*) AS photo_count, '#' || tag AS title, count(*)::VARCHAR || ' items' AS subtitle
FROM o_tags GROUP BY tag""")
def tag_cards(a) -> DataFrame:
    return scopes.tag_cards(a.active)


view("o_tag_pos", """
SELECT b.*, t.tag, row_number() OVER (PARTITION BY b.sha1 ORDER BY t.tag) AS i
FROM o_browse b JOIN o_tags t USING (sha1)""")


@query("scope_top_tags", "TOP5", oracle="""
WITH s AS (
  SELECT *, unnest(['decade', 'year', 'month']) AS level, unnest([decade, year, year || '-' || month]) AS scope
  FROM o_tag_pos WHERE undated = 0),
o AS (SELECT level, scope, tag, row_number() OVER (PARTITION BY level, scope ORDER BY ts DESC, sha1, i) AS seen FROM s),
c AS (SELECT level, scope, tag, count(*) AS tag_count, min(seen) AS seen FROM o GROUP BY 1, 2, 3)
SELECT level, scope, tag, tag_count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY level, scope ORDER BY tag_count DESC, seen) AS rank FROM c) WHERE rank <= 3""")
def scope_top_tags(a) -> DataFrame:
    return scopes.timeline_tags(library.dated(a.active)).select("level", "scope", "tag", "tag_count", "rank")


@query("month_calendar", "AGG2", "JON17", "WIN5", oracle="""
WITH d AS (SELECT date_key, count(*) AS photo_count, arg_max(sha1, (hero_score, final_dt, sha1)) AS thumb_sha1
           FROM o_scored WHERE undated = 0 GROUP BY 1),
o AS (SELECT date_key, tag, row_number() OVER (PARTITION BY date_key ORDER BY ts, sha1, i) AS seen
      FROM o_tag_pos WHERE undated = 0),
c AS (SELECT date_key, tag, count(*) AS n, min(seen) AS seen FROM o GROUP BY 1, 2),
t AS (SELECT date_key, string_agg(tag, ',' ORDER BY r) AS top_tags, min(CASE WHEN r = 1 THEN tag END) AS location_label
      FROM (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY n DESC, seen) AS r FROM c) WHERE r <= 3 GROUP BY 1),
g AS (SELECT year, month, first, unnest(generate_series(first, first + INTERVAL 1 MONTH - INTERVAL 1 DAY,
                                                        INTERVAL 1 DAY)) AS date
      FROM (SELECT DISTINCT year, month, strptime(year || '-' || month || '-01', '%Y-%m-%d') AS first FROM o_browse
            WHERE undated = 0))
SELECT g.year, g.month, strftime(date, '%Y-%m-%d') AS date_key, dayofmonth(date) AS day,
  (dayofmonth(date) - 1 + dayofweek(first)) // 7 AS week, dayofweek(date) AS weekday,
  coalesce(photo_count, 0) AS photo_count, thumb_sha1, top_tags, location_label,
  CASE WHEN photo_count > 0 THEN strftime(date, '%B %-d, %Y') END AS date_label
FROM g LEFT JOIN d ON d.date_key = strftime(date, '%Y-%m-%d') LEFT JOIN t ON t.date_key = d.date_key""")
def month_calendar(a) -> DataFrame:
    return scopes.month_calendar(library.dated(a.active), library.dated(a.scored))


_SIGNATURES = """
WITH m AS (
  SELECT sha1, 'decade' AS scope_type, decade AS scope_key FROM {photos} WHERE undated = 0
  UNION ALL SELECT sha1, 'year', year FROM {photos} WHERE undated = 0
  UNION ALL SELECT sha1, 'month', year || '-' || month FROM {photos} WHERE undated = 0
  UNION ALL SELECT sha1, 'day', date_key FROM {photos} WHERE undated = 0
  UNION ALL SELECT sha1, 'undated', folder_group FROM {photos} WHERE undated = 1
  UNION ALL SELECT sha1, 'tag', tag FROM {tags}
  UNION ALL SELECT sha1, 'folder', array_to_string(p[1:d], '/') FROM (
    SELECT sha1, p, unnest(range(1, len(p))) AS d FROM (SELECT sha1, string_split(web_path, '/') AS p FROM {photos})))
SELECT scope_type, scope_key, count(*) AS photo_count,
  md5(concat_ws('|', count(*)::VARCHAR, sum(('0x' || substr(sha1, 1, 15))::BIGINT)::HUGEINT::VARCHAR,
    sum(('0x' || substr(sha1, 16, 15))::BIGINT)::HUGEINT::VARCHAR,
    sum(('0x' || substr(sha1, 31, 10))::BIGINT)::HUGEINT::VARCHAR)) AS signature
FROM m GROUP BY 1, 2"""


@query("scope_signatures", "PRJ27", oracle=_SIGNATURES.format(photos="o_browse", tags="o_tags"))
def scope_signatures(a) -> DataFrame:
    return scopes.scope_signatures(scopes.membership(a.active))


view("o_browse_after", """
SELECT * REPLACE (CASE WHEN starts_with(sha1, '02') THEN 'Sorted/' || web_path ELSE web_path END AS web_path) FROM o_browse
WHERE NOT starts_with(sha1, '00')""")
view("o_tags_after", "SELECT * FROM o_tags WHERE NOT starts_with(sha1, '00')")


@query("scope_refresh", "PRJ27", oracle=_SIGNATURES.format(photos="o_browse_after", tags="o_tags_after"))
def scope_refresh(a) -> DataFrame:
    """Signatures after photos went (ids in 00), came (01) or moved into another folder (02), from the sums before."""
    kind = F.substring("sha1", 1, 2)
    before = a.active.where(kind != "01")
    moved = a.active.where(kind.isin("01", "02")).withColumn(
        "web_path", F.when(kind == "02", F.concat(F.lit("Sorted/"), "web_path")).otherwise(F.col("web_path")))
    state = cut_lineage(scopes.scope_sums(scopes.membership(before)))
    touched = cut_lineage(refresh.touched_scopes(state, refresh.changes(before.where(kind.isin("00", "02")), moved)))
    return scopes.signatures_of(refresh.apply(state, touched, refresh.SCOPE))


# --- selections and grid orders -------------------------------------------------

def _request(a) -> DataFrame:
    """An ordered id request: the photos whose id starts with one of five digits, positions by id."""
    ids = a.media.where("substring(sha1, 1, 1) IN ('0', '3', '6', '9', 'c')").select("sha1")
    return ordering.with_positions(ids, [], F.col("sha1"))


view("o_request", """
SELECT sha1, row_number() OVER (ORDER BY sha1) - 1 AS pos FROM media WHERE sha1[1] IN ('0', '3', '6', '9', 'c')""")


@query("select_file_dates", "FIL6", oracle="""
SELECT sha1, pos FROM o_active JOIN o_request USING (sha1)
WHERE lower(dt_source) IN ('file modification', 'file_modified', 'mtime')""")
def select_file_dates(a) -> DataFrame:
    return library.special_selection(a.active, _request(a), "filesystem_date").select("sha1", "pos")


@query("select_no_gps", "FIL6", "PRJ6", oracle="""
SELECT sha1, pos FROM o_browse JOIN o_request USING (sha1) WHERE NOT has_gps""")
def select_no_gps(a) -> DataFrame:
    return library.special_selection(a.active, _request(a), "no_gps").select("sha1", "pos")


@query("bucket_rows", "FIL7", oracle="""
SELECT sha1, pos, final_dt FROM o_browse JOIN o_request USING (sha1) WHERE undated = 0""")
def bucket_rows(a) -> DataFrame:
    return library.requested(library.dated(a.active), _request(a)).select("sha1", "pos", "final_dt")
