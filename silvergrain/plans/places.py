"""Place queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import places, refresh
from silvergrain.plans.oracle import view
from silvergrain.plans.registry import query
from silvergrain.session import cut_lineage, shared_folder


def records(a) -> DataFrame:
    return places.place_records(a.placed, a.photo_geo, a.geo_cache)


view("o_place_raw", """
WITH k AS (SELECT g.*, c.* EXCLUDE (coord_key) FROM photo_geo g JOIN geo_cache c USING (coord_key))
SELECT s.sha1, s.final_dt, s.ts, s.hero_score, k.sha1 IS NOT NULL AS known,
  coalesce(k.coord_key, printf('%.3f,%.3f', latitude, longitude)) AS coord_key,
  CASE WHEN k.sha1 IS NULL THEN 'Unknown Country' ELSE k.country END AS country,
  CASE WHEN k.sha1 IS NULL THEN 'Unknown Region' ELSE k.state END AS state, coalesce(k.county, '') AS county,
  coalesce(k.city, '') AS city, coalesce(k.town, '') AS town, coalesce(k.suburb, '') AS suburb,
  coalesce(k.road, '') AS road,
  CASE WHEN k.sha1 IS NULL THEN printf('%.3f, %.3f', latitude, longitude) ELSE k.place_name END AS place_name,
  CASE WHEN k.sha1 IS NULL THEN printf('%.3f, %.3f', latitude, longitude) ELSE k.formatted END AS formatted,
  CASE WHEN k.sha1 IS NULL THEN latitude WHEN k.source_lat <> 0 THEN k.source_lat ELSE k.lat_rounded END AS use_lat,
  CASE WHEN k.sha1 IS NULL THEN longitude WHEN k.source_lon <> 0 THEN k.source_lon ELSE k.lon_rounded END AS use_lon
FROM o_scored s LEFT JOIN k USING (sha1) WHERE k.sha1 IS NOT NULL OR s.has_gps""")

view("o_place_records", """
SELECT *, coalesce(nullif(trim(country), ''), 'Unknown Country') AS country_label,
  coalesce(nullif(trim(CASE WHEN state <> '' THEN state ELSE county END), ''), 'Unknown Region') AS region_label,
  coalesce(nullif(trim(CASE WHEN city <> '' THEN city WHEN town <> '' THEN town WHEN suburb <> '' THEN suburb
    WHEN county <> '' THEN county ELSE state END), ''), 'Miscellaneous') AS city_label,
  coalesce(nullif(trim(CASE WHEN place_name <> '' THEN place_name WHEN road <> '' THEN road ELSE formatted END), ''),
           'Pinned Place') AS place_label FROM o_place_raw""")

view("o_leaves", r"""
WITH l AS (
  SELECT *, first_value(place_label) OVER (PARTITION BY country_label, region_label, city_label, coord_key ORDER BY sha1) AS label
  FROM o_place_records),
n AS (SELECT *, lower(trim(regexp_replace(label, '\s+', ' ', 'g'))) AS norm FROM l),
c AS (SELECT country_label, region_label, city_label, norm, coord_key, label, count(*) AS n FROM n GROUP BY ALL),
t AS (SELECT country_label, region_label, city_label, norm, arg_max(coord_key, (n, coord_key)) AS top_key,
             arg_max(label, (n, coord_key)) AS top_label FROM c GROUP BY ALL)
SELECT n.*, concat('place::', country_label, '::', region_label, '::', city_label, '::', top_key) AS leaf_id, top_label
FROM n JOIN t USING (country_label, region_label, city_label, norm)""")

view("o_node_rows", """
SELECT 'root' AS node_id, 'root' AS level, 'World' AS label, NULL::VARCHAR AS parent_id, * FROM o_leaves
UNION ALL SELECT 'country::' || country_label, 'country', country_label, 'root', * FROM o_leaves
UNION ALL SELECT 'region::' || country_label || '::' || region_label, 'region', region_label,
  'country::' || country_label, * FROM o_leaves
UNION ALL SELECT 'city::' || country_label || '::' || region_label || '::' || city_label, 'city', city_label,
  'region::' || country_label || '::' || region_label, * FROM o_leaves
UNION ALL SELECT leaf_id, 'place', top_label,
  'city::' || country_label || '::' || region_label || '::' || city_label, * FROM o_leaves""".replace(
    "*", "sha1, final_dt, ts, hero_score, use_lat, use_lon"))

view("o_tree", """
WITH g AS (SELECT node_id, level, label, parent_id, count(*) AS photo_count, round(avg(use_lat), 6) AS lat,
             round(avg(use_lon), 6) AS lon, arg_max(sha1, (hero_score, final_dt, sha1)) AS cover_sha1
           FROM o_node_rows GROUP BY 1, 2, 3, 4)
SELECT *, (SELECT count(*) FROM g c WHERE c.parent_id = g.node_id) AS child_count,
  row_number() OVER (PARTITION BY parent_id ORDER BY photo_count DESC, lower(label), node_id) AS child_order FROM g""")


def tree(a) -> DataFrame:
    return places.place_tree(records(a)).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("place_labels", "JON6", "PRJ25", oracle="""
SELECT sha1, coord_key, country_label, region_label, city_label, place_label, round(use_lat, 6) AS use_lat,
  round(use_lon, 6) AS use_lon FROM o_place_records""")
def place_labels(a) -> DataFrame:
    return records(a).select("sha1", "coord_key", "country_label", "region_label", "city_label", "place_label",
                             F.round("use_lat", 6).alias("use_lat"), F.round("use_lon", 6).alias("use_lon"))


@query("place_nodes", "AGG13", "AGG14", "WIN5", oracle="SELECT * FROM o_tree")
def place_nodes(a) -> DataFrame:
    return tree(a)


@query("place_refresh", "AGG13", "WIN5", oracle="""
SELECT country_label, region_label, city_label, coord_key, count(*) AS photo_count, round(avg(use_lat), 6) AS lat,
  round(avg(use_lon), 6) AS lon, arg_max(sha1, (hero_score, final_dt, sha1)) AS cover_sha1, arg_min(place_label, sha1) AS label
FROM (SELECT * REPLACE (CASE WHEN starts_with(sha1, '02') THEN hero_score / 2 ELSE hero_score END AS hero_score)
      FROM o_place_records WHERE NOT starts_with(sha1, '00'))
GROUP BY 1, 2, 3, 4""")
def place_refresh(a) -> DataFrame:
    """The leaves after photos went (ids in 00), came (01) or were scored anew (02), from the state before."""
    rows = cut_lineage(records(a).select("sha1", *refresh.LEAF, "use_lat", "use_lon", "hero_score", "final_dt", "place_label"))
    kind = F.substring("sha1", 1, 2)
    before = rows.where(kind != "01")
    after = rows.where(kind != "00").withColumn("hero_score", F.when(kind == "02", F.col("hero_score") / 2)
                                                .otherwise(F.col("hero_score")))
    path = shared_folder(a.spark, "records")
    refresh.laid_out(after).write.partitionBy(refresh.LAYOUT).parquet(path)
    state = cut_lineage(refresh.leaf_state(before))
    moved = kind.isin("00", "01", "02")
    touched = cut_lineage(refresh.touched_leaves(state, refresh.changes(before.where(moved), after.where(moved)),
                                                 a.spark.read.parquet(path)))
    return refresh.leaves_of(refresh.apply(state, touched, refresh.LEAF)).select(
        *refresh.LEAF, "photo_count", F.round(F.col("lat_sum") / F.col("photo_count"), 6).alias("lat"),
        F.round(F.col("lon_sum") / F.col("photo_count"), 6).alias("lon"), F.col("best.sha1").alias("cover_sha1"), "label")


@query("place_leaf_merge", "AGG14", "PRJ19", oracle="""
SELECT country_label, region_label, city_label, norm, leaf_id AS node_id, top_label AS label, count(*) AS photo_count,
  count(DISTINCT coord_key) AS merged_from FROM o_leaves GROUP BY ALL""")
def place_leaf_merge(a) -> DataFrame:
    return places.merged_leaves(places.leaf_nodes(records(a))).drop("lat_sum", "lon_sum", "best")


@query("place_totals", "AGG15", oracle="""
SELECT (SELECT count(*) FROM o_place_records) AS geotagged_count,
  (SELECT count(*) FROM o_tree WHERE level = 'place') AS leaf_count""")
def place_totals(a) -> DataFrame:
    return places.tree_totals(places.place_tree(records(a)))


@query("place_preview", "AGG20", oracle="""
SELECT label AS place_name, photo_count, cover_sha1 AS cover_image, lat, lon FROM o_tree
WHERE parent_id = 'root' AND child_order = 1""")
def place_preview(a) -> DataFrame:
    return places.preview(tree(a))


@query("place_children", "TOP11", oracle="""
SELECT node_id, parent_id, child_order, label, photo_count FROM o_tree WHERE parent_id IS NOT NULL AND child_order <= 12""")
def place_children(a) -> DataFrame:
    return places.top_children(tree(a)).select("node_id", "parent_id", "child_order", "label", "photo_count")


@query("place_paths", "TOP11", oracle="""
SELECT t.node_id, concat_ws(' > ', CASE WHEN ppp.parent_id IS NOT NULL THEN ppp.node_id END,
    CASE WHEN pp.parent_id IS NOT NULL THEN pp.node_id END, CASE WHEN p.parent_id IS NOT NULL THEN p.node_id END,
    CASE WHEN t.parent_id IS NOT NULL THEN t.node_id END) AS path
FROM o_tree t LEFT JOIN o_tree p ON p.node_id = t.parent_id LEFT JOIN o_tree pp ON pp.node_id = p.parent_id
LEFT JOIN o_tree ppp ON ppp.node_id = pp.parent_id""")
def place_paths(a) -> DataFrame:
    return places.node_path(tree(a))


@query("map_views", "PRJ26", oracle="""
SELECT node_id, label AS title, photo_count::VARCHAR || ' geotagged photo' || CASE WHEN photo_count = 1 THEN '' ELSE 's' END
    AS subtitle,
  CASE level WHEN 'root' THEN 1.0 WHEN 'country' THEN 2.2 WHEN 'region' THEN 3.2 WHEN 'city' THEN 8.0 ELSE 10.5 END::DOUBLE
    AS zoom, lat AS center_lat, lon AS center_lon, printf('%.4f, %.4f', lat, lon) AS coord_text FROM o_tree""")
def map_views(a) -> DataFrame:
    return places.map_views(tree(a))


@query("place_gallery", "TOP8", "WIN2", "PRJ33", oracle="""
WITH m AS (SELECT * FROM o_node_rows WHERE level <> 'root'),
g AS (SELECT *, CASE WHEN ts IS NULL OR lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 20 THEN 1 ELSE 0 END AS opens
      FROM m WINDOW w AS (PARTITION BY node_id ORDER BY ts NULLS LAST, sha1)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY node_id ORDER BY ts NULLS LAST, sha1) AS cluster FROM g),
b AS (SELECT node_id, cluster, count(*) AS size, max({'h': hero_score, 'd': final_dt, 's': sha1}) AS best FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY best DESC) AS rank FROM b)
SELECT node_id, rank, best.s AS sha1, size,
  coalesce(strftime(try_strptime(best.d, '%Y-%m-%d %H:%M:%S'), '%B %-d, %Y'), 'Photo') AS title,
  size::VARCHAR || CASE WHEN size = 1 THEN ' photo' ELSE ' photos' END AS subtitle FROM r WHERE rank <= 18""")
def place_gallery(a) -> DataFrame:
    return places.leaf_gallery(places.leaf_members(records(a)))


@query("geocode_coordinates", "AGG11", "PRJ8", oracle="""
SELECT printf('%.3f,%.3f', round(latitude, 3) + 0, round(longitude, 3) + 0) AS coord_key, min(round(latitude, 3)) AS lat_rounded,
  min(round(longitude, 3)) AS lon_rounded, count(*) AS photo_count FROM o_browse WHERE has_gps GROUP BY 1""")
def geocode_coordinates(a) -> DataFrame:
    return places.coordinates(a.active)


@query("geocode_worklist", "JON13", oracle="""
SELECT * FROM (SELECT printf('%.3f,%.3f', round(latitude, 3) + 0, round(longitude, 3) + 0) AS coord_key,
  min(round(latitude, 3)) AS lat_rounded, min(round(longitude, 3)) AS lon_rounded, count(*) AS photo_count
  FROM o_browse WHERE has_gps GROUP BY 1) WHERE coord_key NOT IN (SELECT coord_key FROM geo_cache)""")
def geocode_worklist(a) -> DataFrame:
    return places.geocode_worklist(places.coordinates(a.active), a.geo_cache)


@query("photo_links", "JON14", oracle="""
SELECT * FROM (SELECT sha1, printf('%.3f,%.3f', round(latitude, 3) + 0, round(longitude, 3) + 0) AS coord_key,
  latitude AS source_lat, longitude AS source_lon FROM o_browse WHERE has_gps)
WHERE coord_key IN (SELECT coord_key FROM geo_cache)""")
def photo_links(a) -> DataFrame:
    return places.photo_links(a.active, a.geo_cache)


def _response(d: str) -> str:
    """JSON text of a geocoder response per cached coordinate, in either SQL dialect."""
    quote = '\'"\''
    parts = [("country", "country"), ("country_code", "lower(substr(country, 1, 2))"), ("state", "state"), ("ISO_3166-2", "city"),
             ("county", "county"), ("city_district", "city"), ("town", "town"), ("village", "substr(town, 1, 3)"),
             ("hamlet", "substr(county, 1, 4)"), ("neighbourhood", "suburb"), ("postcode", "substr(formatted, 6, 2)"),
             ("road", "road"), ("house_number", "substr(formatted, 1, 1)"), ("natural", "place_name")]
    items = " || ', ' || ".join(f"'\"{key}\": ' || {quote} || {col} || {quote}" for key, col in parts)
    body = (f"'{{\"results\": [{{\"confidence\": ' || CAST(length(formatted) AS STRING) || ', \"formatted\": ' || {quote}"
            f" || formatted || {quote} || ', \"type\": \"road\", \"components\": {{' || {items} || '}}}}]}}'")
    return f"CASE WHEN status = 'error' THEN '{{\"results\": []}}' ELSE {body} END"


_PARSED = {"formatted": "formatted", "result_type": "'road'", "country": "country", "country_code": "lower(substr(country, 1, 2))",
           "state": "state", "state_code": "city", "county": "county", "city": "city", "town": "town",
           "village": "substr(town, 1, 3)", "hamlet": "substr(county, 1, 4)", "suburb": "suburb",
           "postcode": "substr(formatted, 6, 2)", "road": "road", "house_number": "substr(formatted, 1, 1)",
           "place_name": "place_name"}


@query("geocode_parse", "PRJ24", oracle="SELECT coord_key, CASE WHEN status = 'ok' THEN length(formatted) END AS confidence, "
       + ", ".join(f"CASE WHEN status = 'ok' THEN {sql} ELSE '' END AS {name}" for name, sql in _PARSED.items())
       + ", (status = 'ok')::INT AS results_count FROM geo_cache")
def geocode_parse(a) -> DataFrame:
    raw = a.geo_cache.selectExpr("coord_key", f"{_response('spark')} AS raw_json")
    return places.parsed_addresses(raw).select("coord_key", "confidence", *_PARSED, "results_count")


def _tile_sql(lon: str, lat: str, z: str) -> tuple[str, str]:
    held = f"least(greatest({lat}, -85.05112878::DOUBLE), 85.05112878::DOUBLE)"
    return (f"floor(({lon} + 180) / 360 * pow(2, {z}))::BIGINT",
            f"floor((1 - asinh(tan(radians({held}))) / pi()) / 2 * pow(2, {z}))::BIGINT")


_TX, _TY = _tile_sql("longitude", "latitude", "12")


@query("tile_of_photo", "PRJ30", oracle=f"""
SELECT sha1, 12 AS z, {_TX} AS x, {_TY} AS y FROM o_browse WHERE has_gps""")
def tile_of_photo(a) -> DataFrame:
    return places.photo_tiles(a.active, 12)


def _plan_sql() -> str:
    rows = ", ".join(f"({i}, {', '.join(str(v) + '::DOUBLE' for v in places.TILE_BOXES[name])}, {low}, {high})"
                     for i, (name, low, high) in enumerate(places.TILE_PLAN))
    x0, y0 = _tile_sql("min_lon", "max_lat", "z")
    x1, y1 = _tile_sql("max_lon", "min_lat", "z")
    top = "(pow(2, z)::BIGINT - 1)"
    return f"""
WITH b(step, min_lon, min_lat, max_lon, max_lat, lo, hi) AS (VALUES {rows}),
z AS (SELECT *, unnest(range(lo, hi + 1)) AS z FROM b),
r AS (SELECT *, greatest(0, least({top}, {x0})) AS x0, greatest(0, least({top}, {x1})) AS x1,
        greatest(0, least({top}, {y0})) AS y0, greatest(0, least({top}, {y1})) AS y1 FROM z),
t AS (SELECT step, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r)),
p AS (SELECT z, x, y, min(step) AS step FROM t GROUP BY 1, 2, 3),
ph AS (SELECT {_TX.replace('12', '8')} AS x, {_TY.replace('12)', '8)')} AS y, count(*) AS photo_count
       FROM o_browse WHERE has_gps GROUP BY 1, 2)
SELECT p.z, p.x, p.y, p.step, coalesce(ph.photo_count, 0) AS photo_count
FROM p LEFT JOIN ph ON p.z = 8 AND p.x = ph.x AND p.y = ph.y"""


@query("tile_plan", "SET4", "PRJ30", oracle=_plan_sql())
def tile_plan(a) -> DataFrame:
    """Seed plan joined to the photos per tile of its deepest zoom."""
    plan = places.tile_plan(places.plan_rows(a.spark))
    photos = places.photo_tiles(a.active, 8).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("photo_count"))
    return plan.join(photos, ["z", "x", "y"], "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))


_BOXES = ", ".join(f"('{k}', {', '.join(str(x) + '::DOUBLE' for x in v)})" for k, v in places.TILE_BOXES.items())


@query("place_boxes", "OPT5", oracle=f"""
WITH b(name, min_lon, min_lat, max_lon, max_lat) AS (VALUES {_BOXES})
SELECT sha1, name FROM o_browse JOIN b ON longitude BETWEEN min_lon AND max_lon AND latitude BETWEEN min_lat AND max_lat
WHERE has_gps AND name <> 'world'""")
def place_boxes(a) -> DataFrame:
    return places.places_by_box(a.active, places.plan_rows(a.spark).where("name <> 'world'")).select("sha1", "name")
