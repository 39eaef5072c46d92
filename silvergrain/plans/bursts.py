"""Time clusters, bursts, cull plans and moves."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import bursts, cull, ranking_scores, sessions
from silvergrain.plans.browse import _request
from silvergrain.plans.oracle import view
from silvergrain.plans.registry import query
from silvergrain.plans.reports import committed
from silvergrain.plans.scores import people_signals
from silvergrain.session import cut_lineage


def _gap_sql(gap: int, keys: str, source: str) -> str:
    return f"""
WITH g AS (SELECT *, CASE WHEN ts IS NULL OR lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {gap} THEN 1 ELSE 0 END AS opens
           FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts NULLS LAST, sha1)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ts NULLS LAST, sha1) AS cluster FROM g)
SELECT {keys}, min(ts) AS cluster_start, max(ts) AS cluster_end, count(*) AS size,
  arg_max(sha1, (hero_score, final_dt, sha1)) AS best_sha1 FROM c GROUP BY {keys}, cluster"""


view("o_placed", """
SELECT *, round(latitude, 3) AS lat3, round(longitude, 3) AS lon3 FROM o_scored WHERE has_gps""")


def _clusters(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    photos = cut_lineage(rows.select(*keys, "ts", "hero_score", "final_dt", "sha1"))
    return sessions.time_clusters(photos, keys, gap).select(
        *keys, "cluster_start", "cluster_end", "size", F.col("best.sha1").alias("best_sha1"))


@query("gap_clusters_15s", "WIN1", "WIN4", "PRJ7", oracle=_gap_sql(15, "lat3, lon3", "o_placed"))
def gap_clusters_15s(a) -> DataFrame:
    return _clusters(a.placed.where("has_gps"), ["lat3", "lon3"], 15)


@query("gap_clusters_20s", "WIN2", "WIN4", oracle=_gap_sql(
    20, "coord_key", "(SELECT s.*, coord_key FROM o_scored s JOIN photo_geo USING (sha1))"))
def gap_clusters_20s(a) -> DataFrame:
    return _clusters(a.placed.join(a.photo_geo.select("sha1", "coord_key").hint("merge"), "sha1"), ["coord_key"], 20)


view("o_year_scored", "SELECT *, 'year' AS scope_type, year AS scope_key FROM o_scored WHERE undated = 0")

view("o_reduced", """
WITH s AS (SELECT *, round(latitude, 3) AS lat3, round(longitude, 3) AS lon3 FROM o_year_scored),
g AS (SELECT *, CASE WHEN ts IS NULL OR lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 15 THEN 1 ELSE 0 END AS opens
      FROM s WHERE has_gps WINDOW w AS (PARTITION BY scope_key, lat3, lon3 ORDER BY ts, sha1)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY scope_key, lat3, lon3 ORDER BY ts, sha1) AS cluster FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY scope_key, lat3, lon3, cluster
                                   ORDER BY hero_score DESC, final_dt DESC, sha1 DESC) AS rn FROM c)
SELECT scope_type, scope_key, sha1, final_dt, hero_score, has_gps, lat3, lon3, latitude, longitude FROM b WHERE rn = 1
UNION ALL SELECT scope_type, scope_key, sha1, final_dt, hero_score, has_gps, NULL, NULL, latitude, longitude
FROM s WHERE NOT has_gps""")


def year_members(a, photos: DataFrame | None = None) -> DataFrame:
    """The dated photos by year; those of ``photos`` where a plan reads them only once."""
    return (photos or a.ranked).where("undated = 0").withColumns({"scope_type": F.lit("year"), "scope_key": F.col("year")})


@query("burst_reduction", "WIN6", "AGG19", "SET3", oracle="""
SELECT scope_type, scope_key, sha1, hero_score, has_gps::INT AS has_gps FROM o_reduced""")
def burst_reduction(a) -> DataFrame:
    return sessions.reduced_candidates(year_members(a), ["scope_type", "scope_key"]).select(
        "scope_type", "scope_key", "sha1", "hero_score", F.col("has_gps").cast("int").alias("has_gps"))


view("o_edges", """
WITH r AS (SELECT sha1, ts, final_dt, latitude AS la, longitude AS lo, row_number() OVER (ORDER BY ts, sha1) AS rn
           FROM o_browse WHERE has_gps AND ts IS NOT NULL),
p AS (SELECT *, ts - lag(ts) OVER w AS gap, lag(la) OVER w AS pa, lag(lo) OVER w AS po FROM r WINDOW w AS (ORDER BY rn)),
d AS (SELECT *, 6371000.0 * sqrt(pow((radians(lo) - radians(po)) * cos((radians(pa) + radians(la)) / 2), 2)
                                 + pow(radians(la) - radians(pa), 2)) AS dist FROM p),
e AS (SELECT *, CASE WHEN gap IS NULL OR gap > 15 THEN 0 WHEN dist <= 15 THEN 1 WHEN gap <= 5 THEN 2 ELSE 0 END AS edge
      FROM d)
SELECT sha1, ts, rn, edge, sum(CASE WHEN edge = 0 THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS block FROM e""")

view("o_walk", """
SELECT sha1, ts, rn, block, ts AS start_ts, sha1 AS cluster_id, 1 AS members FROM o_edges WHERE edge = 0
UNION ALL
SELECT e.sha1, e.ts, e.rn, e.block, CASE WHEN j THEN w.start_ts ELSE e.ts END,
  CASE WHEN j THEN w.cluster_id ELSE e.sha1 END, CASE WHEN j THEN w.members + 1 ELSE 1 END
FROM (SELECT w0.*, e0.edge = 1 OR (w0.members >= 2 AND w0.ts - w0.start_ts <= 10) AS j
      FROM o_walk w0 JOIN o_edges e0 ON e0.rn = w0.rn + 1 AND e0.block = w0.block) w
JOIN o_edges e ON e.rn = w.rn + 1 AND e.block = w.block""")

view("o_bursts", """
SELECT cluster_id, sha1, ts, count(*) OVER (PARTITION BY cluster_id) AS size FROM o_walk QUALIFY size >= 2""")


@query("burst_clusters_bridge", "WIN3", "PRJ10", oracle="SELECT cluster_id, sha1, ts, size FROM o_bursts")
def burst_clusters_bridge(a) -> DataFrame:
    return bursts.burst_members(a.active)


def cull_inputs(a) -> tuple[DataFrame, DataFrame]:
    scored = ranking_scores.cull_scores_v2(people_signals(a)).select(
        "sha1", "score", "face_score", "aesthetic_score", "technical_score")
    return bursts.burst_members(a.active), scored


view("o_ranked_bursts", """
SELECT b.*, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, face_score DESC, aesthetic_score DESC,
                               technical_score DESC, ts, b.sha1) AS r FROM o_bursts b JOIN o_cull2 USING (sha1)""")


@query("cull_plan", "TOP3", "TOP1", "SET2", oracle="""
SELECT cluster_id, sha1, size, keep, CASE WHEN keep = 1 THEN r END AS keeper_rank
FROM (SELECT *, CASE WHEN r <= CASE WHEN size > 4 THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS keep FROM o_ranked_bursts)""")
def cull_plan(a) -> DataFrame:
    return cull.cull_plan(*cull_inputs(a))


@query("cull_totals", "TOP3", oracle="""
SELECT (SELECT count(*) FROM o_active) AS requested, count(DISTINCT cluster_id) AS clusters_found,
  count(*) FILTER (r > CASE WHEN size > 4 THEN 2 ELSE 1 END) AS to_cull,
  (SELECT count(*) FROM o_active) - count(*) FILTER (r > CASE WHEN size > 4 THEN 2 ELSE 1 END) AS kept
FROM o_ranked_bursts""")
def cull_totals(a) -> DataFrame:
    return cull.plan_totals(a.active, cull.cull_plan(*cull_inputs(a)))


@query("cluster_listing", "TOP4", "AGG18", oracle="""
SELECT cluster_id, max(size) AS size,
  printf('%.4f,%.4f', round(arg_min(latitude, (ts, sha1)), 4) + 0, round(arg_min(longitude, (ts, sha1)), 4) + 0)
    AS gps_bucket,
  min(final_dt) AS start_time, max(final_dt) AS end_time, max(CASE WHEN r = 1 THEN sha1 END) AS primary_sha1,
  max(CASE WHEN r = 2 THEN sha1 END) AS secondary_sha1, CASE WHEN max(size) > 4 THEN 2 ELSE 1 END AS keep_count,
  max(size) - CASE WHEN max(size) > 4 THEN 2 ELSE 1 END AS drop_count
FROM (SELECT * FROM o_ranked_bursts JOIN (SELECT sha1, final_dt, latitude, longitude FROM o_active) USING (sha1))
GROUP BY cluster_id""")
def cluster_listing(a) -> DataFrame:
    members, scored = cull_inputs(a)
    return cull.cluster_summary(members, scored, a.active)


def _formula(a, mode: str) -> DataFrame:
    make = ranking_scores.cull_scores_v2 if mode == "cull" else ranking_scores.interesting_scores
    return make(people_signals(a)).join(a.active.select("sha1", "ts", "year"), "sha1")


def _winner_sql(source: str) -> str:
    return f"""
SELECT year, sha1, score, rank FROM (
  SELECT year, sha1, score, row_number() OVER (PARTITION BY year ORDER BY score DESC, face_score DESC,
    aesthetic_score DESC, technical_score DESC, ts NULLS LAST, sha1) AS rank
  FROM {source} JOIN (SELECT sha1, ts, year FROM o_browse) USING (sha1)) WHERE rank <= 5"""


@query("interesting_winners", "TOP1", "TOP2", oracle=_winner_sql("o_interesting"))
def interesting_winners(a) -> DataFrame:
    return cull.winners(_formula(a, "interesting"), ["year"], 5).select("year", "sha1", "score", "rank")


@query("cull_winners", "TOP1", "TOP2", oracle=_winner_sql("o_cull2"))
def cull_winners(a) -> DataFrame:
    return cull.winners(_formula(a, "cull"), ["year"], 5).select("year", "sha1", "score", "rank")


view("o_moved", r"""
WITH r AS (SELECT m.*, q.pos, replace(rel_fqn, chr(92), '/') AS web FROM media m LEFT JOIN o_request q USING (sha1)),
t AS (SELECT *, CASE WHEN pos IS NOT NULL AND NOT regexp_matches(web, '^_(trash|stash|cull)/') THEN '_stash/' || web END AS target
      FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS nth,
        target IN (SELECT web FROM r WHERE starts_with(web, '_stash/')) AS taken FROM t)
SELECT sha1, CASE WHEN target IS NULL THEN rel_fqn ELSE replace(CASE WHEN nth = 1 AND NOT taken THEN target
    ELSE regexp_replace(target, '(\.[^./]*)$', '__' || sha1[1:8] || '\1') END, '/', chr(92)) END AS rel_fqn,
  CASE WHEN target IS NULL THEN is_deleted ELSE 1 END AS is_deleted,
  CASE WHEN target IS NOT NULL THEN 'moved' WHEN pos IS NOT NULL THEN 'skipped' ELSE 'kept' END AS outcome FROM k""")


def _moved(a) -> tuple[DataFrame, DataFrame]:
    request = _request(a)
    return request, cull.soft_move(a.media, request, cull.STASH)


@query("soft_move", "SNK9", oracle="SELECT * FROM o_moved")
def soft_move(a) -> DataFrame:
    request = _request(a)
    moved = committed(a, a.media, lambda media: cull.soft_move(media, request, cull.STASH))
    return moved.select("sha1", "rel_fqn", "is_deleted", "outcome")


@query("soft_move_counts", "SNK9", oracle="""
SELECT (SELECT count(*) FROM o_request) AS requested, count(*) FILTER (outcome = 'moved') AS moved,
  (SELECT count(*) FROM o_request) - count(*) FILTER (outcome = 'moved') AS skipped FROM o_moved""")
def soft_move_counts(a) -> DataFrame:
    return cull.move_counts(*_moved(a))


@query("empty_trash", "SNK10", oracle=r"""
SELECT sha1, rel_fqn FROM media WHERE NOT (starts_with(rel_fqn, '_trash/') OR starts_with(rel_fqn, '_trash' || chr(92)))""")
def empty_trash(a) -> DataFrame:
    return committed(a, a.media, cull.without_trash).select("sha1", "rel_fqn")
