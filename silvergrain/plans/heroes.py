"""Hero cards, place mosaics, zero-shot labels and image statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import heroes, pixels, places, ranking_scores, scopes, semantics
from silvergrain.plans.bursts import year_members
from silvergrain.plans.oracle import VIEWS, view
from silvergrain.plans.places import records
from silvergrain.plans.registry import query
from silvergrain.session import cut_lineage, shared_folder
from silvergrain.sources.tables import VersionedTable

SCOPE = ["scope_type", "scope_key"]


def day_members(a) -> DataFrame:
    return a.ranked.where("undated = 0").withColumns({"scope_type": F.lit("day"), "scope_key": F.col("date_key")})


# Oracle for the clustered cards: the same rules as recursive SQL over small lists of centres.
view("o_buckets", """
WITH met AS (SELECT scope_key, round(latitude, 3) AS lat3, round(longitude, 3) AS lon3, min((coalesce(-ts, 1099511627776), sha1)) AS met
             FROM o_year_scored WHERE has_gps GROUP BY 1, 2, 3),
b AS (SELECT scope_key, lat3, lon3, floor(sum(floor(latitude * 1000000 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5)::BIGINT AS la,
        floor(sum(floor(longitude * 1000000 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5)::BIGINT AS lo, count(*) AS w,
        max({'h': hero_score, 'd': final_dt, 's': sha1}) AS best FROM o_reduced WHERE has_gps GROUP BY 1, 2, 3),
k AS (SELECT scope_key, 16 - max((NOT has_gps)::INT) AS k FROM o_reduced GROUP BY 1)
SELECT b.*, k.k, count(*) OVER (PARTITION BY b.scope_key) AS places,
  row_number() OVER (PARTITION BY b.scope_key ORDER BY met) AS seen
FROM b JOIN met USING (scope_key, lat3, lon3) JOIN k USING (scope_key)""")

_GAP2 = "(b.la - c.la) * (b.la - c.la) + (b.lo - c.lo) * (b.lo - c.lo)"

view("o_seeds", f"""
SELECT scope_key, max(k) AS k, [arg_max({{'la': la, 'lo': lo}}, (best.h, w, -seen))] AS cs FROM o_buckets WHERE places > k
GROUP BY scope_key
UNION ALL
SELECT scope_key, k, list_append(cs, arg_min({{'la': la, 'lo': lo}}, seen)) FROM (
  SELECT *, sum(gap) OVER (PARTITION BY scope_key ORDER BY seen) AS run, sum(gap) OVER (PARTITION BY scope_key) AS total FROM (
    SELECT s.scope_key, s.k, s.cs, b.la, b.lo, b.seen, list_min(list_transform(s.cs, lambda c: {_GAP2})) AS gap
    FROM o_seeds s JOIN o_buckets b ON b.scope_key = s.scope_key WHERE len(s.cs) < s.k))
WHERE 2 * run >= total GROUP BY scope_key, k, cs""")

_OWN2 = (f"list_position(list_transform(s.cs, lambda c: {_GAP2}), list_min(list_transform(s.cs, lambda c: {_GAP2})))")

view("o_settle", f"""
SELECT scope_key, 0 AS r, cs, FALSE AS still FROM o_seeds WHERE len(cs) = k
UNION ALL
SELECT scope_key, r + 1, fresh, fresh = cs FROM (
  SELECT scope_key, r, cs, list_transform(range(1, len(cs) + 1), lambda i: coalesce(m[i], cs[i])) AS fresh FROM (
    SELECT scope_key, r, cs, map(list(own), list({{'la': la, 'lo': lo}})) AS m FROM (
      SELECT scope_key, r, cs, own, floor(sum(la * w)::DOUBLE / sum(w)::DOUBLE + 0.5)::BIGINT AS la,
        floor(sum(lo * w)::DOUBLE / sum(w)::DOUBLE + 0.5)::BIGINT AS lo FROM (
        SELECT s.scope_key, s.r, s.cs, b.la, b.lo, b.w, {_OWN2} AS own
        FROM o_settle s JOIN o_buckets b ON b.scope_key = s.scope_key WHERE NOT s.still AND s.r < 12)
      GROUP BY scope_key, r, cs, own) GROUP BY scope_key, r, cs))""")


CARD_SQL = f"""
WITH f AS (SELECT scope_key, arg_max(cs, r) AS cs FROM o_settle GROUP BY 1),
reps AS (
  SELECT scope_key, max(best) AS best FROM (
    SELECT b.scope_key, b.best, {_OWN2} AS own FROM f s JOIN o_buckets b ON b.scope_key = s.scope_key) GROUP BY scope_key, own
  UNION ALL SELECT scope_key, best FROM o_buckets WHERE places <= k),
chosen AS (
  SELECT scope_key, 0 AS phase, max({{'h': hero_score, 'd': final_dt, 's': sha1}}) AS best FROM o_reduced WHERE NOT has_gps GROUP BY 1
  UNION ALL SELECT scope_key, 1, best FROM reps),
every AS (SELECT * FROM chosen UNION ALL
  SELECT scope_key, 2, {{'h': hero_score, 'd': final_dt, 's': sha1}} FROM o_reduced r
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.scope_key = r.scope_key AND c.best.s = r.sha1))
SELECT 'year' AS scope_type, scope_key, best.s AS sha1, phase,
  row_number() OVER (PARTITION BY scope_key ORDER BY phase, best DESC) - 1 AS pos FROM every QUALIFY pos < 16"""


@query("hero16_geo", "TOP9", "CLU1", "CLU3", "AGG12", "PRJ27", "WIN6", oracle=CARD_SQL)
def hero16_geo(a) -> DataFrame:
    return heroes.hero_selection(year_members(a), SCOPE)


view("o_all_scored", """
WITH m AS (
  SELECT sha1, 'decade' AS t, decade AS k FROM o_browse WHERE undated = 0
  UNION ALL SELECT sha1, 'year', year FROM o_browse WHERE undated = 0
  UNION ALL SELECT sha1, 'month', year || '-' || month FROM o_browse WHERE undated = 0
  UNION ALL SELECT sha1, 'day', date_key FROM o_browse WHERE undated = 0
  UNION ALL SELECT sha1, 'undated', folder_group FROM o_browse WHERE undated = 1
  UNION ALL SELECT sha1, 'tag', tag FROM o_tags
  UNION ALL SELECT sha1, 'folder', array_to_string(p[1:d], '/') FROM (
    SELECT sha1, p, unnest(range(1, len(p))) AS d FROM (SELECT sha1, string_split(web_path, '/') AS p FROM o_browse)))
SELECT s.*, '' AS scope_type, t || '|' || k AS scope_key FROM m JOIN o_scored s USING (sha1)""")


def _for_all_scopes(sql: str) -> str:
    for name in ("o_year_scored", "o_reduced", "o_buckets", "o_seeds", "o_settle"):
        sql = sql.replace(name, "o_all_scored" if name == "o_year_scored" else name.replace("o_", "o_all_"))
    return sql


for _name in ("o_reduced", "o_buckets", "o_seeds", "o_settle"):
    view(_name.replace("o_", "o_all_"), _for_all_scopes(VIEWS[_name]))


@query("hero16_all_scopes", "TOP9", "CLU1", "AGG1", "AGG3", "AGG4", "AGG5", oracle=_for_all_scopes(CARD_SQL).replace(
    "SELECT 'year' AS scope_type, scope_key,",
    "SELECT split_part(scope_key, '|', 1) AS scope_type, split_part(scope_key, '|', 2) AS scope_key,"))
def hero16_all_scopes(a) -> DataFrame:
    """Cards of every decade, year, month, day, folder, tag and undated folder in one job."""
    return heroes.scope_selection(cut_lineage(a.placed))


view("o_day_reduced", """
WITH s AS (SELECT *, round(latitude, 3) AS lat3, round(longitude, 3) AS lon3 FROM o_scored WHERE undated = 0),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 15 THEN 1 ELSE 0 END AS opens
      FROM s WHERE has_gps WINDOW w AS (PARTITION BY date_key, lat3, lon3 ORDER BY ts, sha1)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY date_key, lat3, lon3 ORDER BY ts, sha1) AS cluster FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY date_key, lat3, lon3, cluster
                                   ORDER BY hero_score DESC, final_dt DESC, sha1 DESC) AS rn FROM c)
SELECT date_key, sha1, final_dt, hero_score, has_gps, lat3, lon3 FROM b WHERE rn = 1
UNION ALL SELECT date_key, sha1, final_dt, hero_score, has_gps, NULL, NULL FROM s WHERE NOT has_gps""")

view("o_day_card", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY date_key, has_gps ORDER BY hero_score DESC, final_dt DESC, sha1 DESC) AS r1,
             row_number() OVER (PARTITION BY date_key, has_gps, lat3, lon3 ORDER BY hero_score DESC, final_dt DESC, sha1 DESC) AS r2
           FROM o_day_reduced),
p AS (SELECT *, CASE WHEN NOT has_gps AND r1 = 1 THEN 0 WHEN has_gps AND r2 = 1 THEN 1 ELSE 2 END AS phase FROM r)
SELECT 'day' AS scope_type, date_key AS scope_key, sha1, phase, row_number() OVER (PARTITION BY date_key
  ORDER BY phase, hero_score DESC, final_dt DESC, sha1 DESC) - 1 AS pos FROM p QUALIFY pos < 16""")


@query("hero16_few_places", "TOP9", "SET2", oracle="SELECT * FROM o_day_card")
def hero16_few_places(a) -> DataFrame:
    """Day cards: a day has fewer places than slots, so no clustering takes part."""
    return heroes.hero_selection(day_members(a), SCOPE)


@query("card_signatures", "PRJ27", oracle="""
SELECT scope_type, scope_key, string_agg(sha1, ',' ORDER BY pos) AS sha1_list,
  md5(string_agg(sha1, '|' ORDER BY pos) || '|v1') AS composite_hash FROM o_day_card GROUP BY 1, 2""")
def card_signatures(a) -> DataFrame:
    return scopes.selection_signature(heroes.hero_selection(day_members(a), SCOPE), "v1")


@query("changed_cards", "TOP9", "PRJ27", oracle="""
WITH n AS (SELECT date_key AS scope_key, count(*) AS now, count(*) FILTER (NOT contains('01', sha1[40])) AS before
           FROM o_scored WHERE undated = 0 GROUP BY 1),
h AS (SELECT scope_key, md5(string_agg(sha1, '|' ORDER BY pos) || '|v1') AS composite_hash FROM o_day_card GROUP BY 1)
SELECT 'day' AS scope_type, scope_key, CASE WHEN before = 0 THEN 'new' WHEN before = now THEN 'kept' ELSE 'changed' END AS status,
  composite_hash FROM n JOIN h USING (scope_key)""")
def changed_cards(a) -> DataFrame:
    """Cards of an archive that has grown: only scopes whose photos changed are selected anew, the others are read back."""
    def signed(members: DataFrame, cards: DataFrame) -> DataFrame:
        return scopes.scope_signatures(members).join(scopes.selection_signature(cards, "v1"), SCOPE, "left")

    members = day_members(a)
    earlier = members.where("substring(sha1, 40, 1) NOT IN ('0', '1')")
    store = VersionedTable(a.spark, shared_folder(a.spark, "cards"))
    store.commit(signed(earlier, heroes.hero_selection(earlier, SCOPE)))
    state = cut_lineage(scopes.changed_scopes(store.current(), scopes.scope_signatures(members)))
    todo = state.where("status IN ('new', 'changed')").select(*SCOPE)
    again = members.join(todo, SCOPE, "left_semi")
    fresh = signed(again, heroes.hero_selection(again, SCOPE))
    kept = store.current().join(state.where("status = 'kept'").select(*SCOPE), SCOPE, "left_semi")
    store.commit(kept.unionByName(fresh))
    return store.current().join(state, SCOPE).select(*SCOPE, "status", "composite_hash")


view("o_moments", """
SELECT node_id, ts, count(*) AS n, max({'h': hero_score, 'd': final_dt, 's': sha1}) AS best FROM o_node_rows
WHERE level <> 'root' AND ts IS NOT NULL GROUP BY 1, 2""")

_GAP1 = "list_transform(s.cs, lambda c: abs(v.ts - c))"

view("o_moment_seeds", f"""
SELECT node_id, [list(ts ORDER BY ts)[count(*) // 2 + 1]::DOUBLE] AS cs FROM o_node_rows
WHERE level <> 'root' AND ts IS NOT NULL GROUP BY 1 HAVING count(*) > 16
UNION ALL
SELECT node_id, list_append(cs, arg_max(ts::DOUBLE, (gap, -ts))) FROM (
  SELECT s.node_id, s.cs, v.ts, list_min({_GAP1}) AS gap
  FROM o_moment_seeds s JOIN o_moments v ON v.node_id = s.node_id WHERE len(s.cs) < 16)
GROUP BY node_id, cs""")

view("o_moment_settle", f"""
SELECT node_id, 0 AS r, list_sort(cs) AS cs, FALSE AS still FROM o_moment_seeds WHERE len(cs) = 16
UNION ALL
SELECT node_id, r + 1, fresh, list_max(list_transform(range(1, 17), lambda i: abs(fresh[i] - cs[i]))) < 1 FROM (
  SELECT node_id, r, cs, list_transform(range(1, 17), lambda i: coalesce(m[i], cs[i])) AS fresh FROM (
    SELECT node_id, r, cs, map(list(own), list(mean)) AS m FROM (
      SELECT node_id, r, cs, own, sum(ts * n)::DOUBLE / sum(n)::DOUBLE AS mean FROM (
        SELECT s.node_id, s.r, s.cs, v.ts, v.n, list_position({_GAP1}, list_min({_GAP1})) AS own
        FROM o_moment_settle s JOIN o_moments v ON v.node_id = s.node_id WHERE NOT s.still AND s.r < 10)
      GROUP BY node_id, r, cs, own) GROUP BY node_id, r, cs))""")


@query("place_mosaic", "TOP10", "CLU2", "SET2", oracle=f"""
WITH f AS (SELECT node_id, arg_max(cs, r) AS cs FROM o_moment_settle GROUP BY 1
  UNION ALL SELECT node_id, list(ts::DOUBLE ORDER BY ts) FROM o_moments GROUP BY 1 HAVING sum(n) <= 16),
reps AS (SELECT node_id, 0 AS phase, any_value(cs[own]) AS centre, max(best) AS best FROM (
    SELECT s.node_id, s.cs, v.best, list_position({_GAP1}, list_min({_GAP1})) AS own
    FROM f s JOIN o_moments v ON v.node_id = s.node_id) GROUP BY node_id, own),
every AS (SELECT * FROM reps UNION ALL
  SELECT node_id, CASE WHEN ts IS NULL THEN 1 ELSE 2 END, 0, {{'h': hero_score, 'd': final_dt, 's': sha1}} FROM o_node_rows r
  WHERE level <> 'root' AND NOT EXISTS (SELECT 1 FROM reps c WHERE c.node_id = r.node_id AND c.best.s = r.sha1)),
c AS (SELECT node_id, count(*) AS photo_count FROM o_node_rows GROUP BY 1)
SELECT node_id, best.s AS sha1, photo_count, row_number() OVER (PARTITION BY node_id ORDER BY phase, centre, best DESC) - 1 AS pos
FROM every JOIN c USING (node_id) QUALIFY pos < 16""")
def place_mosaic(a) -> DataFrame:
    return heroes.place_mosaic(places.node_members(records(a)), ["node_id"])


@query("minute_best", "OPT1", oracle="""
SELECT year AS scope_key, ts // 60 * 60 AS minute, arg_max(sha1, (hero_score, final_dt, sha1)) AS sha1
FROM o_scored WHERE undated = 0 GROUP BY 1, 2""")
def minute_best(a) -> DataFrame:
    return heroes.best_per_minute(year_members(a, a.placed), ["scope_key"]).select("scope_key", "minute", "sha1")


@query("round_robin", "OPT2", oracle="""
WITH p AS (SELECT year AS scope_key, sha1, round(latitude, 3) AS lat3, round(longitude, 3) AS lon3,
    row_number() OVER (PARTITION BY year, round(latitude, 3), round(longitude, 3)
                       ORDER BY hero_score DESC, final_dt DESC, sha1 DESC) AS turn FROM o_scored WHERE undated = 0 AND has_gps)
SELECT scope_key, sha1, turn, row_number() OVER (PARTITION BY scope_key ORDER BY turn, lat3, lon3) - 1 AS pos FROM p
QUALIFY pos < 16""")
def round_robin(a) -> DataFrame:
    return heroes.round_robin(year_members(a, a.placed), ["scope_key"])


@query("document_hero", "OPT6", "OPT7", oracle="""
WITH f AS (SELECT *, ln(1.0::DOUBLE + coalesce(face_count, 0)) * 0.6 + coalesce(largest_face_area_ratio, 0) * 0.4 AS fs FROM o_inputs)
SELECT sha1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.30 * tech + 0.30 * fs + 0.25 * aes + 0.15 * sem
  + CASE WHEN face_count > 0 THEN 0.10 ELSE 0 END + CASE WHEN largest_face_area_ratio > 0.15 THEN 0.10 ELSE 0 END
  + CASE WHEN regexp_matches(lower(coalesce(top_labels_json, '')), 'landmark|mountain|monument') THEN 0.05 ELSE 0 END)
  * CASE WHEN tech < 0.25 THEN 0.5 ELSE 1 END
  * CASE WHEN doc OR shot OR coalesce(contains_text, 0) = 1 THEN 0.4 ELSE 1 END)), 6) AS hero_score,
  round(fs, 6) AS face_interest FROM f""")
def document_hero(a) -> DataFrame:
    return ranking_scores.document_hero_scores(a.star)


# --- zero-shot labels -------------------------------------------------------------

SCENE_BANK = ("portrait", "group_photo", "landscape", "nature", "city", "food", "animal", "document", "screenshot",
              "object_closeup")


def label_bank(a) -> DataFrame:
    """A label bank: the mean vector of each embedding label, one row per label."""
    cells = a.base("embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"])
    names = F.array(*[F.lit(s) for s in SCENE_BANK])
    return means.groupBy("label").agg(vector.alias("vector")).select(
        F.col("label").alias("label_pos"), F.coalesce(F.get(names, F.col("label")), F.col("label").cast("string"))
        .alias("label"), "vector")


def images(a) -> DataFrame:
    return a.base("embeddings").select("vec_id", F.col("embedding").alias("vector"))


_SCENES = ", ".join(f"'{s}'" for s in SCENE_BANK)
view("o_bank", f"""
WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label, d, avg(v) AS v FROM c GROUP BY 1, 2)
SELECT label AS label_pos, coalesce([{_SCENES}][label + 1], label::VARCHAR) AS label, list(v ORDER BY d) AS vector
FROM m GROUP BY label""")
view("o_probs", """
WITH e AS (SELECT vec_id, label_pos, b.label, exp(list_dot_product(embedding::DOUBLE[], vector)) AS x,
             list_dot_product(embedding::DOUBLE[], vector) AS dot FROM embeddings, o_bank b)
SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e""")


@query("zero_shot_labels", "JON15", "TOP6", "TOP7", oracle="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label_pos) AS rn FROM o_probs)
SELECT vec_id, max(CASE WHEN rn = 1 THEN label END) AS scene_type, string_agg(label, ',' ORDER BY rn) AS top_labels,
  round(max(p), 6) AS top_score FROM r WHERE rn <= 6 GROUP BY vec_id""")
def zero_shot_labels(a) -> DataFrame:
    rows = semantics.top_probabilities(images(a), label_bank(a), "vec_id")
    return rows.select("vec_id", F.element_at("top", 1)["label"].alias("scene_type"),
                       F.array_join(F.transform("top", lambda s: s["label"]), ",").alias("top_labels"),
                       F.element_at("top", 1)["score"].alias("top_score"))


@query("prompt_margin", "JON16", "PRJ9", oracle="""
WITH d AS (SELECT vec_id, avg(dot) FILTER (label_pos < 5) - avg(dot) FILTER (label_pos >= 5) AS margin FROM o_probs GROUP BY 1)
SELECT vec_id, round(margin, 6) AS margin, round(1 / (1 + exp(-margin / 0.03)), 6) AS score FROM d""")
def prompt_margin(a) -> DataFrame:
    side = label_bank(a).withColumn("label", F.when(F.col("label_pos") < 5, "pos").otherwise("neg"))
    return semantics.prompt_margin(images(a), side).select("vec_id", F.round("margin", 6).alias("margin"),
                                                           F.round("score", 6).alias("score"))


# Bank members by label position: (yes, no) pairs and the three interest levels.
BANK_PAIRS = {"animals_yes": 0, "animals_no": 1, "text_yes": 2, "text_no": 3, "document_yes": 4, "document_no": 5,
              "screenshot_yes": 6, "screenshot_no": 7, "landscape_yes": 8, "landscape_no": 9, "food_yes": 1, "food_no": 2,
              "indoor": 3, "outdoor": 4, "meaningful": 5, "ordinary": 6, "boring": 7}
FLAG_COLUMNS = ("contains_people", "contains_animals", "contains_text", "is_document_like", "is_screenshot_like",
                "is_landscape_like", "is_food_like", "is_indoor_like", "is_outdoor_like")


def _bank_probabilities(a) -> DataFrame:
    probs = semantics.label_probabilities(images(a), label_bank(a), "vec_id")
    at = lambda i: F.coalesce(F.get("probs", F.lit(i))["p"], F.lit(0.0))
    faces = a.face_summary.select("sha1", "face_count")
    return (probs.withColumn("sha1", F.sha1(F.col("vec_id").cast("string").cast("binary")))
            .withColumns({name: at(i) for name, i in BANK_PAIRS.items()})
            .withColumns({"people_max": F.array_max(F.transform("probs", lambda s: s["p"])),
                          "scene_type": semantics.best_label(F.col("probs"))})
            .join(faces, "sha1", "left"))


def _pair(yes: str, no: str, threshold: float) -> str:
    return f"({yes} / greatest(1e-8, {yes} + {no}) >= {threshold})::INT"


view("o_bank_probs", "SELECT vec_id, max(p) AS people_max, arg_max(label, (p, -label_pos)) AS scene_type, "
     + ", ".join(f"max(CASE WHEN label_pos = {i} THEN p END) AS {name}" for name, i in BANK_PAIRS.items())
     + " FROM o_probs GROUP BY vec_id")
view("o_flagged", f"""
SELECT b.*, f.face_count, (people_max >= 0.20 OR scene_type IN ('portrait', 'group_photo') OR coalesce(face_count, 0) > 0)::INT
    AS contains_people,
  {_pair('animals_yes', 'animals_no', 0.52)} AS contains_animals, {_pair('text_yes', 'text_no', 0.52)} AS contains_text,
  {_pair('document_yes', 'document_no', 0.54)} AS is_document_like,
  {_pair('screenshot_yes', 'screenshot_no', 0.54)} AS is_screenshot_like,
  {_pair('landscape_yes', 'landscape_no', 0.53)} AS is_landscape_like, {_pair('food_yes', 'food_no', 0.53)} AS is_food_like,
  (indoor >= outdoor)::INT AS is_indoor_like, (outdoor > indoor)::INT AS is_outdoor_like
FROM o_bank_probs b LEFT JOIN image_face_summary f ON f.sha1 = sha1(b.vec_id::VARCHAR)""")


@query("semantic_flags", "SCO6", "JON10", "SCO9", oracle="SELECT vec_id, " + ", ".join(FLAG_COLUMNS) + """,
  concat_ws('|', CASE WHEN coalesce(face_count, 0) > 0 THEN 'people_from_face_override' END,
    CASE WHEN coalesce(face_count, 0) <= 0 AND scene_type IN ('portrait', 'group_photo') THEN 'people_from_scene_override' END)
  AS warnings FROM o_flagged""")
def semantic_flags(a) -> DataFrame:
    rows = semantics.semantic_flags(_bank_probabilities(a))
    return rows.select("vec_id", *FLAG_COLUMNS, semantics.semantic_warnings(
        F.col("face_count"), F.col("scene_type"), F.col("contains_people")).alias("warnings"))


@query("semantic_score", "SCO7", oracle="""
SELECT vec_id, scene_type, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (least(1.0::DOUBLE, (meaningful + 0.45 * ordinary) / greatest(1e-8, meaningful + ordinary + boring))
   + 0.10 * contains_people + 0.06 * contains_animals + 0.07 * is_landscape_like
   + CASE WHEN scene_type IN ('group_photo', 'portrait', 'landscape', 'nature', 'food', 'animal') THEN 0.05 ELSE 0 END)
  * CASE WHEN is_document_like = 1 THEN 0.45 ELSE 1 END * CASE WHEN is_screenshot_like = 1 THEN 0.35 ELSE 1 END
  * CASE WHEN contains_text = 1 AND contains_people + contains_animals + is_food_like = 0 THEN 0.8 ELSE 1 END)), 6)
  AS semantic_score FROM o_flagged""")
def semantic_score(a) -> DataFrame:
    rows = semantics.semantic_score(semantics.semantic_flags(_bank_probabilities(a)))
    return rows.select("vec_id", "scene_type", "semantic_score")


# --- image statistics --------------------------------------------------------------

def grids(a) -> DataFrame:
    """Eight by eight grey grids and colour planes made from the embedding vectors."""
    grey = lambda k: F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(
        F.lit(255), F.floor(v.cast("double") * k + 128).cast("int"))))
    return a.base("embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey(300).alias("gray"),
        grey(410).alias("red"), grey(-250).alias("green"), grey(170).alias("blue"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("saliency"))


def _grey_sql(k: int) -> str:
    return f"list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * {k} + 128)::INT)))"


view("o_pixels", f"""
SELECT image_id, i // 8 AS y, i % 8 AS x, g, r, gr, b, m FROM (
  SELECT vec_id AS image_id, unnest(range(64)) AS i, unnest({_grey_sql(300)}) AS g, unnest({_grey_sql(410)}) AS r,
    unnest({_grey_sql(-250)}) AS gr, unnest({_grey_sql(170)}) AS b, unnest(embedding) AS m0, abs(unnest(embedding)::DOUBLE) AS m
  FROM embeddings)""")


@query("pixel_statistics", "SCO2", oracle="""
WITH n AS (SELECT p.image_id, p.g, p.x, p.y,
    (SELECT sum(q.g) FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dx, dy) JOIN o_pixels q
       ON q.image_id = p.image_id AND q.x = CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx > 7 THEN 6 ELSE p.x + dx END
      AND q.y = CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy > 7 THEN 6 ELSE p.y + dy END) - 4 * p.g AS lap FROM o_pixels p),
h AS (SELECT image_id, g, count(*) / 64 AS pr FROM o_pixels GROUP BY 1, 2),
e AS (SELECT image_id, -sum(pr * log2(pr)) AS entropy FROM h GROUP BY 1),
c AS (SELECT image_id, sqrt(var_pop(abs(r - gr)) + var_pop(abs(0.5::DOUBLE * (r + gr) - b)))
        + 0.3 * sqrt(pow(avg(abs(r - gr)), 2) + pow(avg(abs(0.5::DOUBLE * (r + gr) - b)), 2)) AS colourfulness,
        avg(CASE WHEN greatest(r, gr, b) > 0 THEN round((greatest(r, gr, b) - least(r, gr, b)) * 255 / greatest(r, gr, b))
            ELSE 0 END) / 255 AS saturation FROM o_pixels GROUP BY 1)
SELECT n.image_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, round(any_value(entropy), 6) AS entropy,
  (sum(lap * lap) * 64 - sum(lap) * sum(lap))::DOUBLE / 4096 AS laplacian, round(any_value(colourfulness), 6) AS colourfulness,
  round(any_value(saturation), 6) AS saturation
FROM n JOIN e USING (image_id) JOIN c USING (image_id) GROUP BY n.image_id""")
def pixel_statistics(a) -> DataFrame:
    out = pixels.grid_statistics(grids(a))
    return out.select("image_id", "laplacian", *[F.round(c, 6).alias(c) for c in out.columns[1:] if c != "laplacian"])


@query("saliency_map", "SCO3", oracle="""
WITH q AS (SELECT image_id, quantile_cont(m, 0.9) AS q90 FROM o_pixels GROUP BY 1),
p AS (SELECT o.*, m >= q90 AS s FROM o_pixels o JOIN q USING (image_id)),
g AS (SELECT image_id, sum(m) AS t, sum(m * x) / sum(m) / 7 AS cx, sum(m * y) / sum(m) / 7 AS cy,
    count(*) FILTER (s) / 64 AS q90_ratio,
    (max(x) FILTER (s) - min(x) FILTER (s) + 1) * (max(y) FILTER (s) - min(y) FILTER (s) + 1) / 64 AS box_ratio,
    count(*) FILTER (s AND (x IN (0, 7) OR y IN (0, 7))) / count(*) FILTER (s) AS edge_touch,
    1 - (abs(sum(CASE WHEN x < 4 THEN m ELSE -m END)) + abs(sum(CASE WHEN y < 4 THEN m ELSE -m END))) / sum(m) / 2 AS balance
  FROM p GROUP BY 1)
SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, q90_ratio, box_ratio, round(edge_touch, 6) AS edge_touch,
  round(balance, 6) AS balance,
  round(greatest(0.0::DOUBLE, 1 - sqrt(least(pow(cx - 1 / 3, 2), pow(cx - 2 / 3, 2)) + least(pow(cy - 1 / 3, 2), pow(cy - 2 / 3, 2)))
    / 0.4715), 6) AS thirds FROM g""")
def saliency_map(a) -> DataFrame:
    out = pixels.saliency_properties(grids(a))
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
