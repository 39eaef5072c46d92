"""Score queries: each is one expression tree over joined signal tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.operators import keywords, ranking_scores, semantics, sidecars
from silvergrain.plans.oracle import view
from silvergrain.plans.oracle_views import CULL_PET, HERO_PET
from silvergrain.plans.registry import query


@query("hero_scores", "JON1", "SCO10", "SCO11", "SCO19", "PRJ9", "PRJ21", "SCO20", oracle="SELECT * FROM o_hero")
def hero_scores(a) -> DataFrame:
    return ranking_scores.hero_scores(a.star)


view("o_hero_sidecar", """
SELECT h.sha1, CASE WHEN m.width IS NULL THEN 0 ELSE hero_score END AS hero_score,
  CASE WHEN m.width IS NULL THEN '{}' ELSE printf('{"technical_score": %.6f, "aesthetic_score": %.6f, "subject_prominence_score": %.6f, '
    || '"semantic_score": %.6f, "face_score": %.6f, "note": "%s"}', technical_score, aesthetic_score, subject_prominence_score,
    semantic_score, face_score, note) END AS breakdown_json,
  'hero_derived' AS model_name, 'hero_v1' AS model_version, '2026-01-01T00:00:00Z' AS scored_at,
  CASE WHEN m.width IS NULL THEN 'compute_failed:no image size' ELSE '' END AS warnings
FROM o_hero h JOIN o_active m USING (sha1)""")


def _hero_sidecar(a) -> DataFrame:
    scored = ranking_scores.hero_scores(a.star, "width")
    return ranking_scores.score_sidecar(scored, "hero_score", F.col("width").isNotNull(), "hero_derived", "hero_v1",
                                        "2026-01-01T00:00:00Z")


@query("hero_sidecar", "SCO11", "SCO20", oracle="SELECT * FROM o_hero_sidecar")
def hero_sidecar(a) -> DataFrame:
    return _hero_sidecar(a)


@query("score_failures", "SCO20", "JON4", "JON5", oracle="""
WITH failed AS (SELECT sha1 FROM o_active WHERE width IS NULL)
SELECT m.sha1, 'hero' AS score, 0::DOUBLE AS value, '{}' AS details, 'compute_failed:no image size' AS warnings
FROM o_active m JOIN failed USING (sha1)
UNION ALL SELECT m.sha1, 'semantic', 0, '[]', 'open_failed' FROM o_active m JOIN failed USING (sha1)""")
def score_failures(a) -> DataFrame:
    """Failure rows of two score tables, as the retry work lists of these tables find them again."""
    unreadable = a.active.where("width IS NULL").select("sha1").hint("merge")  # of any number
    version = "semantic_v1"
    rows = sidecars.failure_rows(unreadable, a.semantic, {
        "scene_type": F.lit("unknown"), "top_labels_json": F.lit("[]"), "ai_tags_json": F.lit("[]"),
        "model_version": F.lit(version), "warnings": F.lit("open_failed")})
    semantic = sidecars.upsert(a.semantic, rows, "sha1")
    retried = sidecars.todo_by_warnings(a.active, semantic, version).select("sha1").hint("merge")
    hero = _hero_sidecar(a)
    again = sidecars.todo_by_warnings(a.active, hero, "hero_v1").select("sha1").hint("merge")
    return (hero.where("warnings <> ''").join(again, "sha1", "left_semi")
            .select("sha1", F.lit("hero").alias("score"), F.col("hero_score").alias("value"),
                    F.col("breakdown_json").alias("details"), "warnings")
            .unionByName(semantic.join(unreadable, "sha1", "left_semi").join(retried, "sha1", "left_semi")
                         .select("sha1", F.lit("semantic").alias("score"), F.col("semantic_score").alias("value"),
                                 F.col("top_labels_json").alias("details"), "warnings")))


@query("cull_scores", "SCO12", "PRJ21", oracle=f"""
SELECT sha1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    (tech * 0.34 + aes * 0.20 + prom * 0.26 + face * 0.14 + sem * 0.06
     + CASE WHEN ppl THEN 0.03 ELSE 0 END + CASE WHEN ani THEN 0.04 ELSE 0 END
     + CASE WHEN ani THEN prom * 0.08 ELSE 0 END + CASE WHEN {CULL_PET} THEN 0.03 ELSE 0 END)
    * CASE WHEN tech < 0.20 THEN 0.45 ELSE 1 END * CASE WHEN doc THEN 0.70 ELSE 1 END
    * CASE WHEN shot THEN 0.60 ELSE 1 END)), 6) AS cull_score,
  round(tech, 6) AS technical_score, round(aes, 6) AS aesthetic_score, round(prom, 6) AS subject_prominence_score,
  round(sem, 6) AS semantic_score, round(face, 6) AS face_score,
  concat_ws(',', CASE WHEN ppl THEN 'people' END, CASE WHEN ani THEN 'animals' END,
    CASE WHEN ani THEN 'animal_prominence' END, CASE WHEN {CULL_PET} THEN 'dog_summary_bonus' END,
    CASE WHEN tech < 0.20 THEN 'low_tech_penalty' END, CASE WHEN doc THEN 'document_penalty' END,
    CASE WHEN shot THEN 'screenshot_penalty' END) AS note
FROM o_inputs""")
def cull_scores(a) -> DataFrame:
    return ranking_scores.cull_scores(a.star)


view("o_expr_summary", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY expression_score * greatest(area_ratio, 0.000001) DESC,
                                        face_index) AS rn FROM face_expression)
SELECT sha1, count(*) AS face_count_scored, count(*) FILTER (smile_score >= 0.60) AS smiling_face_count,
  count(*) FILTER (eyes_open_score >= 0.55) AS eyes_open_face_count,
  count(*) FILTER (expression_score >= 0.65) AS good_expression_face_count,
  max(CASE WHEN rn = 1 THEN expression_score END) AS best_face_expression_score,
  (coalesce(max(CASE WHEN rn = 1 THEN expression_score END), 0) + coalesce(max(CASE WHEN rn = 2 THEN expression_score END), 0))
    / least(2, count(*)) AS avg_top2_face_expression_score,
  max(CASE WHEN rn = 1 THEN expression_score * area_ratio END) AS prominent_face_expression_score,
  coalesce(max(CASE WHEN rn = 1 THEN expression_score * 1.0 * least(1.0::DOUBLE, greatest(0.10::DOUBLE, area_ratio / 0.05)) END), 0)
  + coalesce(max(CASE WHEN rn = 2 THEN expression_score * 0.7 * least(1.0::DOUBLE, greatest(0.10::DOUBLE, area_ratio / 0.05)) END), 0)
  + coalesce(max(CASE WHEN rn = 3 THEN expression_score * 0.45 * least(1.0::DOUBLE, greatest(0.10::DOUBLE, area_ratio / 0.05)) END), 0)
    AS people_moment_score
FROM r GROUP BY sha1""")


@query("expression_summary", "AGG17", "TOP12", oracle="""
SELECT sha1, face_count_scored, smiling_face_count, eyes_open_face_count, good_expression_face_count,
  round(best_face_expression_score, 9) AS best_face_expression_score,
  round(avg_top2_face_expression_score, 9) AS avg_top2_face_expression_score,
  round(prominent_face_expression_score, 9) AS prominent_face_expression_score,
  round(people_moment_score, 9) AS people_moment_score FROM o_expr_summary""")
def expression_summary(a) -> DataFrame:
    out = ranking_scores.expression_summary(a.expression)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 9) for c in doubles})


@query("expression_metrics", "SCO18", oracle="""
WITH m AS (SELECT sha1, face_index, (smile_left + smile_right) / 2 AS smile,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (blink_left + blink_right) / 2)) AS eyes,
    (squint_left + squint_right) / 2 AS engage, abs(smile_left - smile_right) AS g1, abs(blink_left - blink_right) AS g2,
    abs(squint_left - squint_right) AS g3,
    (brow_up_left + brow_up_right + mouth_upper_left + mouth_upper_right) / 4 AS lift FROM face_expression)
SELECT sha1, face_index, round(smile, 9) AS m_smile, round(eyes, 9) AS m_eyes_open, round(engage, 9) AS m_engagement,
  round(greatest(g1, g2, g3), 9) AS m_asymmetry,
  round(0.50 * smile + 0.18 * eyes + 0.17 * engage + 0.10 * greatest(g1, g2, g3) + 0.05 * lift, 9) AS m_expression FROM m""")
def expression_metrics(a) -> DataFrame:
    names = ["m_smile", "m_eyes_open", "m_engagement", "m_asymmetry", "m_expression"]
    out = ranking_scores.expression_metrics(a.expression)
    return out.select("sha1", "face_index", *[F.round(c, 9).alias(c) for c in names])


def people_signals(a) -> DataFrame:
    return ranking_scores.people_signals(a.star, a.faces, a.expression)


view("o_geometry", """
SELECT sha1, count(*) AS boxes, count(*) FILTER (area_ratio > 0) AS positive,
  list(area_ratio ORDER BY area_ratio DESC) AS areas FROM image_faces GROUP BY sha1""")

view("o_asym", """
SELECT sha1, avg(asymmetry_score) AS asymmetry, sum(asymmetry_score) / count(*) AS asym2 FROM (
  SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY face_index) AS rn FROM face_expression
  WHERE asymmetry_score IS NOT NULL) WHERE rn <= 2 GROUP BY sha1""")


def _step(low: float, high: float, x: str) -> str:
    u = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)))"
    return f"({u} * {u} * (3 - 2 * {u}))"


view("o_people", f"""
WITH j AS (
  SELECT i.*, coalesce(i.face_count, 0) AS fc, coalesce(i.prominent_face_count, 0) AS pc, g.positive,
    CASE WHEN g.positive > 0 THEN g.areas[1] ELSE coalesce(i.largest_face_area_ratio, 0) END AS la,
    coalesce(g.areas[1], i.largest_face_area_ratio, 0) AS lb, coalesce(g.areas[2], 0) AS se, q.asym2,
    coalesce(e.best_face_expression_score, 0) AS e1, coalesce(e.avg_top2_face_expression_score, 0) AS e2,
    coalesce(e.prominent_face_expression_score, 0) AS e3, coalesce(e.people_moment_score, 0) AS e4,
    coalesce(e.good_expression_face_count, 0) AS c1, coalesce(e.smiling_face_count, 0) AS c2,
    coalesce(e.eyes_open_face_count, 0) AS c3
  FROM o_inputs i LEFT JOIN o_geometry g USING (sha1) LEFT JOIN o_asym q USING (sha1)
  LEFT JOIN o_expr_summary e USING (sha1)),
s AS (
  SELECT *, CASE WHEN (CASE WHEN fc > 0 THEN fc ELSE coalesce(positive, 0) END) <= 0 THEN 0::DOUBLE ELSE
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.44 * {_step(0.006, 0.038, 'la')} + 0.18 * {_step(0.003, 0.022, 'se')}
      + 0.30 * {_step(0.010, 0.055, '(la + se)')}
      + 0.08 * {_step(1.0, 3.0, '(CASE WHEN fc > 0 THEN fc ELSE positive END)')})
      * CASE WHEN la < 0.005 AND la + se < 0.008 THEN 0.2 ELSE 1 END)) END AS subj,
    greatest(0, e1 - e2) AS gap FROM j)
SELECT *, CASE WHEN fc <= 0 THEN 0::DOUBLE WHEN pc <= 0 AND lb < 0.006 AND lb + se < 0.009 THEN 0.02::DOUBLE ELSE
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, greatest(0.02 + pow(subj, 0.82) * 0.86,
      CASE WHEN fc >= 2 AND lb >= 0.018 AND se >= 0.008 THEN 0.64 ELSE 0 END,
      CASE WHEN fc >= 2 AND lb >= 0.022 AND se >= 0.010 THEN 0.72 ELSE 0 END,
      CASE WHEN fc >= 2 AND lb + se >= 0.034 THEN 0.78 ELSE 0 END,
      CASE WHEN pc >= 1 AND lb >= 0.018 THEN 0.74 ELSE 0 END, CASE WHEN pc >= 1 AND lb >= 0.028 THEN 0.86 ELSE 0 END,
      CASE WHEN pc >= 1 AND lb >= 0.045 THEN 0.93 ELSE 0 END, CASE WHEN pc >= 2 AND lb >= 0.028 THEN 0.91 ELSE 0 END)))
    END AS pw,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, greatest(0, e2 - 0.6 * gap) * 0.62 + e1 * 0.10 + e3 * 0.04 + e4 * 0.09
    + least(1.0::DOUBLE, (0.45 * c1 + 0.35 * c2 + 0.20 * c3)::DOUBLE / 3) * 0.05
    + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - gap / 0.06)) * 0.05
    + CASE WHEN asym2 IS NULL THEN 0 ELSE least(1.0::DOUBLE, asym2 / 0.16) * 0.05 END)) AS expr
FROM s""")


@query("people_weight", "SCO13", "SCO14", "SCO15", "TOP12", oracle="""
SELECT sha1, round(subj, 6) AS subjectness, round(pw, 6) AS people_weight, round(expr, 6) AS face_expression_score
FROM o_people""")
def people_weight(a) -> DataFrame:
    return people_signals(a).select("sha1", F.round("subjectness", 6).alias("subjectness"),
                                    F.round("pw", 6).alias("people_weight"),
                                    F.round("expr", 6).alias("face_expression_score"))


view("o_people4", """
SELECT * REPLACE (round(tech, 4) AS tech, round(prom, 4) AS prom, round(sem, 4) AS sem,
  CASE WHEN round(coalesce(overall_aesthetic_score, 0), 4) > 0 THEN round(overall_aesthetic_score, 4)
       ELSE round(coalesce(aesthetic_score, 0), 4) END AS aes) FROM o_people""")

V2_COLUMNS = """round(tech, 6) AS technical_score, round(aes, 6) AS aesthetic_score,
  round(prom, 6) AS subject_prominence_score, round(sem, 6) AS semantic_score, round(face, 6) AS face_score,
  round(expr, 6) AS face_expression_score, round(pw, 6) AS people_weight"""

view("o_interesting", f"""
SELECT sha1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    ((tech * 0.16 + aes * 0.30 + prom * 0.28 + sem * 0.18 + face * 0.08) * (1 - pw)
     + (tech * 0.05 + aes * 0.03 + prom * 0.01 + sem * 0.01 + face * 0.01 + expr * 0.89) * pw
     + CASE WHEN ppl THEN 0.03 ELSE 0 END + CASE WHEN ani THEN 0.06 ELSE 0 END
     + CASE WHEN ani THEN prom * 0.10 ELSE 0 END + CASE WHEN {HERO_PET} THEN 0.05 ELSE 0 END
     + CASE WHEN land AND pw < 0.18 THEN 0.03 ELSE 0 END + CASE WHEN food THEN 0.02 ELSE 0 END)
    * CASE WHEN tech < 0.25 THEN 0.55 ELSE 1 END * CASE WHEN doc THEN 0.45 ELSE 1 END
    * CASE WHEN shot THEN 0.35 ELSE 1 END)), 6) AS score, {V2_COLUMNS},
  concat_ws(',', CASE WHEN ppl THEN 'people' END, CASE WHEN ani THEN 'animals' END,
    CASE WHEN ani THEN 'animal_prominence' END, CASE WHEN {HERO_PET} THEN 'dog_summary_bonus' END,
    CASE WHEN land AND pw < 0.18 THEN 'landscape' END, CASE WHEN food THEN 'food' END,
    CASE WHEN pw >= 0.2 THEN 'people_mode' END, CASE WHEN tech < 0.25 THEN 'low_tech_penalty' END,
    CASE WHEN doc THEN 'document_penalty' END, CASE WHEN shot THEN 'screenshot_penalty' END) AS note FROM o_people4""")


@query("interesting_scores", "SCO16", "PRJ21", oracle="SELECT * FROM o_interesting")
def interesting_scores(a) -> DataFrame:
    return ranking_scores.interesting_scores(people_signals(a))


view("o_cull2", f"""
SELECT sha1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    ((tech * 0.34 + aes * 0.26 + prom * 0.24 + face * 0.08 + sem * 0.08) * (1 - pw)
     + (tech * 0.08 + aes * 0.03 + prom * 0.01 + sem * 0.01 + face * 0.01 + expr * 0.86) * pw
     + CASE WHEN ppl THEN 0.02 ELSE 0 END + CASE WHEN ani THEN 0.04 ELSE 0 END
     + CASE WHEN ani THEN prom * 0.08 ELSE 0 END + CASE WHEN {CULL_PET} THEN 0.03 ELSE 0 END)
    * CASE WHEN tech < 0.20 THEN 0.45 ELSE 1 END * CASE WHEN doc THEN 0.70 ELSE 1 END
    * CASE WHEN shot THEN 0.60 ELSE 1 END)), 6) AS score, {V2_COLUMNS},
  concat_ws(',', CASE WHEN ppl THEN 'people' END, CASE WHEN ani THEN 'animals' END,
    CASE WHEN ani THEN 'animal_prominence' END, CASE WHEN {CULL_PET} THEN 'dog_summary_bonus' END,
    CASE WHEN pw >= 0.2 THEN 'people_mode' END, CASE WHEN tech < 0.20 THEN 'low_tech_penalty' END,
    CASE WHEN doc THEN 'document_penalty' END, CASE WHEN shot THEN 'screenshot_penalty' END) AS note FROM o_people4""")


@query("cull_scores_v2", "SCO17", oracle="SELECT * FROM o_cull2")
def cull_scores_v2(a) -> DataFrame:
    return ranking_scores.cull_scores_v2(people_signals(a))


@query("technical_score", "SCO1", oracle="""
SELECT sha1, round(0.35 * least(1.0::DOUBLE, sharpness / 1000) + 0.20 * least(1.0::DOUBLE, contrast / 64)
  + 0.15 * (1 - abs(brightness - 127) / 127) + 0.20 * least(1.0::DOUBLE, edge_density * 4)
  + 0.10 * least(1.0::DOUBLE, width * height / 1000000.0::DOUBLE / 12), 6) AS score FROM image_scores""")
def technical_score(a) -> DataFrame:
    return ranking_scores.technical_score(a.technical).select("sha1", F.round("score", 6).alias("score"))


def _L(x: str, a: float, s: float) -> str:
    return f"(1 / (1 + exp(-({x} - {a}) / {s})))"


@query("aesthetic_heuristic", "SCO4", oracle=f"""
WITH m AS (
  SELECT i.sha1, brightness AS mean, contrast AS std, sharpness / 5 AS laplacian, 4 + 4 * resolution_score AS entropy,
    60 * technical_score AS colourfulness, saliency_score AS saturation, edge_density AS edges,
    interest_score / 2 AS saliency_mean, composition_score AS thirds, aesthetic_score AS balance,
    subject_prominence_score AS touch, technical_score / 3 AS box_share, resolution_score / 4 AS mask_share
  FROM image_scores i JOIN aesthetic_scores USING (sha1)),
p AS (SELECT *, 1 - least(1.0::DOUBLE, abs(mean / 255 - 0.5) / 0.5) AS exposure FROM m),
q AS (SELECT *, least(1.0::DOUBLE, 0.35 * thirds + 0.35 * balance + 0.15 * (1 - touch) + 0.15 * exposure) AS comp,
  least(1.0::DOUBLE, 0.45 * {_L('box_share', 0.18, 0.10)}
    + 0.35 * greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, mask_share / 0.25)) + 0.20 * (1 - touch)) AS subj FROM p)
SELECT sha1, round(comp, 6) AS composition_score, round(subj, 6) AS subject_score,
  round(least(1.0::DOUBLE, 0.22 * {_L('laplacian', 120, 80)} + 0.18 * least(1.0::DOUBLE, std / 64) + 0.14 * exposure
    + 0.12 * least(1.0::DOUBLE, saturation / 0.65) + 0.12 * {_L('colourfulness', 35, 18)} + 0.12 * comp
    + 0.10 * {_L('entropy', 6.5, 1)}), 6) AS aesthetic_score,
  round({_L('saliency_mean', 0.22, 0.08)}, 6) AS saliency_score,
  round(least(1.0::DOUBLE, 0.30 * subj + 0.20 * {_L('saliency_mean', 0.22, 0.08)} + 0.20 * {_L('entropy', 6.5, 1)}
    + 0.15 * {_L('colourfulness', 35, 18)} + 0.15 * least(1.0::DOUBLE, edges / 0.18)), 6) AS interest_score,
  round(exposure, 6) AS exposure_score FROM q""")
def aesthetic_heuristic(a) -> DataFrame:
    t = a.technical
    joined = t.join(a.aesthetic.drop("model_version", "scored_at"), "sha1")
    metrics = joined.selectExpr(
        "sha1", "brightness AS mean", "contrast AS std", "sharpness / 5 AS laplacian",
        "4 + 4 * resolution_score AS entropy", "60 * technical_score AS colourfulness",
        "saliency_score AS saturation", "edge_density AS edges", "interest_score / 2 AS saliency_mean",
        "composition_score AS thirds", "aesthetic_score AS balance", "subject_prominence_score AS touch",
        "technical_score / 3 AS box_share", "resolution_score / 4 AS mask_share")
    names = ["composition_score", "subject_score", "aesthetic_score", "saliency_score", "interest_score",
             "exposure_score"]
    return ranking_scores.heuristic_aesthetics(metrics).select("sha1", *[F.round(c, 6).alias(c) for c in names])


def _blend(h: str, m: str) -> str:
    return f"CASE WHEN {m} IS NULL THEN {h} ELSE 0.45 * {h} + 0.55 * {m} END"


@query("aesthetic_blend", "SCO5", oracle=f"""
WITH b AS (
  SELECT t.sha1, {_blend('t.technical_score', 'a.aesthetic_score')} AS ab,
    {_blend('t.resolution_score', 'a.composition_score')} AS cb,
    {_blend('t.technical_score', 'a.subject_prominence_score')} AS sb,
    {_blend('t.resolution_score', 'a.interest_score')} AS ib
  FROM image_scores t LEFT JOIN aesthetic_scores a USING (sha1))
SELECT sha1, round(ab, 6) AS aesthetic_blend, round(cb, 6) AS composition_blend, round(sb, 6) AS subject_blend,
  round(ib, 6) AS interest_blend, round(0.35 * ab + 0.30 * cb + 0.20 * sb + 0.15 * ib, 6) AS overall FROM b""")
def aesthetic_blend(a) -> DataFrame:
    t = a.technical.selectExpr("sha1", "technical_score AS aesthetic_heuristic",
                               "resolution_score AS composition_heuristic", "technical_score AS subject_heuristic",
                               "resolution_score AS interest_heuristic")
    m = a.aesthetic.selectExpr("sha1", "aesthetic_score AS aesthetic_model", "composition_score AS composition_model",
                               "subject_prominence_score AS subject_model", "interest_score AS interest_model")
    names = ["aesthetic_blend", "composition_blend", "subject_blend", "interest_blend", "overall"]
    return ranking_scores.blended_aesthetics(t.join(m, "sha1", "left")).select(
        "sha1", *[F.round(c, 6).alias(c) for c in names])


BOX = "greatest({0}, round({1} * {2})::INT)"

view("o_boxes", """
WITH p AS (SELECT sha1, face_index, img_width AS iw, img_height AS ih, greatest(0, round(x * 2.2973)::INT) AS face_x,
    greatest(0, round(y * 1.7093)::INT) AS face_y, greatest(1, round(w * 2.2973)::INT) AS face_w, greatest(1, round(h * 1.7093)::INT) AS face_h
  FROM image_faces),
c AS (SELECT * REPLACE (least(face_w, iw - face_x) AS face_w, least(face_h, ih - face_y) AS face_h) FROM p WHERE face_x < iw AND face_y < ih)
SELECT *, face_w * face_h / (iw::DOUBLE * ih) AS area FROM c""")


def _scaled(a) -> DataFrame:
    return a.faces.withColumns({"scale_x": F.lit(2.2973), "scale_y": F.lit(1.7093)})


@query("face_boxes", "AGG16", oracle="""
SELECT sha1, face_index, face_x, face_y, face_w, face_h, round(area, 9) AS area, round(face_x / iw, 9) AS x_norm, round(face_y / ih, 9) AS y_norm,
  round(face_w / iw, 9) AS w_norm, round(face_h / ih, 9) AS h_norm FROM o_boxes""")
def face_boxes(a) -> DataFrame:
    names = ["area", "x_norm", "y_norm", "w_norm", "h_norm"]
    return ranking_scores.scaled_boxes(_scaled(a)).select("sha1", "face_index", "face_x", "face_y", "face_w", "face_h",
                                                          *[F.round(c, 9).alias(c) for c in names])


@query("face_summary", "AGG16", oracle="""
SELECT sha1, max(iw) AS width, max(ih) AS height, count(*) AS face_count,
  count(*) FILTER (area >= 0.05) AS prominent_face_count, round(max(area), 9) AS largest_face_area_ratio,
  max((area >= 0.05)::INT) AS has_prominent_face FROM o_boxes GROUP BY sha1""")
def face_summary(a) -> DataFrame:
    return ranking_scores.face_summary(_scaled(a)).withColumn("largest_face_area_ratio",
                                                              F.round("largest_face_area_ratio", 9))


@query("padded_faces", "PRJ34", oracle="""
WITH p AS (SELECT *, round(w * 0.28)::INT AS px, round(h * 0.28)::INT AS py FROM image_faces),
c AS (SELECT *, greatest(0, least(x - px, img_width - 1)) AS crop_left, greatest(0, least(y - py, img_height - 1)) AS crop_top
      FROM p),
d AS (SELECT *, greatest(crop_left + 1, least(x + w + px, img_width)) AS crop_right,
        greatest(crop_top + 1, least(y + h + py, img_height)) AS crop_bottom FROM c),
e AS (SELECT *, crop_right - crop_left AS cw, crop_bottom - crop_top AS ch FROM d)
SELECT sha1, face_index, crop_left, crop_top, crop_right, crop_bottom,
  greatest(1, round(cw * (least(greatest(cw, ch, 224), 1024) / greatest(cw, ch)::DOUBLE))::INT) AS crop_w,
  greatest(1, round(ch * (least(greatest(cw, ch, 224), 1024) / greatest(cw, ch)::DOUBLE))::INT) AS crop_h,
  greatest(1, round(img_width * least(1.0::DOUBLE, 1024 / greatest(img_width, img_height)::DOUBLE))::INT) AS work_w,
  greatest(1, round(img_height * least(1.0::DOUBLE, 1800 / greatest(img_width, img_height)::DOUBLE))::INT) AS detect_h
FROM e""")
def padded_faces(a) -> DataFrame:
    out = ranking_scores.padded_boxes(a.faces)
    cw, ch = ranking_scores.crop_size(F.col("crop_right") - F.col("crop_left"),
                                      F.col("crop_bottom") - F.col("crop_top"))
    return out.select("sha1", "face_index", "crop_left", "crop_top", "crop_right", "crop_bottom", cw.alias("crop_w"),
                      ch.alias("crop_h"),
                      ranking_scores.working_size(F.col("img_width"), F.col("img_height"), 1024)[0].alias("work_w"),
                      ranking_scores.working_size(F.col("img_width"), F.col("img_height"), 1800)[1].alias("detect_h"))


@query("caption_clean", "PRJ18", "PRJ19", "PRJ20", oracle=r"""
WITH t AS (
  SELECT sha1, summary_text AS s FROM ai_summaries
  UNION ALL SELECT 'doc' || doc_id::VARCHAR, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') FROM documents),
c AS (SELECT sha1, s, replace(trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')), 'close up', 'close-up') AS one FROM t),
d AS (SELECT sha1, regexp_replace(upper(one[1]) || lower(one[2:]), '\.+$', '') AS bare, s FROM c)
SELECT sha1, CASE WHEN length(bare) > 240 THEN rtrim(bare[1:240], ' ') ELSE bare END AS caption,
  length(lower(trim(regexp_replace(s, '\s+', ' ', 'g')))) AS token_length FROM d""")
def caption_clean(a) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]+", "")
    rows = a.summaries.select("sha1", F.col("summary_text").alias("s")).unionByName(
        a.base("documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("sha1"),
                                   ascii_only.alias("s")))
    return rows.select("sha1", text.clean_caption(F.coalesce("s", F.lit(""))).alias("caption"),
                       F.length(text.normal_token(F.col("s"))).alias("token_length"))


KEYWORD_LISTS = {"cull_pet": text.CULL_PET_WORDS, "hero_pet": text.HERO_PET_WORDS, "landmark": text.LANDMARK_WORDS,
                 "label": ("beach", "mountain", "museum", "food", "sunset", "garden", "tower", "cat", "people", "text")}

view("o_keyword_text", r"""
SELECT s.sha1, summary_text, top_labels_json, ai_tags_json FROM ai_summaries s LEFT JOIN semantic_scores USING (sha1)
UNION ALL SELECT 'doc' || doc_id::VARCHAR, regexp_replace(text, '[^\x00-\x7F]+', '', 'g'), source, lang FROM documents""")
view("o_keyword", "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{word}')" for name, words in KEYWORD_LISTS.items() for word in words) + ") AS k(list, word)")
view("o_keyword_hit", """
SELECT sha1, list, word FROM o_keyword_text, o_keyword
WHERE contains(lower(coalesce(summary_text, '')), word) OR contains(lower(coalesce(top_labels_json, '')), word)
   OR contains(lower(coalesce(ai_tags_json, '')), word)""")


def _keyword_texts(a) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]+", "")
    photos = (a.summaries.select("sha1", "summary_text")
              .join(a.semantic.select("sha1", "top_labels_json", "ai_tags_json"), "sha1", "left"))
    return photos.unionByName(a.base("documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("sha1"), ascii_only.alias("summary_text"),
        F.col("source").alias("top_labels_json"), F.col("lang").alias("ai_tags_json")))


@query("keyword_hits", "PRJ21", oracle="""
SELECT sha1, coalesce(words, '') AS words, coalesce(lists, '') AS lists FROM o_keyword_text LEFT JOIN (
  SELECT sha1, string_agg(DISTINCT word, ',' ORDER BY word) AS words, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM o_keyword_hit GROUP BY 1) USING (sha1)""")
def keyword_hits(a) -> DataFrame:
    hits = keywords.with_hits(_keyword_texts(a), ["summary_text", "top_labels_json", "ai_tags_json"], KEYWORD_LISTS)
    return hits.select("sha1", F.array_join("words", ",").alias("words"), F.array_join("lists", ",").alias("lists"))


@query("keyword_usage", "PRJ21", oracle="""
SELECT list, word, count(DISTINCT sha1) AS n_rows, min(sha1) AS first
FROM o_keyword LEFT JOIN o_keyword_hit USING (list, word) GROUP BY 1, 2""")
def keyword_usage(a) -> DataFrame:
    return keywords.word_usage(_keyword_texts(a), ["summary_text", "top_labels_json", "ai_tags_json"], KEYWORD_LISTS, "sha1")


@query("label_display", "PRJ23", oracle="""
SELECT sha1, CASE WHEN json_valid(top_labels_json) THEN coalesce(array_to_string(list_transform(
    from_json(top_labels_json, '[{"label":"VARCHAR","score":"DOUBLE"}]')[1:6],
    lambda x: x.label || ' (' || printf('%.2f', x.score) || ')'), ', '), '') ELSE '' END AS display,
  CASE WHEN ai_tags_json IS NULL THEN '' ELSE array_to_string(from_json(ai_tags_json, '["VARCHAR"]'), ', ') END AS tags
FROM semantic_scores""")
def label_display(a) -> DataFrame:
    return a.semantic.select("sha1", text.label_display(text.parse_labels(F.col("top_labels_json"))).alias("display"),
                             F.array_join(text.parse_strings(F.col("ai_tags_json")), ", ").alias("tags"))


@query("ai_tags", "SCO8", "FIL12", oracle="""
WITH p AS (SELECT *, from_json(CASE WHEN json_valid(top_labels_json) THEN top_labels_json ELSE '[]' END,
                               '[{"label":"VARCHAR","score":"DOUBLE"}]') AS labels FROM semantic_scores),
all_tags AS (
  SELECT sha1, is_document_like, is_screenshot_like, list_filter(list_transform(list_concat(
    [scene_type], list_transform(list_filter(labels, lambda x: x.score >= 0.08), lambda x: x.label),
    [CASE WHEN contains_people = 1 THEN 'people' END, CASE WHEN contains_animals = 1 THEN 'animals' END,
     CASE WHEN contains_text = 1 THEN 'text' END, CASE WHEN is_document_like = 1 THEN 'document' END,
     CASE WHEN is_screenshot_like = 1 THEN 'screenshot' END, CASE WHEN is_landscape_like = 1 THEN 'landscape' END,
     CASE WHEN is_landscape_like = 1 THEN 'travel' END, CASE WHEN is_food_like = 1 THEN 'food' END,
     CASE WHEN is_indoor_like = 1 THEN 'indoor' END, CASE WHEN is_outdoor_like = 1 THEN 'outdoor' END,
     CASE WHEN semantic_score >= 0.7 THEN 'interesting' WHEN semantic_score <= 0.35 THEN 'low_information' END]),
    lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '') AS raw FROM p),
u AS (SELECT sha1, is_document_like + is_screenshot_like > 0 AS drop_travel, unnest(raw) AS tag,
             generate_subscripts(raw, 1) AS pos FROM all_tags),
d AS (SELECT sha1, tag, min(pos) AS pos FROM u WHERE NOT (drop_travel AND tag IN ('travel', 'landscape')) GROUP BY 1, 2)
SELECT sha1, string_agg(tag, ',' ORDER BY pos) AS ai_tags FROM (
  SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY pos) AS rn FROM d) WHERE rn <= 12 GROUP BY sha1""")
def ai_tags(a) -> DataFrame:
    rows = a.semantic.withColumn("labels", text.parse_labels(F.col("top_labels_json")))
    return semantics.with_ai_tags(rows).select("sha1", F.array_join("ai_tags", ",").alias("ai_tags"))
