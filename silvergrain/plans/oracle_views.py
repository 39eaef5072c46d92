"""Shared oracle views, written directly in SQL from the operator definitions."""
from __future__ import annotations

from silvergrain.plans.oracle import view

view("o_active", "SELECT * FROM media WHERE is_deleted = 0")

view("o_raw_tags", """
SELECT sha1, trim(t) AS tag FROM (
  SELECT sha1, unnest(string_split(coalesce(path_tags, '') || ',' || coalesce(custom_tags, ''), ',')) AS t
  FROM o_active) WHERE trim(t) <> ''""")

view("o_tags", r"""
SELECT DISTINCT sha1, array_to_string(list_transform(
    regexp_extract_all(lower(tag), '(\p{L}+|\P{L}+)'), lambda r: upper(r[1]) || r[2:]), '') AS tag
FROM o_raw_tags
WHERE lower(tag) NOT IN ('pictures', 'photos', 'photographs', 'media', 'images', 'topaz-undated')
  AND NOT regexp_full_match(tag, '\d{4}')""")

view("o_tag_text", "SELECT sha1, string_agg(tag, ',' ORDER BY tag) AS tags FROM o_tags GROUP BY sha1")

view("o_browse", """
SELECT *,
  CASE WHEN undated = 1 THEN CASE WHEN contains(web_path, '/') THEN string_split(web_path, '/')[-2] ELSE 'Root' END END
    AS folder_group,
  CASE WHEN undated = 0 THEN substr(final_dt, 1, 4) END AS year,
  CASE WHEN undated = 0 THEN substr(final_dt, 6, 2) END AS month,
  CASE WHEN undated = 0 THEN strftime(stamp, '%B') END AS month_name,
  CASE WHEN undated = 0 THEN substr(final_dt, 9, 2) END AS day,
  CASE WHEN undated = 0 THEN substr(final_dt, 1, 10) END AS date_key,
  CASE WHEN undated = 0 THEN substr(final_dt, 1, 3) || '0s' END AS decade,
  epoch(stamp)::BIGINT AS ts
FROM (SELECT *, replace(rel_fqn, chr(92), '/') AS web_path,
        CASE WHEN starts_with(final_dt, '0000') THEN 1 ELSE 0 END AS undated,
        try_strptime(final_dt, '%Y-%m-%d %H:%M:%S') AS stamp,
        coalesce(abs(latitude) > 0.000001 OR abs(longitude) > 0.000001, FALSE) AS has_gps
      FROM o_active)""")

view("o_star", """
SELECT m.*, t.technical_score, f.face_count, f.prominent_face_count, f.largest_face_area_ratio,
  a.overall_aesthetic_score, a.aesthetic_score, a.subject_prominence_score, s.semantic_score, s.scene_type,
  s.top_labels_json, s.ai_tags_json, s.contains_people, s.contains_animals, s.contains_text, s.is_document_like,
  s.is_screenshot_like, s.is_landscape_like, s.is_food_like, s.is_indoor_like, s.is_outdoor_like, c.summary_text
FROM o_active m LEFT JOIN image_scores t USING (sha1) LEFT JOIN image_face_summary f USING (sha1)
LEFT JOIN aesthetic_scores a USING (sha1) LEFT JOIN semantic_scores s USING (sha1)
LEFT JOIN ai_summaries c USING (sha1)""")

FACE_SCORE = """
CASE WHEN coalesce(face_count, 0) <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.30 * least(1.0::DOUBLE, ln(1.0::DOUBLE + face_count))
  + CASE WHEN largest_face_area_ratio > 0 THEN 0.45 * least(1.0::DOUBLE, largest_face_area_ratio / 0.18) ELSE 0 END
  + 0.15 * least(1.0::DOUBLE, prominent_face_count / 2.0::DOUBLE) + 0.10)) END"""

view("o_inputs", f"""
SELECT *, coalesce(technical_score, 0)::DOUBLE AS tech,
  CASE WHEN coalesce(overall_aesthetic_score, 0) > 0 THEN overall_aesthetic_score
       ELSE coalesce(aesthetic_score, 0) END::DOUBLE AS aes,
  coalesce(subject_prominence_score, 0)::DOUBLE AS prom, coalesce(semantic_score, 0)::DOUBLE AS sem,
  {FACE_SCORE} AS face, coalesce(contains_people, 0) = 1 AS ppl, coalesce(contains_animals, 0) = 1 AS ani,
  coalesce(is_document_like, 0) = 1 AS doc, coalesce(is_screenshot_like, 0) = 1 AS shot,
  coalesce(is_landscape_like, 0) = 1 AS land, coalesce(is_food_like, 0) = 1 AS food,
  lower(coalesce(summary_text, '')) AS cap
FROM o_star""")

HERO_PET = ("(contains(cap, 'dog') OR contains(cap, 'puppy') OR contains(cap, 'golden retriever')"
            " OR contains(cap, 'great pyrenees') OR contains(cap, 'pet'))")
CULL_PET = "(ani AND (contains(cap, 'dog') OR contains(cap, 'puppy') OR contains(cap, 'pet')))"

view("o_hero", f"""
SELECT sha1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    (tech * 0.14 + aes * 0.20 + prom * 0.22 + sem * 0.14 + face * 0.30
     + CASE WHEN ppl THEN 0.07 ELSE 0 END + CASE WHEN ani THEN 0.06 ELSE 0 END
     + CASE WHEN ani THEN prom * 0.10 ELSE 0 END + CASE WHEN {HERO_PET} THEN 0.05 ELSE 0 END
     + CASE WHEN land THEN 0.03 ELSE 0 END + CASE WHEN food THEN 0.02 ELSE 0 END)
    * CASE WHEN tech < 0.25 THEN 0.55 ELSE 1 END * CASE WHEN doc THEN 0.45 ELSE 1 END
    * CASE WHEN shot THEN 0.35 ELSE 1 END)), 6) AS hero_score,
  round(tech, 6) AS technical_score, round(aes, 6) AS aesthetic_score, round(prom, 6) AS subject_prominence_score,
  round(sem, 6) AS semantic_score, round(face, 6) AS face_score,
  concat_ws(',', CASE WHEN ppl THEN 'people' END, CASE WHEN ani THEN 'animals' END,
    CASE WHEN ani THEN 'animal_prominence' END, CASE WHEN {HERO_PET} THEN 'dog_summary_bonus' END,
    CASE WHEN land THEN 'landscape' END, CASE WHEN food THEN 'food' END,
    CASE WHEN tech < 0.25 THEN 'low_tech_penalty' END, CASE WHEN doc THEN 'document_penalty' END,
    CASE WHEN shot THEN 'screenshot_penalty' END) AS note
FROM o_inputs""")

view("o_scored", "SELECT b.*, h.hero_score FROM o_browse b JOIN o_hero h USING (sha1)")
