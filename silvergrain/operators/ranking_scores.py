"""Ranking scores: per-photo arithmetic over the joined signal tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.functions.score import (cap1, clamp01, joined_notes, logistic, smoothstep, weighted, zero,
                                         zero_int)


def signal_star(active: DataFrame, technical: DataFrame, faces: DataFrame, aesthetic: DataFrame,
                semantic: DataFrame, summaries: DataFrame) -> DataFrame:
    """Active photos left-joined to five signal tables on ``sha1``.

    All sides hold one row per key, so the join neither fans out nor skews, and
    one hash partitioning on ``sha1`` serves the whole chain.
    """
    flags = ["contains_people", "contains_animals", "contains_text", "is_document_like", "is_screenshot_like",
             "is_landscape_like", "is_food_like", "is_indoor_like", "is_outdoor_like"]
    return (
        active
        .join(technical.select("sha1", "technical_score"), "sha1", "left")
        .join(faces.select("sha1", "face_count", "prominent_face_count", "largest_face_area_ratio"), "sha1", "left")
        .join(aesthetic.select("sha1", "overall_aesthetic_score", "aesthetic_score", "subject_prominence_score"),
              "sha1", "left")
        .join(semantic.select("sha1", "semantic_score", "scene_type", "top_labels_json", "ai_tags_json", *flags),
              "sha1", "left")
        .join(summaries.select("sha1", "summary_text"), "sha1", "left")
    )


def face_score(count: Column, prominent: Column, largest: Column) -> Column:
    n, p, r = zero_int(count), zero_int(prominent), zero(largest)
    raised = (0.30 * cap1(F.log1p(n)) + F.when(r > 0, 0.45 * cap1(r / 0.18)).otherwise(0.0)
              + 0.15 * cap1(p / 2.0) + 0.10)
    return F.when(n > 0, clamp01(raised)).otherwise(F.lit(0.0))


def overall_aesthetic(overall: Column, plain: Column) -> Column:
    """The blended score when it is positive, else the plain one."""
    return F.when(zero(overall) > 0, zero(overall)).otherwise(zero(plain))


def _flag(name: str) -> Column:
    return zero_int(F.col(name)) != 0


def _signals(star: DataFrame, digits: int | None = None) -> DataFrame:
    """Null-safe score inputs; ``digits`` rounds them as the detail view shows them."""
    def shown(column: Column) -> Column:
        return F.round(column, digits) if digits is not None else column

    return star.withColumns({
        "tech": shown(zero(F.col("technical_score"))),
        "aes": overall_aesthetic(shown(F.col("overall_aesthetic_score")), shown(F.col("aesthetic_score"))),
        "prom": shown(zero(F.col("subject_prominence_score"))),
        "sem": shown(zero(F.col("semantic_score"))),
    })


def _breakdown(scored: DataFrame, name: str, *extra: str) -> DataFrame:
    return scored.select(
        "sha1", F.round(clamp01(F.col("raw")), 6).alias(name), F.round("tech", 6).alias("technical_score"),
        F.round("aes", 6).alias("aesthetic_score"), F.round("prom", 6).alias("subject_prominence_score"),
        F.round("sem", 6).alias("semantic_score"), F.round("face", 6).alias("face_score"), *extra, "note")


def hero_scores(star: DataFrame, *extra: str) -> DataFrame:
    """Batch hero score with its breakdown and notes, and further columns of the star."""
    rows = _signals(star).withColumn(
        "face", face_score(F.col("face_count"), F.col("prominent_face_count"), F.col("largest_face_area_ratio")))
    pet = text.contains_any(F.col("summary_text"), text.HERO_PET_WORDS)
    people, animals = _flag("contains_people"), _flag("contains_animals")
    land, food = _flag("is_landscape_like"), _flag("is_food_like")
    doc, shot = _flag("is_document_like"), _flag("is_screenshot_like")
    tech, prom = F.col("tech"), F.col("prom")
    score = weighted((tech, 0.14), (F.col("aes"), 0.20), (prom, 0.22), (F.col("sem"), 0.14), (F.col("face"), 0.30))
    for cond, bonus in ((people, F.lit(0.07)), (animals, F.lit(0.06)), (animals, prom * 0.10), (pet, F.lit(0.05)),
                        (land, F.lit(0.03)), (food, F.lit(0.02))):
        score = score + F.when(cond, bonus).otherwise(0.0)
    for cond, factor in ((tech < 0.25, 0.55), (doc, 0.45), (shot, 0.35)):
        score = score * F.when(cond, factor).otherwise(1.0)
    note = joined_notes((people, "people"), (animals, "animals"), (animals, "animal_prominence"),
                        (pet, "dog_summary_bonus"), (land, "landscape"), (food, "food"),
                        (tech < 0.25, "low_tech_penalty"), (doc, "document_penalty"), (shot, "screenshot_penalty"))
    return _breakdown(rows.withColumns({"raw": score, "note": note}), "hero_score", *extra)


BREAKDOWN = ("technical_score", "aesthetic_score", "subject_prominence_score", "semantic_score", "face_score")


def score_sidecar(scored: DataFrame, score: str, readable: Column, model: str, version: str, scored_at: str) -> DataFrame:
    """Rows of a batch score table: ``sha1``, the score, ``breakdown_json``, model, time and warnings.

    A photo that can't be read gets a row as well: score 0, an empty breakdown
    and a warning, so that the retry work lists find it.
    """
    parts = [F.format_string(f'"{c}": %.6f', F.col(c)) for c in BREAKDOWN]
    breakdown = F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.format_string('"note": "%s"', "note")), F.lit("}"))
    fine = F.coalesce(readable, F.lit(False))
    return scored.select(
        "sha1", F.when(fine, F.col(score)).otherwise(F.lit(0.0)).alias(score),
        F.when(fine, breakdown).otherwise("{}").alias("breakdown_json"), F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"), F.lit(scored_at).alias("scored_at"),
        F.when(fine, "").otherwise("compute_failed:no image size").alias("warnings"))


def cull_scores(star: DataFrame) -> DataFrame:
    """Batch cull score with its breakdown and notes."""
    rows = _signals(star).withColumn(
        "face", face_score(F.col("face_count"), F.col("prominent_face_count"), F.col("largest_face_area_ratio")))
    people, animals = _flag("contains_people"), _flag("contains_animals")
    pet = animals & text.contains_any(F.col("summary_text"), text.CULL_PET_WORDS)
    doc, shot = _flag("is_document_like"), _flag("is_screenshot_like")
    tech, prom = F.col("tech"), F.col("prom")
    score = weighted((tech, 0.34), (F.col("aes"), 0.20), (prom, 0.26), (F.col("face"), 0.14), (F.col("sem"), 0.06))
    for cond, bonus in ((people, F.lit(0.03)), (animals, F.lit(0.04)), (animals, prom * 0.08), (pet, F.lit(0.03))):
        score = score + F.when(cond, bonus).otherwise(0.0)
    for cond, factor in ((tech < 0.20, 0.45), (doc, 0.70), (shot, 0.60)):
        score = score * F.when(cond, factor).otherwise(1.0)
    note = joined_notes((people, "people"), (animals, "animals"), (animals, "animal_prominence"),
                        (pet, "dog_summary_bonus"), (tech < 0.20, "low_tech_penalty"), (doc, "document_penalty"),
                        (shot, "screenshot_penalty"))
    return _breakdown(rows.withColumns({"raw": score, "note": note}), "cull_score")


# --- detail-view scores ----------------------------------------------------

def _faces_in_order(order: Column, **values: Column) -> Column:
    """The faces of one photo as an array, smallest ``order`` first, then by index; nulls last."""
    key = F.coalesce(order.cast("double"), F.lit(float("inf")))
    return F.array_sort(F.collect_list(F.struct(key.alias("_order"), F.col("face_index"),
                                                *[v.alias(n) for n, v in values.items()])))


def face_geometry(faces: DataFrame) -> DataFrame:
    """Two largest boxes per photo, and how many boxes have an area."""
    area = zero(F.col("area_ratio"))
    found = faces.groupBy("sha1").agg(F.count_if(area > 0).alias("positive_count"),
                                      _faces_in_order(-area, area=area).alias("boxes"))
    return found.select("sha1", "positive_count", F.get("boxes", F.lit(0))["area"].alias("box_largest"),
                        F.coalesce(F.get("boxes", F.lit(1))["area"], F.lit(0.0)).alias("box_second"))


def face_subjectness(count: Column, largest: Column, second: Column) -> Column:
    """How far faces are the subject rather than background."""
    pair = largest + second
    smooth = weighted((smoothstep(0.006, 0.038, largest), 0.44), (smoothstep(0.003, 0.022, second), 0.18),
                      (smoothstep(0.010, 0.055, pair), 0.30),
                      (smoothstep(1.0, 3.0, count.cast("double")), 0.08))
    tiny = (largest < 0.005) & (pair < 0.008)
    return F.when(count <= 0, F.lit(0.0)).otherwise(clamp01(smooth * F.when(tiny, 0.20).otherwise(1.0)))


def people_weight(count: Column, prominent: Column, largest: Column, second: Column, subjectness: Column) -> Column:
    """Share of the people formula in the final score."""
    pair = largest + second
    floors = [
        ((count >= 2) & (largest >= 0.018) & (second >= 0.008), 0.64),
        ((count >= 2) & (largest >= 0.022) & (second >= 0.010), 0.72),
        ((count >= 2) & (pair >= 0.034), 0.78),
        ((prominent >= 1) & (largest >= 0.018), 0.74),
        ((prominent >= 1) & (largest >= 0.028), 0.86),
        ((prominent >= 1) & (largest >= 0.045), 0.93),
        ((prominent >= 2) & (largest >= 0.028), 0.91),
    ]
    curve = 0.02 + F.pow(subjectness, F.lit(0.82)) * 0.86
    raised = F.greatest(curve, *[F.when(cond, F.lit(floor)).otherwise(F.lit(0.0)) for cond, floor in floors])
    background = (prominent <= 0) & (largest < 0.006) & (pair < 0.009)
    return F.when(count <= 0, F.lit(0.0)).when(background, F.lit(0.02)).otherwise(clamp01(raised))


def expression_signal(best: Column, top2: Column, prominent: Column, moment: Column, good: Column, smiling: Column,
                      eyes: Column, asymmetry: Column) -> Column:
    """One expression number per photo; favours even groups over a single best face."""
    gap = F.greatest(F.lit(0.0), best - top2)
    coherence = F.greatest(F.lit(0.0), top2 - gap * 0.60)
    counts = cap1((0.45 * good + 0.35 * smiling + 0.20 * eyes) / 3.0)
    even = clamp01(1.0 - gap / 0.06)
    asym = F.when(asymmetry.isNotNull(), clamp01(asymmetry / 0.16) * 0.05).otherwise(F.lit(0.0))
    return clamp01(weighted((coherence, 0.62), (best, 0.10), (prominent, 0.04), (moment, 0.09), (counts, 0.05),
                            (even, 0.05)) + asym)


def people_signals(star: DataFrame, faces: DataFrame, expression: DataFrame) -> DataFrame:
    """Star rows plus face score, subjectness, people weight and expression signal."""
    rows = star.join(face_geometry(faces), "sha1", "left").join(expression_profile(expression), "sha1", "left")
    n, p = zero_int(F.col("face_count")), zero_int(F.col("prominent_face_count"))
    listed = zero(F.col("largest_face_area_ratio"))
    largest = F.when(zero_int(F.col("positive_count")) > 0, F.col("box_largest")).otherwise(listed)
    second = zero(F.col("box_second"))
    boxed_largest = F.coalesce(F.col("box_largest"), listed)
    count = F.when(n > 0, n).otherwise(zero_int(F.col("positive_count")))
    rows = rows.withColumn("subjectness", face_subjectness(count, largest, second))
    return rows.withColumns({
        "face": face_score(F.col("face_count"), F.col("prominent_face_count"), F.col("largest_face_area_ratio")),
        "pw": people_weight(n, p, boxed_largest, second, F.col("subjectness")),
        "expr": expression_signal(
            zero(F.col("best_face_expression_score")), zero(F.col("avg_top2_face_expression_score")),
            zero(F.col("prominent_face_expression_score")), zero(F.col("people_moment_score")),
            zero_int(F.col("good_expression_face_count")), zero_int(F.col("smiling_face_count")),
            zero_int(F.col("eyes_open_face_count")), F.col("asymmetry")),
    })


def _mixed(scene: Column, people: Column) -> Column:
    return scene * (1.0 - F.col("pw")) + people * F.col("pw")


def interesting_scores(signals: DataFrame) -> DataFrame:
    """Detail-view interest score; signal inputs rounded to four places."""
    rows = _signals(signals, digits=4)
    tech, aes, prom, sem, face = (F.col(c) for c in ("tech", "aes", "prom", "sem", "face"))
    people, animals = _flag("contains_people"), _flag("contains_animals")
    land, food = _flag("is_landscape_like"), _flag("is_food_like")
    doc, shot = _flag("is_document_like"), _flag("is_screenshot_like")
    pet = text.contains_any(F.col("summary_text"), text.HERO_PET_WORDS)
    wide = land & (F.col("pw") < 0.18)
    score = _mixed(
        weighted((tech, 0.16), (aes, 0.30), (prom, 0.28), (sem, 0.18), (face, 0.08)),
        weighted((tech, 0.05), (aes, 0.03), (prom, 0.01), (sem, 0.01), (face, 0.01), (F.col("expr"), 0.89)))
    for cond, bonus in ((people, F.lit(0.03)), (animals, F.lit(0.06)), (animals, prom * 0.10), (pet, F.lit(0.05)),
                        (wide, F.lit(0.03)), (food, F.lit(0.02))):
        score = score + F.when(cond, bonus).otherwise(0.0)
    for cond, factor in ((tech < 0.25, 0.55), (doc, 0.45), (shot, 0.35)):
        score = score * F.when(cond, factor).otherwise(1.0)
    note = joined_notes((people, "people"), (animals, "animals"), (animals, "animal_prominence"),
                        (pet, "dog_summary_bonus"), (wide, "landscape"), (food, "food"),
                        (F.col("pw") >= 0.20, "people_mode"), (tech < 0.25, "low_tech_penalty"),
                        (doc, "document_penalty"), (shot, "screenshot_penalty"))
    return _v2_breakdown(rows.withColumns({"raw": score, "note": note}))


def cull_scores_v2(signals: DataFrame) -> DataFrame:
    """Detail-view cull score; signal inputs rounded to four places."""
    rows = _signals(signals, digits=4)
    tech, aes, prom, sem, face = (F.col(c) for c in ("tech", "aes", "prom", "sem", "face"))
    people, animals = _flag("contains_people"), _flag("contains_animals")
    doc, shot = _flag("is_document_like"), _flag("is_screenshot_like")
    pet = animals & text.contains_any(F.col("summary_text"), text.CULL_PET_WORDS)
    score = _mixed(
        weighted((tech, 0.34), (aes, 0.26), (prom, 0.24), (face, 0.08), (sem, 0.08)),
        weighted((tech, 0.08), (aes, 0.03), (prom, 0.01), (sem, 0.01), (face, 0.01), (F.col("expr"), 0.86)))
    for cond, bonus in ((people, F.lit(0.02)), (animals, F.lit(0.04)), (animals, prom * 0.08), (pet, F.lit(0.03))):
        score = score + F.when(cond, bonus).otherwise(0.0)
    for cond, factor in ((tech < 0.20, 0.45), (doc, 0.70), (shot, 0.60)):
        score = score * F.when(cond, factor).otherwise(1.0)
    note = joined_notes((people, "people"), (animals, "animals"), (animals, "animal_prominence"),
                        (pet, "dog_summary_bonus"), (F.col("pw") >= 0.20, "people_mode"),
                        (tech < 0.20, "low_tech_penalty"), (doc, "document_penalty"), (shot, "screenshot_penalty"))
    return _v2_breakdown(rows.withColumns({"raw": score, "note": note}))


def _v2_breakdown(rows: DataFrame) -> DataFrame:
    return _breakdown(rows.withColumns({"face_expression_score": F.round("expr", 6),
                                        "people_weight": F.round("pw", 6)}),
                      "score", "face_expression_score", "people_weight")


# --- single-signal scores ----------------------------------------------------

def technical_score(metrics: DataFrame) -> DataFrame:
    """Sharpness, contrast, brightness, edges and resolution in one number."""
    megapixels = F.col("width") * F.col("height") / 1000000.0
    score = weighted((cap1(F.col("sharpness") / 1000), 0.35), (cap1(F.col("contrast") / 64), 0.20),
                     (1 - F.abs(F.col("brightness") - 127) / 127, 0.15), (cap1(F.col("edge_density") * 4), 0.20),
                     (cap1(megapixels / 12.0), 0.10))
    return metrics.withColumn("score", score)


def heuristic_aesthetics(metrics: DataFrame) -> DataFrame:
    """Composition, subject, aesthetic and interest scores from image metrics."""
    c = {name: F.col(name) for name in ("mean", "std", "laplacian", "entropy", "colourfulness", "saturation", "edges",
                                        "saliency_mean", "thirds", "balance", "touch", "box_share", "mask_share")}
    brightness = c["mean"] / 255.0
    exposure = 1.0 - cap1(F.abs(brightness - 0.5) / 0.5)
    composition = clamp01(weighted((c["thirds"], 0.35), (c["balance"], 0.35), (1 - c["touch"], 0.15),
                                   (exposure, 0.15)))
    subject = clamp01(weighted((logistic(c["box_share"], 0.18, 0.10), 0.45),
                               (clamp01(1.0 - cap1(c["mask_share"] / 0.25)), 0.35), (1 - c["touch"], 0.20)))
    aesthetic = clamp01(weighted((logistic(c["laplacian"], 120, 80), 0.22), (clamp01(c["std"] / 64.0), 0.18),
                                 (exposure, 0.14), (clamp01(c["saturation"] / 0.65), 0.12),
                                 (logistic(c["colourfulness"], 35, 18), 0.12), (composition, 0.12),
                                 (logistic(c["entropy"], 6.5, 1), 0.10)))
    saliency = logistic(c["saliency_mean"], 0.22, 0.08)
    interest = clamp01(weighted((subject, 0.30), (saliency, 0.20), (logistic(c["entropy"], 6.5, 1), 0.20),
                                (logistic(c["colourfulness"], 35, 18), 0.15),
                                (clamp01(c["edges"] / 0.18), 0.15)))
    return metrics.withColumns({"composition_score": composition, "subject_score": subject,
                                "aesthetic_score": aesthetic, "saliency_score": saliency,
                                "interest_score": interest, "exposure_score": exposure})


def blended_aesthetics(rows: DataFrame) -> DataFrame:
    """Heuristic 0.45 and model 0.55 per metric; a missing model score leaves the heuristic."""
    out = rows
    for name in ("aesthetic", "composition", "subject", "interest"):
        plain, model = F.col(f"{name}_heuristic"), F.col(f"{name}_model")
        out = out.withColumn(f"{name}_blend", clamp01(F.when(model.isNull(), plain)
                                                      .otherwise(plain * 0.45 + model * 0.55)))
    return out.withColumn("overall", clamp01(weighted(
        (F.col("aesthetic_blend"), 0.35), (F.col("composition_blend"), 0.30), (F.col("subject_blend"), 0.20),
        (F.col("interest_blend"), 0.15))))


def expression_metrics(faces: DataFrame) -> DataFrame:
    """Per-face expression numbers from raw left/right blend values."""
    f = {name: zero(F.col(name)) for name in (
        "smile_left", "smile_right", "blink_left", "blink_right", "squint_left", "squint_right", "brow_up_left",
        "brow_up_right", "mouth_upper_left", "mouth_upper_right")}
    smile = (f["smile_left"] + f["smile_right"]) / 2.0
    eyes = clamp01(1.0 - (f["blink_left"] + f["blink_right"]) / 2.0)
    engage = (f["squint_left"] + f["squint_right"]) / 2.0
    gaps = [F.abs(f[f"{k}_left"] - f[f"{k}_right"]) for k in ("smile", "blink", "squint")]
    asym = F.greatest(*gaps)
    lift = (f["brow_up_left"] + f["brow_up_right"] + f["mouth_upper_left"] + f["mouth_upper_right"]) / 4.0
    return faces.withColumns({
        "m_smile": smile, "m_eyes_open": eyes, "m_engagement": engage, "m_smile_asymmetry": gaps[0],
        "m_blink_asymmetry": gaps[1], "m_squint_asymmetry": gaps[2], "m_asymmetry": asym,
        "m_expression": weighted((smile, 0.50), (eyes, 0.18), (engage, 0.17), (asym, 0.10), (lift, 0.05)),
    })


def expression_profile(faces: DataFrame) -> DataFrame:
    """Expression summary of each photo and the mean asymmetry of its first two faces that have one.

    One pass over the faces: those of a photo are few and fit a row. For the
    summary they are ranked by expression times area.
    """
    weight = F.col("expression_score") * F.greatest("area_ratio", F.lit(0.000001))
    grouped = faces.groupBy("sha1").agg(
        F.count(F.lit(1)).cast("int").alias("face_count_scored"),
        F.count_if(F.col("smile_score") >= 0.60).cast("int").alias("smiling_face_count"),
        F.count_if(F.col("eyes_open_score") >= 0.55).cast("int").alias("eyes_open_face_count"),
        F.count_if(F.col("expression_score") >= 0.65).cast("int").alias("good_expression_face_count"),
        _faces_in_order(-weight, e=F.col("expression_score"), a=F.col("area_ratio")).alias("top"),
        _faces_in_order(F.col("face_index"), asym=F.col("asymmetry_score")).alias("listed"))

    def top(i: int, name: str) -> Column:
        return F.get("top", F.lit(i - 1))[name]

    def moment(i: int, share: float) -> Column:
        part = top(i, "e") * share * cap1(F.greatest(F.lit(0.10), top(i, "a") / 0.05))
        return F.coalesce(part, F.lit(0.0))

    known = F.filter(F.transform("listed", lambda f: f["asym"]), lambda x: x.isNotNull())
    first, second = F.get(known, F.lit(0)), F.get(known, F.lit(1))
    pair = (top(1, "e") + F.coalesce(top(2, "e"), F.lit(0.0))) / F.least(F.lit(2), F.col("face_count_scored"))
    return grouped.select(
        "sha1", "face_count_scored", "smiling_face_count", "eyes_open_face_count", "good_expression_face_count",
        top(1, "e").alias("best_face_expression_score"), pair.alias("avg_top2_face_expression_score"),
        (top(1, "e") * top(1, "a")).alias("prominent_face_expression_score"),
        (moment(1, 1.00) + moment(2, 0.70) + moment(3, 0.45)).alias("people_moment_score"),
        ((first + F.coalesce(second, F.lit(0.0))) / F.when(second.isNull(), 1).otherwise(2)).alias("asymmetry"))


def expression_summary(faces: DataFrame) -> DataFrame:
    """Per-photo expression summary; faces ranked by expression times area."""
    return expression_profile(faces.withColumn("asymmetry_score", F.lit(None).cast("double"))).drop("asymmetry")


def face_summary(boxes: DataFrame, prominent_at: float = 0.05) -> DataFrame:
    """Scale, clamp and normalise detector boxes, then summarise them per photo.

    ``boxes`` needs ``sha1, face_index, img_width, img_height, x, y, w, h, scale_x, scale_y``.
    """
    kept = scaled_boxes(boxes)
    return kept.groupBy("sha1").agg(
        F.max("img_width").alias("width"), F.max("img_height").alias("height"),
        F.count(F.lit(1)).cast("int").alias("face_count"),
        F.count_if(F.col("area") >= prominent_at).cast("int").alias("prominent_face_count"),
        F.max("area").alias("largest_face_area_ratio"),
        F.max((F.col("area") >= prominent_at).cast("int")).alias("has_prominent_face"))


def scaled_boxes(boxes: DataFrame) -> DataFrame:
    def scaled(name: str, axis: str, least: int) -> Column:
        return F.greatest(F.lit(least), F.round(F.col(name) * F.col(axis)).cast("int"))

    wide, high = F.col("img_width"), F.col("img_height")
    placed = boxes.withColumns({"face_x": scaled("x", "scale_x", 0), "face_y": scaled("y", "scale_y", 0),
                                "face_w": scaled("w", "scale_x", 1), "face_h": scaled("h", "scale_y", 1)})
    inside = placed.where((F.col("face_x") < wide) & (F.col("face_y") < high))
    trimmed = inside.withColumns({"face_w": F.least(F.col("face_w"), wide - F.col("face_x")),
                                  "face_h": F.least(F.col("face_h"), high - F.col("face_y"))})
    return trimmed.withColumns({
        "area": F.col("face_w") * F.col("face_h") / (wide.cast("double") * high),
        "x_norm": F.col("face_x") / wide, "y_norm": F.col("face_y") / high,
        "w_norm": F.col("face_w") / wide, "h_norm": F.col("face_h") / high})


def padded_boxes(boxes: DataFrame, pad: float = 0.28) -> DataFrame:
    """Crop rectangle around a face: padded on all sides and held inside the image."""
    px, py = F.round(F.col("w") * pad).cast("int"), F.round(F.col("h") * pad).cast("int")

    def held(value: Column, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(high, value))

    placed = boxes.withColumns({"crop_left": held(F.col("x") - px, F.lit(0), F.col("img_width") - 1),
                                "crop_top": held(F.col("y") - py, F.lit(0), F.col("img_height") - 1)})
    return placed.withColumns({
        "crop_right": held(F.col("x") + F.col("w") + px, F.col("crop_left") + 1, F.col("img_width")),
        "crop_bottom": held(F.col("y") + F.col("h") + py, F.col("crop_top") + 1, F.col("img_height"))})


def crop_size(width: Column, height: Column, least: int = 224, most: int = 1024) -> tuple[Column, Column]:
    """Crop size after scaling its long side into ``least..most``."""
    long_side = F.greatest(width, height)
    target = F.least(F.greatest(long_side, F.lit(least)), F.lit(most))
    scale = target / long_side.cast("double")
    grow = lambda side: F.greatest(F.lit(1), F.round(side * scale).cast("int"))
    return grow(width), grow(height)


def working_size(width: Column, height: Column, long_side: int) -> tuple[Column, Column]:
    """Image size after scaling its long side down to ``long_side``."""
    scale = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))
    shrink = lambda side: F.greatest(F.lit(1), F.round(side * scale).cast("int"))
    return shrink(width), shrink(height)


def document_hero_scores(star: DataFrame) -> DataFrame:
    """The written-down hero formula with its boosts and penalties, and its face interest part."""
    rows = _signals(star)
    count, largest = zero_int(F.col("face_count")), zero(F.col("largest_face_area_ratio"))
    face = F.log1p(count) * 0.6 + largest * 0.4
    landmark = text.contains_any(F.col("top_labels_json"), ("landmark", "mountain", "monument"))
    paper = _flag("is_document_like") | _flag("is_screenshot_like") | _flag("contains_text")
    score = weighted((F.col("tech"), 0.30), (face, 0.30), (F.col("aes"), 0.25), (F.col("sem"), 0.15))
    for cond, bonus in ((count > 0, 0.10), (largest > 0.15, 0.10), (landmark, 0.05)):
        score = score + F.when(cond, bonus).otherwise(0.0)
    for cond, factor in ((F.col("tech") < 0.25, 0.5), (paper, 0.4)):
        score = score * F.when(cond, factor).otherwise(1.0)
    return rows.select("sha1", F.round(clamp01(score), 6).alias("hero_score"), F.round(face, 6).alias("face_interest"))
