"""Label banks: zero-shot probabilities, flags, semantic score and tags.

A bank's vectors go to the workers in blocks of at most ``BANK_BYTES``, and
every photo is scored against a block by a matrix product over its Arrow batch. Of a
block a photo keeps the largest product, the sum of exponentials relative to
it, and its labels; maxima and sums of blocks merge exactly, so probabilities never overflow and a bank has
no largest size. One block, the usual case, needs no shuffle at all.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions.score import clamp01, logistic, zero_int
from silvergrain.session import cut_lineage, ship_package

SUBJECT_SCENES = ("group_photo", "portrait", "landscape", "nature", "food", "animal")
PEOPLE_SCENES = ("portrait", "group_photo")
#: Bytes of label vectors that are broadcast at once.
BANK_BYTES = 64 << 20
#: Products that a task holds at once.
PRODUCTS = 2_000_000
#: Decimal places of a product within which two labels tie; the earlier of the bank comes first.
TIE_PLACES = 12


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and rows of the vectors that have ``dims`` components, none of them null."""
    whole = [i for i, v in enumerate(column) if v.is_valid and len(v.values) == dims and not v.values.null_count]
    rows = column.take(pa.array(whole, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.array(whole, np.int64), rows.reshape(len(whole), dims)


def softmax_parts(rows: np.ndarray, bank: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each row: the largest product, the sum of exponentials relative to it, and labels with their products.

    Labels are all of the bank, or the first ``limit`` by product; ties in bank order. The bank passes by in
    pieces, with a running maximum and sum.
    """
    n, step = len(rows), max(1, PRODUCTS // max(1, len(rows)))
    top, total = np.full(n, -np.inf), np.zeros(n)
    of_row, of_label, products = [], [], []
    for at in range(0, len(bank), step):
        part = rows @ bank[at:at + step].T
        higher = np.maximum(top, part.max(1))
        total = total * np.exp(top - higher) + np.exp(part - higher[:, None]).sum(1)
        top = higher
        kept = np.ones(part.shape, bool)
        if limit and part.shape[1] > limit:
            ranked = np.round(part, TIE_PLACES)
            kept = ranked >= np.partition(ranked, -limit, axis=1)[:, -limit, None]
        r, c = np.nonzero(kept)
        of_row.append(r), of_label.append(c + at), products.append(part[r, c])
    r, label, product = map(np.concatenate, (of_row, of_label, products))
    order = np.lexsort((label, -np.round(product, TIE_PLACES), r)) if limit else np.lexsort((label, r))
    r, label, product = r[order], label[order], product[order]
    borders = np.searchsorted(r, np.arange(n + 1))
    ends = np.minimum(borders[1:], borders[:-1] + limit) if limit else borders[1:]
    cut = [slice(a, b) for a, b in zip(borders, ends)]
    return top, total, [label[s] for s in cut], [product[s] for s in cut]


LABELS = "array<struct<label_pos:{kind},label:string,logit:double>>"


def _scored(images: DataFrame, bank: DataFrame, key: str, limit: int | None, bank_bytes: int) -> DataFrame:
    """``key, top, total, labels`` of every image over the whole bank."""
    spark = images.sparkSession
    ship_package(spark)
    kind, of_key = dict(bank.dtypes)["label_pos"], dict(images.dtypes)[key]
    schema = f"key {of_key}, top double, total double, labels {LABELS.format(kind=kind)}"
    bank = bank.select("label_pos", F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    bank = cut_lineage(bank)
    size = bank.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size["n"]:
        raise ValueError("a label bank needs at least one label")
    blocks = -(-size["n"] * size["dims"] * 8 // bank_bytes)
    found = []
    for block in range(blocks):
        part = bank.where(F.pmod(F.xxhash64("label_pos"), F.lit(blocks)) == block).orderBy("label_pos").toArrow()
        if not part.num_rows:
            continue
        _, vectors = _vectors(part["vector"].combine_chunks(), size["dims"])
        if len(vectors) < part.num_rows:
            raise ValueError("all vectors of a label bank have one length and no null")
        sent = spark.sparkContext.broadcast((vectors, part["label_pos"].combine_chunks(), part["label"].combine_chunks()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bank_vectors, places, names = sent.value
            step = max(1, PRODUCTS // len(bank_vectors)) if limit is None else 4096
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    whole, rows = _vectors(some.column(1), bank_vectors.shape[1])
                    top, total, labels, products = softmax_parts(rows, bank_vectors, limit) if len(rows) else ([], [], [], [])
                    n, order = some.num_rows, np.full(some.num_rows, -1)
                    order[whole] = np.arange(len(whole))
                    missing = order < 0
                    lengths = np.zeros(n, np.int64)
                    lengths[whole] = [len(x) for x in labels]
                    flat = np.concatenate(labels) if labels else np.zeros(0, np.int64)
                    items = pa.StructArray.from_arrays(
                        [places.take(pa.array(flat)), names.take(pa.array(flat)),
                         pa.array(np.concatenate(products) if labels else np.zeros(0))], ["label_pos", "label", "logit"])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(missing, False))
                    at_row = np.maximum(order, 0)
                    number = lambda v: pa.array(np.append(v, 0.0)[at_row if len(whole) else np.zeros(n, int)], mask=missing)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), number(top), number(total), pa.ListArray.from_arrays(offsets, items)],
                        ["key", "top", "total", "labels"])

        scored = images.select(F.col(key).alias("key"), "vector").mapInArrow(score, schema)
        if blocks == 1:
            return scored.withColumnRenamed("key", key)
        found.append(cut_lineage(scored))
        sent.unpersist()
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    parts = union.groupBy("key").agg(F.max("top").alias("highest"), F.collect_list(F.struct("top", "total")).alias("sums"),
                                     F.flatten(F.collect_list("labels")).alias("labels"))
    total = F.aggregate("sums", F.lit(0.0), lambda acc, s: acc + s["total"] * F.exp(s["top"] - F.col("highest")))
    return parts.select(F.col("key").alias(key), F.col("highest").alias("top"), total.alias("total"),
                        F.when(F.col("highest").isNotNull(), F.col("labels")).alias("labels"))


def _probability(item: Column) -> Column:
    return F.exp(item["logit"] - F.col("top")) / F.col("total")


def label_probabilities(images: DataFrame, bank: DataFrame, key: str, bank_bytes: int = BANK_BYTES) -> DataFrame:
    """``key, probs``: softmax over the products with every bank label, as one array per image in bank order.

    ``images`` needs a unique ``key`` and ``vector``, ``bank`` the columns ``label_pos`` (unique), ``label, vector``. An image whose
    vector is missing, has a null or another length than the bank's gets null.
    """
    rows = _scored(images, bank, key, None, bank_bytes)
    probs = F.transform("labels", lambda s: F.struct(s["label_pos"].alias("label_pos"), s["label"].alias("label"),
                                                     _probability(s).alias("p")))
    return rows.select(key, F.array_sort(probs).alias("probs"))


def top_probabilities(images: DataFrame, bank: DataFrame, key: str, limit: int = 6, bank_bytes: int = BANK_BYTES) -> DataFrame:
    """``key, top``: the first ``limit`` labels by probability, scores rounded to six places.

    The same as the first of :func:`label_probabilities`, but only these labels leave a task. Ties in bank order.
    """
    rows = _scored(images, bank, key, limit, bank_bytes)
    keyed = F.transform("labels", lambda s: F.struct((-F.round(s["logit"], TIE_PLACES)).alias("neg"), s["label_pos"].alias("pos"),
                                                     s["label"].alias("label"), F.round(_probability(s), 6).alias("score")))
    return rows.select(key, F.transform(F.slice(F.array_sort(keyed), 1, limit),
                                        lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"))).alias("top"))


def top_labels(probs: Column, limit: int = 6) -> Column:
    """Labels by probability, ties in bank order, scores rounded to six places."""
    keyed = F.array_sort(F.transform(probs, lambda s: F.struct((-s["p"]).alias("neg"), s["label_pos"].alias("pos"),
                                                               s["label"].alias("label"))))
    return F.transform(F.slice(keyed, 1, limit), lambda s: F.struct(s["label"].alias("label"),
                                                                    F.round(-s["neg"], 6).alias("score")))


def best_label(probs: Column) -> Column:
    return F.element_at(top_labels(probs, 1), 1)["label"]


def prompt_margin(images: DataFrame, bank: DataFrame, centre: float = 0.0, scale: float = 0.03) -> DataFrame:
    """Mean positive similarity minus mean negative similarity through a logistic.

    A mean of products is the product with the mean vector, so a bank of any size comes down to one vector.
    """
    cells = bank.select("label", F.posexplode("vector").alias("dim", "v"))
    mean = lambda side: F.avg(F.when(F.col("label") == side, F.col("v").cast("double")))
    axis = (cells.groupBy("dim").agg((mean("pos") - mean("neg")).alias("v"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("axis")))
    scored = images.crossJoin(F.broadcast(axis)).withColumn("margin", dot(F.col("vector"), F.col("axis")))  # one row
    return scored.withColumn("score", clamp01(logistic(F.col("margin"), centre, scale))).drop("axis")


def pair_flag(yes: Column, no: Column, threshold: float) -> Column:
    share = yes / F.greatest(F.lit(1e-8), yes + no)
    return (share >= threshold).cast("int")


def semantic_flags(probs: DataFrame) -> DataFrame:
    """Nine flags from bank probabilities, scene consistency and detected faces."""
    people = (F.col("people_max") >= 0.20) | F.col("scene_type").isin(*PEOPLE_SCENES) | (
        zero_int(F.col("face_count")) > 0)
    return probs.withColumns({
        "contains_people": people.cast("int"),
        "contains_animals": pair_flag(F.col("animals_yes"), F.col("animals_no"), 0.52),
        "contains_text": pair_flag(F.col("text_yes"), F.col("text_no"), 0.52),
        "is_document_like": pair_flag(F.col("document_yes"), F.col("document_no"), 0.54),
        "is_screenshot_like": pair_flag(F.col("screenshot_yes"), F.col("screenshot_no"), 0.54),
        "is_landscape_like": pair_flag(F.col("landscape_yes"), F.col("landscape_no"), 0.53),
        "is_food_like": pair_flag(F.col("food_yes"), F.col("food_no"), 0.53),
        "is_indoor_like": (F.col("indoor") >= F.col("outdoor")).cast("int"),
        "is_outdoor_like": (F.col("outdoor") > F.col("indoor")).cast("int"),
    })


def semantic_score(rows: DataFrame) -> DataFrame:
    """Interest mix with bonuses and penalties, clamped and rounded to six places."""
    m, o, b = F.col("meaningful"), F.col("ordinary"), F.col("boring")
    base = clamp01((m + o * 0.45) / F.greatest(F.lit(1e-8), m + o + b))
    on = lambda name: F.col(name) == 1
    score = base
    for cond, bonus in ((on("contains_people"), 0.10), (on("contains_animals"), 0.06), (on("is_landscape_like"), 0.07),
                        (F.col("scene_type").isin(*SUBJECT_SCENES), 0.05)):
        score = score + F.when(cond, bonus).otherwise(0.0)
    bare_text = on("contains_text") & ~on("contains_people") & ~on("contains_animals") & ~on("is_food_like")
    for cond, factor in ((on("is_document_like"), 0.45), (on("is_screenshot_like"), 0.35), (bare_text, 0.80)):
        score = score * F.when(cond, factor).otherwise(1.0)
    return rows.withColumn("semantic_score", F.round(clamp01(score), 6))


def semantic_warnings(face_count: Column, scene_type: Column, contains_people: Column) -> Column:
    by_face = zero_int(face_count) > 0
    by_scene = ~by_face & scene_type.isin(*PEOPLE_SCENES) & (contains_people == 1)
    return F.concat_ws("|", F.when(by_face, F.lit("people_from_face_override")),
                       F.when(by_scene, F.lit("people_from_scene_override")))


def with_ai_tags(rows: DataFrame) -> DataFrame:
    """Ordered distinct tags from scene, gated labels, flags and score; first twelve."""
    on = lambda name: F.col(name) == 1
    gated = F.transform(F.filter("labels", lambda s: s["score"] >= 0.08), lambda s: s["label"])
    flagged = F.array(
        F.when(on("contains_people"), "people"), F.when(on("contains_animals"), "animals"),
        F.when(on("contains_text"), "text"), F.when(on("is_document_like"), "document"),
        F.when(on("is_screenshot_like"), "screenshot"), F.when(on("is_landscape_like"), "landscape"),
        F.when(on("is_landscape_like"), "travel"), F.when(on("is_food_like"), "food"),
        F.when(on("is_indoor_like"), "indoor"), F.when(on("is_outdoor_like"), "outdoor"),
        F.when(F.col("semantic_score") >= 0.70, "interesting")
        .when(F.col("semantic_score") <= 0.35, "low_information"))
    raw = F.concat(F.array("scene_type"), gated, flagged)
    clean = F.filter(F.transform(raw, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    distinct = F.array_distinct(clean)
    travel = F.array(F.lit("travel"), F.lit("landscape"))
    kept = F.when(on("is_document_like") | on("is_screenshot_like"), F.array_except(distinct, travel)).otherwise(distinct)
    return rows.withColumn("ai_tags", F.slice(kept, 1, 12))
