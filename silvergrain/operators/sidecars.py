"""Signal tables: work lists, keyed writes, child sets, ledgers and joined records."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from silvergrain.functions.score import zero_int
from silvergrain.operators.ordering import top_rows

# Warnings that make an aesthetic row worth another try.
RETRY_PATTERNS = ("clip_model_load_failed", "clip_inference_failed", "CLIP unavailable", "transformers_init_failed",
                  "open_clip_init_failed", "clip_backend_unavailable")

# Names a summary column may have in an export, best first.
SUMMARY_COLUMNS = ("summary", "summary_text", "ai_summary", "caption", "description", "text")


# Tables of photos are never broadcast: a plan's guess of their size may be far too low.

# --- reading -------------------------------------------------------------------

def optional_table(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """A signal table, or an empty one with its schema when nothing was written yet; rows without ``key`` are left out."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return keyed(rows, key) if key else rows


def keyed(rows: DataFrame, key: str = "sha1") -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.col(key) != ""))


# --- work lists ------------------------------------------------------------------

def todo_by_version(active: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Photos without a row of this model version."""
    current = done.where(F.col("model_version") == version).select("sha1").hint("merge")
    return active.select("sha1", "rel_fqn").join(current, "sha1", "left_anti")


def todo_by_presence(active: DataFrame, faces: DataFrame, summary: DataFrame) -> DataFrame:
    """Photos with faces and no expression summary, whatever its version."""
    return (active.select("sha1", "rel_fqn").join(summary.select("sha1").hint("merge"), "sha1", "left_anti")
            .join(faces.select("sha1").hint("merge"), "sha1", "left_semi"))


def todo_by_warnings(active: DataFrame, done: DataFrame, version: str, retry: bool = True,
                     limit: int | None = None) -> DataFrame:
    """Photos without a row of this version, and with ``retry`` those whose row has warnings."""
    clean = done.where(F.col("model_version") == version)
    if retry:
        clean = clean.where(~(F.col("warnings") != "") | F.col("warnings").isNull())
    rows = active.select("sha1", "rel_fqn").join(clean.select("sha1").hint("merge"), "sha1", "left_anti")
    return rows.orderBy("sha1").limit(limit) if limit else rows


def todo_by_patterns(active: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Photos without a row, with another version, or with a retryable warning."""
    fine = F.lit(True)
    for pattern in RETRY_PATTERNS:
        fine = fine & ~F.contains(F.lower(F.coalesce("warnings", F.lit(""))), F.lit(pattern.lower()))
    settled = done.where((F.col("model_version") == version) & fine).select("sha1").hint("merge")
    return active.select("sha1", "rel_fqn").join(settled, "sha1", "left_anti")


# --- keyed writes: each returns the next version of the table --------------------

def upsert(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """New rows win by key. ``order`` picks one new row per key when keys repeat."""
    if order is not None:
        new = top_rows(new, list(keys), 1, order, name="_n").drop("_n")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows win by key; only unknown keys are added."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def replace_children(old: DataFrame, parents: DataFrame, children: DataFrame, key: str = "sha1") -> DataFrame:
    """All children of the given parents are dropped and the new set put in."""
    return old.join(parents.select(key), key, "left_anti").unionByName(children)


def with_new_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive schema upgrade: missing columns appear with their default."""
    return rows.withColumns({name: value for name, value in defaults.items() if name not in rows.columns})


def run_ledger(scored: DataFrame, model: str) -> DataFrame:
    """One ledger row: attempted, scored without warning, failed."""
    failed = F.coalesce(F.col("warnings"), F.lit("")).contains("failed")
    return scored.agg(F.count(F.lit(1)).alias("images_attempted"), F.count_if(~failed).alias("images_scored"),
                      F.count_if(failed).alias("images_failed")).withColumn("model_name", F.lit(model))


def ledger_rows(scored: DataFrame, model: str, notes: str = "") -> DataFrame:
    """One row per model version found in a signal table: span of its scores, and what was scored and failed."""
    failed = F.coalesce(F.col("warnings"), F.lit("")).contains("failed")
    return scored.groupBy("model_version").agg(
        F.min("scored_at").alias("started_at"), F.max("scored_at").alias("completed_at"),
        F.count(F.lit(1)).alias("images_attempted"), F.count_if(~failed).alias("images_scored"),
        F.count_if(failed).alias("images_failed")).select(
        "started_at", "completed_at", F.lit(model).alias("model_name"), "model_version", "images_attempted",
        "images_scored", "images_failed", F.lit(notes).alias("notes"))


def appended_runs(ledger: DataFrame | None, runs: DataFrame) -> DataFrame:
    """The ledger with further runs, numbered on from its last one; a batch of runs has one row per model version."""
    last = ledger.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0] if ledger is not None else 0
    numbered = runs.withColumn("run_id", (F.row_number().over(Window.orderBy("model_version")) + last).cast("long"))
    numbered = numbered.select("run_id", *runs.columns)
    return numbered if ledger is None else ledger.unionByName(numbered)


def failure_rows(unreadable: DataFrame, template: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows for photos whose input could not be read, in the columns of a signal table.

    Scores are 0, texts empty, flags 0; ``values`` names what differs, the
    warning among it, which retry work lists pick up.
    """
    blank = {"string": F.lit(""), "double": F.lit(0.0), "int": F.lit(0)}
    return unreadable.select("sha1", *[values.get(c, blank.get(t, F.lit(None))).cast(t).alias(c)
                                       for c, t in template.dtypes if c != "sha1"])


# --- exports ---------------------------------------------------------------------

def summary_export(summaries: DataFrame) -> DataFrame:
    """Non-blank summaries under their export names; the first known text column is used."""
    found = [c for c in SUMMARY_COLUMNS if c in summaries.columns]
    if not found:
        raise ValueError(f"no summary column among {summaries.columns}")
    rows = summaries.where(F.coalesce(F.col(found[0]), F.lit("")) != "")
    return rows.select("sha1", F.trim(found[0]).alias("summary"), F.col("model_name").alias("model"), "model_version",
                       F.col("scored_at").alias("timestamp"), "warnings")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- joined records ----------------------------------------------------------------

def faces_by_area(active: DataFrame, faces: DataFrame) -> DataFrame:
    """Each photo's faces, largest first, as one small array per photo."""
    key = F.struct((-F.col("area_ratio")).alias("neg"), "face_index", "x", "y", "w", "h", "confidence")
    return (active.select("sha1", "rel_fqn").join(faces, "sha1")
            .groupBy("sha1", "rel_fqn").agg(F.array_sort(F.collect_list(key)).alias("faces")))


def people_override(semantic: DataFrame, face_summary: DataFrame) -> DataFrame:
    """A detected face always sets the people flag."""
    joined = semantic.join(face_summary.select("sha1", "face_count"), "sha1", "left")
    return joined.withColumn("contains_people", F.when(zero_int(F.col("face_count")) > 0, 1)
                             .otherwise(F.col("contains_people")))


def wide_record(active: DataFrame, technical: DataFrame, face_summary: DataFrame, faces: DataFrame,
                expression: DataFrame, expression_summary: DataFrame, aesthetic: DataFrame, semantic: DataFrame,
                summaries: DataFrame) -> DataFrame:
    """One record per photo over all signal tables with its faces as arrays in index order."""
    boxes = faces.groupBy("sha1").agg(F.array_sort(F.collect_list(F.struct(
        "face_index", "x", "y", "w", "h", "area_ratio"))).alias("boxes"))
    looks = expression.groupBy("sha1").agg(F.array_sort(F.collect_list(F.struct(
        "face_index", "expression_score", "asymmetry_score"))).alias("looks"))
    return (active.join(technical.select("sha1", "technical_score", "sharpness"), "sha1", "left")
            .join(face_summary.select("sha1", "face_count", "largest_face_area_ratio"), "sha1", "left")
            .join(boxes, "sha1", "left").join(looks, "sha1", "left")
            .join(expression_summary.select("sha1", "people_moment_score"), "sha1", "left")
            .join(aesthetic.select("sha1", "overall_aesthetic_score"), "sha1", "left")
            .join(semantic.select("sha1", "semantic_score", "scene_type"), "sha1", "left")
            .join(summaries.select("sha1", "summary_text"), "sha1", "left"))
