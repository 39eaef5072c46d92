"""Incremental jobs: ingest with identity dedupe, streaming bursts, incremental scoring.

Every batch writes its own ``batch=<id>`` partition and overwrites it on a
retry, so a batch that runs twice after a lost executor leaves one copy.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from silvergrain.operators import bloom, ingest
from silvergrain.operators.ordering import ordered_slices, running_max
from silvergrain.operators.sessions import DAY
from silvergrain.operators.sidecars import optional_table
from silvergrain.session import cut_lineage, drop_folder, ship_package
from silvergrain.streaming.session_state import BEST, STATE_STORE, Sessions


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _per_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def earlier_batches(spark: SparkSession, table: str, schema: StructType, batch: int) -> DataFrame:
    """Rows that earlier batches wrote; a retry of ``batch`` does not see its own first try."""
    full = StructType(list(schema.fields)).add("batch", "long")
    return optional_table(spark, table, full).where(F.col("batch") < batch)


def ingest_stream(files: DataFrame, table: str, checkpoint: str, blocks: int = bloom.BLOCKS) -> StreamingQuery:
    """Admits new photos from a stream of file rows into ``table``.

    Inside a batch the first source of a content wins; content that an earlier
    batch admitted is skipped. A Bloom filter of all admitted contents, of ``blocks``
    blocks, stands in front: what it rules out is new without any look at earlier
    rows, and only the rest meets their ids in an anti-join. Each batch writes the
    filter with its own ids added, so the next one reads one filter, however many batches there were.
    """
    schema = StructType([f for f in files.schema.fields if f.name == "content_sha1"]
                        + [f for f in files.schema.fields if f.name != "content_sha1"])

    def admit(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        earlier = earlier_batches(spark, table, schema, batch).select("content_sha1")
        known = known_filter(spark, table, batch, earlier, blocks)
        good = rows.where(ingest.file_kind(F.col("rel_path")) == "photo")
        good = good.where(ingest.admitted(good).isNull())
        nothing = spark.createDataFrame([], "sha1 string")
        tested = cut_lineage(bloom.with_seen(ingest.first_of_each(good, nothing), "content_sha1", known, blocks))
        fresh = tested.where(~F.col("seen"))
        possible = tested.where("seen")
        if not possible.isEmpty():
            fresh = fresh.unionByName(possible.join(repeats(possible, earlier), "content_sha1", "left_anti"))
        fresh.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{table}/batch={batch}")
        added = spark.read.schema(schema).parquet(f"{table}/batch={batch}")
        grown = bloom.united(known.unionByName(bloom.filter_of(added, "content_sha1", blocks)))
        grown.write.mode("overwrite").parquet(filter_path(table, batch, blocks))
        drop_folder(filter_path(table, batch - 2, blocks))  # a retry needs the one before only

    return _per_batch(files, checkpoint, admit)


def repeats(possible: DataFrame, earlier: DataFrame) -> DataFrame:
    """The contents of ``possible`` that earlier batches admitted; the larger side only passes by."""
    return earlier.join(possible.select("content_sha1"), "content_sha1", "left_semi")


def filter_path(table: str, batch: int, blocks: int) -> str:
    """Readers of the table skip folders whose names begin with an underscore."""
    return f"{table}/_known-{blocks}/batch={batch}"


def known_filter(spark: SparkSession, table: str, batch: int, earlier: DataFrame, blocks: int) -> DataFrame:
    """The filter that the batch before left; made anew from the table where there is none."""
    stored = optional_table(spark, filter_path(table, batch - 1, blocks), bloom.SCHEMA)
    return cut_lineage(bloom.filter_of(earlier, "content_sha1", blocks)) if stored.isEmpty() else stored


def distinct_events(events: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """In-stream dedupe with bounded state: repeats of a key within the watermark delay are dropped."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


SESSION = ("size", "first_taken", "last_taken", "best")


def merged_sessions(sessions: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Sessions of a key that lie at most ``gap`` seconds apart become one; sizes add up, the best photo wins.

    Ordered by their first second, a session opens a new one when it starts
    later than the latest end before it. A key of any size is cut into slices.
    """
    order = ["first_taken", "last_taken", "best"]
    sliced = ordered_slices(sessions.select(*keys, *SESSION), *keys, *order)
    reached = running_max(sliced, keys, order, "reached", F.col("last_taken"))
    opened = cut_lineage(reached.withColumn("opens", F.when(
        F.col("reached").isNull() | (F.col("first_taken") - F.col("reached") > gap), F.col("first_taken"))).drop("reached"))
    named = running_max(opened, keys, order, "open_before", F.col("opens"))
    return (named.groupBy(*keys, F.coalesce("opens", "open_before").alias("start"))
            .agg(F.sum("size").alias("size"), F.min("first_taken").alias("first_taken"),
                 F.max("last_taken").alias("last_taken"), F.max("best").alias("best")).drop("start"))


def burst_stream(photos: DataFrame, keys: list[str], table: str, checkpoint: str, gap: int = 15) -> StreamingQuery:
    """Keeps time clusters per key while photos arrive in any order, and logs what changes in ``table``.

    ``photos`` needs the keys, ``ts`` (seconds), ``hero_score, final_dt, sha1``.
    Photo files do not come in the order they were taken, so no photo is ever
    too late. The sessions of a key and day are keyed state in the state store, so a batch reads
    its own photos and the state of the days they touch, never what earlier batches
    wrote. Its touched days go to the batch's partition; read with :func:`current_sessions`.
    A day has at most 86,400 seconds, so the state of a key that holds a third of all photos is
    spread over its days.
    """
    spark = photos.sparkSession
    ship_package(spark)
    of_key = [f for f in photos.schema.fields if f.name in keys]
    best = [f for name in BEST for f in photos.schema.fields if f.name == name]
    stored = StructType().add("size", "long").add("first_taken", "long").add("last_taken", "long")
    for field in best:
        stored.add(field.name, field.dataType)
    schema = StructType(of_key).add("day", "long")
    for field in stored.fields:
        schema.add(field.name, field.dataType)
    days = photos.where("ts IS NOT NULL").withColumn("day", F.floor(F.col("ts") / DAY).cast("long"))
    sessions = days.select(*keys, "day", "ts", *BEST).groupBy(*keys, "day").transformWithStateInPandas(
        Sessions([*keys, "day"], gap, stored), schema, "Update", "None")

    def log(rows: DataFrame, batch: int) -> None:
        rows.select(*keys, "day", "size", "first_taken", "last_taken", F.struct(*BEST).alias("best")
                    ).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return _per_batch(sessions, checkpoint, log, "update")  # the query keeps the setting that it starts with
    finally:
        spark.conf.set(name, before)


def current_sessions(stored: DataFrame, keys: list[str], gap: int = 15) -> DataFrame:
    """The sessions of each key: those of each day as its latest batch left them, joined over midnight."""
    of_day = [*keys, "day"]
    latest = stored.groupBy(*of_day).agg(F.max("batch").alias("batch"))
    return merged_sessions(stored.join(latest, [*of_day, "batch"]), keys, gap)


def append_to(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all available data into a parquet table and stops."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", table)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def scoring_stream(signals: DataFrame, score: Callable[[DataFrame], DataFrame], log: str, checkpoint: str
                   ) -> StreamingQuery:
    """Scores arriving signal rows and appends them to a score log, one partition per batch."""
    def write(rows: DataFrame, batch: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    return _per_batch(signals, checkpoint, write)


def latest_scores(log: DataFrame, key: str = "sha1") -> DataFrame:
    """Current row per key of a score log: a combining ``max_by`` over the batch number."""
    columns = [c for c in log.columns if c not in (key, "batch")]
    newest = F.max_by(F.struct(*columns), "batch").alias("row")
    return log.groupBy(key).agg(newest).select(key, "row.*")
