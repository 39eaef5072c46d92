"""Streaming queries: files arrive in steps, each step is one available-now run."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import ranking_scores
from silvergrain.plans.ingest import files
from silvergrain.plans.registry import query
from silvergrain.session import cut_lineage, shared_folder
from silvergrain.streaming import incremental


@query("stream_ingest", "STR1", "JON11", "SNK2", oracle="""
SELECT content_sha1, file_id FROM (SELECT *, row_number() OVER (PARTITION BY content_sha1 ORDER BY source_rank, rel_path, file_id)
  AS rn FROM o_good) WHERE rn = 1""")
def stream_ingest(a) -> DataFrame:
    """Three sources delivered one after the other; the earliest source of a content wins."""
    base = shared_folder(a.spark, "stream-ingest")
    rows = files(a)
    for rank in range(3):
        rows.where(F.col("source_rank") == rank).write.mode("append").parquet(f"{base}/in")
        stream = incremental.file_stream(a.spark, f"{base}/in", rows.schema)
        incremental.ingest_stream(stream, f"{base}/table", f"{base}/state").awaitTermination()
    return a.spark.read.parquet(f"{base}/table").select("content_sha1", "file_id")


@query("stream_bursts", "STR2", "WIN1", oracle="""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 15 THEN 1 ELSE 0 END AS opens
           FROM o_placed WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY lat3, lon3 ORDER BY ts, sha1)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY lat3, lon3 ORDER BY ts, sha1) AS cluster FROM g)
SELECT lat3, lon3, count(*) AS size, min(ts) AS first_taken, max(ts) AS last_taken,
  arg_max(sha1, (hero_score, final_dt, sha1)) AS best_sha1 FROM c GROUP BY lat3, lon3, cluster""")
def stream_bursts(a) -> DataFrame:
    """Photos arrive in four batches from the newest to the oldest; bursts are split over batches."""
    base = shared_folder(a.spark, "stream-bursts")
    keys = ["lat3", "lon3"]
    rows = cut_lineage(a.placed.where("has_gps AND ts IS NOT NULL").select(*keys, "ts", "hero_score", "final_dt", "sha1"))
    year = F.substring("final_dt", 1, 4)
    parts = [year >= "2003", year < "2003"]
    odd = F.col("sha1").rlike("[13579bdf]$")
    for part in parts:
        for half in (odd, ~odd):
            rows.where(part & half).write.mode("append").parquet(f"{base}/in")
            stream = incremental.file_stream(a.spark, f"{base}/in", rows.schema)
            incremental.burst_stream(stream, keys, f"{base}/table", f"{base}/state").awaitTermination()
    stored = incremental.current_sessions(a.spark.read.parquet(f"{base}/table"), keys)
    return stored.select(*keys, "size", "first_taken", "last_taken", F.col("best.sha1").alias("best_sha1"))


@query("stream_scores", "STR3", "SNK1", "JON2", oracle="""
SELECT sha1, round(0.35 * least(1.0::DOUBLE, sharpness / 1000) + 0.20 * least(1.0::DOUBLE, contrast / 64)
  + 0.15 * (1 - abs(brightness - 127) / 127) + 0.20 * least(1.0::DOUBLE, edge_density * 4)
  + 0.10 * least(1.0::DOUBLE, width * height / 1000000.0::DOUBLE / 12), 6) AS score FROM (
  SELECT * REPLACE (CASE WHEN model_version = 'technical_v0' THEN sharpness / 2 ELSE sharpness END AS sharpness)
  FROM image_scores)""")
def stream_scores(a) -> DataFrame:
    """Signals of the old version arrive again, corrected; the later score of a photo is current."""
    base = shared_folder(a.spark, "stream-scores")
    signals = a.technical
    redone = signals.where("model_version = 'technical_v0'").withColumn("sharpness", F.col("sharpness") / 2)

    def score(rows: DataFrame) -> DataFrame:
        return ranking_scores.technical_score(rows).select("sha1", F.round("score", 6).alias("score"))

    for step in (signals, redone):
        step.write.mode("append").parquet(f"{base}/in")
        stream = incremental.file_stream(a.spark, f"{base}/in", signals.schema)
        incremental.scoring_stream(stream, score, f"{base}/log", f"{base}/state").awaitTermination()
    return incremental.latest_scores(a.spark.read.parquet(f"{base}/log"))
