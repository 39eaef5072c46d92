"""Ranking of photos by formula, cull plans, and moves to holding folders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import geo
from silvergrain.operators.ordering import top_rows

HOLDING = ("_trash", "_stash", "_cull")

#: Holding folder of a plain soft move; other folders are passed by name.
STASH = "_stash"


def formula_order() -> list[Column]:
    """Best first: score, then face, aesthetic and technical score, then the order given."""
    return [F.desc("score"), F.desc("face_score"), F.desc("aesthetic_score"), F.desc("technical_score"),
            F.asc_nulls_last("ts"), F.asc("sha1")]


def winners(scored: DataFrame, group: list[str], keep: int) -> DataFrame:
    """Best ``keep`` photos of each group by formula; a photo has one row per group."""
    return top_rows(scored, group, max(1, keep), *formula_order())


def keepers(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Kept photos of every burst: two of a burst above four photos, else one."""
    ranked = top_rows(members.join(scored, "sha1"), ["cluster_id"], 2, *formula_order())
    return ranked.where(F.col("rank") <= F.when(F.col("size") > 4, 2).otherwise(1))


def cull_plan(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Every burst photo with its verdict: ``keep`` 1 or 0 and the keeper rank.

    Keepers come from a two-row group limit; the verdict joins back on the
    photo id, so a burst of any size stays spread out.
    """
    kept = keepers(members, scored).select("sha1", F.col("rank").cast("long").alias("keeper_rank"))
    return (members.join(kept, "sha1", "left")
            .withColumn("keep", F.col("keeper_rank").isNotNull().cast("int"))
            .select("cluster_id", "sha1", "size", "keep", "keeper_rank"))


def cluster_summary(members: DataFrame, scored: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per burst: size, place bucket, time span, keepers and number dropped."""
    best = (top_rows(members.join(scored, "sha1"), ["cluster_id"], 2, *formula_order())
            .groupBy("cluster_id").agg(F.max(F.when(F.col("rank") == 1, F.col("sha1"))).alias("primary_sha1"),
                                       F.max(F.when(F.col("rank") == 2, F.col("sha1"))).alias("secondary_sha1")))
    shown = members.join(photos.select("sha1", "final_dt", "latitude", "longitude"), "sha1")
    first = F.min(F.struct("ts", "sha1", "latitude", "longitude"))
    spans = shown.groupBy("cluster_id").agg(
        F.max("size").alias("size"), F.min("final_dt").alias("start_time"), F.max("final_dt").alias("end_time"),
        first.alias("first"))
    keep = F.when(F.col("size") > 4, 2).otherwise(1)
    return spans.join(best, "cluster_id").select(
        "cluster_id", "size", geo.coord_key(F.col("first.latitude"), F.col("first.longitude"), 4).alias("gps_bucket"),
        "start_time", "end_time", "primary_sha1", "secondary_sha1", keep.alias("keep_count"),
        (F.col("size") - keep).alias("drop_count"))


def plan_totals(requested: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: photos requested, bursts found, photos to cull, photos kept."""
    asked = requested.agg(F.count(F.lit(1)).alias("requested"))
    found = plan.agg(F.count_if(F.col("keeper_rank") == 1).alias("clusters_found"),
                     F.count_if(F.col("keep") == 0).alias("to_cull"))
    return asked.crossJoin(found).withColumn("kept", F.col("requested") - F.col("to_cull"))


def soft_move(media: DataFrame, request: DataFrame, folder: str) -> DataFrame:
    """The next media table after moving the requested photos under ``folder``.

    ``request`` is ``sha1, pos``. A target path already taken, by a file or by
    an earlier photo of the request, gets ``__`` and eight id digits before
    the extension. Targets are settled one row per path, so many photos with
    one path never meet in a task. Adds ``outcome``: moved, skipped or kept.
    """
    rows = media.join(request, "sha1", "left").withColumn("web_path", F.translate("rel_fqn", "\\", "/"))
    held = F.lit(False)
    for name in HOLDING:
        held = held | F.col("web_path").startswith(f"{name}/")
    rows = rows.withColumn("moves", F.col("pos").isNotNull() & ~held)
    rows = rows.withColumn("target", F.when(F.col("moves"), F.concat(F.lit(f"{folder}/"), F.col("web_path"))))
    taken = rows.where(F.col("web_path").startswith(f"{folder}/")).select(F.col("web_path").alias("target")).distinct()
    free = (rows.where("moves").groupBy("target").agg(F.min(F.struct("pos", "sha1"))["sha1"].alias("sha1"))
            .join(taken, "target", "left_anti").select("sha1", F.lit(True).alias("plain")))
    stem = F.regexp_replace("target", r"(?<=[^/])\.[^./]*$", "")
    suffix = F.col("target").substr(F.length(stem) + 1, F.length("target"))
    renamed = F.concat(stem, F.lit("__"), F.substring("sha1", 1, 8), suffix)
    settled = rows.join(free, "sha1", "left")
    path = F.when(F.col("plain"), F.col("target")).otherwise(renamed)
    return settled.withColumns({
        "rel_fqn": F.when(F.col("moves"), F.translate(path, "/", "\\")).otherwise(F.col("rel_fqn")),
        "is_deleted": F.when(F.col("moves"), 1).otherwise(F.col("is_deleted")),
        "outcome": F.when(F.col("moves"), "moved").when(F.col("pos").isNotNull(), "skipped").otherwise("kept"),
    }).drop("web_path", "target", "moves", "plain", "pos")


def move_counts(request: DataFrame, moved: DataFrame) -> DataFrame:
    asked = request.agg(F.count(F.lit(1)).alias("requested"))
    done = moved.agg(F.count_if(F.col("outcome") == "moved").alias("moved"))
    return asked.crossJoin(done).withColumn("skipped", F.col("requested") - F.col("moved"))


def without_trash(media: DataFrame) -> DataFrame:
    """The next media table after emptying the trash folder."""
    return media.where(~F.translate("rel_fqn", "\\", "/").startswith("_trash/"))
