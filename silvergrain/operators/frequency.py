"""Frequencies of flags, scenes, labels and tags over the semantic signals."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.functions import text

FLAGS = ("contains_people", "contains_animals", "contains_text", "is_document_like", "is_screenshot_like",
         "is_landscape_like", "is_food_like", "is_indoor_like", "is_outdoor_like")


def flag_counts(semantic: DataFrame) -> DataFrame:
    """Count and percentage per flag: one aggregate row, unpivoted."""
    sums = semantic.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f) == 1).alias(f) for f in FLAGS])
    long = sums.unpivot(["total"], list(FLAGS), "flag", "flag_count")
    return long.select("flag", text.flag_title(F.col("flag")).alias("title"), "flag_count",
                       F.when(F.col("total") > 0, F.round(100.0 * F.col("flag_count") / F.col("total"), 6))
                       .otherwise(0.0).alias("percent"))


def scene_counts(semantic: DataFrame) -> DataFrame:
    return (semantic.select(text.normal_token(F.col("scene_type")).alias("scene_type")).where("scene_type <> ''")
            .groupBy("scene_type").agg(F.count(F.lit(1)).alias("image_count")))


def label_stats(semantic: DataFrame) -> DataFrame:
    """Per label: images, occurrences, first places, mean and best score.

    A label may repeat inside one photo. The first mention inside the photo's
    own array counts the image, so no distinct shuffle over (label, photo).
    """
    labels = F.transform(text.parse_labels(F.col("top_labels_json")),
                         lambda s: F.struct(text.normal_token(s["label"]).alias("label"),
                                            F.coalesce(s["score"], F.lit(0.0)).alias("score")))
    rows = (semantic.select(labels.alias("labels")).withColumn("names", F.transform("labels", lambda s: s["label"]))
            .select("names", F.posexplode("labels").alias("pos", "item")))
    rows = rows.select("pos", "item.*", (F.array_position("names", F.col("item.label")) - 1 == F.col("pos"))
                       .alias("first_mention")).where("label <> ''")
    return rows.groupBy("label").agg(
        F.count_if("first_mention").alias("image_count"), F.count(F.lit(1)).alias("occurrence_count"),
        F.count_if(F.col("pos") == 0).alias("top1_count"), F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"))


def tag_stats(semantic: DataFrame) -> DataFrame:
    tags = F.transform(text.parse_strings(F.col("ai_tags_json")), text_token)
    rows = semantic.select(tags.alias("names")).select("names", F.posexplode("names").alias("pos", "tag"))
    rows = rows.withColumn("first_mention", F.array_position("names", F.col("tag")) - 1 == F.col("pos"))
    counts = rows.where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("occurrence_count"),
                                                        F.count_if("first_mention").alias("image_count"))
    total = semantic.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "tag", "occurrence_count", "image_count",
        F.round(100.0 * F.col("image_count") / F.col("total"), 6).alias("coverage"))


def text_token(value):
    return text.normal_token(value)


def config_lists(semantic: DataFrame, top: int = 20, min_count: int = 10) -> DataFrame:
    """Ranked lists of frequent labels, tags, scenes and flags, as ``kind, rank, name``.

    Each list is cut by ``orderBy().limit()`` before it is numbered.
    """
    def ranked(kind: str, rows: DataFrame, name: str, *order) -> DataFrame:
        best = rows.orderBy(*order).limit(top).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "*")
        number = F.row_number().over(Window.partitionBy("kind").orderBy(*order)).cast("long")
        return best.select("kind", number.alias("rank"), "name")

    labels = label_stats(semantic).where(F.col("image_count") >= min_count)
    tags = tag_stats(semantic).where(F.col("image_count") >= min_count)
    scenes = scene_counts(semantic).where(F.col("image_count") >= min_count)
    place = F.create_map(*[F.lit(x) for i, f in enumerate(FLAGS) for x in (f, i + 1)])
    flags = flag_counts(semantic).where(F.col("flag_count") >= min_count).withColumn("at", place[F.col("flag")])
    flag_rank = F.row_number().over(Window.partitionBy("kind").orderBy("at")).cast("long")
    flags = flags.withColumn("kind", F.lit("flag")).select("kind", flag_rank.alias("rank"), F.col("flag").alias("name"))
    return (ranked("label", labels, "label", F.desc("image_count"), F.desc("top1_count"), F.desc("avg_score"),
                   F.desc("label"))
            .unionByName(ranked("tag", tags, "tag", F.desc("image_count"), F.desc("tag")))
            .unionByName(ranked("scene", scenes, "scene_type", F.desc("image_count"), F.desc("scene_type")))
            .unionByName(flags))


def scene_frequency(semantic: DataFrame, top: int = 20, min_count: int = 10) -> DataFrame:
    return (scene_counts(semantic).where(F.col("image_count") >= min_count)
            .orderBy(F.desc("image_count"), F.desc("scene_type")).limit(top))
