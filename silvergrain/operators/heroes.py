"""Sixteen representative photos per scope, and time mosaics per place."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import clusters, scopes, sessions
from silvergrain.operators.ordering import top_rows
from silvergrain.session import cut_lineage

CARD = 16
BEST = ("hero_score", "final_dt", "sha1")


def _best_first() -> list[Column]:
    return [F.desc(c) for c in BEST]


def _buckets(met: DataFrame, reduced: DataFrame, keys: list[str]) -> DataFrame:
    """Place buckets of the reduced photos with centroid, weight, best photo and encounter order."""
    met = met.groupBy(*keys, "lat3", "lon3").agg(F.min("met").alias("met"))
    grouped = reduced.where("has_gps").groupBy(*keys, "lat3", "lon3").agg(
        clusters.whole_mean(F.sum(clusters.micro(F.col("latitude"))), F.count(F.lit(1))).alias("lat"),
        clusters.whole_mean(F.sum(clusters.micro(F.col("longitude"))), F.count(F.lit(1))).alias("lon"),
        F.count(F.lit(1)).alias("weight"),
        F.max(F.struct(*BEST)).alias("best"))
    return grouped.join(met, [*keys, "lat3", "lon3"]).withColumns({
        "hero_score": F.col("best.hero_score"), "seen_at": F.col("met.o"), "seen_id": F.col("met.sha1")}).drop("met")


def hero_selection(members: DataFrame, keys: list[str], card: int = CARD, limit: int = clusters.GROUP_LIMIT) -> DataFrame:
    """``keys, pos, sha1, phase``: the card of every scope, best order first.

    Phase 0 is the slot kept for photos without GPS, phase 1 one photo per
    place or region, phase 2 the best of the remaining reduced photos.
    ``members`` is as for :func:`sessions.reduced_candidates`, plus latitude and longitude.
    """
    met = members.where("has_gps").select(*keys, "lat3", "lon3", sessions.encounter().alias("met"))
    return _selection(sessions.reduced_candidates(members, keys), met, keys, card, limit)


def scope_selection(photos: DataFrame, card: int = CARD, limit: int = clusters.GROUP_LIMIT) -> DataFrame:
    """:func:`hero_selection` of all scopes that photos belong to; ``photos`` also has what :func:`scopes.membership` reads."""
    keys = ["scope_type", "scope_key"]
    return _selection(*sessions.reduced_of_scopes(photos, scopes.leaf_rows, scopes.LEAF, scopes.membership, keys), keys, card, limit)


def _selection(candidates: DataFrame, met: DataFrame, keys: list[str], card: int, limit: int) -> DataFrame:
    reduced = cut_lineage(candidates)
    loose = reduced.where(~F.col("has_gps")).groupBy(*keys).agg(F.max(F.struct(*BEST)).alias("best"))
    buckets = cut_lineage(_buckets(met, reduced, keys))
    slots = buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("places")).join(
        loose.select(*keys, F.lit(1).alias("held")), keys, "left")
    slots = slots.select(*keys, "places", (F.lit(card) - F.coalesce("held", F.lit(0))).alias("k"))
    sized = buckets.join(slots, keys)
    many = sized.where(F.col("places") > F.col("k"))
    centres = clusters.region_centres(many, keys, limit=limit)
    region = clusters.nearest_place(F.col("lat"), F.col("lon"), F.col("centres"))
    regions = (many.join(centres, keys).groupBy(*keys, region.alias("region"))
               .agg(F.max("best").alias("best")).select(*keys, "best"))
    few = sized.where(F.col("places") <= F.col("k")).select(*keys, "best")
    chosen = (loose.withColumn("phase", F.lit(0))
              .unionByName(few.unionByName(regions).withColumn("phase", F.lit(1)))
              .select(*keys, "phase", "best.*"))
    # At most `card` photos are chosen per scope, so the best 2*card hold every possible filler.
    pool = top_rows(reduced, keys, 2 * card, *_best_first()).select(*keys, F.lit(2).alias("phase"), *BEST)
    filler = pool.join(chosen.select(*keys, "sha1"), [*keys, "sha1"], "left_anti").select(*chosen.columns)
    ranked = top_rows(chosen.unionByName(filler), keys, card, F.asc("phase"), *_best_first(), name="place")
    return ranked.select(*keys, (F.col("place") - 1).cast("long").alias("pos"), "sha1", "phase")


def place_mosaic(members: DataFrame, keys: list[str], card: int = CARD, limit: int = clusters.GROUP_LIMIT) -> DataFrame:
    """``keys, pos, sha1, photo_count``: time-spread photos of every place.

    One best photo per time cluster in time order, then undated photos, then
    the best of the rest, each by score.
    """
    seconds = cut_lineage(members.where("ts IS NOT NULL").groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(*BEST)).alias("best")))
    centres = clusters.moment_centres(seconds, keys, card, limit=limit)
    own = clusters.nearest_time(F.col("ts"), F.col("centres"))
    owned = seconds.join(centres, keys).withColumn("own", own)
    reps = (owned.groupBy(*keys, "own").agg(F.max("best").alias("best"), F.first(F.element_at("centres", F.col("own") + 1))
                                            .alias("centre"))
            .select(*keys, F.lit(0).alias("phase"), "centre", "best.*"))
    undated = F.when(F.col("ts").isNull(), 1).otherwise(2)
    rest = members.withColumn("phase", undated)
    # A card of each kind is enough: at most `card` photos are shown in all.
    pool = top_rows(rest, [*keys, "phase"], 2 * card, *_best_first()).select(
        *keys, "phase", F.lit(0.0).alias("centre"), *BEST)
    filler = pool.join(reps.select(*keys, "sha1"), [*keys, "sha1"], "left_anti").select(*reps.columns)
    ranked = top_rows(reps.unionByName(filler), keys, card, F.asc("phase"), F.asc("centre"), *_best_first(),
                      name="place")
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("photo_count"))
    return ranked.join(counts, keys).select(*keys, (F.col("place") - 1).cast("long").alias("pos"), "sha1", "photo_count")


# --- earlier selection rules ----------------------------------------------------------

def best_per_minute(members: DataFrame, keys: list[str]) -> DataFrame:
    """One best photo per minute window and scope."""
    minute = F.window(F.timestamp_seconds("ts"), "1 minute")["start"]
    return (members.where("ts IS NOT NULL").groupBy(*keys, minute.alias("minute"))
            .agg(F.max(F.struct(*BEST)).alias("best")).select(*keys, F.unix_timestamp("minute").alias("minute"), "best.*"))


def round_robin(members: DataFrame, keys: list[str], card: int = CARD) -> DataFrame:
    """Best of every place, then second best of every place, up to the card size."""
    place = ["lat3", "lon3"]
    in_place = top_rows(members.where("has_gps"), [*keys, *place], card, *_best_first(), name="turn")
    return top_rows(in_place, keys, card, F.asc("turn"), F.asc("lat3"), F.asc("lon3"), name="place").select(
        *keys, (F.col("place") - 1).cast("long").alias("pos"), "turn", "sha1")
