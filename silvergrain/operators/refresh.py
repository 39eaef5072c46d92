"""Place leaves and scope signatures kept up to date from changes, without another pass over all photos.

A change is a row with ``sign``: -1 takes back a photo as it was, +1 adds it as it
is now; a photo that changed has both. Counts and sums are exact, so what is taken
back leaves no trace. A maximum can't be taken back: only where a leaf loses its
best or its first photo are its photos searched again, and of photos laid out by
leaf (:func:`laid_out`) only the folders of such leaves are read. Untouched leaves
and scopes stay as they are; a change that takes back more than there is fails.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.operators import scopes
from silvergrain.operators.places import PATH
from silvergrain.session import cut_lineage

LEAF = [*PATH, "coord_key"]
SCOPE = ["scope_type", "scope_key"]
SUMS = ["s1", "s2", "s3"]
LAYOUT = "leaf_part"


def _best() -> Column:
    return F.struct("hero_score", "final_dt", "sha1")


def _first() -> Column:
    return F.struct("sha1", "place_label")


def _exact(column: str) -> Column:
    """A coordinate as a decimal, whose sums don't depend on their order."""
    return F.col(column).cast("decimal(24,12)")


def _signed(value: Column) -> Column:
    return F.when(F.col("sign") < 0, -value).otherwise(value)


def _counted(held: Column, change: Column, what: str) -> Column:
    total = F.coalesce(held, F.lit(0)) + change
    return F.when(total >= 0, total).otherwise(
        F.raise_error(F.lit(f"the changes take back more photos than this {what} holds")).cast("long"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that lead from one version of some photos to another; either may lack a photo."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def apply(state: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """The state with its touched rows replaced; those that hold no photo any more go."""
    return state.join(touched, keys, "left_anti").unionByName(touched.where("photo_count > 0"))


# --- place leaves --------------------------------------------------------------------

def leaf_state(records: DataFrame) -> DataFrame:
    """Per city and coordinate: photo count, exact sums of positions, best and first photo."""
    return records.groupBy(*LEAF).agg(
        F.count(F.lit(1)).alias("photo_count"), F.sum(_exact("use_lat")).alias("lat_sum"),
        F.sum(_exact("use_lon")).alias("lon_sum"), F.max(_best()).alias("best"), F.min(_first()).alias("first"))


def leaves_of(state: DataFrame) -> DataFrame:
    """The rows of :func:`silvergrain.operators.places.leaf_nodes`, from a state."""
    return state.select(*LEAF, "photo_count", F.col("lat_sum").cast("double").alias("lat_sum"),
                        F.col("lon_sum").cast("double").alias("lon_sum"), "best", F.col("first.place_label").alias("label"))


def laid_out(rows: DataFrame, parts: int = 256) -> DataFrame:
    """Rows with the number of their leaf's folder, for a table partitioned by it."""
    return rows.withColumn(LAYOUT, F.pmod(F.xxhash64(*LEAF), F.lit(parts)).cast("int"))


def touched_leaves(state: DataFrame, changed: DataFrame, current: DataFrame, parts: int = 256) -> DataFrame:
    """New state of every leaf that a change touches; a count of 0 is a leaf that is gone.

    ``current`` holds the photos after the change. If it is a table partitioned by ``leaf_part`` in ``parts``
    folders, Spark prunes it to the leaves that are searched.
    """
    taken, added = F.col("sign") < 0, F.col("sign") > 0
    change = changed.groupBy(*LEAF).agg(
        F.sum(F.col("sign").cast("long")).alias("d_count"), F.sum(_signed(_exact("use_lat"))).alias("d_lat"),
        F.sum(_signed(_exact("use_lon"))).alias("d_lon"),
        F.max(F.when(added, _best())).alias("best_in"), F.max(F.when(taken, _best())).alias("best_out"),
        F.min(F.when(added, _first())).alias("first_in"), F.min(F.when(taken, _first())).alias("first_out"))
    total = lambda held, extra: (F.coalesce(F.col(held), F.lit(0).cast("decimal(34,12)")) + F.col(extra)).cast("decimal(34,12)")
    # What was taken back is missed only if nothing at least as good came in its place.
    lost = lambda held, out, better: F.coalesce((F.col(out) == F.col(held)) & ~F.coalesce(better, F.lit(False)), F.lit(False))
    merged = cut_lineage(change.join(state, LEAF, "left").select(
        *LEAF, _counted(F.col("photo_count"), F.col("d_count"), "leaf").alias("photo_count"),
        total("lat_sum", "d_lat").alias("lat_sum"), total("lon_sum", "d_lon").alias("lon_sum"),
        F.greatest("best", "best_in").alias("best"), F.least("first", "first_in").alias("first"),
        (lost("best", "best_out", F.col("best_in") >= F.col("best"))
         | lost("first", "first_out", F.col("first_in") <= F.col("first"))).alias("lost")))
    searched = merged.where("lost AND photo_count > 0").select(*LEAF)
    keys = LEAF
    if LAYOUT in current.columns:
        searched, keys = laid_out(searched, parts), [*LEAF, LAYOUT]
    found = current.join(searched, keys, "left_semi").groupBy(*LEAF).agg(
        F.max(_best()).alias("found_best"), F.min(_first()).alias("found_first"))
    return merged.join(found, LEAF, "left").select(
        *LEAF, "photo_count", "lat_sum", "lon_sum", F.when(F.col("lost"), F.col("found_best")).otherwise(F.col("best")).alias("best"),
        F.when(F.col("lost"), F.col("found_first")).otherwise(F.col("first")).alias("first"))


# --- scope signatures -------------------------------------------------------------------

def touched_scopes(state: DataFrame, changed: DataFrame) -> DataFrame:
    """New sums of every scope that a change touches; ``state`` is of :func:`scopes.scope_sums`, ``changed`` has browse columns."""
    one = scopes.scope_sums(scopes.membership(changed), "sign")
    change = one.withColumnsRenamed({c: f"d_{c}" for c in ("photo_count", *SUMS)})
    held = lambda c: (F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")) + F.col(f"d_{c}")).cast("decimal(38,0)").alias(c)
    return change.join(state, SCOPE, "left").select(
        *SCOPE, _counted(F.col("photo_count"), F.col("d_photo_count"), "scope").alias("photo_count"), *[held(c) for c in SUMS])
