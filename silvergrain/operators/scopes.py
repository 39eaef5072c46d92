"""Cards and cells for every timeline node, folder and tag at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.operators.ordering import top_rows

TIMELINE = ["decade", "year", "month"]
#: What :func:`membership` reads.
LEAF = ["decade", "year", "date_key", "folder_group", "web_path", "tags"]


def timeline_cards(dated: DataFrame) -> DataFrame:
    """Counts per decade, year and month from one month-level aggregate.

    The roll-up runs over at most a few thousand month rows. ``pos`` is the
    card order: decades and years newest first, months ascending.
    """
    months = dated.groupBy(*TIMELINE).agg(F.count(F.lit(1)).alias("n"))
    cards = (months.rollup(*TIMELINE).agg(F.sum("n").alias("photo_count"), F.grouping_id().alias("gid"))
             .where("decade IS NOT NULL"))
    # Named after counting: a text maximum would turn the hash aggregate into a sort.
    cards = cards.withColumn("month_name", F.date_format(
        F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)), "MMMM"))
    level = F.when(F.col("gid") == 3, "decade").when(F.col("gid") == 1, "year").otherwise("month")
    parent = F.when(F.col("gid") == 3, "").when(F.col("gid") == 1, F.col("decade")).otherwise(F.col("year"))
    cards = cards.withColumns({
        "level": level, "parent": parent,
        "title": F.when(F.col("gid") == 3, F.col("decade")).when(F.col("gid") == 1, F.col("year"))
        .otherwise(F.col("month_name")),
        "newest": F.when(F.col("gid") == 3, F.col("decade")).when(F.col("gid") == 1, F.col("year")),
    })
    order = Window.partitionBy("level", "parent").orderBy(F.col("newest").desc_nulls_last(), F.col("month"))
    return cards.select("level", "parent", "title", "decade", "year", "month", "photo_count",
                        (F.row_number().over(order) - 1).cast("long").alias("pos"))


def scope_tags(rows: DataFrame, keys: list[str], ascending: bool = False, limit: int = 3) -> DataFrame:
    """Top tags per scope: by count, ties by first encounter in browse order.

    Tags are counted per (scope, tag) with map-side partials before any
    ranking, so a hot scope ships one row per tag and partition.
    """
    stamp = F.coalesce(F.col("ts"), F.lit(-(1 << 40)))
    seen = rows.select(*keys, "sha1", (stamp if ascending else -stamp).alias("o"), F.posexplode("tags").alias("i", "tag"))
    counted = seen.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("tag_count"),
                                             F.min(F.struct("o", "sha1", "i")).alias("first"))
    return rank_tags(counted, keys, limit)


def rank_tags(counted: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    return top_rows(counted, keys, limit, F.desc("tag_count"), F.col("first"), F.col("tag"))


def timeline_tags(dated: DataFrame) -> DataFrame:
    """Top three tags of every decade, year and month from one month-level count."""
    seen = dated.select(*TIMELINE, "sha1", (-F.col("ts")).alias("o"), F.posexplode("tags").alias("i", "tag"))
    monthly = seen.groupBy(*TIMELINE, "tag").agg(F.count(F.lit(1)).alias("n"),
                                                 F.min(F.struct("o", "sha1", "i")).alias("first"))
    levels = F.explode(F.array(
        F.struct(F.lit("decade").alias("level"), F.col("decade").alias("scope")),
        F.struct(F.lit("year").alias("level"), F.col("year").alias("scope")),
        F.struct(F.lit("month").alias("level"), F.concat_ws("-", "year", "month").alias("scope"))))
    counted = (monthly.select(levels.alias("s"), "tag", "n", "first").select("s.*", "tag", "n", "first")
               .groupBy("level", "scope", "tag").agg(F.sum("n").alias("tag_count"), F.min("first").alias("first")))
    return rank_tags(counted, ["level", "scope"])


def day_cells(dated: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per day with photos: count, best photo, top tags, label; only the photo needs scores."""
    best = F.max(F.struct("hero_score", "final_dt", "sha1"))["sha1"]
    days = scored.groupBy("date_key").agg(F.count(F.lit(1)).alias("photo_count"), best.alias("thumb_sha1"))
    tags = (scope_tags(dated, ["date_key"], ascending=True).groupBy("date_key")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"]).alias("t"))
            .select("date_key", F.array_join("t", ",").alias("top_tags"), F.element_at("t", 1).alias("location_label")))
    return days.join(tags, "date_key", "left")


def month_calendar(dated: DataFrame, scored: DataFrame) -> DataFrame:
    """Every day of every month that has photos, Sunday-first weeks, joined to its day cell.

    ``scored`` holds the same photos with their hero score.
    """
    first = F.to_date(F.concat_ws("-", "year", "month", F.lit("01")))
    months = dated.select("year", "month").distinct().withColumn("first", first)
    grid = (months.withColumn("date", F.explode(F.sequence("first", F.last_day("first"), F.expr("INTERVAL 1 DAY"))))
            .withColumn("date_key", F.date_format("date", "yyyy-MM-dd")))
    lead = F.dayofweek("first") - 1
    cells = day_cells(dated, scored)
    return (grid.join(cells, "date_key", "left").select(
        "year", "month", "date_key", F.dayofmonth("date").alias("day"),
        F.floor((F.dayofmonth("date") - 1 + lead) / 7).cast("int").alias("week"),
        (F.dayofweek("date") - 1).alias("weekday"),
        F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
        "thumb_sha1", "top_tags", "location_label",
        F.when(F.col("photo_count") > 0, F.date_format("date", "MMMM d, yyyy")).alias("date_label")))


def undated_cards(undated: DataFrame) -> DataFrame:
    counts = undated.groupBy("folder_group").agg(F.count(F.lit(1)).alias("photo_count"))
    return counts.withColumn("subtitle", F.concat(F.col("photo_count").cast("string"), F.lit(" items")))


def folder_cards(rows: DataFrame) -> DataFrame:
    """Child folders of every folder with recursive counts, and direct-file counts.

    Photos are counted per folder first; only those counts are expanded to the
    folder's ancestors.
    """
    folder = F.when(F.instr("web_path", "/") > 0, F.regexp_replace("web_path", "/[^/]*$", "")).otherwise("")
    direct = rows.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("folder", "/")
    steps = F.when(F.col("folder") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(parts)))
    up = direct.withColumn("parts", parts).withColumn("depth", F.explode(steps))
    children = (up.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
                           F.element_at("parts", F.col("depth")).alias("child"))
                .agg(F.sum("n").alias("photo_count")).withColumn("kind", F.lit("folder")))
    files = direct.select(F.col("folder").alias("parent"), F.lit("").alias("child"), F.col("n").alias("photo_count"),
                          F.lit("files").alias("kind"))
    return children.unionByName(files)


def tag_cards(rows: DataFrame) -> DataFrame:
    return (rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("photo_count"))
            .withColumn("title", F.concat(F.lit("#"), F.col("tag")))
            .withColumn("subtitle", F.concat(F.col("photo_count").cast("string"), F.lit(" items"))))


def membership(rows: DataFrame) -> DataFrame:
    """``scope_type, scope_key`` for every scope a photo belongs to, one row each."""
    folder = F.when(F.instr("web_path", "/") > 0, F.regexp_replace("web_path", "/[^/]*$", "")).otherwise("")
    parts = F.split("folder", "/")
    ancestors = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/")))

    def scope(kind: str, key) -> F.Column:
        return F.struct(F.lit(kind).alias("scope_type"), key.alias("scope_key"))

    single = F.filter(F.array(
        scope("decade", F.col("decade")), scope("year", F.col("year")),
        scope("month", F.substring("date_key", 1, 7)), scope("day", F.col("date_key")),
        scope("undated", F.col("folder_group"))), lambda s: F.coalesce(s["scope_key"], F.lit("")) != "")
    scopes = F.concat(single, F.transform(F.col("ancestors"), lambda p: scope("folder", p)),
                      F.transform(F.col("tags"), lambda t: scope("tag", t)))
    return (rows.withColumn("folder", folder).withColumn("ancestors", ancestors)
            .withColumn("scope", F.explode(scopes)).select("scope.*", *rows.columns))


def leaf_rows(rows: DataFrame) -> DataFrame:
    """A row of each photo for the timeline, its folder and its tags, with the columns ``LEAF`` of these alone.

    Their :func:`membership` is that of the photos, so what leaves have in common can be combined before.
    """
    path = F.substring("web_path", F.lit(1), F.length("web_path") - F.length(F.substring_index("web_path", "/", -1)))
    blank = {c: F.lit(None).cast("string") for c in LEAF} | {"web_path": F.lit(""), "tags": F.array().cast("array<string>")}

    def leaf(**own) -> F.Column:
        return F.struct(*[c.alias(name) for name, c in (blank | own).items()])

    timeline = leaf(**{c: F.col(c) for c in ("decade", "year", "date_key", "folder_group")})
    some = lambda s: (F.coalesce(s["decade"], s["year"], s["date_key"], s["folder_group"]).isNotNull()
                      | (s["web_path"] != "") | (F.size(s["tags"]) > 0))
    leaves = F.filter(F.array(timeline, leaf(web_path=path), leaf(tags=F.col("tags"))), some)
    return rows.withColumn("leaf", F.explode(leaves)).select("leaf.*", *[c for c in rows.columns if c not in LEAF])


def scope_sums(members: DataFrame, sign: str | None = None) -> DataFrame:
    """``scope_type, scope_key, photo_count, s1, s2, s3``: exact sums of slices of up to 60 bits of each id.

    A scope of any size is one partial aggregate per task. With the name of a column of signs,
    members that are taken back count against those that are added.
    """
    weight = F.lit(1) if sign is None else F.col(sign)
    part = lambda at: F.conv(F.substring("sha1", at, 15), 16, 10).cast("decimal(20,0)") * weight.cast("decimal(1,0)")
    return members.groupBy("scope_type", "scope_key").agg(
        F.sum(weight.cast("long")).alias("photo_count"),
        *[F.sum(part(at)).cast("decimal(38,0)").alias(name) for name, at in (("s1", 1), ("s2", 16), ("s3", 31))])


def signatures_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "scope_type", "scope_key", "photo_count",
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("photo_count", "s1", "s2", "s3")]).cast("binary"))
        .alias("signature"))


def scope_signatures(members: DataFrame) -> DataFrame:
    """Order-free digest of each scope's photo set, for change detection: all forty digits of each id are folded."""
    return signatures_of(scope_sums(members))


def changed_scopes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``scope_type, scope_key, status`` from two sets of :func:`scope_signatures`: new, changed, kept or gone."""
    keys = ["scope_type", "scope_key"]
    joined = (stored.select(*keys, F.col("signature").alias("before"))
              .join(fresh.select(*keys, F.col("signature").alias("now")), keys, "full"))
    status = (F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone")
              .when(F.col("before") == F.col("now"), "kept").otherwise("changed"))
    return joined.select(*keys, status.alias("status"))


def selection_signature(selected: DataFrame, version: str) -> DataFrame:
    """Digest of an ordered selection (``scope_type, scope_key, pos, sha1``) and its version.

    A selection holds at most 16 photos per scope, so the list is small.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha1"))), lambda s: s["sha1"])
    return (selected.groupBy("scope_type", "scope_key").agg(ordered.alias("ids"))
            .select("scope_type", "scope_key", F.array_join("ids", ",").alias("sha1_list"),
                    F.md5(F.concat(F.array_join("ids", "|"), F.lit("|" + version)).cast("binary"))
                    .alias("composite_hash")))
