"""Places: labels, the five-level place tree, galleries and map views."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.functions import geo, text
from silvergrain.functions.score import zero
from silvergrain.operators import sessions
from silvergrain.operators.ordering import top_rows, with_positions
from silvergrain.session import cut_lineage

LEVELS = ("root", "country", "region", "city", "place")

# Map zoom per node level; other levels use DEFAULT_ZOOM.
LEVEL_ZOOM = {"root": 1.0, "country": 2.2, "state": 3.2, "province": 3.2, "region": 3.2, "county": 4.4, "city": 8.0,
              "town": 8.5, "village": 9.0, "hamlet": 9.2, "suburb": 9.6, "road": 11.0, "place": 10.5, "coord": 10.5}
DEFAULT_ZOOM = 4.2


def _first_filled(*columns: str) -> Column:
    """First non-empty value, blanks counting as filled, as the label rules choose before trimming."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def _label(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback))


def place_records(photos: DataFrame, photo_geo: DataFrame, geo_cache: DataFrame) -> DataFrame:
    """One record per located photo with its four place labels.

    Photos without a geocoded row fall back to their own coordinates. A home
    address may hold a third of all photos; its side of the join is left to
    AQE's split of skewed partitions. The coordinate dimension joins on its key; as a written table it is broadcast
    only while its size stays under the broadcast threshold. The links are as many as photos and never are.
    """
    address = ["country", "state", "county", "city", "town", "village", "hamlet", "suburb", "place_name", "formatted",
               "road", "lat_rounded", "lon_rounded"]
    known = photo_geo.join(geo_cache.select("coord_key", *address), "coord_key").withColumn("known", F.lit(True)).hint("merge")
    rows = photos.join(known, "sha1", "left").where("known OR has_gps")
    lat, lon = F.col("latitude"), F.col("longitude")
    key = F.format_string("%.3f,%.3f", lat, lon)
    shown = F.format_string("%.3f, %.3f", lat, lon)
    found = F.coalesce(F.col("known"), F.lit(False))

    def pick(column: str, fallback: Column) -> Column:
        return F.when(found, F.col(column)).otherwise(fallback)

    rows = rows.select(
        *photos.columns, pick("coord_key", key).alias("coord_key"), pick("source_lat", lat).alias("source_lat"),
        pick("source_lon", lon).alias("source_lon"), pick("country", F.lit("Unknown Country")).alias("country"),
        pick("state", F.lit("Unknown Region")).alias("state"),
        *[pick(c, F.lit("")).alias(c) for c in ("county", "city", "town", "village", "hamlet", "suburb", "road")],
        pick("place_name", shown).alias("place_name"), pick("formatted", shown).alias("formatted"),
        pick("lat_rounded", lat).alias("lat_rounded"), pick("lon_rounded", lon).alias("lon_rounded"))
    return rows.withColumns(place_labels()).withColumns({
        "use_lat": F.coalesce(F.nullif("source_lat", F.lit(0.0)), "lat_rounded", F.lit(0.0)),
        "use_lon": F.coalesce(F.nullif("source_lon", F.lit(0.0)), "lon_rounded", F.lit(0.0))})


def place_labels() -> dict[str, Column]:
    return {
        "country_label": _label(F.col("country"), "Unknown Country"),
        "region_label": _label(_first_filled("state", "county"), "Unknown Region"),
        "city_label": _label(_first_filled("city", "town", "village", "hamlet", "suburb", "county", "state"),
                             "Miscellaneous"),
        "place_label": _label(_first_filled("place_name", "road", "formatted"), "Pinned Place"),
    }


PATH = ["country_label", "region_label", "city_label"]


def leaf_nodes(records: DataFrame) -> DataFrame:
    """Photos aggregated per (city, coordinate): the only pass over all records.

    A leaf is keyed by its city and coordinate, which its id spells; its label is the one of its
    first record by id.
    """
    return records.groupBy(*PATH, "coord_key").agg(
        F.count(F.lit(1)).alias("photo_count"), F.sum("use_lat").alias("lat_sum"), F.sum("use_lon").alias("lon_sum"),
        F.max(F.struct("hero_score", "final_dt", "sha1")).alias("best"),
        F.min(F.struct("sha1", "place_label"))["place_label"].alias("label"))


def merged_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves of one city with the same normalised label become one, named by the largest."""
    named = leaves.withColumns({"norm": text.normal_token(F.col("label")),
                                "node_id": F.concat_ws("::", F.lit("place"), *PATH, "coord_key")})
    top = F.max(F.struct("photo_count", "node_id", "coord_key", "label"))
    return named.groupBy(*PATH, "norm").agg(
        top.alias("top"), F.sum("photo_count").alias("photo_count"), F.sum("lat_sum").alias("lat_sum"),
        F.sum("lon_sum").alias("lon_sum"), F.max("best").alias("best"), F.count(F.lit(1)).alias("merged_from")
    ).select(*PATH, "norm", F.col("top.node_id").alias("node_id"), F.col("top.label").alias("label"),
             "photo_count", "lat_sum", "lon_sum", "best", "merged_from")


#: What cards and galleries read of a photo.
MEMBER = ["sha1", "final_dt", "ts", "hero_score"]


def place_tree(records: DataFrame) -> DataFrame:
    """Node table: id, level, label, parent, count, mean position, cover, child count and order."""
    return tree_of(leaf_nodes(records))


def tree_of(leaf_rows: DataFrame) -> DataFrame:
    """The node table over leaves.

    Ancestors roll up from the leaves, not from photos. The leaves are written
    once, and so are the nodes, which are counted and ordered from there.
    """
    leaves = cut_lineage(merged_leaves(leaf_rows))
    upper = leaves.rollup(*PATH).agg(
        F.sum("photo_count").alias("photo_count"), F.sum("lat_sum").alias("lat_sum"),
        F.sum("lon_sum").alias("lon_sum"), F.max("best").alias("best"), F.grouping_id().alias("gid"))
    country, region, city = (F.col(c) for c in PATH)
    ids = {7: F.lit("root"), 3: F.concat(F.lit("country::"), country),
           1: F.concat_ws("::", F.lit("region"), country, region),
           0: F.concat_ws("::", F.lit("city"), country, region, city)}
    parents = {7: F.lit(None).cast("string"), 3: ids[7], 1: ids[3], 0: ids[1]}
    labels = {7: F.lit("World"), 3: country, 1: region, 0: city}
    levels = {7: "root", 3: "country", 1: "region", 0: "city"}

    def by_level(choices: dict) -> Column:
        out = None
        for gid, value in choices.items():
            value = F.lit(value) if isinstance(value, str) else value
            out = F.when(F.col("gid") == gid, value) if out is None else out.when(F.col("gid") == gid, value)
        return out

    stats = ["photo_count", "lat_sum", "lon_sum", "best"]
    nodes = upper.select(by_level(ids).alias("node_id"), by_level(levels).alias("level"),
                         by_level(labels).alias("label"), by_level(parents).alias("parent_id"), *stats)
    tips = leaves.select("node_id", F.lit("place").alias("level"), "label", ids[0].alias("parent_id"), *stats)
    tree = nodes.unionByName(tips).where("photo_count > 0").withColumns({
        "of": F.coalesce("parent_id", F.lit("")), "sort_label": F.lower("label")})
    # A node may have any number of children (all photos without an address share a city), so positions come from slices.
    placed = cut_lineage(with_positions(tree, ["of"], F.desc("photo_count"), F.col("sort_label"), F.col("node_id")))
    children = placed.groupBy(F.col("of").alias("node_id")).agg(F.count(F.lit(1)).alias("child_count"))
    return (placed.join(children, "node_id", "left").withColumn("child_order", F.col("pos") + 1)
            .select("node_id", "level", "label", "parent_id", "photo_count",
                    (F.col("lat_sum") / F.col("photo_count")).alias("lat"),
                    (F.col("lon_sum") / F.col("photo_count")).alias("lon"),
                    F.col("best.sha1").alias("cover_sha1"), F.coalesce("child_count", F.lit(0)).alias("child_count"),
                    "child_order"))


def tree_totals(tree: DataFrame) -> DataFrame:
    leaf = F.col("level") == "place"
    return tree.agg(F.coalesce(F.sum(F.when(leaf, F.col("photo_count"))), F.lit(0)).alias("geotagged_count"),
                    F.count_if(leaf).alias("leaf_count"))


def node_path(tree: DataFrame) -> DataFrame:
    """Ancestor ids of each node: the tree has five fixed levels, so the id itself spells the path."""
    bits = F.split("node_id", "::")
    country = F.concat(F.lit("country::"), F.get(bits, F.lit(1)))
    region = F.concat_ws("::", F.lit("region"), F.get(bits, F.lit(1)), F.get(bits, F.lit(2)))
    source = F.when(F.col("level") == "place", F.col("parent_id")).otherwise(F.col("node_id"))
    named = tree.withColumn("leaf_id", F.col("node_id")).withColumn("node_id", source)
    steps = F.filter(F.array(
        F.when(F.col("level") != "root", country), F.when(F.col("level").isin("region", "city", "place"), region),
        F.when(F.col("level").isin("city", "place"), F.col("node_id")),
        F.when(F.col("level") == "place", F.col("leaf_id"))), lambda s: s.isNotNull())
    return named.select(F.col("leaf_id").alias("node_id"), F.array_join(steps, " > ").alias("path"))


def top_children(tree: DataFrame, limit: int = 12) -> DataFrame:
    return tree.where((F.col("child_order") <= limit) & F.col("parent_id").isNotNull())


def preview(tree: DataFrame) -> DataFrame:
    """First child of the root, as the archive's place teaser."""
    return tree.where("parent_id = 'root' AND child_order = 1").select(
        F.col("label").alias("place_name"), "photo_count", F.col("cover_sha1").alias("cover_image"), "lat", "lon")


def map_views(tree: DataFrame) -> DataFrame:
    zooms = F.create_map(*[F.lit(x) for pair in LEVEL_ZOOM.items() for x in pair])
    return tree.select(
        "node_id", F.col("label").alias("title"),
        F.concat(F.col("photo_count").cast("string"), F.lit(" geotagged photo"),
                 F.when(F.col("photo_count") == 1, "").otherwise("s")).alias("subtitle"),
        F.coalesce(zooms[F.col("level")], F.lit(DEFAULT_ZOOM)).alias("zoom"),
        F.coalesce("lat", F.lit(20.0)).alias("center_lat"), F.coalesce("lon", F.lit(0.0)).alias("center_lon"),
        F.format_string("%.4f, %.4f", "lat", "lon").alias("coord_text"))


def leaf_members(records: DataFrame) -> DataFrame:
    """Every record with its place labels and ``leaf_id``, the merged leaf, found through the leaf table.

    The records are written once with what this reads of them: finding the leaves and
    giving each photo its own are two passes.
    """
    rows = cut_lineage(records.select(*PATH, "coord_key", "place_label", "use_lat", "use_lon", *MEMBER))
    leaves = cut_lineage(leaf_nodes(rows))
    merged = merged_leaves(leaves).select(*PATH, "norm", "node_id")
    leaf_of = (leaves.withColumn("norm", text.normal_token(F.col("label")))
               .select(*PATH, "coord_key", "norm").join(merged, [*PATH, "norm"]).drop("norm"))
    return rows.join(cut_lineage(leaf_of), [*PATH, "coord_key"]).select(*PATH, F.col("node_id").alias("leaf_id"), *MEMBER)


def node_ids(include_places: bool = True) -> Column:
    """The nodes below the root that a record with its ``leaf_id`` belongs to."""
    country, region, city = (F.col(c) for c in PATH)
    ids = [F.concat(F.lit("country::"), country), F.concat_ws("::", F.lit("region"), country, region),
           F.concat_ws("::", F.lit("city"), country, region, city)]
    return F.array(*ids, *([F.col("leaf_id")] if include_places else []))


def node_members(records: DataFrame, include_places: bool = True) -> DataFrame:
    """``node_id`` membership of every record below the root, one row per level."""
    rows = leaf_members(records) if include_places else records
    return rows.select(F.explode(node_ids(include_places)).alias("node_id"), *MEMBER)


def gallery(members: DataFrame, limit: int = 18, gap: int = 20) -> DataFrame:
    """Best photo of the best time clusters of every node, with title and subtitle."""
    return _shown(sessions.time_clusters(members, ["node_id"], gap).select("node_id", "size", "best.*"), limit)


def leaf_gallery(leaf_rows: DataFrame, limit: int = 18, gap: int = 20) -> DataFrame:
    """The :func:`gallery` of all nodes from :func:`leaf_members`.

    Photos meet in clusters of their leaf and day, and only these go to the nodes above. A photo
    without a time is a cluster; only the best of a leaf can be shown by any of its nodes.
    """
    of_leaf, node = ["leaf_id", *PATH], F.explode(node_ids()).alias("node_id")
    pieces = cut_lineage(sessions.day_pieces(leaf_rows.where("ts IS NOT NULL"), of_leaf, gap))
    dated = sessions.joined_pieces(pieces.select(node, "first", "last", "n", "best"), ["node_id"], gap)
    loose = top_rows(leaf_rows.where("ts IS NULL"), of_leaf, limit, *_best_first())
    return _shown(dated.select("node_id", "size", "best.*").unionByName(
        loose.select(node, F.lit(1).cast("long").alias("size"), "hero_score", "final_dt", "sha1")), limit)


def _best_first() -> list[Column]:
    return [F.desc("hero_score"), F.desc("final_dt"), F.desc("sha1")]


def _shown(clusters: DataFrame, limit: int) -> DataFrame:
    ranked = top_rows(clusters, ["node_id"], limit, *_best_first())
    dated = F.try_to_timestamp(F.col("final_dt"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return ranked.select(
        "node_id", F.col("rank").cast("long").alias("rank"), "sha1", "size",
        F.coalesce(F.date_format(dated, "MMMM d, yyyy"), F.lit("Photo")).alias("title"),
        text.plural(F.col("size"), "photo").alias("subtitle"))


# --- geocoder work -------------------------------------------------------------

def coordinates(active: DataFrame, decimals: int = 3) -> DataFrame:
    """Distinct rounded coordinates with their photo count."""
    located = active.where(geo.has_gps(F.col("latitude"), F.col("longitude")))
    lat, lon = geo.bucket(F.col("latitude"), decimals), geo.bucket(F.col("longitude"), decimals)
    return located.groupBy(geo.coord_key(F.col("latitude"), F.col("longitude"), decimals).alias("coord_key")).agg(
        F.min(lat).alias("lat_rounded"), F.min(lon).alias("lon_rounded"), F.count(F.lit(1)).alias("photo_count"))


def geocode_worklist(coords: DataFrame, geo_cache: DataFrame, limit: int = 0) -> DataFrame:
    """Coordinates without a cache row, in key order; cached errors count as present."""
    todo = coords.join(geo_cache.select("coord_key"), "coord_key", "left_anti").orderBy("coord_key")
    return todo.limit(limit) if limit else todo


def photo_links(active: DataFrame, geo_cache: DataFrame, decimals: int = 3) -> DataFrame:
    """Photo to coordinate links for coordinates that are resolved."""
    located = active.where(geo.has_gps(F.col("latitude"), F.col("longitude"))).select(
        "sha1", geo.coord_key(F.col("latitude"), F.col("longitude"), decimals).alias("coord_key"),
        F.col("latitude").alias("source_lat"), F.col("longitude").alias("source_lon"))
    return located.join(geo_cache.select("coord_key"), "coord_key", "left_semi")


RESULT_SCHEMA = ("results array<struct<confidence:int,formatted:string,_type:string,type:string,"
                 "components:map<string,string>>>")


def parsed_addresses(responses: DataFrame) -> DataFrame:
    """Address columns of the first result of each geocoder response (``coord_key, raw_json``)."""
    doc = F.from_json("raw_json", RESULT_SCHEMA)
    rows = responses.withColumn("results", F.coalesce(doc["results"], F.array().cast(
        "array<struct<confidence:int,formatted:string,_type:string,type:string,components:map<string,string>>>")))
    best = F.try_element_at("results", F.lit(1))
    rows = rows.withColumn("best", best).withColumn("c", F.col("best.components"))

    def part(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("c", F.lit(n)), F.lit("")) for n in names], F.lit(""))

    return rows.select(
        "coord_key", F.col("best.confidence").alias("confidence"),
        F.coalesce("best.formatted", F.lit("")).alias("formatted"),
        F.coalesce(F.nullif("best._type", F.lit("")), F.nullif("best.type", F.lit("")), F.lit("")).alias("result_type"),
        part("country").alias("country"), part("country_code").alias("country_code"), part("state").alias("state"),
        part("state_code", "ISO_3166-2").alias("state_code"), part("county").alias("county"),
        part("city", "city_district").alias("city"), part("town").alias("town"), part("village").alias("village"),
        part("hamlet").alias("hamlet"), part("suburb", "neighbourhood").alias("suburb"),
        part("postcode").alias("postcode"), part("road").alias("road"), part("house_number").alias("house_number"),
        part("attraction", "building", "amenity", "park", "natural").alias("place_name"),
        F.size("results").alias("results_count"))


# --- map tiles -------------------------------------------------------------------

# Named boxes (min lon, min lat, max lon, max lat) and the zooms seeded for each.
TILE_BOXES = {
    "world": (-180.0, -85.0, 180.0, 85.0), "usa": (-125.0, 24.0, -66.0, 50.0), "hawaii": (-161.0, 18.5, -154.0, 22.8),
    "europe": (-12.0, 34.0, 32.0, 72.0), "italy": (6.0, 36.0, 19.5, 47.5), "france": (-5.8, 41.0, 9.8, 51.5),
    "spain": (-10.5, 35.0, 4.8, 44.5), "japan": (129.0, 30.0, 146.5, 46.5), "missouri": (-95.9, 35.9, -89.0, 40.8),
    "ohio": (-84.9, 38.2, -80.3, 42.3),
}
TILE_PLAN = [("world", 0, 2), ("usa", 3, 5), ("europe", 3, 5), ("japan", 3, 5), ("hawaii", 6, 8), ("italy", 6, 8),
             ("france", 6, 8), ("spain", 6, 8), ("missouri", 6, 8), ("ohio", 6, 8)]


def plan_rows(spark) -> DataFrame:
    rows = [(name, i, *TILE_BOXES[name], low, high) for i, (name, low, high) in enumerate(TILE_PLAN)]
    return spark.createDataFrame(
        rows, "name string, step int, min_lon double, min_lat double, max_lon double, max_lat double, "
              "min_zoom int, max_zoom int")


def tile_plan(boxes: DataFrame, max_tiles: int = 0) -> DataFrame:
    """Distinct tiles covering all boxes at all their zooms, with the step that first asks for each."""
    zoomed = boxes.withColumn("z", F.explode(F.sequence("min_zoom", "max_zoom")))
    last = F.pow(F.lit(2.0), F.col("z")).cast("long") - 1

    def held(value: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(last, value))

    z = F.col("z")
    ranged = zoomed.withColumns({
        "x0": held(geo.tile_x(F.col("min_lon"), z)), "x1": held(geo.tile_x(F.col("max_lon"), z)),
        "y0": held(geo.tile_y(F.col("max_lat"), z)), "y1": held(geo.tile_y(F.col("min_lat"), z))})
    tiles = (ranged.withColumn("x", F.explode(F.sequence(F.least("x0", "x1"), F.greatest("x0", "x1"))))
             .withColumn("y", F.explode(F.sequence(F.least("y0", "y1"), F.greatest("y0", "y1")))))
    distinct = tiles.groupBy("z", "x", "y").agg(F.min("step").alias("step"))
    if max_tiles:
        distinct = distinct.orderBy("step", "z", "x", "y").limit(max_tiles)
    return distinct


def photo_tiles(active: DataFrame, zoom: int) -> DataFrame:
    located = active.where(geo.has_gps(F.col("latitude"), F.col("longitude")))
    z = F.lit(zoom)
    return located.select("sha1", z.alias("z"), geo.tile_x(zero(F.col("longitude")), z).alias("x"),
                          geo.tile_y(zero(F.col("latitude")), z).alias("y"))


def places_by_box(photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """Named boxes that contain each photo: an equi-join on one-degree cells, then the exact test.

    Each box is expanded to the cells it touches, so no photo meets a box far away.
    """
    cells = (boxes.withColumn("cell_x", F.explode(F.sequence(F.floor("min_lon"), F.floor("max_lon"))))
             .withColumn("cell_y", F.explode(F.sequence(F.floor("min_lat"), F.floor("max_lat")))))
    placed = photos.where("has_gps").withColumns({"cell_x": F.floor("longitude"), "cell_y": F.floor("latitude")})
    inside = (F.col("longitude").between(F.col("min_lon"), F.col("max_lon"))
              & F.col("latitude").between(F.col("min_lat"), F.col("max_lat")))
    return placed.join(cells, ["cell_x", "cell_y"]).where(inside)
