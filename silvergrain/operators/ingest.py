"""Ingest as table work: manifests, dates, positions, identity and file naming."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.functions import geo, text, time
from silvergrain.operators.ordering import with_positions

# File kinds by extension.
PHOTO_EXTENSIONS = (".jpg", ".jpeg")
OTHER_IMAGES = (".png", ".bmp", ".gif", ".webp", ".tif", ".tiff", ".heic", ".heif", ".avif", ".jfif")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp", ".heic")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v")

MIN_WIDTH, MIN_HEIGHT = 500, 300


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root folder as ``rel_path, file_size, mtime``, without reading them.

    Spark's listing leaves out names that start with an underscore, which is
    also the ingest's rule for private folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = root.rstrip("/") + "/"
    rel = F.col("path").substr(F.instr("path", start) + len(start), F.length("path"))
    return files.select(rel.alias("rel_path"), F.col("length").alias("file_size"),
                        F.unix_timestamp("modificationTime").alias("mtime"))


def is_private(rel_path: Column) -> Column:
    """Any path component that starts with an underscore."""
    return F.exists(F.split(rel_path, "/"), lambda part: part.startswith("_"))


def file_kind(rel_path: Column) -> Column:
    ext = extension(rel_path)
    return (F.when(is_private(rel_path), "private").when(ext.isin(*PHOTO_EXTENSIONS), "photo")
            .when(ext.isin(*OTHER_IMAGES), "other_image").otherwise("ignored"))


def manifest(files: DataFrame) -> DataFrame:
    """Photo files of a listing, with archive path and folder tags."""
    folder = F.when(F.instr("rel_path", "/") > 0, F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("")
    photos = files.where(file_kind(F.col("rel_path")) == "photo")
    archive_dir = F.when(folder == "", F.col("source")).otherwise(F.concat_ws("/", "source", folder))
    return photos.withColumns({
        "file_name": F.substring_index("rel_path", "/", -1), "archive_dir": archive_dir,
        "rel_fqn": F.concat_ws("/", "source", "rel_path"),
        "path_tags": text.path_tag_text(archive_dir),
        "extension": F.upper(F.substring(extension(F.col("rel_path")), 2, 10)),
        "mtime_utc": F.concat(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))})


# --- dates ---------------------------------------------------------------------------

def sidecar_times(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``file_id, takeout_ts, takeout_name``: capture time from the first export sidecar that has one.

    Each file asks for its two candidate names; that is one equi-join on the
    path, with no listing of folders.
    """
    full = F.col("rel_fqn")
    stem = F.regexp_replace(full, r"(?<=[^/])\.[^./]*$", "")
    asked = files.select("file_id", F.posexplode(F.array_distinct(F.array(
        F.concat(full, F.lit(".json")), F.concat(stem, F.lit(".json"))))).alias("priority", "json_path"))
    timed = sidecars.select("json_path", time.takeout_timestamp(F.col("json_text")).alias("ts")).where("ts IS NOT NULL")
    found = asked.join(timed, "json_path")
    return found.groupBy("file_id").agg(
        F.min(F.struct("priority", "ts", F.substring_index("json_path", "/", -1).alias("name"))).alias("first")).select(
        "file_id", F.col("first.ts").alias("takeout_ts"), F.col("first.name").alias("takeout_name"))


def resolved_dates(files: DataFrame, takeout: DataFrame) -> DataFrame:
    """``final_dt, dt_source`` by the fixed cascade of date sources."""
    rows = files.join(takeout, "file_id", "left").withColumns({
        "t_original": time.camera_timestamp(F.col("exif_original")),
        "t_digitized": time.camera_timestamp(F.col("exif_digitized")),
        "t_plain": time.camera_timestamp(F.col("exif_plain")),
        "t_xmp": time.xmp_timestamp(F.col("xmp")),
        "t_name": time.from_filename(F.col("file_name")),
        "t_file": F.when(F.col("mtime") > 0, F.timestamp_seconds("mtime"))})
    sources = [("t_original", F.lit("EXIF: DateTimeOriginal")), ("t_digitized", F.lit("EXIF: DateTimeDigitized")),
               ("t_plain", F.lit("EXIF: DateTime")), ("t_xmp", F.lit("XMP")),
               ("takeout_ts", F.concat(F.lit("Google Takeout JSON: "), F.col("takeout_name"))),
               ("t_name", F.lit("Filename Pattern")), ("t_file", F.lit("File Modification"))]
    override = F.contains(F.lower("archive_dir"), F.lit("undated"))
    stamp = F.coalesce(time.stamp_text(F.coalesce(*[F.col(c) for c, _ in sources])), F.lit(time.ZERO_DATE))
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in sources], F.lit("Fallback"))
    return rows.withColumns({
        "final_dt": F.when(override, time.ZERO_DATE).otherwise(stamp),
        "dt_source": F.when(override, "Path Override: Undated").otherwise(label),
    }).drop("t_original", "t_digitized", "t_plain", "t_xmp", "t_name", "t_file")


# --- admission and identity -------------------------------------------------------------

def admitted(files: DataFrame) -> Column:
    """Reason a photo file is refused, or null."""
    return (F.when(F.col("width").isNull() | F.col("height").isNull(), "unreadable")
            .when((F.col("width") < MIN_WIDTH) | (F.col("height") < MIN_HEIGHT), "tiny"))


def first_of_each(files: DataFrame, known: DataFrame) -> DataFrame:
    """New photos by content: unknown to the archive, and the first source of each content wins.

    The first copy is found by a ``min`` of (rank, path), which combines on the
    map side, so any number of copies of one photo never meets in a task. Both
    joins then run on unique keys.
    """
    first = files.groupBy("content_sha1").agg(F.min(F.struct("source_rank", "rel_path", "file_id"))["file_id"]
                                              .alias("file_id"))
    fresh = first.join(known.select(F.col("sha1").alias("content_sha1")), "content_sha1", "left_anti")
    return files.join(fresh.select("file_id"), "file_id", "left_semi")


def counters(files: DataFrame, known: DataFrame, archive: DataFrame) -> DataFrame:
    """Ingest counters in one row; ``archive`` holds paths that exist already (healed files)."""
    kinds = files.withColumn("kind", file_kind(F.col("rel_path")))
    kinds = kinds.withColumn("refused", F.when(F.col("kind") == "photo", admitted(kinds)))
    good = kinds.where("kind = 'photo' AND refused IS NULL")
    new = first_of_each(good, known).withColumn("rel_fqn", F.concat_ws("/", "source", "rel_path"))
    healed = new.join(archive.select("rel_fqn").distinct(), "rel_fqn", "left_semi").agg(
        F.count(F.lit(1)).alias("healed"))
    taken = new.agg(F.count(F.lit(1)).alias("taken"))
    base = kinds.agg(
        F.count(F.lit(1)).alias("examined"), F.count_if(F.col("kind") == "other_image").alias("non_jpeg"),
        F.count_if(F.col("refused") == "tiny").alias("tiny"),
        F.count_if(F.col("refused") == "unreadable").alias("unreadable"),
        F.count_if((F.col("kind") == "photo") & F.col("refused").isNull()).alias("good"))
    return base.crossJoin(taken).crossJoin(healed).select(
        "examined", (F.col("taken") - F.col("healed")).alias("new_added"), "healed",
        (F.col("good") - F.col("taken")).alias("duplicates"), "non_jpeg", "tiny", "unreadable")


def positions_from_exif(files: DataFrame) -> DataFrame:
    """Signed degrees and metres from the rational parts of the position tags."""
    pair = lambda num, den: F.struct(F.col(num).alias("num"), den.alias("den"))
    one = F.lit(1).cast("long")
    parts = F.array(pair("lat_deg", one), pair("lat_min", one), pair("lat_sec", F.col("lat_den").cast("long")))
    return files.withColumns({
        "latitude": geo.dms_to_degrees(parts, F.col("lat_ref")),
        "altitude_meters": geo.altitude(pair("alt_num", F.lit(10).cast("long")), F.col("alt_ref"))})


def healed_paths(media: DataFrame, seen: DataFrame) -> DataFrame:
    """Known photos whose stored path is gone take the path where their content was seen."""
    present = seen.select(F.col("content_sha1").alias("sha1"), "rel_fqn")
    gone = media.select("sha1", "rel_fqn").join(present, ["sha1", "rel_fqn"], "left_anti")
    found = present.groupBy("sha1").agg(F.min("rel_fqn").alias("new_path"))
    moved = gone.join(found, "sha1").select("sha1", "new_path")
    return media.join(moved, "sha1", "left").withColumn("rel_fqn", F.coalesce("new_path", "rel_fqn")).drop("new_path")


# --- file naming -------------------------------------------------------------------------

def split_name(name: Column) -> tuple[Column, Column]:
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return stem, name.substr(F.length(stem) + 1, F.length(name))


def flattened(files: DataFrame) -> DataFrame:
    """Target names when folders are flattened: ``name(1).ext`` for later files of one name.

    ``files`` needs ``dest_dir, file_name, path``. The first file of a name (by
    path) keeps it. The k-th later file takes the k-th number whose numbered
    name is not itself the name of some file. All ranks are exact positions
    over range slices, so one very common name is spread over many tasks.
    """
    stem, ext = split_name(F.col("file_name"))
    named = with_positions(files.withColumns({"stem": stem, "ext": ext}), ["dest_dir", "file_name"], F.col("path"),
                           name="copy")
    firsts = named.where("copy = 0").withColumn("target_name", F.col("file_name"))
    later = named.where("copy > 0")
    # Literal names of the form base(t).ext, each with the count of free numbers before it.
    literal = (firsts.select("dest_dir", "ext", F.regexp_extract("stem", r"^(.+)\(([1-9]\d{0,17})\)$", 1).alias("stem"),
                             F.regexp_extract("stem", r"^(.+)\(([1-9]\d{0,17})\)$", 2).try_cast("long").alias("t"))
               .where("t IS NOT NULL"))
    wanted = later.select("dest_dir", "stem", "ext").distinct()
    blocked = with_positions(literal.join(wanted, ["dest_dir", "stem", "ext"], "left_semi"),
                             ["dest_dir", "stem", "ext"], F.col("t"), name="j")
    marks = blocked.select("dest_dir", "stem", "ext", (F.col("t") - F.col("j") - 1).alias("at"), F.lit(1).alias("kind"),
                           F.lit("").alias("path"))
    crowded = blocked.select("dest_dir", "stem", "ext").distinct()
    shifted = later.join(crowded, ["dest_dir", "stem", "ext"], "left_semi").select(
        "dest_dir", "stem", "ext", F.col("copy").alias("at"), F.lit(0).alias("kind"), "path")
    # In the merged order a file's position counts the files and blocked numbers before it.
    merged = with_positions(shifted.unionByName(marks), ["dest_dir", "stem", "ext"], F.col("at"), F.col("kind"),
                            F.col("path"), name="place")
    numbers = merged.where("kind = 0").select("dest_dir", "path", (F.col("place") + 1).alias("number"))
    numbered = later.join(numbers, ["dest_dir", "path"], "left").withColumn(
        "target_name", F.concat("stem", F.lit("("), F.coalesce("number", "copy").cast("string"), F.lit(")"), "ext"))
    columns = ["dest_dir", "path", "file_name", "target_name"]
    return firsts.select(*columns).unionByName(numbered.select(*columns))


def routed(files: DataFrame, existing: DataFrame, move_images: bool = False, move_videos: bool = True) -> DataFrame:
    """Media files with their target path; a taken path gets ``_1``, ``_2`` … before the extension.

    ``files`` and ``existing`` hold ``rel_path`` (existing: below each target root).
    The next free number is one more than the unbroken run of taken numbers.
    """
    ext = extension(F.col("rel_path"))
    kind = F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video")
    wanted = [k for k, on in (("image", move_images), ("video", move_videos)) if on]
    rows = files.withColumn("kind", kind).where(F.col("kind").isin(*wanted))
    path_stem = F.regexp_replace("rel_path", r"(?<=[^/])\.[^./]*$", "")
    path_ext = F.col("rel_path").substr(F.length(path_stem) + 1, F.length("rel_path"))
    taken = existing.select("rel_path").distinct()
    numbered = (taken.select(F.regexp_extract("rel_path", r"^(.+)_([1-9]\d{0,17})(\.[^./]*)$", 1).alias("stem"),
                             F.regexp_extract("rel_path", r"^(.+)_([1-9]\d{0,17})(\.[^./]*)$", 2).try_cast("long")
                             .alias("t"),
                             F.regexp_extract("rel_path", r"^(.+)_([1-9]\d{0,17})(\.[^./]*)$", 3).alias("ext"))
                .where("t IS NOT NULL"))
    runs = (with_positions(numbered, ["stem", "ext"], F.col("t"), name="j").where("t = j + 1")
            .groupBy("stem", "ext").agg(F.max("t").alias("run")))
    clash = rows.join(taken.withColumn("clash", F.lit(True)), "rel_path", "left").withColumns(
        {"stem": path_stem, "ext": path_ext})
    out = clash.join(runs, ["stem", "ext"], "left")
    free = F.coalesce("run", F.lit(0)) + 1
    return out.withColumn("target_path", F.when(F.col("clash"), F.concat("stem", F.lit("_"), free.cast("string"), "ext"))
                          .otherwise(F.col("rel_path"))).drop("stem", "ext", "run")


# --- rules written down but not used by default ------------------------------------------

def folder_year(folders: Column) -> Column:
    """Year named by the deepest folder that names one."""
    years = F.regexp_extract_all(folders, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.try_element_at(years, F.lit(-1))


def date_with_folder_year(final_dt: Column, has_gps: Column, folders: Column) -> Column:
    """A date whose year contradicts its folder becomes that year's first day, unless GPS backs the date."""
    year = folder_year(folders)
    clash = year.isNotNull() & (F.substring(final_dt, 1, 4) != year) & ~has_gps
    return F.when(clash, F.concat(year, F.lit("-01-01 00:00:00"))).otherwise(final_dt)


def tags_without_years(tags: Column) -> Column:
    """Folder tags with four-digit years removed from inside their names."""
    bare = F.transform(F.split(tags, ","), lambda t: text.collapse_spaces(
        F.regexp_replace(t, r"(?<!\d)\d{4}(?!\d)", " ")))
    return F.array_join(F.filter(bare, lambda t: t != ""), ", ")
