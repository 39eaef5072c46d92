"""Timestamps kept as text: parsing, guards and calendar parts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_DATE = "0000-00-00 00:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"
MIN_YEAR, MAX_YEAR = 1950, 2026

# Normalised names that mean "date taken from the file system".
FILE_DATE_SOURCES = ("filesystem", "file system", "file modification", "file modified", "mtime", "modified time")

# Date fields of photo metadata packets.
XMP_DATE_NAMES = ("xmp:CreateDate", "photoshop:DateCreated", "xmp:ModifyDate", "exif:DateTimeOriginal")


def stamp_seconds(text: Column) -> Column:
    """Whole seconds since 1970 of a ``yyyy-MM-dd HH:mm:ss`` text; null if undated or broken."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(STAMP)))


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def is_undated(text: Column) -> Column:
    return text.startswith("0000")


def in_valid_years(ts: Column) -> Column:
    return F.when(F.year(ts).between(MIN_YEAR, MAX_YEAR), ts)


def camera_timestamp(text: Column) -> Column:
    """Camera-style date text (colon or dash dates, ISO with zone) inside the valid years."""
    bare = F.trim(F.replace(text, F.lit("\x00"), F.lit("")))
    iso = F.when(F.regexp_like(bare, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")), bare.try_cast("timestamp"))
    return F.coalesce(in_valid_years(F.try_to_timestamp(bare, F.lit("yyyy:MM:dd HH:mm:ss"))),
                      in_valid_years(F.try_to_timestamp(bare, F.lit(STAMP))),
                      in_valid_years(iso))


def lenient_timestamp(text: Column) -> Column:
    """First parse that succeeds out of ISO and three camera layouts."""
    bare = F.trim(text)
    iso = F.when(F.regexp_like(bare, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")), bare.try_cast("timestamp"))
    return F.coalesce(iso, F.try_to_timestamp(bare, F.lit("yyyy:MM:dd HH:mm:ss")))


# Lengths of the digit runs of a date in a file name, in the order in which they are tried.
FILE_NAME_RUNS = ((8, 6), (4, 2, 2, 2, 2, 2))


def from_filename(name: Column) -> Column:
    """Date written in a file name: day and time as two runs of digits first, then as six.

    One dash or underscore stands between the runs, no digit before or behind them, and the
    year begins with 20. Of each layout the first place counts; where it is no date of the valid years,
    the next layout is tried.
    """
    def parsed(runs: tuple[int, ...]) -> Column:
        century = rf"20\d{{{runs[0] - 2}}}"
        pattern = r"(?<!\d)" + "[-_]".join([century, *[rf"\d{{{n}}}" for n in runs[1:]]]) + r"(?!\d)"
        digits = F.translate(F.regexp_extract(name, pattern, 0), "-_", "")
        return in_valid_years(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")))

    return F.coalesce(*[parsed(runs) for runs in FILE_NAME_RUNS])


def xmp_timestamp(text: Column) -> Column:
    """First valid date among XMP attributes, then among XMP elements, of the packet text."""
    names = "|".join(XMP_DATE_NAMES)
    hits = F.regexp_extract_all(text, F.lit(rf'(<?(?:{names})(?:\s*=\s*"[^"]+"|>[^<]+</))'), F.lit(1))
    ordered = F.concat(F.filter(hits, lambda h: ~h.startswith("<")), F.filter(hits, lambda h: h.startswith("<")))
    values = F.transform(ordered, lambda h: F.regexp_extract(h, r'[">]([^"<]+)', 1))
    stamps = F.filter(F.transform(values, camera_timestamp), lambda t: t.isNotNull())
    return F.try_element_at(stamps, F.lit(1))


def takeout_timestamp(json_text: Column) -> Column:
    """Capture time of an export sidecar: photo time, else creation time, else a digit field."""
    photo = F.get_json_object(json_text, "$.photoTakenTime.timestamp")
    created = F.get_json_object(json_text, "$.creationTime.timestamp")
    plain = F.get_json_object(json_text, "$.timestamp")
    digits = F.when(F.regexp_like(plain, F.lit(r"^\d+$")), plain)
    return in_valid_years(F.timestamp_seconds(F.coalesce(photo, created, digits).try_cast("long")))


def is_file_date(source: Column) -> Column:
    """True when a date source names the file system rather than the camera."""
    name = F.translate(F.lower(F.trim(F.coalesce(source, F.lit("")))), "-_", "  ")
    return name.isin(*FILE_DATE_SOURCES) | (
        name.contains("file") & (name.contains("modification") | name.contains("modified")))
