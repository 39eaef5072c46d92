"""Text columns: tags, titles, captions, keyword tests, label JSON."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag words that never become browse tags. Site-specific backup
# folder names are passed by the caller.
EXCLUDED_TAGS = ("pictures", "photos", "photographs", "media", "images", "topaz-undated")

# Keyword lists for caption tests.
HERO_PET_WORDS = ("dog", "puppy", "golden retriever", "great pyrenees", "pet")
CULL_PET_WORDS = ("dog", "puppy", "pet")
LANDMARK_WORDS = ("landmark", "monument", "temple", "church", "cathedral", "castle", "bridge", "tower", "statue",
                  "ruin", "palace", "shrine", "memorial", "pagoda", "mosque", "synagogue", "capitol", "courthouse",
                  "museum")

LABEL_SCHEMA = "array<struct<label:string,score:double>>"


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower the rest.

    ``initcap`` starts words only after a space, so a marked space is put
    between any other non-letter and a letter, and taken out again.
    """
    marked = F.regexp_replace(text, r"([^\p{L} ])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def split_tags(path_tags: Column, custom_tags: Column) -> Column:
    """Raw comma-separated tags of both columns, trimmed, blanks dropped."""
    merged = F.concat(F.coalesce(path_tags, F.lit("")), F.lit(","), F.coalesce(custom_tags, F.lit("")))
    return F.filter(F.transform(F.split(merged, ","), lambda t: F.trim(t)), lambda t: t != "")


def browse_tags(path_tags: Column, custom_tags: Column, extra_excluded: tuple[str, ...] = ()) -> Column:
    """Sorted, distinct, title-cased tags without excluded words and years."""
    excluded = list(EXCLUDED_TAGS) + [w.lower() for w in extra_excluded]
    # Title case is applied to the joined text once rather than tag by tag.
    titled = split_tags(title_case(F.coalesce(path_tags, F.lit(""))), title_case(F.coalesce(custom_tags, F.lit(""))))
    kept = F.filter(titled, lambda t: ~F.lower(t).isin(excluded) & ~F.regexp_like(t, F.lit(r"^\d{4}$")))
    return F.array_sort(F.array_distinct(kept))


def path_tag_text(folders: Column, keep_private: bool = True) -> Column:
    """Folder names as a comma list; ``_`` and ``-`` become spaces."""
    parts = F.filter(F.split(folders, "/"), lambda p: p != "")
    if not keep_private:
        parts = F.filter(parts, lambda p: ~p.startswith("_"))
    cleaned = F.transform(parts, lambda p: F.translate(F.trim(p), "_-", "  "))
    return F.array_join(F.filter(cleaned, lambda p: p != ""), ", ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_token(text: Column) -> Column:
    return F.lower(collapse_spaces(F.coalesce(text, F.lit(""))))


def clean_caption(text: Column, limit: int = 240) -> Column:
    """Caption with single spaces, sentence capitals and no trailing dot."""
    one = F.replace(collapse_spaces(text), F.lit("close up"), F.lit("close-up"))
    cap = F.concat(F.upper(F.substring(one, 1, 1)), F.lower(one.substr(F.lit(2), F.greatest(F.length(one), F.lit(1)))))
    bare = F.regexp_replace(cap, r"\.+$", "")
    return F.when(F.length(bare) > limit, F.rtrim(F.substring(bare, 1, limit))).otherwise(bare)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Substring test against a word list (not a word-boundary test)."""
    pattern = "|".join(re.escape(w) for w in words)
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern))


def parse_labels(json_text: Column) -> Column:
    """Label array from JSON text; malformed text gives an empty array."""
    empty = F.from_json(F.lit("[]"), LABEL_SCHEMA)
    return F.coalesce(F.from_json(json_text, LABEL_SCHEMA), empty)


def parse_strings(json_text: Column) -> Column:
    empty = F.from_json(F.lit("[]"), "array<string>")
    return F.coalesce(F.from_json(json_text, "array<string>"), empty)


def label_display(labels: Column, top: int = 6) -> Column:
    shown = F.filter(F.slice(labels, 1, top), lambda s: F.coalesce(s["label"], F.lit("")) != "")
    return F.array_join(F.transform(shown, lambda s: F.format_string("%s (%.2f)", s["label"],
                                                                     F.coalesce(s["score"], F.lit(0.0)))), ", ")


def flag_title(name: Column) -> Column:
    """Display name of a flag column."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^contains_", ""), "^is_", ""), "_like$", "")
    return title_case(F.replace(bare, F.lit("_"), F.lit(" ")))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))
