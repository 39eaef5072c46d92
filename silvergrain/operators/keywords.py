"""Words of many lists found in texts, in one pass over each text.

All words of all lists form one automaton, so a text is read once however many
words there are. A hit is a substring, not a whole word, as in
``text.contains_any``. Words can't match across two columns.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.session import ship_package

#: Stands between the columns of a row; words may not hold it.
SEPARATOR = "\0"
HITS = "words array<string>, lists array<string>"


@lru_cache(maxsize=1)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word in words:
        machine.add_word(word, word)
    machine.make_automaton()
    return machine


def _owners(lists: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """The lists of each word."""
    owners: dict[str, set[str]] = {}
    for name, words in lists.items():
        for word in words:
            if not word or SEPARATOR in word or word != word.lower():
                raise ValueError(f"not a lower-case word: {word!r} in list {name}")
            owners.setdefault(word, set()).add(name)
    return {word: tuple(sorted(names)) for word, names in sorted(owners.items())}


def with_hits(rows: DataFrame, columns: Sequence[str], lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``words`` and ``lists``: the words found in any of the text columns and the lists that hold them.

    Both are distinct and in code-point order, empty where nothing is found or all
    columns are null. Texts are lower-cased, words must be. Columns of these names are replaced.
    """
    owners = _owners(lists)
    kept = [c for c in rows.columns if c not in ("words", "lists")]
    text = F.lower(F.concat_ws(SEPARATOR, *columns))
    if not owners:
        none = F.array().cast("array<string>")
        return rows.select(*kept, none.alias("words"), none.alias("lists"))
    ship_package(rows.sparkSession)

    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _automaton(tuple(owners))
        for batch in batches:
            words = [sorted({word for _, word in machine.iter(one)}) for one in batch]
            yield pd.DataFrame({"words": words, "lists": [sorted({n for w in some for n in owners[w]}) for some in words]})

    hits = rows.select(*kept, found(text).alias("_hits"))
    return hits.select(*kept, "_hits.words", "_hits.lists")


def word_usage(rows: DataFrame, columns: Sequence[str], lists: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """``list, word, n_rows, first``: in how many rows each word occurs, and the smallest key among them.

    Words that occur nowhere are listed with 0 and null, so that a list shows its dead words.
    """
    spark = rows.sparkSession
    pairs = [(name, word) for word, names in _owners(lists).items() for name in names]
    listed = spark.createDataFrame(pairs, "list string, word string")
    used = (with_hits(rows.select(key, *columns), columns, lists).select(key, F.explode("words").alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first")))
    return listed.join(used, "word", "left").select("list", "word", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "first")
