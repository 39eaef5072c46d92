"""Small tables with awkward rows, and plain versions of the operators."""
from __future__ import annotations

import re

import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, n_tokens string, slice int, rank int, score double, label string, node long, kept boolean")

PROSE = ["the quick brown fox jumps over the lazy dog and runs into the green forest near the river",
         "le petit chat noir dort sur le grand lit dans la chambre bleue de la maison blanche",
         "der kleine hund schläft unter dem großen baum im garten hinter dem alten haus"]


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    full = [(i, t, la, s, None if t is None else len(t), 1, "x", 2, 3, 0.5, "y", 4, True) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Null, empty, blank and very long texts, missing ids, langs and sources, and a row that occurs three times."""
    long_text = " ".join(f"word{i % 997} {PROSE[i % 3]}" for i in range(2000)) + " " + "z" * 5000
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "fr", None), (4, long_text, "en", "a"),
            (5, PROSE[0], "en", "b"), (5, PROSE[0], "en", "b"), (5, PROSE[0], "en", "b"), (6, PROSE[1] + " <|endoftext|>", "fr", None),
            (7, PROSE[2], "de", "c"), (None, PROSE[0], "en", "a"), (8, "a", None, "c"), (9, "ÀÉ \x0b İ日本 é ''s", "en", "a"),
            (10, "word " * 3000, "en", "c")]
    return documents(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
