"""Exact token ids of a word-form BPE tokenizer, with a memo over pieces of text.

The tokenizer file drops white space and never joins across it, so a text's ids
are those of its space-separated chunks in order. Arrow cuts many texts at once:
into chunks, the distinct chunks into pieces, and the distinct pieces are all
that Python sees. Pieces recur, and each one is encoded once per worker while it
stays in a bounded memo. Pieces of plain letters go straight to the library's BPE
model; chunks with other signs go through the library's whole pipeline as one.
"""
from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: One of the kinds of pieces.
LETTER_RUN = r"[\p{L}]+|"

#: Entries of each generation of the memos, of odd chunks and of pieces; less than 100 MB per worker.
CHUNK_ENTRIES, PIECE_ENTRIES = 100_000, 160_000
#: Bytes of the texts that are cut at once (one text at least), and their number.
GROUP_BYTES, GROUP_ROWS = 2 << 20, 10_000
#: Longer chunks are encoded anew each time, so that entries stay small.
MEMO_CHARS = 64

#: Code points below 304 have one-to-one lower case and are stable under composition.
PLAIN = regex.compile(r"[!-~\xa1-į]+")
#: The same of Arrow's: what a chunk must hold for the library to split it itself.
ODD = r"[^!-~\x{a1}-\x{12f}]|<\|"


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte that has none, of byte-level BPE."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


LETTERS = byte_letters()


def as_letters(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)


BYTES = {ord(letter): chr(b) for b, letter in LETTERS.items()}


def as_bytes(piece: str) -> bytes:
    """The bytes that letters of byte-level BPE stand for."""
    return piece.translate(BYTES).encode("latin-1")


class Cut(NamedTuple):
    """Texts as numbers of their distinct chunks, and those as numbers of their distinct pieces."""
    pieces: list[str]  # a chunk that the library must split is one
    chunk_pieces: np.ndarray
    chunk_bounds: np.ndarray  # chunk c has chunk_pieces[chunk_bounds[c]:chunk_bounds[c + 1]]
    chunk_chars: np.ndarray
    text_chunks: np.ndarray
    text_bounds: np.ndarray


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return bounds


def joined(flat: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``wanted`` of ``flat`` one after the other, and their bounds."""
    lengths = np.diff(bounds)[wanted]
    out = bounds_of(lengths)
    at = np.repeat(bounds[wanted] - out[:-1], lengths)
    at += np.arange(out[-1])
    return flat[at], out


def grouped(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose second column, the texts, has about ``most`` bytes, one row at least."""
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
            pa.default_memory_pool().release_unused()  # cutting takes several times the group's bytes


class WordBpe:
    """``encode(text)`` gives the ids, as raw unsigned 16-bit little-endian bytes; ``encode_all`` those of many texts."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = next((p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
        if spec["model"].get("end_of_word_suffix") is None or split is None or split["behavior"] != "Removed":
            raise ValueError("only tokenizers that drop white space between words are supported")
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t["content"] for t in spec["added_tokens"]]
        pattern = split["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        #: The other pieces; what lies between them in a plain chunk are runs of letters.
        self.others = pattern.replace(LETTER_RUN, "", 1)
        others, plain = regex.compile(self.others), list(filter(PLAIN.fullmatch, map(chr, range(304))))
        if LETTER_RUN not in pattern or any(bool(others.match(c)) == bool(regex.match(r"\p{L}", c)) for c in plain):
            raise ValueError("only tokenizers with runs of letters and pieces of other signs are supported")
        self.pieces = Memo(self.encode_piece, PIECE_ENTRIES)

    def release(self) -> None:
        self.pieces.forget()

    def cut(self, texts: pa.Array) -> Cut:
        """Cuts texts (strings without nulls) into chunks and pieces."""
        blanks = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        lists = pc.split_pattern(blanks, " ")
        chunks = lists.flatten().dictionary_encode()
        own = chunks.dictionary
        apart = pc.replace_substring_regex(pc.utf8_lower(own), self.others, r" \0 ")
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(own, ODD), own, apart), " ")
        pieces = parts.flatten().dictionary_encode()
        return Cut(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(),
                   bounds_of(pc.list_value_length(parts).to_numpy()), pc.utf8_length(own).to_numpy(),
                   chunks.indices.to_numpy(), bounds_of(pc.list_value_length(lists).to_numpy()))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their bounds."""
        cut = self.cut(texts)
        ids = [self.pieces[p] for p in cut.pieces]
        own, own_bounds = joined(np.frombuffer(b"".join(ids), "<u2"), bounds_of(np.fromiter(map(len, ids), np.int64, len(ids)) // 2),
                                 cut.chunk_pieces)
        out, out_bounds = joined(own, own_bounds[cut.chunk_bounds], cut.text_chunks)
        return out, out_bounds[cut.text_bounds]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_odd(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes() if chunk else b""

    def encode_piece(self, piece: str) -> bytes:
        if is_odd(piece):
            return self.encode_odd(piece)
        ids = array("H", [t.id for t in self.model.tokenize(as_letters(piece))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def pieces_of(self, chunk: str) -> list[str] | None:
        """The lower-case pieces of a plain chunk; None where the library must split it."""
        return None if is_odd(chunk) else self.split.findall(chunk.lower())


def is_odd(chunk: str) -> bool:
    """Whether the library must split a chunk itself; no piece of a plain one is odd."""
    return not PLAIN.fullmatch(chunk) or "<|" in chunk


def chunks_of(text: str) -> list[str]:
    """The text between blanks, tabs and line feeds; each of these separates tokens."""
    return text.replace("\n", " ").replace("\t", " ").split(" ")


class Memo(dict):
    """A bounded memo of ``fn`` in two generations: a full one becomes the old one, and what recurs moves on."""

    def __init__(self, fn, entries: int):
        super().__init__()
        self.fn, self.entries, self.old = fn, entries, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def word_bpe(name: str) -> WordBpe:
    """The worker's tokenizer for one of the public vocabulary files."""
    return WordBpe(public_tokenizers.path(name))
