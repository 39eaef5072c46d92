"""Exact token counts at every prefix of a text, by dynamic programming.

A run of tokens is the BPE encoding of its letters exactly when the encoding of
every two neighbours together is those two. So the encoding of a prefix follows
from its last token: the one that ends there and agrees with the last token of
the prefix before it. One pass over a piece of text keeps, for each of its
prefixes, the last token and the count, and never encodes a prefix anew. Counts
of longer texts are sums: white space and piece borders cut all tokens.

Questions are answered from these counts: the tokens of the whole text, and the
longest prefix that stays within a budget.

A missing or empty text has no tokens. Strings of special tokens count as the
library counts them: one token. Repeated rows are answered row by row; an empty
table gives an empty result. Further columns are left out.
"""
from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers.models import BPE

from silvergrain.llm.common import by_batch, hold, record, texts
from silvergrain.llm.word_bpe import (
    CHUNK_ENTRIES,
    GROUP_ROWS,
    MEMO_CHARS,
    PIECE_ENTRIES,
    Memo,
    WordBpe,
    as_bytes,
    as_letters,
    bounds_of,
    chunks_of,
    grouped,
    is_odd,
)

#: Entries of each generation of the memos of neighbours and of signs.
PAIR_ENTRIES = 160_000


class PrefixCounts:
    """Counts at prefixes for one tokenizer file of word form."""

    def __init__(self, path: str):
        self.words = WordBpe(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: The same merges without the mark of a word's end, for tokens inside a word.
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        #: For each beginning of a token: 1 if it is a token inside words, 2 if it is one at their end.
        self.table: dict[str, int] = {}
        for token in model["vocab"]:
            bare, kind = (token[:-len(self.suffix)], 2) if token.endswith(self.suffix) else (token, 1)
            for end in range(1, len(bare)):
                self.table.setdefault(bare[:end], 0)
            self.table[bare] = self.table.get(bare, 0) | kind
        self.agree_inside = Memo(self._agree_inside, PAIR_ENTRIES)
        self.agree_ended = Memo(self._agree_ended, PAIR_ENTRIES)
        self.piece_counts = Memo(self.count_piece_prefixes, PIECE_ENTRIES)
        self.odd_totals = Memo(self.count_odd, CHUNK_ENTRIES)
        normalize = self.words.library.normalizer.normalize_str
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.words.special, key=len, reverse=True))) or r"(?!)")
        self.normal = Memo(normalize, PAIR_ENTRIES)
        #: Whether the second of two characters leaves the first alone when both are normalised.
        self.apart = Memo(lambda pair: normalize(pair[0] + pair[1]) == normalize(pair[0]) + normalize(pair[1]), PAIR_ENTRIES)
        self.cut_special = Memo(self._cut_special, 1_000)
        self.last_long: tuple[str, object] = ("", b"\0")

    def release(self) -> None:
        self.words.release()
        for memo in (self.agree_inside, self.agree_ended, self.piece_counts, self.odd_totals, self.normal, self.apart, self.cut_special):
            memo.forget()
        self.last_long = "", b"\0"

    def _agree_inside(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens stay as they are when both stand inside a word."""
        return [t.value for t in self.inner.tokenize(pair[0] + pair[1])] == list(pair)

    def _agree_ended(self, pair: tuple[str, str]) -> bool:
        """The same where the right token ends the word."""
        return [t.value for t in self.words.model.tokenize(pair[0] + pair[1])] == [pair[0], pair[1] + self.suffix]

    def count_piece_prefixes(self, piece: str) -> bytes | np.ndarray:
        """Tokens of each prefix of a piece (in letters of byte-level BPE), as if the word ended there.

        ``inside[i]`` is the last token of the first i letters when the word goes
        on, and ``depth[i]`` their count; each prefix has exactly one such token.
        """
        n = len(piece)
        inside, depth, ended = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        table, agree_inside, agree_ended = self.table, self.agree_inside, self.agree_ended
        for start in range(n):
            left, count = inside[start], depth[start] + 1
            for end in range(start + 1, n + 1):
                token = piece[start:end]
                kind = table.get(token)
                if kind is None:
                    break
                if kind & 1 and not inside[end] and (not start or agree_inside[left, token]):
                    inside[end], depth[end] = token, count
                if kind & 2 and not ended[end] and (not start or agree_ended[left, token]):
                    ended[end] = count
        return bytes(ended) if n < 256 else np.array(ended, np.int32)

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a chunk between blanks."""
        pieces = self.words.pieces_of(chunk) if chunk else []
        if pieces is None:
            return self.count_odd(chunk)
        return int(sum(self.stored(as_letters(p))[-1] for p in pieces))

    def count_part(self, part: str) -> int:
        """Tokens of a piece, or of a chunk that the library must split."""
        if is_odd(part):
            return self.odd_totals[part]
        return int(self.stored(as_letters(part))[-1])

    def segments(self, chunk: str) -> list[tuple[str, bool]]:
        """A chunk cut at its special strings, and whether a part is one."""
        out, at = [], 0
        for hit in self.special.finditer(chunk):
            out += [(chunk[at:hit.start()], False), (hit.group(), True)]
            at = hit.end()
        return [(part, special) for part, special in [*out, (chunk[at:], False)] if part]

    def library_pieces(self, part: str) -> list[str]:
        """The pieces of a part without special strings, as letters of bytes."""
        library = self.words.library
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))]

    def count_odd(self, chunk: str) -> int:
        """Chunks with special tokens or characters outside the plain range: the library splits, the program counts."""
        return sum(1 if special else sum(int(self.stored(p)[-1]) for p in self.library_pieces(part))
                   for part, special in self.segments(chunk))

    def _cut_special(self, at: tuple[str, str]) -> list[int]:
        """Tokens that each prefix of a special string adds, as text, to the signs before it."""
        tail, special = at
        own = self.count_odd(tail) if tail else 0
        return [self.count_odd(tail + special[:end]) - own for end in range(1, len(special))]

    def stored(self, piece: str) -> bytes | np.ndarray:
        """Counts at the prefixes of a piece; the last long one is kept, too, as its total and its prefixes are asked for in turn."""
        if len(piece) <= MEMO_CHARS:
            return self.piece_counts[piece]
        if self.last_long[0] != piece:
            self.last_long = piece, self.count_piece_prefixes(piece)
        return self.last_long[1]

    def clusters(self, part: str) -> list[tuple[str, str]]:
        """A part cut into characters that are normalised apart from each other, with their normal forms."""
        normal, out = self.normal, []
        for c in part:
            if out and (unicodedata.combining(c) or not self.apart[out[-1][-1:], c]):
                out[-1] += c
            else:
                out.append(c)
        return [(c, normal[c]) for c in out]

    def odd_prefixes(self, chunk: str) -> list[int]:
        """Tokens of every prefix of an odd chunk, the empty one first.

        The chunk is split once. A prefix that ends between two characters reads the stored counts of the piece
        that it cuts. Only what cuts a special string, a composed character or a contraction is counted
        anew, and of it only the piece that it ends in.
        """
        counts, before, tail = [0], 0, ""
        for part, special in self.segments(chunk):
            if special:  # a cut special string is text, and goes on with the signs before it
                counts += [before + more for more in self.cut_special[tail, part]] + [before + 1]
                before, tail = before + 1, ""
                continue
            marks = self.clusters(part)
            pieces = self.library_pieces(part)
            if "".join(n for _, n in marks).encode() != b"".join(map(as_bytes, pieces)):  # the library drops or adds something
                counts += [before + self.count_odd(part[:end]) for end in range(1, len(part) + 1)]
                before, tail = counts[-1], part
                continue
            at, inside, done = 0, 0, 0  # piece, bytes of it read, tokens of the pieces before it
            text = ""  # the piece's characters so far
            for raw, form in marks:
                for end in range(1, len(raw)):
                    counts.append(before + done + self.count_odd(text + raw[:end]))
                for c in form:
                    inside += len(c.encode())
                    while at < len(pieces) and inside > len(pieces[at]):
                        inside -= len(pieces[at])
                        done += int(self.stored(pieces[at])[-1])
                        at, text = at + 1, ""
                    text += c
                piece = pieces[at] if at < len(pieces) else ""
                cuts = inside < len(piece) and piece[0] == "'" and len(piece) > 1
                own = self.count_odd(text) if cuts else int(self.stored(piece)[inside]) if piece else 0
                counts.append(before + done + own)
            before, tail = counts[-1], text if text and not text[-1].isalnum() else ""
        return counts

    def count(self, text: str) -> int:
        return sum(map(self.count_chunk, chunks_of(text)))

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of every prefix of a chunk, by code points, the empty one first.

        Inside plain pieces these are stored counts. A prefix that cuts a contraction is counted by itself.
        """
        pieces = self.words.pieces_of(chunk) if chunk else []
        if pieces is None or sum(map(len, pieces)) != len(chunk):
            return self.odd_prefixes(chunk)
        counts, before = [0], 0
        for piece in pieces:
            stored = self.stored(as_letters(piece))
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                inner = [self.count_chunk(piece[:end]) for end in range(1, len(piece))] + [int(stored[-1])]
            elif piece.isascii():
                inner = list(map(int, stored[1:]))
            else:
                inner = [int(stored[w]) for w in np.cumsum([len(c.encode()) for c in piece])]
            counts += [before + c for c in inner]
            before += int(stored[-1])
        return counts

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, by code points, the empty one first."""
        out, before = [], 0
        for chunk in chunks_of(text):
            counts = self.chunk_prefixes(chunk)
            out += [before + c for c in counts]
            before += counts[-1]
        return np.array(out, np.int64)

    def within(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the text, code points of its longest prefix of at most ``budget`` tokens)."""
        totals, chars = self.within_all(pa.array([text]), budget)
        return int(totals[0]), int(chars[0])

    def within_all(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of each text.

        Counts at chunk borders never fall, so only the chunk that crosses the
        budget is looked into.
        """
        cut = self.words.cut(texts)
        parts = np.fromiter(map(self.count_part, cut.pieces), np.int64, len(cut.pieces))
        own = np.diff(bounds_of(parts[cut.chunk_pieces])[cut.chunk_bounds])
        before = bounds_of(own[cut.text_chunks])  # tokens before each chunk
        totals, chars = np.diff(before[cut.text_bounds]), pc.utf8_length(texts).to_numpy().astype(np.int64)
        for row in np.flatnonzero(totals > budget).tolist():
            first, last = cut.text_bounds[row:row + 2].tolist()
            over = first + int(np.searchsorted(before[first + 1:last + 1], before[first] + budget, "right"))
            start = int(cut.chunk_chars[cut.text_chunks[first:over]].sum()) + over - first
            chunk = texts[row].as_py()[start:start + int(cut.chunk_chars[cut.text_chunks[over]])]
            left = budget - int(before[over] - before[first])
            chars[row] = start + max(i for i, c in enumerate(self.chunk_prefixes(chunk)) if c <= left)
        return totals, chars


@lru_cache(maxsize=2)
def prefix_counter(name: str) -> PrefixCounts:
    return PrefixCounts(public_tokenizers.path(name))


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` and ``cut_chars``, the longest prefix within ``limit`` tokens.

    A scan with no shuffle: each text is counted where it is read.
    """
    def count(batches):
        counter = prefix_counter(tokenizer)
        hold(counter)
        for batch in grouped(batches):
            tokens, cut = counter.within_all(batch.column(1), limit)
            yield record(doc_id=batch.column(0), n_bytes=pc.binary_length(batch.column(1)).cast(pa.int64()), n_tokens=tokens,
                         over_limit=tokens > limit, cut_chars=cut)

    return by_batch(texts(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long", GROUP_ROWS)
