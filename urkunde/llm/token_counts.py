"""Token counts of all prefixes of a text.

A text is cut where the library's pattern cuts it. Inside each piece a dynamic program over prefixes gives
the number of tokens of every prefix. The counts are kept as two bytes per code point, the change from the prefix
before, so that any budget or truncation question is a cumulative sum and needs no new encoding. (A letter more
can only change what its last token covers, so a change is at most the longest token's letters.)
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Memo, Merges, letters
from .common import map_batches, own_cache, strings

#: Units whose table a worker keeps, and as many words, in each of two generations.
UNITS = 200_000

# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = letters(" ")
#: Up to here all versions of Unicode agree on what is a letter.
LATIN = "\u024f"
#: White space with what follows it: a text's pieces never straddle a unit.
UNIT = r"(?:\s+(?<! ))?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"


class Tables(Memo):
    """From a unit to the changes of the count along it."""

    def __init__(self, merges: Merges):
        super().__init__(UNITS)
        self.merges = merges
        self.pieces = regex.compile(PIECES).findall
        self.spaces = regex.compile(r"\s*").match

    def piece(self, text: str) -> list[int]:
        """Token counts of a piece's prefixes, by code points."""
        counts = self.merges.last_tokens(letters(text))[1]
        if text[0] == "'" and text in ("'re", "'ve", "'ll"):
            counts[2] = 2  # cut off here, the letter is a piece of its own
        if text.isascii():
            return counts
        ends, at = [0], 0
        for c in text:
            at += len(c.encode("utf-8", "surrogatepass"))
            ends.append(at)
        return [counts[e] for e in ends]

    def changes(self, unit: str, shape: str) -> bytes:
        """The changes along a unit. shape: the unit with letters of its length that the pattern takes for what they are."""
        if unit[0] == " " and unit.isascii() and unit[1:].isalpha():  # the common case: one piece of one-byte letters
            counts = self.merges.last_tokens(SPACE + unit[1:])[1]
        else:
            counts, at = [0], 0
            for p in self.pieces(shape):
                base = counts[-1]
                counts += [base + x for x in self.piece(unit[at : at + len(p)])[1:]]
                at += len(p)
        if unit[0].isspace() and 1 < (spaces := self.spaces(unit).end()) < len(unit):
            counts[spaces] = self.piece(unit[:spaces])[-1]  # cut off here, all the white space is one piece
        steps = [b - a for a, b in zip(counts, counts[1:], strict=False)]
        return array("h", steps).tobytes()

    def make(self, unit: str) -> bytes:
        return self.changes(unit, unit)


class Words(Memo):
    """From what stands between two single spaces to the changes along it and the space before."""

    def __init__(self, tables: Tables):
        super().__init__(UNITS)
        self.tables = tables
        self.units = regex.compile(UNIT).findall

    def make(self, word: str) -> bytes:
        units = self.units(" " + word)
        if len(units) == 1:  # kept here only
            return self.tables.make(units[0])
        return b"".join([self.tables[u] for u in units])


class TokenCounter:
    """Prefix tables for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cut = self.merges.library.pre_tokenizer.pre_tokenize_str
        self.shapes: dict[str, str] = {}
        self.tables = Tables(self.merges)
        self.words = Words(self.tables)
        self.units = self.words.units
        self.two_spaces = re.compile(r"\s\s").search
        self.special = sorted(self.merges.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def table(self, text: str) -> bytes:
        """A signed 16-bit number for each code point; their sum up to a place is the token count of the text up to there."""
        if not self.special or not any(s in text for s in self.special):
            return self.plain(text)
        def count(table: bytes) -> int:
            return int(np.frombuffer(table, np.int16).sum())

        out: list[bytes] = []
        odd = self.odd(text)
        tail = ("", b"")  # the last unit, from which a special string's first letters go on as ordinary text
        for i, part in enumerate(self.split(text)):
            if i % 2 == 0:
                units = self.unit_tables(part, odd)
                out += [t for _, t in units]
                tail = units[-1] if units else ("", b"")
                continue
            counts = [0]
            for j in range(1, len(part)):
                counts.append(sum(count(t) for _, t in self.unit_tables(tail[0] + part[:j], odd)) - count(tail[1]))
            out.append(np.diff(np.array([*counts, 1])).astype(np.int16).tobytes())
            tail = ("", b"")
        return b"".join(out)

    def shape(self, c: str) -> str:
        """The character, or a common one of the kind that the library takes it for if the pattern does not."""
        if (out := self.shapes.get(c)) is None:
            kinds = [len(self.cut(x + c)) == 1 for x in "a1."]
            own = [len(self.tables.pieces(x + c)) == 1 for x in "a1."]
            out = self.shapes[c] = c if kinds == own or not any(kinds) else "\u4e2d\u0663\u2020"[kinds.index(True)]
        return out

    def odd(self, text: str) -> dict[str, str]:
        """The characters that the pattern takes for another kind than the library, with their shapes."""
        return {c: s for c in set(text) if c > LATIN and (s := self.shape(c)) != c}

    def unit_tables(self, text: str, odd: dict[str, str]) -> list[tuple[str, bytes]]:
        """A text's units, each with its table."""
        if not odd:
            return [(u, self.tables[u]) for u in self.units(text)]
        at, out = 0, []
        for shape in self.units(text.translate(str.maketrans(odd))):
            unit = text[at : at + len(shape)]
            out.append((unit, self.tables.changes(unit, shape)))
            at += len(shape)
        return out

    def plain(self, text: str) -> bytes:
        """The table of a text without special strings."""
        if not text.isascii() and (odd := self.odd(text)):
            return b"".join([t for _, t in self.unit_tables(text, odd)])
        if self.two_spaces(text):
            return b"".join(map(self.tables.__getitem__, self.units(text)))
        first, *words = text.split(" ")  # a single space opens a unit
        return b"".join([*map(self.tables.__getitem__, self.units(first)), *map(self.words.__getitem__, words)])

    def counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes, from the empty one on."""
        return prefix_counts(self.table(text))


def prefix_counts(table: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int16), dtype=np.int64)])


def longest_prefix(table: bytes, budget: int) -> int:
    """The most code points whose own encoding has at most `budget` tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def counter(path: str) -> TokenCounter:
    """One a worker, for all its tasks."""
    cache = own_cache(__name__)
    if path not in cache:
        cache[path] = TokenCounter(path)
    return cache[path]


def token_counts(
    df: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None, with_table: bool = False
) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit (n_tokens > limit), keep_chars (code points of the longest prefix within the
    limit) and, if asked for, prefix_table (see TokenCounter.table).

    Null and empty texts have 0 tokens and an empty table. Rows are neither moved nor merged, so ties and
    repeated rows need no rule and an empty table stays empty. A column that has a new column's name is replaced.
    """

    def make():
        c = counter(path)

        def function(batch):
            out: list[list] = [[], [], [], [], []]
            for t in strings(batch, text):
                table = c.table(t)
                counts = prefix_counts(table)
                n = int(counts[-1])
                out[0].append(len(t.encode("utf-8", "surrogatepass")))
                out[1].append(n)
                out[2].append(n > limit)
                out[3].append(len(t) if counts.max() <= limit else int(np.flatnonzero(counts <= limit)[-1]))
                if with_table:
                    out[4].append(table)
            return out if with_table else out[:4]

        return function

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("keep_chars", T.LongType())]
    return map_batches(df, fields + [("prefix_table", T.BinaryType())] * with_table, make, keep)
