"""Encoding with a word-level merge list, and decoding.

A text is normalised and cut into words as the vocabulary file says. Each word goes through the transducer
of bpe.py, which gives out a token as soon as no later letter can change it. Words recur, so a bounded memo
keeps their ids. Decoding runs the ids through a machine that holds back only an unfinished code point.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import LETTERS, MARK, Memo, Merges, Transducer, letters
from .common import map_batches, own_cache, strings

#: Pieces of text whose ids a worker keeps, in each of two generations.
WORDS = 250_000
#: Ids that are decoded at once.
FED = 1 << 16
# Fixed value: the pattern by which vocabularies of this kind find words in a normalised text.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Up to here, lower() and split() do what the library does; beyond, its own normaliser is asked.
LATIN = "ɏ"


class ByteText:
    """Incremental machine from ids to text: holds back at most the bytes of one unfinished code point."""

    def __init__(self, pieces: dict[int, bytes], between: bytes = b""):
        self.get, self.between = pieces.get, between
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        """The text that the next ids complete; ids without a token are passed over."""
        found = [x for x in map(self.get, ids) if x is not None]
        whole = self.between.join(found)
        if self.begun and found:
            whole = self.between + whole
        self.begun |= bool(found)
        return self.decoder.decode(whole)

    def end(self) -> str:
        out = self.decoder.decode(b"", final=True)
        self.decoder.reset()
        self.begun = False
        return out

    def text(self, ids: Sequence[int]) -> Iterator[str]:
        """The text of all ids, piece by piece."""
        for i in range(0, len(ids), FED):
            yield self.feed(ids[i : i + FED])
        yield self.end()


class Pieces(Memo):
    """From what stands between spaces, or a word of it, to its ids (unsigned, 32 bits)."""

    def __init__(self, codec: Codec):
        super().__init__(WORDS)
        self.codec = codec
        self.find = regex.compile(WORD).findall

    def make(self, piece: str) -> bytes:
        words = self.find(piece) if piece.isascii() or max(piece) <= LATIN else self.codec.cut(piece)
        if len(words) < 2:
            return b"".join([array("I", self.codec.encode_word(w)).tobytes() for w in words])
        return b"".join([self[w] for w in words])


class Codec:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.merges.names |= {i: t for t, i in self.merges.special.items()}
        self.transducer = Transducer(self.merges)
        self.normalise = self.merges.library.normalizer.normalize_str
        self.in_letters = self.merges.library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in LETTERS.items()}
        self.named = ByteText({i: t.encode("utf-8") for i, t in self.merges.names.items()}, b" ")
        self.plain: ByteText | None = None
        self.odd_space = re.compile("[\x1c-\x1f]").search
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")").split
        self.pieces = Pieces(self)

    def bytes_of(self, name: str, suffix: str) -> bytes:
        ends = bool(suffix) and name.endswith(suffix)
        return bytes(self.byte_of[c] for c in (name[: -len(suffix)] if ends else name)) + b" " * ends

    def cut(self, piece: str) -> list[str]:
        """The words of a piece in whose letters two versions of Unicode may differ, as the library cuts them."""
        return [bytes(self.byte_of[c] for c in w).decode("utf-8") for w, _ in self.in_letters(piece)]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of a normalised text."""
        ids = self.merges.ids
        return [ids[t] for t in self.transducer.encode(letters(word) + MARK)]

    def parts(self, text: str) -> list[bytes]:
        """Ids of a text without special strings."""
        if not text.isascii() and max(text) > LATIN or self.odd_space(text):
            return [self.pieces[p] for p in self.normalise(text).split(" ") if p]
        return list(map(self.pieces.__getitem__, text.lower().split()))

    def packed(self, text: str) -> bytes:
        """Ids, little-endian, unsigned, of 32 bits."""
        if "<|" in text and len(segments := self.split(text)) > 1:
            found: list[bytes] = []
            for i, x in enumerate(segments):
                found += [array("I", [self.merges.special[x]]).tobytes()] if i % 2 else self.parts(x)
            return b"".join(found)
        return b"".join(self.parts(text))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """As the library without a decoder: the tokens' names, joined by a space."""
        return "".join(self.named.text(ids))

    def decode_text(self, ids: Sequence[int]) -> str:
        """The bytes behind the tokens as text, a space after each word."""
        if self.plain is None:
            self.plain = ByteText({i: self.bytes_of(t, self.merges.suffix) for i, t in self.merges.names.items()})
        return "".join(self.plain.text(ids))


def codec(path: str) -> Codec:
    """One a worker, for all its tasks."""
    cache = own_cache(__name__)
    if path not in cache:
        cache[path] = Codec(path)
    return cache[path]


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, digests: bool = False, with_ids: bool = True) -> DataFrame:
    """Adds n_tokens and ids (array of int); with digests also ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded text in UTF-8, both lowercase hex).

    Null and empty texts have no ids and decode to an empty text. Rows are neither moved nor merged, so ties and
    repeated rows need no rule and an empty table stays empty. A column that has a new column's name is replaced.
    """
    fields = [("n_tokens", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    fields += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] * digests

    def make():
        c = codec(path)

        def function(batch):
            n: list[int] = []
            every: list[bytes] = []
            hashes: list[list[str]] = [[], []]
            for t in strings(batch, text):
                ids = c.packed(t)
                n.append(len(ids) // 4)
                if with_ids:
                    every.append(ids)
                if digests:
                    hashes[0].append(hashlib.sha256(ids).hexdigest())
                    decoded = hashlib.sha256()
                    for x in c.named.text(array("I", ids)):
                        decoded.update(x.encode("utf-8"))
                    hashes[1].append(decoded.hexdigest())
            whole = [n]
            if with_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                whole.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(every), np.int32))))
            return whole + hashes * digests

        return function

    return map_batches(df, fields, make, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", as_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded: the tokens' names joined by a space, or as_text the bytes behind them. Null ids give null."""

    def make():
        c = codec(path)
        one = c.decode_text if as_text else c.decode
        return lambda batch: [[None if x is None else one(x) for x in batch.column(ids).to_pylist()]]

    return map_batches(df, [("decoded", T.StringType())], make, keep)
