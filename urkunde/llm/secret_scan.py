"""Secrets: three fixed kinds, and strings in a sensitive place that do not compress.

For each candidate the bytes that it adds to a zstandard frame are measured, with a dictionary made of common
identifiers and of the text around it. A string that its surroundings or the identifiers explain costs little;
one that costs nearly its own length is new, and reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import log2

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, strings

# The kinds in their order and their patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of at least 24 characters
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

#: Words that make the place before a candidate sensitive.
CONTEXT = re.compile(r"(?ai:passw|secret|token|api[_-]?key|credential|bearer|authorization|private[_-]?key|access[_-]?key|signature)")
#: How far before the candidate such a word may end.
REACH = 48
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # of at least LEAST characters
LOWER, UPPER, DIGIT = re.compile(r"[a-z]").search, re.compile(r"[A-Z]").search, re.compile(r"\d").search
#: Code points of text on each side that prime the dictionary.
AROUND = 512
#: Share of its own bytes that a candidate must add.
NOVELTY = 0.8
#: Bytes from which on zstandard codes literals by their frequency.
CODED = 64
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_secret client_id username "
    "authorization bearer credential signature certificate session cookie config settings environment production "
    "staging development database connection string localhost example placeholder changeme undefined null true false "
    "function return import export const static public private protected class interface package require module "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX"
).encode()

LIKELY = ("passw", "secret", "token", "api", "credential", "bearer", "authorization", "private", "access", "signature")


def added_bytes(candidate: str, surroundings: str) -> int:
    """Bytes that the candidate adds to a frame primed with the identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + surroundings.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(press.compress(candidate.encode("utf-8", "surrogatepass"))) - len(press.compress(b""))


def is_novel(candidate: str, surroundings: str) -> bool:
    """Whether the candidate adds NOVELTY of its bytes; from 64 bytes on, of what its alphabet alone lets them come to.

    zstandard codes the characters of longer strings by their frequencies, so that a random string of 16 different
    characters adds half of its bytes.
    """
    bits = 8.0
    if len(candidate) >= CODED:
        shares = [n / len(candidate) for n in Counter(candidate).values()]
        bits = -sum(x * log2(x) for x in shares)
    return added_bytes(candidate, surroundings) >= NOVELTY * len(candidate) * bits / 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    found = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates after a sensitive word that no base span touches, mix kinds of characters and do not compress.

    A candidate is a whole run of its characters, or what of it follows the last sensitive word inside; so candidates
    do not overlap, and the text is gone through once.
    """
    low = text.lower()
    if not any(x in low for x in LIKELY):
        return []
    words = [m.end() for m in CONTEXT.finditer(text)]
    taken: list[list[int]] = []
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    out = []
    for run in CANDIDATE.finditer(text):
        start, end = run.span()
        i = bisect_right(words, end - LEAST)
        if not i or words[i - 1] < start - REACH:
            continue
        start = max(start, words[i - 1])  # what follows the last sensitive word, if one is inside
        i = bisect_left(taken, [end]) - 1
        if i >= 0 and taken[i][1] > start:
            continue
        value = text[start:end]
        kinds = bool(LOWER(value)) + bool(UPPER(value)) + bool(DIGIT(value))
        if kinds >= 2 and is_novel(value, around(text, start, end)):
            out.append((start, 3, end))
    return out


def around(text: str, start: int, end: int) -> str:
    return text[max(0, start - AROUND) : start] + text[end : end + AROUND]


def measures(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Of each span the bytes that it adds to what is around it, joined by commas. A span that its surroundings or the
    identifiers explain (an example, a repeated key) adds few."""
    return ",".join([str(added_bytes(text[s:e], around(text, s, e))) for s, _, e in spans])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 (of the base spans, kind:start:end by start and kind, joined by
    commas, code points, end exclusive), spans (all spans, joined likewise) and added_bytes (see measures(), in the order
    of spans).

    Matches of one kind do not overlap, those of different kinds may. Beside the three base kinds, `novel` are runs of
    at least LEAST letters, digits and +/_=- that start at most REACH characters after a sensitive word, hold two of
    lower case, upper case and digits, are touched by no base span, and add at least NOVELTY of their own bytes (of
    what their alphabet allows, from CODED on) to a zstandard frame primed with identifiers and the AROUND characters
    on each side. Null and empty texts have no spans and
    the digest of the empty string. Rows are neither moved nor merged, so repeated rows need no rule and an
    empty table stays empty. A column that has a new column's name is replaced.
    """

    def make():
        def function(batch):
            out: list[list] = [[], [], [], [], [], []]
            for t in strings(batch, text):
                base = base_spans(t)
                for k in range(3):
                    out[k].append(sum(1 for x in base if x[1] == k))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans = sorted([*base, *novel_spans(t, base)])
                out[4].append(joined(spans))
                out[5].append(measures(t, spans))
            return out

        return function

    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("added_bytes", T.StringType())]
    return map_batches(df, fields, make, keep)
