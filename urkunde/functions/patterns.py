"""Rules that find fields in a document's text, as column expressions.

Each rule is a literal regular expression, so it is compiled once a task. A match is a struct of value, start,
end, rule, rank and confidence; matches of a field come in the order of confidence, then rule, then place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let


@dataclass(frozen=True)
class PatternSpec:
    field: str
    name: str
    confidence: float
    regex: str


# The rules of the default pack in their order.
DEFAULT_PACK = (
    PatternSpec("date", "standard_date", 0.80, r"(\d{1,2})\.\s*([a-zA-ZäöüÄÖÜß]+)\s*(\d{4})"),
    PatternSpec("date", "vom_date", 0.90, r"vom\s+(\d{1,2})\.\s*([a-zA-ZäöüÄÖÜß]+)\s*(\d{4})"),
    PatternSpec("date", "numeric_date", 0.70, r"(\d{1,2})\.(\d{1,2})\.(\d{4})"),
    PatternSpec("date", "stand_vom_date", 0.95, r"Stand\s+vom\s+(\d{1,2})\.\s*([a-zA-ZäöüÄÖÜß]+)\s*(\d{4})"),
    PatternSpec("publisher", "bundesministerium", 0.90, r"(Bundesministerium\s+für\s+[^.\n]+)"),
    PatternSpec("publisher", "reichsministerium", 0.90, r"(Reichsministerium\s+für\s+[^.\n]+)"),
    PatternSpec("publisher", "deutscher_ausschuss", 0.85, r"(Deutscher\s+Ausschuss\s+für\s+[^.\n]{5,40})"),
    PatternSpec("document_type", "doc_type_verordnung", 0.95, r"^\s*(Verordnung)\b"),
    PatternSpec("document_type", "doc_type_anordnung", 0.95, r"\bAnordnung\b"),
    PatternSpec("document_type", "doc_type_pruefungsordnung", 0.95, r"\b(Prüfungsordnung|Prüfungsanforderungen)\b"),
    PatternSpec("document_type", "doc_type_satzung", 0.90, r"\bSatzung\b"),
    PatternSpec("title", "title_verordnung_long", 0.92, r"Verordnung\s+über\s+die\s+Berufsausbildung\s+(?:zum|zur|in der|für|von)?\s?[^\n\(\)]+"),
    PatternSpec("title", "title_named_parenthesis", 0.95, r"\([\w\s\-–]+Ausbildungsverordnung\s*[-–]\s*[^\)]+\)"),
    PatternSpec("author", "author_herausgeber", 0.90, r"(?i)(Herausgegeben\s+von\s+.+?)(?:\.|\n)"),
    PatternSpec("author", "author_named", 0.85, r"(?i)(Autor(?:in)?(?:en)?:\s*[^\n\.]+)"),
    PatternSpec("author", "author_ministry_named", 0.80, r"(Bundesministerium\s+für\s+[^\n\.]{3,40})"),
)

#: Opt-in rules for inflected publishers and further document types.
EXTENDED_PACK = (
    *DEFAULT_PACK,
    PatternSpec("publisher", "deutscher_ausschuss_inflected", 0.85, r"Deutsche[nrms]?\s+Ausschu(?:ß|ss)\s+für\s+[^.\n]{5,60}"),
    PatternSpec("document_type", "doc_type_eignungsanforderungen", 0.90, r"Berufs-?\s?Eignungsanforderungen"),
)

FIELDS = ("title", "publisher", "document_type", "profession", "author")
#: No rule matches an empty string, so an empty first match is none.
LETTER = r"[\p{L}\p{N}_]"


def dialect(regex: str) -> str:
    """The rule in Java's dialect with the meaning that it has, case-insensitive and by lines, in Python's.

    Flags: i u case by Unicode, m lines, d only a line feed ends one, U classes by Unicode. White space also
    takes U+001C to U+001F, a word's edge is one of letters, digits and underscores, and a class with ß takes
    its capital form.
    """
    out = regex.removeprefix("(?i)")
    if out.startswith(r"\b"):
        out = f"(?<!{LETTER})" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?!{LETTER})"
    parts = re.split(r"(\[(?:\\.|[^\]])*\])", out)
    for i, p in enumerate(parts):
        if i % 2:
            parts[i] = p.replace(r"\s", r"\s\x1c-\x1f").replace(r"\w", r"\p{L}\p{N}_").replace("ß", "ßẞ")
        else:
            parts[i] = p.replace(r"\s", r"[\s\x1c-\x1f]")
    return "(?iumdU)" + "".join(parts)


def needed(regex: str) -> str | None:
    """A word, folded, that is in every text with a match; None if none is sure. Saves trying the rule on other texts."""
    out = regex.removeprefix("(?i)")
    if re.search(r"\(\?(?!:)|\\Q", out):
        return None
    out = re.sub(r"\\[pP]\{[^}]*\}|\\x..|\\u....|\\.|\[(?:\\.|[^\]])*\]", " ", out)
    for optional in (r"\((?:\?:)?[^()]*\)[?*]", r"\((?:\?:)?[^()|]*\|[^()]*\)", r"[^\W\d_][?*{]"):
        out = re.sub(optional, " ", out)
    words = re.findall(r"[^\W\d_]{3,}", out)
    return max(words, key=len).lower() if words and "|" not in out else None


def folded(text: Column) -> Column:
    """Lower-cased, with the letters that a case-insensitive rule takes for i, k or s. Few texts have one, and replacing is slow."""
    odd = "ſıİ\u212a"
    return F.lower(F.when(F.rlike(text, F.lit(f"[{odd}]")), F.translate(text, odd, "siik")).otherwise(text))


def tried(text: Column, low: Column, spec: PatternSpec, found: Column, otherwise: Column) -> Column:
    """found, where the text can hold a match of the rule; low: the folded text."""
    word = needed(spec.regex)
    return F.when(F.contains(low, F.lit(word)), found).otherwise(otherwise) if word else found


def ranked(field: str, pack: tuple[PatternSpec, ...] = DEFAULT_PACK) -> list[tuple[int, PatternSpec]]:
    """A field's rules with their rank, the most confident first; none for an unknown field."""
    own = [p for p in pack if p.field == field]
    return sorted(enumerate(own), key=lambda x: (-x[1].confidence, x[0]))


def values(text: Column, spec: PatternSpec) -> Column:
    """All matches of one rule, left to right; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(dialect(spec.regex)), F.lit(0)), F.array().cast("array<string>"))


KIND = "array<struct<value:string,start:int,end:int,rule:string,rank:int,confidence:double>>"


def placing(before: Column, spec: PatternSpec, rank: int):
    """Adds a match to those so far and moves on behind it; before: the texts before each of them."""

    def step(a: Column, value: Column) -> Column:
        start = a["at"] + F.length(F.get(before, F.size(a["out"])))
        end = start + F.length(value)
        one = F.struct(value.alias("value"), start.alias("start"), end.alias("end"), F.lit(spec.name).alias("rule"), F.lit(rank).alias("rank"), F.lit(spec.confidence).alias("confidence"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).cast(KIND).alias("out"))

    return step


def matches(text: Column, field: str, pack: tuple[PatternSpec, ...] = DEFAULT_PACK, low: Column | None = None) -> Column:
    """All matches of a field with their places (code points, end exclusive). low: the folded text, if it is at hand."""
    none = F.array().cast(KIND)

    def places(found: Column, rank: int, spec: PatternSpec) -> Column:
        # A match starts after all text between matches, and all matches, before it. What follows the last one has none.
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return let(F.split(text, dialect(spec.regex), -1), lambda before: F.aggregate(found, start, placing(before, spec, rank), lambda a: a["out"]))

    def one(low: Column, rank: int, spec: PatternSpec) -> Column:
        placed = let(values(text, spec), lambda found: F.when(F.size(found) > 0, places(found, rank, spec)).otherwise(none))
        return tried(text, low, spec, placed, none)

    def every(low: Column) -> Column:
        return F.concat(*[one(low, rank, spec) for rank, spec in own])

    own = ranked(field, pack)
    if not own:
        return none
    return let(folded(text), every) if low is None else every(low)


def best(text: Column, field: str, pack: tuple[PatternSpec, ...] = DEFAULT_PACK) -> Column:
    """struct(value, score) of a field's first match; null without one. A rule is tried once, and only if none before it matched."""
    kind = "struct<value:string,score:double>"

    def first(low: Column, spec: PatternSpec) -> Column:
        score = F.lit(spec.confidence).alias("score")
        found = tried(text, low, spec, F.regexp_extract(text, dialect(spec.regex), 0), F.lit(""))
        return let(found, lambda v: F.when(v != "", F.struct(v.alias("value"), score)))

    own = ranked(field, pack)
    return let(folded(text), lambda low: F.coalesce(*[first(low, spec) for _, spec in own])).cast(kind) if own else F.lit(None).cast(kind)


def first_matches(docs: DataFrame, text: str, low: str, fields: tuple[str, ...], pack: tuple[PatternSpec, ...] = DEFAULT_PACK) -> tuple[DataFrame, dict[str, Column]]:
    """docs with a column for each rule, and `best` of each field from them; low: the column of folded texts.

    The rules of one rank are plain columns of one projection, so they run as compiled code and the text is folded once;
    one behind a match is not tried.
    """
    own = {f: ranked(f, pack) for f in fields}
    column = lambda f, level: f"_{f}_{level}"
    for level in range(max(map(len, own.values()), default=0)):
        found = {}
        for f in (f for f in fields if level < len(own[f])):
            spec = own[f][level][1]
            one = tried(F.col(text), F.col(low), spec, F.regexp_extract(F.col(text), dialect(spec.regex), 0), F.lit(""))
            earlier = [F.col(column(f, k)) != "" for k in range(level)]
            found[column(f, level)] = F.when(reduce(or_, earlier), F.lit("")).otherwise(one) if earlier else one
        docs = docs.withColumns(found)
    bests = {}
    for f in fields:
        hits = [(F.col(column(f, level)), spec.confidence) for level, (_, spec) in enumerate(own[f])]
        value = F.coalesce(*[F.when(v != "", v) for v, _ in hits]) if hits else F.lit(None).cast("string")
        score = F.coalesce(*[F.when(v != "", F.lit(c)) for v, c in hits]) if hits else F.lit(None).cast("double")
        bests[f] = F.struct(value.alias("value"), score.alias("score"))
    return docs, bests


def context(text: Column, start: Column, end: Column, reach: int = 50) -> Column:
    """The text around a match, `reach` code points on each side."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substring(text, first + 1, F.least(F.length(text), end + reach) - first)
