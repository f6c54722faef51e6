"""German dates in matches."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DEFAULT_PACK, PatternSpec, context, dialect, folded, matches, ranked, tried, values
from .text import let

# Fixed value: month names and their numbers.
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "mär": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6,
    "jun": 6, "juli": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "oktober": 10, "okt": 10,
    "november": 11, "nov": 11, "dezember": 12, "dez": 12,
}
#: Every bonus needs it, lower-cased.
BONUS_WORD = "vom"
NUMERIC = dialect(r"(\d{1,2})\.(\d{1,2})\.(\d{4})")
NAMED = dialect(r"(\d{1,2})\.\s*([a-zA-ZäöüÄÖÜß]+)\s*(\d{4})")


def month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*MONTHS.items()))), F.lower(name))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none such; years 1 to 9999."""
    # Days are counted from the month's first, as trying dates that do not exist costs an exception each.
    first = F.when(year.between(1, 9999) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return let(F.struct(first.alias("first"), day.alias("day")), lambda x: F.when(x["day"].between(1, F.dayofmonth(F.last_day(x["first"]))), F.date_add(x["first"], x["day"] - 1)))


def parse(value: Column) -> Column:
    """The date in a match: a numeric one if there is one, valid or not, else one with a month's name."""

    def part(regex: str, group: int) -> Column:
        return F.regexp_extract(value, regex, group)

    def number(regex: str, group: int) -> Column:
        return part(regex, group).try_cast("int")

    numeric = calendar_date(number(NUMERIC, 3), number(NUMERIC, 2), number(NUMERIC, 1))
    named = calendar_date(number(NAMED, 3), month_number(part(NAMED, 2)), number(NAMED, 1))
    return F.when(F.rlike(value, F.lit(NUMERIC)), numeric).otherwise(named)


def best_date(text: Column, pack: tuple[PatternSpec, ...] = DEFAULT_PACK, low: Column | None = None) -> Column:
    """struct(date, score) of the date of the highest confidence with its bonus for what stands around it; the earliest
    of equals; nulls if none parses. The score is at most 1. low: the folded text, if it is at hand."""
    if low is None:
        return let(folded(text), lambda own: best_date(text, pack, own))
    rated = F.transform(
        matches(text, "date", pack, low),
        lambda m, i: F.struct(
            (m["confidence"] + let(F.lower(context(text, m["start"], m["end"])), bonus)).alias("total"),
            (-i).alias("place"),
            parse(m["value"]).alias("date"),
        ),
    )
    top = F.array_max(F.filter(rated, lambda x: x["date"].isNotNull()))
    near = let(top, lambda t: F.struct(t["date"].alias("date"), F.when(t["date"].isNotNull(), F.least(t["total"], F.lit(1.0))).alias("score")))
    # Without the word that earns a bonus, places do not matter: it is the first date of the most confident rule with one.
    return F.when(F.contains(low, F.lit(BONUS_WORD)), near).otherwise(plain_date(text, pack, low))


def plain_date(text: Column, pack: tuple[PatternSpec, ...], low: Column) -> Column:
    """best_date of a text in which nothing earns a bonus."""

    def first(spec: PatternSpec) -> Column:
        parsed = F.transform(tried(text, low, spec, values(text, spec), F.array().cast("array<string>")), parse)
        date = F.get(F.filter(parsed, lambda d: d.isNotNull()), F.lit(0))
        return let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(min(spec.confidence, 1.0)).alias("score"))))

    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("score"))
    return F.coalesce(*[first(spec) for _, spec in ranked("date", pack)], none)


def bonus(around: Column) -> Column:
    return F.when(F.contains(around, F.lit("stand vom")), 0.2).when(F.contains(around, F.lit(BONUS_WORD)), 0.1).otherwise(0.0)
