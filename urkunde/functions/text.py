"""Text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, EDGES, "")


def stripped_length(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0))


def preview(text: Column, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def one_line(text: Column, most: int = 300) -> Column:
    return F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" "))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def page_span(first: Column, last: Column) -> Column:
    """"first-last", where null and 0 stand for the end."""
    return F.concat_ws("-", first.cast("string"), F.coalesce(F.nullif(last, F.lit(0)).cast("string"), F.lit("end")))


def repair_digits(text: Column) -> Column:
    """Opt-in: an l before a full stop, after white space, read as the digit it was."""
    return F.regexp_replace(text, r"(?<=\s)l\.(?=\s)", "1.")
