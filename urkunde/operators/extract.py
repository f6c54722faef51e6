"""Metadata records from texts: one narrow stage without a shuffle."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import best_date
from ..functions.patterns import DEFAULT_PACK, FIELDS, PatternSpec, context, first_matches, folded, matches
from ..functions.text import preview


def match_table(docs: DataFrame, field: str, text: str = "text", doc_id: str = "doc_id", pack: tuple[PatternSpec, ...] = DEFAULT_PACK) -> DataFrame:
    """One row for each match of a field, ranked within its document."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), matches(F.col(text), field, pack).alias("found"))
    # The outer form, as for the inner one the optimiser would put the matching into a filter as well, twice.
    rows = found.select("doc_id", "text", F.posexplode_outer("found").alias("at", "m")).filter("m is not null")
    return rows.select(
        "doc_id",
        F.lit(field).alias("field"),
        F.col("m.rule").alias("pattern_name"),
        F.col("m.rank").alias("pattern_rk"),
        (F.col("at") + 1).alias("match_rk"),
        F.col("m.value").alias("value"),
        F.col("m.confidence").alias("confidence"),
        F.col("m.start").alias("start_pos"),
        F.col("m.end").alias("end_pos"),
        context(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"),
    )


def overall(scores: list[Column]) -> Column:
    """Mean of the scores that are not null, 0 if there is none."""
    total = reduce(add, [F.coalesce(s, F.lit(0.0)) for s in scores], F.lit(0.0))
    known = reduce(add, [s.isNotNull().cast("int") for s in scores])
    return F.when(known > 0, total / known).otherwise(0.0)


def metadata(docs: DataFrame, text: str = "text", pack: tuple[PatternSpec, ...] = DEFAULT_PACK) -> DataFrame:
    """Adds the record's columns: each field's best match, date and year, the scores, their mean and a preview."""
    body = F.col(text)
    tried, bests = first_matches(docs.withColumn("_low", folded(body)), text, "_low", FIELDS, pack)
    own = F.struct(*[v.alias(f) for f, v in bests.items()], best_date(body, pack, F.col("_low")).alias("date"))
    # The generator keeps the optimiser from putting the matching into each of the columns that use it.
    out = tried.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(own.alias("_found")))))
    each = {f: F.col(f"_found.{f}.score") for f in (*FIELDS, "date")}
    scores = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in each.items()]), lambda e: e["value"].isNotNull()))
    given = {f: F.col(f"_found.{f}.value") for f in FIELDS} | {"date": F.col("_found.date.date"), "year": F.year("_found.date.date"), "confidence_scores": scores}
    out = out.withColumns(given | {"overall_confidence": overall(list(each.values())), "raw_text_preview": preview(body)})
    return out.drop("_found")


def consolidate(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Records of pages to one of each document: of each field the value of the highest score, the first page's of equals."""
    rated = []
    for f in (*FIELDS, "date"):
        rank = F.struct(F.try_element_at("confidence_scores", F.lit(f)).alias("score"), (-F.col("page_num")).alias("page"))
        rated.append(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f))
    return pages.groupBy(doc_id).agg(*rated)
