"""Findings on metadata records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The findings' texts. A date and a field's name are put in.
UNLIKELY_DATE = ("Date ", " seems unreasonable for historical document")
OTHER_YEAR = "Year field inconsistent with date field"
SHORT_TITLE = "Title seems too short"
SHORT_PUBLISHER = "Publisher name seems too short"
BAD_SCORE = "Invalid confidence score for "
LOW_SCORE = "Low confidence score for "

KIND = "array<struct<severity:string,rule:string,message:string>>"


def broken(least: float = 0.3) -> Column:
    """A record's findings (severity, rule, message): one for each rule that it breaks. Empty texts and year 0 count as absent."""

    def hit(when, severity, rule, message):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message")))

    date, year = F.col("date"), F.nullif(F.col("year"), F.lit(0))
    fixed = F.array(
        hit(~F.year(date).between(1800, 2030), "warning", "date_range", F.concat(F.lit(UNLIKELY_DATE[0]), date.cast("string"), F.lit(UNLIKELY_DATE[1]))),
        hit(date.isNotNull() & (year != F.year(date)), "error", "date_year", F.lit(OTHER_YEAR)),
        hit(F.length(F.nullif(F.col("title"), F.lit(""))) < 5, "warning", "title_length", F.lit(SHORT_TITLE)),
        hit(F.length(F.nullif(F.col("publisher"), F.lit(""))) < 3, "warning", "publisher_length", F.lit(SHORT_PUBLISHER)),
    )
    scored = F.transform(
        F.map_entries("confidence_scores"),
        lambda e: F.when(
            (e["value"] < 0) | (e["value"] > 1),
            F.struct(F.lit("error").alias("severity"), F.lit("score_range").alias("rule"), F.concat(F.lit(BAD_SCORE), e["key"]).alias("message")),
        ).when(
            e["value"] < least,
            F.struct(F.lit("warning").alias("severity"), F.lit("score_low").alias("rule"), F.concat(F.lit(LOW_SCORE), e["key"]).alias("message")),
        ),
    )
    return F.concat(F.array_compact(fixed).cast(KIND), F.coalesce(F.array_compact(scored).cast(KIND), F.array().cast(KIND)))


def findings(records: DataFrame, least: float = 0.3, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, severity, rule, message: one row for each rule that a record breaks."""
    found = records.select(F.col(doc_id).alias("doc_id"), broken(least).alias("found"))
    # The outer form, as for the inner one the optimiser would put the rules into a filter as well.
    return found.select("doc_id", F.inline_outer("found")).filter("rule is not null")


def summary(records: DataFrame, least: float = 0.3, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, is_valid, errors, warnings for every record, each on its own: nothing is joined."""
    found = records.select(F.col(doc_id).alias("doc_id"), broken(least).alias("found"))
    errors = F.size(F.filter("found", lambda x: x["severity"] == "error")).cast("long")
    counted = found.select("doc_id", errors.alias("errors"), F.size("found").cast("long").alias("n"))
    return counted.select("doc_id", (F.col("errors") == 0).alias("is_valid"), "errors", (F.col("n") - F.col("errors")).alias("warnings"))
