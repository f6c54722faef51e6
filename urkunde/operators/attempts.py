"""The order, the end and the result of a page's recognition attempts, as relations.

attempts: a page's key, rk (order), approach, success, confidence, text_length, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_excluded(attempts: DataFrame, excluded: list[str]) -> DataFrame:
    """Excluded approaches leave no row."""
    return attempts.filter(~F.col("approach").isin(excluded)) if excluded else attempts


def tried(attempts: DataFrame, page: list[str], confidence: float = 0.8, length: int = 100) -> DataFrame:
    """The attempts up to the first that is good enough: over the confidence and over the length."""
    good = (F.col("confidence") > confidence) & (F.col("text_length") > length)
    before = Window.partitionBy(*page).orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("_over", F.max(good).over(before)).filter(~F.coalesce("_over", F.lit(False))).drop("_over")


def outcome(attempts: DataFrame, page: list[str]) -> DataFrame:
    """A row for each page: text of the most confident attempt (empty if none is over 0), the approach that is
    reported (also at 0), its confidence, and the numbers of attempts. The first of equals wins."""
    rank = F.struct("confidence", -F.col("rk"))
    return attempts.groupBy(*page).agg(
        F.coalesce(F.max_by("text", F.when(F.col("success") & (F.col("confidence") > 0), rank)), F.lit("")).alias("text"),
        F.max_by("approach", F.when(F.col("success"), rank)).alias("successful_approach"),
        F.coalesce(F.max(F.when(F.col("success"), F.col("confidence"))), F.lit(0.0)).alias("final_confidence"),
        F.count("*").alias("n_attempts"),
        F.count_if("success").alias("n_success"),
    )


def longest_fallback(candidates: DataFrame, page: list[str], least: int = 20) -> DataFrame:
    """The text of a page over its languages (rk 0 is the primary one): the primary text if it has `least` stripped code
    points, else the longest, the earliest of equals."""
    rank = F.struct("text_length", -F.col("rk"))
    primary = F.max(F.when(F.col("rk") == 0, F.col("text_length")))
    return candidates.groupBy(*page).agg(
        F.when(F.coalesce(primary, F.lit(0)) >= least, F.max(F.when(F.col("rk") == 0, F.col("text")))).otherwise(F.max_by("text", rank)).alias("text")
    )


def with_pipelines(attempts: DataFrame, known: list[str]) -> DataFrame:
    """Adds error: an approach that is not known fails."""
    return attempts.withColumn("error", F.when(~F.col("approach").isin(known), F.concat(F.lit("Unknown approach: "), F.col("approach"))))
