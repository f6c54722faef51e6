"""Documents from pages. Grouping by document is the engine's only shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_span, stripped_length

NO_TEXT = "No text could be extracted from document"


def page_range(pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    return pages.filter(F.col("page_num") >= first if not last else F.col("page_num").between(first, last))


def gathered(error: Column) -> list[Column]:
    """What a document's pages come to: text (non-blank pages in order under their headings), total_pages,
    successful_pages, page_results. error: a page's, or null."""
    filled = stripped_length(F.col("text")) > 0
    heading = F.concat(F.lit("\n--- Page "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.when(filled, F.struct("page_num", heading.alias("part")))))
    return [
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"),
        F.count("*").alias("total_pages"),
        F.count_if(filled).alias("successful_pages"),
        F.array_sort(F.collect_list(F.struct("page_num", error.isNull().alias("success"), error.alias("error")))).alias("page_results"),
    ]


def documents(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, total_pages, successful_pages, page_results, error."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    out = pages.groupBy(doc_id).agg(*gathered(error))
    return out.withColumn("error", F.when(stripped_length(F.col("text")) == 0, NO_TEXT))


def with_processing(records: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Adds pages_processed, text_length and status."""
    return records.withColumns(
        {
            "pages_processed": page_span(F.lit(first), F.lit(last).cast("int")),
            "text_length": F.length("text"),
            "status": F.when(F.col("error").isNull(), "success").otherwise("failed"),
        }
    )


def batch_summary(records: DataFrame) -> DataFrame:
    """documents, succeeded, and counted_as_success: a record without a success flag counts as one."""
    return records.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.coalesce("success", F.lit(True))).alias("counted_as_success"),
    )


def not_yet_processed(files: DataFrame, results: DataFrame, key: str = "md5") -> DataFrame:
    """Files whose content no result has."""
    return files.join(results.select(key).distinct(), key, "left_anti")


def cached_results(files: DataFrame, results: DataFrame, key: str = "md5") -> DataFrame:
    """Files with the result of the same content."""
    return files.join(results, key)


def ground_truth(records: DataFrame, truth: DataFrame, fields: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Share of documents for which a field equals the truth."""
    both = records.alias("r").join(truth.alias("t"), doc_id)
    return both.agg(*[F.avg(F.col(f"r.{f}").eqNullSafe(F.col(f"t.{f}")).cast("int")).alias(f) for f in fields])
