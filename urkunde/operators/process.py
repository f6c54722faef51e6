"""From files to records: pages, analysis, recognition attempts, documents, metadata. A failure is a row, never the job's end.

Everything up to a page's result is one narrow stage; only the pages of PDF files are grouped. Recognition and
measuring are Arrow functions that get the image of one page after the other.
"""

from __future__ import annotations

import logging
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProcessingConfig
from ..functions.recommend import parsed_choice, selected
from ..functions.text import stripped_length
from ..sources import files
from .assemble import NO_TEXT, gathered, with_processing
from .extract import metadata
from .images import MEASURED, PIPELINES, analysis, decoded, few_images, measured, names_of
from .ocr import ATTEMPT, OcrBackend, limited, page_attempts, sample

#: Approaches that are offered for a choice.
SHOWN = 5
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def measured_pages(pages: DataFrame, backend: OcrBackend, config: ProcessingConfig) -> DataFrame:
    """Adds MEASURED values, a sample of the text, and the seconds that they took. pages: doc_id, page_num, image, error."""

    @F.pandas_udf(f"{MEASURED}, sample string, seconds double")
    def run(doc: pd.Series, number: pd.Series, image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for d, n, (_, x) in zip(doc, number, image.iterrows(), strict=True):
            began = time.monotonic()
            try:
                with limited(config.processing_timeout_seconds):
                    a = decoded(x)
                    row = (*measured(a, d), "" if a is None else sample(backend, a, (d, n)))
            except Exception as e:  # noqa: BLE001  a page's failure is its own
                row = (None,) * 8 + (str(e), "")
            rows.append((*row, time.monotonic() - began))
        return pd.DataFrame(rows, columns=[*names_of(MEASURED), "sample", "seconds"])

    few_images(pages)
    out = pages.withColumn("_m", run("doc_id", F.coalesce("page_num", F.lit(0)), "image"))
    given = {c: F.col(f"_m.{c}") for c in [*names_of(MEASURED), "sample", "seconds"]}
    return out.withColumns(given | {"error": F.coalesce("error", "_m.error")}).drop("_m")


def attempted(pages: DataFrame, backend: OcrBackend, config: ProcessingConfig) -> DataFrame:
    """Adds attempts (array of ATTEMPT) and adds their seconds. pages: doc_id, page_num, image, approaches, image_quality, error."""
    kind = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ATTEMPT.split(', '))}>>"

    @F.pandas_udf(f"attempts {kind}, late string, seconds double")
    def run(doc: pd.Series, number: pd.Series, image: pd.DataFrame, approaches: pd.Series, quality: pd.Series, failed: pd.Series) -> pd.DataFrame:
        rows = []
        for d, n, (_, x), own, q, bad in zip(doc, number, image.iterrows(), approaches, quality, failed, strict=True):
            began, tried, late = time.monotonic(), [], None
            try:
                with limited(config.processing_timeout_seconds):
                    for one in [] if bad else page_attempts(backend, config, decoded(x), own, q, (d, n)):
                        tried.append(dict(zip(names_of(ATTEMPT), one, strict=True)))
            except TimeoutError as e:
                late = str(e)
            rows.append((tried, late, time.monotonic() - began))
        return pd.DataFrame(rows, columns=["attempts", "late", "seconds"])

    failed = F.col("error").isNotNull()
    approaches = F.when(~failed, F.col("approaches")).otherwise(F.array().cast("array<string>"))
    out = pages.withColumn("_a", run("doc_id", F.coalesce("page_num", F.lit(0)), "image", approaches, "image_quality", failed))
    return out.withColumns({"attempts": F.col("_a.attempts"), "error": F.coalesce("error", "_a.late"), "seconds": F.col("seconds") + F.col("_a.seconds")}).drop("_a")


def best_of(attempts: Column, least: float | None, field: str) -> Column:
    """The field of the successful attempt with the highest confidence (over `least`, if it is given); the first of equals."""
    good = F.filter(attempts, lambda x: x["success"] if least is None else x["success"] & (x["confidence"] > least))
    rated = F.transform(good, lambda x: F.struct(x["confidence"].alias("confidence"), (-x["rk"]).alias("place"), x[field].alias("value")))
    return F.array_max(rated)["value"]


def read_pages(pages: DataFrame, backend: OcrBackend, config: ProcessingConfig, choice: str | None = None, typed: DataFrame | None = None) -> DataFrame:
    """pages with their analysis, attempts, text, successful_approach and final_confidence. pages: doc_id, page_num, image, error.

    The approaches are those of the choice. In interactive mode, without a choice, what was typed (doc_id, page_num,
    typed) at the sight of the first SHOWN recommendations decides; where nothing valid was typed, the settings do.
    """
    out = analysis(measured_pages(pages, backend, config), "sample")
    chosen = F.lit(choice)
    if config.enable_interactive_mode and choice is None and typed is not None:
        out = out.join(typed.select("doc_id", "page_num", "typed"), ["doc_id", "page_num"], "left")
        chosen = parsed_choice(F.col("typed"), F.slice("recommended", 1, SHOWN))["choice"]
    approaches = selected(chosen, F.col("recommended"), list(PIPELINES), list(config.preferred_approaches), config.max_approaches_to_try)
    out = attempted(out.withColumns({"user_choice": chosen.cast("string"), "approaches": approaches}), backend, config).drop("image")
    return out.withColumns(
        {
            "text": F.coalesce(best_of(F.col("attempts"), 0.0, "text"), F.lit("")),
            "successful_approach": best_of(F.col("attempts"), None, "approach"),
            "final_confidence": F.coalesce(best_of(F.col("attempts"), None, "confidence"), F.lit(0.0)),
            "successful_attempts": F.size(F.filter("attempts", lambda x: x["success"])),
        }
    )


def records(wanted: DataFrame, pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """One record for each row of wanted (path, ordinal, error): the metadata of its text, and how it was come by.

    pages: those of read_pages with is_pdf. An image's text is its page's; a PDF's text is put together from its pages,
    and a page that failed is only listed. The page of the highest confidence tells the record's approach and analysis.
    """
    rank = F.struct("final_confidence", -F.coalesce("page_num", F.lit(0)))
    told = ["successful_approach", "document_type", "image_quality", "confidence"]
    found = pages.groupBy("doc_id").agg(
        *gathered(F.col("error")),
        F.sum(F.size("attempts")).cast("int").alias("ocr_attempts_count"),
        F.sum("successful_attempts").cast("int").alias("successful_attempts"),
        F.sum("seconds").alias("seconds"),
        F.max("final_confidence").alias("final_confidence"),
        F.max("user_choice").alias("user_choice"),
        F.max_by(F.struct(*told), rank).alias("told"),
        F.first(F.col("is_pdf")).alias("is_pdf"),
        F.max(F.when(~F.col("is_pdf"), F.col("text"))).alias("own_text"),
        F.max(F.when(~F.col("is_pdf") | F.col("page_num").isNull(), F.col("error"))).alias("own_error"),
    )
    found = found.withColumn("text", F.when(F.col("is_pdf"), F.col("text")).otherwise(F.col("own_text")))
    out = wanted.select(F.col("path").alias("doc_id"), "ordinal", F.col("error").alias("missing")).join(found, "doc_id", "left")
    blank = F.when(stripped_length(F.col("text")) == 0, NO_TEXT)
    error = F.coalesce("missing", "own_error", blank)
    out = out.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    out = with_processing(metadata(out), first, last)
    info = {
        "error": F.col("error"),
        "success": F.when(F.col("error").isNotNull(), "false"),
        "file_path": F.col("doc_id"),
        "processing_time_seconds": F.coalesce("seconds", F.lit(0.0)).cast("string"),
        "pages_processed": F.when(F.col("error").isNull(), F.col("pages_processed")),
        "text_length": F.col("text_length").cast("string"),
        "total_pages": F.when(F.col("is_pdf"), F.col("total_pages").cast("string")),
        "successful_pages": F.when(F.col("is_pdf"), F.col("successful_pages").cast("string")),
        "page_results": F.when(F.col("is_pdf"), F.to_json("page_results")),
        "ocr_attempts": F.col("ocr_attempts_count").cast("string"),
        "successful_attempts": F.col("successful_attempts").cast("string"),
        "user_choice": F.col("user_choice"),
        "successful_approach": F.col("told.successful_approach"),
        "final_confidence": F.col("final_confidence").cast("string"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in info.items()]), lambda e: e["value"].isNotNull())
    return out.withColumns(
        {
            "success": F.when(F.col("error").isNotNull(), F.lit(False)),
            "ocr_attempts_count": F.coalesce("ocr_attempts_count", F.lit(0)),
            "successful_approach": F.col("told.successful_approach"),
            "analysis_document_type": F.col("told.document_type"),
            "analysis_quality": F.col("told.image_quality"),
            "processing_time_seconds": F.coalesce("seconds", F.lit(0.0)),
            "processing_metadata": F.map_from_entries(entries),
        }
    ).drop("told", "is_pdf", "own_text", "own_error", "missing", "seconds", "user_choice", "successful_attempts")


def process(
    spark: SparkSession,
    folder: str,
    backend: OcrBackend,
    config: ProcessingConfig,
    wanted: DataFrame | None = None,
    first: int = 1,
    last: int | None = None,
    choice: str | None = None,
    typed: DataFrame | None = None,
    rasterise: files.Rasteriser = files.by_pdf2image,
) -> DataFrame:
    """Records of the wanted files (path, ordinal; by default all in the folder), in no order; `ordinal` keeps the order asked for.

    A file that is missing or broken, and a page that takes longer than the settings' timeout, have their error in the
    record. The whole is one lazy plan that Spark retries by task; with a batch nothing else is needed.
    """
    logging.getLogger("urkunde").info("Planning the documents of %s", folder)
    present = files.files(spark, folder)
    if wanted is None:
        wanted = present.select("path", F.xxhash64("path").alias("ordinal"))
    listed = files.requested(wanted, present)
    asked = listed.filter("error is null").select(F.col("path").alias("doc_id")).distinct()
    images = files.images(spark, folder).join(asked, "doc_id", "left_semi").withColumn("is_pdf", F.lit(False))
    found = files.files(spark, folder, content=True, extensions=(".pdf",)).join(asked.withColumnRenamed("doc_id", "path"), "path", "left_semi")
    pdfs = files.pdf_pages(found, first, last, config.dpi, rasterise).withColumn("is_pdf", F.lit(True))
    pages = images.withColumn("image", F.col("image").cast(IMAGE)).unionByName(pdfs)
    return records(listed, read_pages(pages, backend, config, choice, typed), first, last)
