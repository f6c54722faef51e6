"""Test corpora derived from the star-schema tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cases(on: str, *values: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " ELSE '' END"


K, D, LF = "o_orderkey", "o_orderdate", "chr(10)"
MONTH_NAMES = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_NAMES, 1)) + " END"
TEXT = " || ".join(
    [
        cases(f"{K} % 5", "'Verordnung über die Berufsausbildung zum '", "'Anordnung zur '", "'Satzung der '", "'Prüfungsordnung für '", "'Hinweis zur '"),
        f"o_orderpriority || {LF}",
        f"CASE WHEN {K} % 13 < 4 THEN '(Fachkraft Küche-Ausbildungsverordnung – FKA' || CAST({K} % 13 AS STRING) || ')' || {LF} ELSE '' END",
        cases(f"{K} % 4", "'Bundesministerium für Arbeit'", "'Reichsministerium für Wissenschaft'", "'Deutscher Ausschuss für Technisches Schulwesen'", "'Amt'") + f" || {LF}",
        cases(f"{K} % 7", "'Stand vom '", "'vom '", "''", "'am 31. Februar 1938 und '", "'am 1. Foobar 1938, '", "'am '", "'ohne Datum'"),
        f"CASE WHEN {K} % 7 = 6 THEN '' WHEN {K} % 3 < 2 THEN CAST(day({D}) AS STRING) || '. ' || {MONTH} || ' ' || CAST(year({D}) AS STRING)"
        f" ELSE CAST(day({D}) AS STRING) || '.' || CAST(month({D}) AS STRING) || '.' || CAST(year({D}) AS STRING) END || {LF}",
        cases(f"{K} % 11", "'Herausgegeben von Dr. Muster.'", "'Autorin: E. Beispiel'", f"'Herausgegeben von Amt' || {LF} || 'Autoren: A und B'"),
    ]
)
CORPUS_SQL = f"corpus AS (SELECT {K} AS doc_id, {TEXT} AS text FROM orders)"

ATTEMPT_COLUMNS = (
    "l_orderkey AS page_id",
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rk",
    "CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE CAST(l_discount * 10 AS DOUBLE) END AS confidence",
    "CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity * 8 AS BIGINT) END AS text_length",
    "l_returnflag <> 'R' AS success",
    "CAST(l_partkey AS STRING) AS text",
    "CASE l_linenumber % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'standard' WHEN 2 THEN 'light' ELSE 'other' END AS approach",
)
ATTEMPTS_SQL = f"attempts AS (SELECT {', '.join(ATTEMPT_COLUMNS)} FROM lineitem)"

PAGE_COLUMNS = ("conv_id AS doc_id", "turn + 1 AS page_num", "CASE WHEN (conv_id + turn) % 9 = 0 THEN '  ' ELSE text END AS text")
PAGES_SQL = f"doc_pages AS (SELECT {', '.join(PAGE_COLUMNS)} FROM conversations)"

PIXEL_COLUMNS = (
    "CAST(floor(p_partkey / 2000) AS INT) AS page_id",
    "CAST(floor(p_partkey % 2000 / 50) AS INT) AS y",
    "CAST(p_partkey % 50 AS INT) AS x",
    "CAST((p_size * 5 + p_partkey * 7) % 256 AS INT) AS v",
)
#: Pages of 40 lines (the last may be shorter) of 50 pixels.
PIXELS_SQL = f"pixels AS (SELECT {', '.join(PIXEL_COLUMNS)} FROM part)"

METRIC_COLUMNS = (
    "p_partkey AS page_id",
    "CAST(p_size * 1.5 AS DOUBLE) AS contrast",
    "p_partkey % 3 * 500000 + 250000 AS pixels",
    "CAST(p_partkey * 37 % 256 AS DOUBLE) AS brightness",
    "CAST(p_partkey % 11 AS DOUBLE) / 10 AS noise",
    "CASE p_partkey % 4 WHEN 0 THEN 'fraktur' WHEN 1 THEN 'official_document' WHEN 2 THEN 'mixed_period' ELSE 'modern_german' END AS doc_type",
)
METRICS_SQL = f"metrics AS (SELECT {', '.join(METRIC_COLUMNS)} FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Headers in a task: matching them takes seconds, whatever the size of the table.
HEADERS = 1 << 15


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores, where its files make fewer splits; larger tables are left as they are, unless tasks of at most
    about `rows` rows are asked for (the rows are counted by the files' footers)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    waves = -(-df.count() // (rows * cores)) if rows else 1
    wanted = cores * max(waves, 1)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of documents. Matching them costs far more than reading them, so they are spread by their number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return spread(orders, HEADERS).selectExpr(f"{K} AS doc_id", f"{TEXT} AS text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ATTEMPT_COLUMNS)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*PAGE_COLUMNS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*PIXEL_COLUMNS)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*METRIC_COLUMNS)


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each document of doc_pages, some of which failed; failed ones lack the success flag."""
    out = doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    failed = F.col("doc_id") % 5 == 0
    return out.select("doc_id", F.when(failed, F.lit("Processing failed")).alias("error"), F.when(failed, F.lit(None).cast("boolean")).otherwise(F.col("n") > 1).alias("success"))
