"""Registry of the engine's own queries and of the SQL that checks them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ERA_APPROACHES, OTHER_ERA
from ..functions import dates, patterns, recommend, scoring
from ..functions import text as texts
from ..operators import assemble, attempts, extract, pixels, validate
from ..operators.images import PIPELINES
from ..sources import export, files
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def duck(spec: patterns.PatternSpec) -> str:
    """A rule as a DuckDB expression for all its matches."""
    regex = spec.regex.removeprefix("(?i)").replace(r"[\w", r"[\p{L}\p{N}_")
    return f"regexp_extract_all(text, '(?im){regex}')"


def duck_matches(field: str) -> str:
    """found: doc_id, rule, rank, place, value, start_pos, confidence."""
    parts = []
    for rank, s in patterns.ranked(field):
        regex = s.regex.removeprefix("(?i)").replace(r"[\w", r"[\p{L}\p{N}_")
        parts.append(
            f"SELECT doc_id, text, '{s.name}' AS pattern_name, {rank} AS pattern_rk, i AS place, m[i] AS value, {s.confidence}::DOUBLE AS confidence, "
            f"(list_sum(list_transform(sp[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start_pos "
            f"FROM (SELECT doc_id, text, m, sp, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, text, {duck(s)} AS m, regexp_split_to_array(text, '(?im){regex}') AS sp FROM corpus))"
        )
    return f"WITH {fx.CORPUS_SQL}, found AS ({' UNION ALL '.join(parts)})"


for _field in ("date", "publisher", "document_type", "title", "author"):

    @query(
        f"match_all_{_field}",
        f"{duck_matches(_field)} SELECT doc_id, pattern_name, pattern_rk::BIGINT AS pattern_rk, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pattern_rk, place) AS match_rk, value, confidence FROM found",
    )
    def _match_all(spark: SparkSession, sf_dir: str, field: str = _field) -> DataFrame:
        out = extract.match_table(fx.corpus(spark, sf_dir), field)
        return out.select("doc_id", "pattern_name", F.col("pattern_rk").cast("long").alias("pattern_rk"), F.col("match_rk").cast("long").alias("match_rk"), "value", "confidence")


@query(
    "match_positions",
    f"{duck_matches('date')} SELECT doc_id, pattern_name, value, start_pos, start_pos + length(value) AS end_pos, "
    "text[greatest(start_pos - 50, 0) + 1 : least(length(text), start_pos + length(value) + 50)] AS context FROM found",
)
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.match_table(fx.corpus(spark, sf_dir), "date")
    return out.select("doc_id", "pattern_name", "value", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "context")


def duck_best(field: str) -> tuple[str, str]:
    own = [s for _, s in patterns.ranked(field)]
    value = f"coalesce({', '.join(f'{duck(s)}[1]' for s in own)})" if own else "CAST(NULL AS VARCHAR)"
    score = "CASE " + " ".join(f"WHEN len({duck(s)}) > 0 THEN {s.confidence}::DOUBLE" for s in own) + " END" if own else "CAST(NULL AS DOUBLE)"
    return value, score


for _field in ("title", "publisher", "document_type", "author", "profession"):
    _value, _score = duck_best(_field)

    @query(f"best_{_field}", f"WITH {fx.CORPUS_SQL} SELECT doc_id, {_value} AS {_field}, {_score} AS confidence FROM corpus")
    def _best(spark: SparkSession, sf_dir: str, field: str = _field) -> DataFrame:
        found = fx.corpus(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct(patterns.best(F.col("text"), field).alias("m")))))
        return found.select("doc_id", F.col("m.value").alias(field), F.col("m.score").alias("confidence"))


MONTH_CASE = "CASE lower(regexp_extract(value, '(\\d{1,2})\\.\\s*([a-zA-ZäöüÄÖÜß]+)\\s*(\\d{4})', 2)) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in dates.MONTHS.items()) + " END"
NUM, NAM = r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"(\d{1,2})\.\s*([a-zA-ZäöüÄÖÜß]+)\s*(\d{4})"
DATES_SQL = f"""{duck_matches("date")},
rated AS (
  SELECT doc_id, confidence + CASE WHEN contains(around, 'stand vom') THEN 0.2 WHEN contains(around, 'vom') THEN 0.1 ELSE 0 END::DOUBLE AS total, ord,
    CASE WHEN regexp_extract(value, '{NUM}') <> ''
      THEN try_strptime(regexp_extract(value, '{NUM}', 3) || '-' || regexp_extract(value, '{NUM}', 2) || '-' || regexp_extract(value, '{NUM}', 1), '%Y-%m-%d')
      ELSE try_strptime(regexp_extract(value, '{NAM}', 3) || '-' || CAST({MONTH_CASE} AS VARCHAR) || '-' || regexp_extract(value, '{NAM}', 1), '%Y-%m-%d') END::DATE AS date
  FROM (SELECT *, lower(text[greatest(start_pos - 50, 0) + 1 : least(length(text), start_pos + length(value) + 50)]) AS around,
    row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pattern_rk, place) AS ord FROM found)),
dated AS (
  SELECT doc_id, date, least(total, 1.0)::DOUBLE AS score FROM rated WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, ord) = 1)"""


@query("best_date", f"{DATES_SQL} SELECT corpus.doc_id, date, year(date) AS year, round(score, 6) AS confidence FROM corpus LEFT JOIN dated ON corpus.doc_id = dated.doc_id")
def best_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fx.corpus(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct(dates.best_date(F.col("text")).alias("d")))))
    return out.select("doc_id", F.col("d.date").alias("date"), F.year("d.date").cast("long").alias("year"), F.round("d.score", 6).alias("confidence"))


_BESTS = {f: duck_best(f) for f in ("title", "publisher", "document_type", "author")}
RECORD_SQL = f"""{DATES_SQL},
record AS (
  SELECT corpus.doc_id, {", ".join(f"{v} AS {f}, {s} AS {f}_score" for f, (v, s) in _BESTS.items())}, date, score, text
  FROM corpus LEFT JOIN dated ON corpus.doc_id = dated.doc_id)"""
MEAN = f"coalesce(list_avg(list_filter([{', '.join(f'{f}_score' for f in _BESTS)}, score], lambda x: x IS NOT NULL)), 0)"


@query(
    "metadata_record",
    f"{RECORD_SQL} SELECT doc_id, title, publisher, document_type, CAST(NULL AS VARCHAR) AS profession, author, date, year(date) AS year, round({MEAN}, 6) AS overall_confidence, "
    "CASE WHEN length(text) > 1000 THEN text[1:1000] || '...' ELSE text END AS raw_text_preview FROM record",
)
def metadata_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.metadata(fx.corpus(spark, sf_dir))
    return out.select(
        "doc_id", "title", "publisher", "document_type", "profession", "author", "date", F.col("year").cast("long").alias("year"), F.round("overall_confidence", 6).alias("overall_confidence"), "raw_text_preview"
    )


@query(
    "overall_confidence",
    f"{RECORD_SQL} SELECT doc_id, {' + '.join(f'({f}_score IS NOT NULL)::BIGINT' for f in _BESTS)} + (score IS NOT NULL)::BIGINT AS n_scores, round({MEAN}, 6) AS overall_confidence FROM record",
)
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.metadata(fx.corpus(spark, sf_dir))
    return out.select("doc_id", F.size("confidence_scores").cast("long").alias("n_scores"), F.round("overall_confidence", 6).alias("overall_confidence"))


def read_back(*keys: str) -> str:
    """The schema under which keys of an exported record are read back."""
    kinds = {"confidence_scores": "map<string,double>", "overall_confidence": "double", "processing_metadata": "map<string,string>", "ocr_attempts_count": "bigint"}
    return ", ".join(f"{k} {kinds.get(k, 'string')}" for k in keys)


@query(
    "metadata_json_fields",
    f"{RECORD_SQL} SELECT doc_id, title AS title, CAST(year(date) AS VARCHAR) AS year, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, 0::BIGINT AS attempts, publisher AS publisher FROM record",
)
def metadata_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = extract.metadata(fx.corpus(spark, sf_dir))
    out = export.as_json(records.withColumn("processing_metadata", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"))))
    # One parse gives all fields.
    return out.select(F.from_json("value", read_back("title", "year", "date", "publisher", "processing_metadata", "ocr_attempts_count")).alias("r")).select(
        F.try_element_at("r.processing_metadata", F.lit("doc_id")).cast("long").alias("doc_id"), "r.title", "r.year", "r.date", F.col("r.ocr_attempts_count").alias("attempts"), "r.publisher"
    )


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN text[1:1000] || '...' ELSE text END AS preview, replace(text[1:300], chr(10), ' ') AS one_line FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", texts.preview(F.col("text")).alias("preview"), texts.one_line(F.col("text")).alias("one_line"))


def duck_hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', ''), '[\s\x{1c}-\x{1f}\x{85}\x{a0}]+$', '')"
CONFIDENCE_SQL = (
    f"CASE WHEN length({STRIPPED}) = 0 THEN 0.0 ELSE least(1.0, (0.0::DOUBLE + least(length({STRIPPED}) / 500.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE "
    f"+ least({duck_hits('lower(text)', scoring.SCORED_WORDS)} / 8.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE "
    "+ least(len(regexp_extract_all(text, '[\\n().,:;]')) / 20.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE "
    f"+ least(({' + '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})::INT' for p in scoring.DATE_SIGNS)}) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE) "
    "* CASE WHEN len(regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s.,:;()\\-]')) / greatest(length(text), 1)::DOUBLE > 0.3 THEN 0.7 ELSE 1.0 END::DOUBLE) END"
)


@query("ocr_confidence", f"SELECT doc_id, round({CONFIDENCE_SQL}, 6)::DOUBLE AS confidence FROM documents")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).select("doc_id", F.round(scoring.ocr_confidence(F.col("text")), 6).alias("confidence"))


@query(
    "doc_type_detect",
    f"""WITH hits AS (SELECT doc_id, {duck_hits("text", scoring.FRAKTUR_SIGNS)} AS f, {duck_hits("lower(text)", scoring.OFFICIAL_TERMS)} AS o, {duck_hits("lower(text)", scoring.TYPE_WORDS)} AS g FROM documents),
scores AS (SELECT doc_id, f * 0.3::DOUBLE AS f, CASE WHEN g > 3 THEN 0.4 ELSE 0 END::DOUBLE AS m, o * 0.4::DOUBLE AS o, CASE WHEN f > 0 AND g > 2 THEN 0.3 ELSE 0 END::DOUBLE AS x FROM hits)
SELECT doc_id, CASE WHEN greatest(f, m, o, x) < 0.3 THEN 'modern_german' WHEN f >= greatest(m, o, x) THEN 'fraktur' WHEN m >= greatest(o, x) THEN 'modern_german'
  WHEN o >= x THEN 'official_document' ELSE 'mixed_period' END AS document_type,
  round(CASE WHEN greatest(f, m, o, x) < 0.3 THEN 0.5 ELSE least(greatest(f, m, o, x), 1.0) END, 6)::DOUBLE AS confidence FROM scores""",
)
def doc_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fx.documents(spark, sf_dir).select("doc_id", scoring.document_type(F.col("text")).alias("t"))
    return out.select("doc_id", F.col("t.type").alias("document_type"), F.round("t.confidence", 6).alias("confidence"))


QUALITY_SQL = """quality AS (SELECT *, CASE WHEN points >= 4 THEN 'excellent' WHEN points >= 3 THEN 'good' WHEN points >= 2 THEN 'fair' ELSE 'poor' END AS quality, brightness < 127 AS inverted FROM (
  SELECT *, CASE WHEN contrast > 60 THEN 3 WHEN contrast > 40 THEN 2 WHEN contrast > 20 THEN 1 ELSE 0 END + CASE WHEN pixels > 1000000 THEN 2 WHEN pixels > 500000 THEN 1 ELSE 0 END AS points FROM metrics))"""
ADVICE_STEPS = f"""{QUALITY_SQL},
a AS (SELECT *, CASE doc_type WHEN 'fraktur' THEN ['fraktur_traditional', 'fraktur_enhanced'] WHEN 'official_document' THEN ['official_document', 'german_italic']
  WHEN 'mixed_period' THEN ['mixed_period', 'standard'] ELSE ['modern_german', 'standard'] END AS l0 FROM quality),
b AS (SELECT *, CASE quality WHEN 'poor' THEN ['enhanced'] || l0 WHEN 'excellent' THEN ['direct'] || l0 ELSE l0 END AS l1 FROM a),
c AS (SELECT *, CASE WHEN inverted THEN l1[1:1] || ['minimal'] || l1[2:] ELSE l1 END AS l2 FROM b),
d AS (SELECT *, CASE WHEN contrast < 30 THEN ['enhanced'] || l2 ELSE l2 END AS l3 FROM c),
e AS (SELECT *, CASE WHEN noise > 0.6 AND NOT list_contains(l3, 'enhanced') THEN ['enhanced'] || l3 ELSE l3 END AS l4 FROM d),
f AS (SELECT *, l4 || list_filter(['light', 'standard', 'direct'], lambda x: NOT list_contains(l4, x)) AS l5 FROM e),
advice AS (SELECT *, l5[1:6] AS advised FROM f)"""
ADVICE_SQL = f"WITH {fx.METRICS_SQL}, {ADVICE_STEPS}"


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    out = fx.metrics(spark, sf_dir).withColumns({"quality": scoring.image_quality(F.col("contrast"), F.col("pixels")), "inverted": scoring.is_inverted(F.col("brightness"))})
    return out, [F.col(c) for c in ("doc_type", "quality", "inverted", "contrast", "noise")]


@query("quality_bucket", f"WITH {fx.METRICS_SQL}, {QUALITY_SQL} SELECT page_id, quality, inverted FROM quality")
def quality_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir)[0].select("page_id", "quality", "inverted")


_REASONS = recommend.REASONS
@query(
    "recommend_approaches",
    f"""{ADVICE_SQL} SELECT page_id, array_to_string(advised, ',') AS advised, concat_ws('; ',
  CASE doc_type WHEN 'fraktur' THEN '{_REASONS["fraktur"]}' WHEN 'official_document' THEN '{_REASONS["official_document"]}' WHEN 'mixed_period' THEN '{_REASONS["mixed_period"]}' ELSE '{_REASONS["modern"]}' END,
  CASE quality WHEN 'poor' THEN '{_REASONS["poor"]}' WHEN 'excellent' THEN '{_REASONS["excellent"]}' END, CASE WHEN inverted THEN '{_REASONS["inverted"]}' END,
  CASE WHEN contrast < 30 THEN '{_REASONS["contrast"]}' END, CASE WHEN noise > 0.6 THEN '{_REASONS["noise"]}' END) AS reasons FROM advice""",
)
def recommend_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, given = measured(spark, sf_dir)
    return out.select("page_id", F.array_join(recommend.recommended(*given), ",").alias("advised"), F.array_join(recommend.reasons(*given), "; ").alias("reasons"))


CHOICE = "CASE page_id % 5 WHEN 0 THEN 'skip_analysis' WHEN 1 THEN 'all_recommended' WHEN 2 THEN 'newspaper' WHEN 3 THEN 'no such approach' END"


@query(
    "approach_selection",
    f"""{ADVICE_SQL} SELECT page_id, rk, approach FROM (SELECT page_id, unnest(chosen) AS approach, generate_subscripts(chosen, 1) AS rk FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN ['standard', 'light', 'direct'] WHEN 1 THEN advised WHEN 2 THEN ['newspaper'] ELSE advised[1:4] END AS chosen FROM advice))""",
)
def approach_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, given = measured(spark, sf_dir)
    chosen = recommend.selected(F.expr(CHOICE), recommend.recommended(*given), list(PIPELINES), [], 4)
    return out.select("page_id", F.posexplode(chosen).alias("at", "approach")).select("page_id", (F.col("at") + 1).cast("long").alias("rk"), "approach")


TRIED_SQL = f"""WITH {fx.ATTEMPTS_SQL}, tried AS (SELECT * EXCLUDE over FROM (SELECT *, coalesce(bool_or(confidence > 0.8 AND text_length > 100) OVER (
  PARTITION BY page_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM attempts) WHERE NOT over)"""


def tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.tried(fx.attempts(spark, sf_dir), ["page_id"])


@query("early_exit_attempts", f"{TRIED_SQL} SELECT page_id, rk::BIGINT AS rk, confidence, text_length FROM tried")
def early_exit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tried(spark, sf_dir).select("page_id", F.col("rk").cast("long").alias("rk"), "confidence", F.col("text_length").cast("long").alias("text_length"))


OUTCOME_SQL = f"""{TRIED_SQL}, best AS (SELECT page_id, coalesce(first(text ORDER BY confidence DESC, rk) FILTER (success AND confidence > 0), '') AS text,
  first(approach ORDER BY confidence DESC, rk) FILTER (success) AS successful_approach, coalesce(max(confidence) FILTER (success), 0.0)::DOUBLE AS final_confidence,
  count(*) AS n_attempts, count(*) FILTER (success) AS n_success FROM tried GROUP BY page_id)"""
for _name, _columns in {"best_attempt": ["text"], "reported_attempt": ["successful_approach", "final_confidence"], "attempt_counts": ["n_attempts", "n_success"]}.items():

    @query(_name, f"{OUTCOME_SQL} SELECT page_id, {', '.join(_columns)} FROM best")
    def _outcome(spark: SparkSession, sf_dir: str, columns: tuple = tuple(_columns)) -> DataFrame:
        return attempts.outcome(tried(spark, sf_dir), ["page_id"]).select("page_id", *columns)


@query("excluded_approaches", f"WITH {fx.ATTEMPTS_SQL} SELECT page_id, count(*) AS n FROM attempts WHERE approach NOT IN ('other', 'light') GROUP BY page_id")
def excluded_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.without_excluded(fx.attempts(spark, sf_dir), ["other", "light"]).groupBy("page_id").agg(F.count("*").alias("n"))


@query("unknown_approaches", f"WITH {fx.ATTEMPTS_SQL} SELECT page_id, rk::BIGINT AS rk, CASE WHEN approach = 'other' THEN 'Unknown approach: other' END AS error FROM attempts")
def unknown_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.with_pipelines(fx.attempts(spark, sf_dir), list(PIPELINES)).select("page_id", F.col("rk").cast("long").alias("rk"), "error")


@query(
    "language_fallback",
    f"""WITH {fx.ATTEMPTS_SQL} SELECT page_id, CASE WHEN coalesce(max(text_length) FILTER (rk = 1), 0) >= 20 THEN max(text) FILTER (rk = 1)
  ELSE first(text ORDER BY text_length DESC, rk) END AS text FROM attempts GROUP BY page_id""",
)
def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.longest_fallback(fx.attempts(spark, sf_dir).withColumn("rk", F.col("rk") - 1), ["page_id"])


BLANK = r"regexp_replace(text, '\s+', '', 'g') = ''"


@query(
    "page_assembly",
    f"""WITH {fx.PAGES_SQL} SELECT doc_id, coalesce(string_agg(chr(10) || '--- Page ' || page_num || ' ---' || chr(10) || text, chr(10) ORDER BY page_num) FILTER (NOT {BLANK}), '') AS text
  FROM doc_pages GROUP BY doc_id""",
)
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.documents(fx.doc_pages(spark, sf_dir)).select("doc_id", "text")


@query("page_counts", f"WITH {fx.PAGES_SQL} SELECT doc_id, count(*) AS total_pages, count(*) FILTER (NOT {BLANK}) AS successful_pages, bool_and({BLANK}) AS failed FROM doc_pages GROUP BY doc_id")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.documents(fx.doc_pages(spark, sf_dir)).select("doc_id", "total_pages", "successful_pages", F.col("error").isNotNull().alias("failed"))


@query("page_range", f"WITH {fx.PAGES_SQL} SELECT doc_id, count(*) AS n, min(page_num)::BIGINT AS first_page, '2-4' AS pages_processed FROM doc_pages WHERE page_num BETWEEN 2 AND 4 GROUP BY doc_id")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.page_range(fx.doc_pages(spark, sf_dir), 2, 4).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("page_num").cast("long").alias("first_page"))
    return out.withColumn("pages_processed", texts.page_span(F.lit(2), F.lit(4)))


@query("page_results", f"WITH {fx.PAGES_SQL} SELECT doc_id, string_agg(page_num::VARCHAR, ',' ORDER BY page_num) AS pages FROM doc_pages GROUP BY doc_id")
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.documents(fx.doc_pages(spark, sf_dir)).select("doc_id", F.array_join(F.transform("page_results", lambda p: p["page_num"].cast("string")), ",").alias("pages"))


BATCH_SQL = "batch AS (SELECT conv_id AS doc_id, CASE WHEN conv_id % 5 = 0 THEN 'Processing failed' END AS error, CASE WHEN conv_id % 5 <> 0 THEN count(*) > 1 END AS success FROM conversations GROUP BY conv_id)"


@query("batch_success", f"WITH {BATCH_SQL} SELECT count(*) AS documents, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (coalesce(success, true)) AS counted_as_success FROM batch")
def batch_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.batch_summary(fx.batch(spark, sf_dir))


@query("batch_errors", f"WITH {BATCH_SQL} SELECT doc_id, error, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status FROM batch")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.with_processing(fx.batch(spark, sf_dir).withColumn("text", F.lit(""))).select("doc_id", "error", "status")


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata records, most of them broken by one rule each."""
    k = F.col("doc_id") % 6
    out = extract.metadata(fx.corpus(spark, sf_dir))
    return out.select(
        "doc_id",
        F.when(k == 5, "Kurz").otherwise(F.col("title")).alias("title"),
        F.when(k == 5, "AB").otherwise(F.col("publisher")).alias("publisher"),
        F.when(k == 2, F.to_date(F.lit("1700-01-01"))).otherwise(F.col("date")).alias("date"),
        F.when(k == 1, F.col("year") + 1).when(k == 2, 1700).otherwise(F.col("year")).alias("year"),
        F.when(k == 3, F.create_map(F.lit("title"), F.lit(1.2))).when(k == 4, F.create_map(F.lit("title"), F.lit(0.1))).otherwise(F.create_map(F.lit("title"), F.lit(0.9))).alias("confidence_scores"),
    )


FINDINGS_SQL = f"""{RECORD_SQL}, cases AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'Kurz' ELSE title END AS title, CASE WHEN doc_id % 6 = 5 THEN 'AB' ELSE publisher END AS publisher,
  CASE WHEN doc_id % 6 = 2 THEN DATE '1700-01-01' ELSE date END AS date, CASE doc_id % 6 WHEN 1 THEN year(date) + 1 WHEN 2 THEN 1700 ELSE year(date) END AS year,
  CASE doc_id % 6 WHEN 3 THEN 1.2 WHEN 4 THEN 0.1 ELSE 0.9 END AS score FROM record),
findings AS (
  SELECT doc_id, 'warning' AS severity, 'date_range' AS rule FROM cases WHERE year(date) NOT BETWEEN 1800 AND 2030
  UNION ALL SELECT doc_id, 'error', 'date_year' FROM cases WHERE date IS NOT NULL AND year <> 0 AND year <> year(date)
  UNION ALL SELECT doc_id, 'error', 'score_range' FROM cases WHERE score < 0 OR score > 1
  UNION ALL SELECT doc_id, 'warning', 'score_low' FROM cases WHERE score >= 0 AND score < 0.3
  UNION ALL SELECT doc_id, 'warning', 'title_length' FROM cases WHERE title <> '' AND length(title) < 5
  UNION ALL SELECT doc_id, 'warning', 'publisher_length' FROM cases WHERE publisher <> '' AND length(publisher) < 3)"""


@query("validate_rules", f"{FINDINGS_SQL} SELECT doc_id, severity, rule FROM findings")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.findings(perturbed(spark, sf_dir)).select("doc_id", "severity", "rule")


@query(
    "validate_summary",
    f"""{FINDINGS_SQL} SELECT corpus.doc_id, count(*) FILTER (severity = 'error') = 0 AS is_valid, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
  FROM corpus LEFT JOIN findings ON corpus.doc_id = findings.doc_id GROUP BY corpus.doc_id""",
)
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(perturbed(spark, sf_dir))


EXTENSION_SQL = r"lower(regexp_extract(url, '[^/.][^/]*?(\.[^./]+)$', 1))"


@query("supported_files", f"SELECT page_id, {EXTENSION_SQL} AS ext, {EXTENSION_SQL} IN {files.EXTENSIONS} AS supported, CASE WHEN {EXTENSION_SQL} = '.pdf' THEN 'pdf' ELSE 'image' END AS branch FROM pages")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select("page_id", files.extension(url).alias("ext"), files.is_supported(url).alias("supported"), files.branch(url).alias("branch"))


@query("file_hash", "SELECT doc_id, md5(text) AS md5 FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("month_lookup", f"WITH {fx.CORPUS_SQL} SELECT doc_id, month FROM (SELECT doc_id, {MONTH_CASE.replace('value', 'text')}::BIGINT AS month FROM corpus)")
def month_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.corpus(spark, sf_dir).select("doc_id", dates.month_number(F.regexp_extract("text", dates.NAMED, 2)).cast("long").alias("month"))


@query(
    "era_preferences",
    "SELECT n_nationkey, CASE n_nationkey % 6 "
    + " ".join(f"WHEN {i} THEN '{','.join(a)}'" for i, a in enumerate(ERA_APPROACHES.values()))
    + f" ELSE '{','.join(OTHER_ERA)}' END AS approaches FROM nation",
)
def era_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras = spark.createDataFrame([(e, ",".join(a)) for e, a in ERA_APPROACHES.items()], "era string, own string")
    asked = fx.table(spark, sf_dir, "nation").withColumn("era", F.element_at(F.array(*map(F.lit, [*ERA_APPROACHES, "2050"])), (F.col("n_nationkey") % 6 + 1).cast("int")))
    return asked.join(F.broadcast(eras), "era", "left").select("n_nationkey", F.coalesce("own", F.lit(",".join(OTHER_ERA))).alias("approaches"))  # five rows


def pixel_query(name: str, sql: str, step: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = step(fx.pixels(spark, sf_dir))
        return out.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    query(name, f"WITH {fx.PIXELS_SQL} {sql}")(run)


XYV = "page_id::BIGINT AS page_id, y::BIGINT AS y, x::BIGINT AS x"
SIZE_SQL = ", dims AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY page_id)"
pixel_query("img_brightness_contrast", "SELECT page_id::BIGINT AS page_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast FROM pixels GROUP BY page_id", pixels.brightness_contrast)
pixel_query("img_invert", f"SELECT {XYV}, 255 - v::BIGINT AS v FROM pixels", pixels.invert)
pixel_query("img_contrast", f"SELECT {XYV}, least(255, round_even(abs(v * 1.2::DOUBLE + 10), 0))::BIGINT AS v FROM pixels", pixels.contrast)
pixel_query("img_binarize", f"SELECT {XYV}, CASE WHEN v > 127 THEN 255 ELSE 0 END::BIGINT AS v FROM pixels", pixels.binarize)
pixel_query("img_center_crop", f"{SIZE_SQL} SELECT {XYV}, v::BIGINT AS v FROM pixels JOIN dims USING (page_id) WHERE y >= h // 4 AND y < 3 * h // 4 AND x >= w // 4 AND x < 3 * w // 4", pixels.center)
pixel_query(
    "img_border",
    f"{SIZE_SQL} SELECT d.page_id::BIGINT AS page_id, d.y::BIGINT AS y, d.x::BIGINT AS x, coalesce(v, 255)::BIGINT AS v FROM (SELECT page_id, y, unnest(range(w + 10)) AS x FROM (SELECT *, unnest(range(h + 10)) AS y FROM dims)) d LEFT JOIN pixels p ON p.page_id = d.page_id AND p.y + 5 = d.y AND p.x + 5 = d.x",
    lambda p: pixels.border(p, 5),
)
LAPLACIAN_SQL = """, laplacian AS (SELECT page_id, coalesce(lag(v) OVER r, lead(v) OVER r) + coalesce(lead(v) OVER r, lag(v) OVER r) + coalesce(lag(v) OVER c, lead(v) OVER c) + coalesce(lead(v) OVER c, lag(v) OVER c) - 4 * v AS l
  FROM pixels WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y))"""
pixel_query(
    "img_noise",
    LAPLACIAN_SQL
    + """ SELECT page_id::BIGINT AS page_id, round(least(var_pop(l) / 1000, 1.0), 6)::DOUBLE AS noise_level FROM laplacian GROUP BY page_id""",
    pixels.noise,
)
OTSU_SQL = """histogram AS (SELECT page_id, v, count(*)::DOUBLE AS n FROM cur GROUP BY page_id, v),
sums AS (SELECT page_id, v, sum(n) OVER p AS low, sum(n * v) OVER p AS low_sum, sum(n) OVER (PARTITION BY page_id) AS total, sum(n * v) OVER (PARTITION BY page_id) AS total_sum
  FROM histogram WINDOW p AS (PARTITION BY page_id ORDER BY v)),
otsu AS (SELECT page_id, v AS t FROM sums
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY round(CASE WHEN total > low THEN low * (total - low) * ((low_sum / low) - (total_sum - low_sum) / (total - low)) ** 2 ELSE 0 END, 3) DESC, v) = 1)"""
pixel_query(
    "img_otsu",
    f""", {OTSU_SQL.replace("FROM cur", "FROM pixels")} SELECT page_id::BIGINT AS page_id, t::BIGINT AS threshold FROM otsu""",
    pixels.otsu,
)
pixel_query("img_bounding_box", "SELECT page_id::BIGINT AS page_id, min(y)::BIGINT AS top, max(y)::BIGINT AS bottom, min(x)::BIGINT AS left, max(x)::BIGINT AS right FROM pixels WHERE v < 250 GROUP BY page_id".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'), pixels.bounding_box)


def as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel relation as one row of the kind that the image source gives."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    whole = fx.pixels(spark, sf_dir).groupBy("page_id").agg(ordered.alias("p"), (F.max("x") + 1).alias("w"))
    data = F.unhex(F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["v"].cast("long")), 2, "0")), ""))
    image = F.struct(F.lit("").alias("origin"), (F.size("p") / F.col("w")).cast("int").alias("height"), F.col("w").cast("int").alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return whole.select(F.col("page_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), image.alias("image"))


def resampled(axis: str, other: str, size: str, factor: float) -> str:
    """A relation's pixels along an axis, by Keys' kernel with -0.75 from the four nearest, the edges repeated."""
    weight = lambda k: f"abs(pos - (f + {k}))"
    near = lambda x: f"(((-0.75::DOUBLE + 2) * {x} - (-0.75::DOUBLE + 3)) * {x} * {x} + 1)"
    far = lambda x: f"(((-0.75::DOUBLE * {x} - 5 * -0.75::DOUBLE) * {x} + 8 * -0.75::DOUBLE) * {x} - 4 * -0.75::DOUBLE)"
    kernel = lambda k: f"CASE WHEN {weight(k)} <= 1 THEN {near(weight(k))} WHEN {weight(k)} < 2 THEN {far(weight(k))} ELSE 0.0::DOUBLE END"
    taps = ", ".join(f"{kernel(k)} AS w{k + 1}, greatest(0, least(n - 1, f + {k})) AS s{k + 1}" for k in range(-1, 3))
    joins = " ".join(f"JOIN cur p{k} ON p{k}.page_id = t.page_id AND p{k}.{axis} = t.s{k}" + (f" AND p{k}.{other} = p0.{other}" if k else "") for k in range(4))
    total = "0.0::DOUBLE" + "".join(f" + w{k} * p{k}.v" for k in range(4))
    return f"""SELECT t.page_id, t.i AS {axis}, p0.{other} AS {other}, {total} AS v FROM (
  SELECT page_id, i, {taps} FROM (SELECT *, floor(pos)::BIGINT AS f FROM (SELECT *, (i + 0.5::DOUBLE) * n / floor(n * {factor}::DOUBLE) - 0.5::DOUBLE AS pos FROM (
    SELECT page_id, {size} AS n, unnest(range(floor({size} * {factor}::DOUBLE)::BIGINT)) AS i FROM dims)))) t {joins}"""


def chain_sql(approach: str, upto: int | None = None) -> str | None:
    """A named chain (or its first steps) on the pixel relation, and the digest of the last image; None for chains that SQL
    does not express."""
    chain = PIPELINES[approach][:upto]
    parts, n, channels = [f"{fx.PIXELS_SQL}, c0 AS (SELECT page_id, y, x, v::DOUBLE AS v FROM pixels)"], 0, 3
    byte = "least(255, greatest(0, round_even(v, 0)))"

    def add(sql: str) -> None:
        nonlocal n
        parts.append(f"d{n} AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM c{n} GROUP BY page_id)")
        for name in ("cur", "dims"):
            sql = re.sub(rf"\b{name}\b", f"{'c' if name == 'cur' else 'd'}{n}", sql)
        n += 1
        parts.append(f"c{n} AS ({sql})")

    for step, *given in chain:
        if step == "denoise":
            return None
        channels = 1 if step in ("gray", "threshold", "binarize") else channels
        if step == "invert":
            add("SELECT page_id, y, x, 255 - v AS v FROM cur")
        elif step == "contrast":
            add(f"SELECT page_id, y, x, least(255, round_even(abs({given[0]}::DOUBLE * v + {given[1]}), 0)) AS v FROM cur")
        elif step == "scale":
            add(resampled("y", "x", "h", given[0]))
            add(resampled("x", "y", "w", given[0]))
            add(f"SELECT page_id, y, x, {byte} AS v FROM cur")
        elif step == "binarize":
            add(f"SELECT page_id, y, x, CASE WHEN v > {given[0]} THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM cur")
        elif step == "threshold":
            add(f"WITH {OTSU_SQL} SELECT page_id, y, x, CASE WHEN v > t THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM cur JOIN otsu USING (page_id)")
        elif step == "border":
            b = given[0]
            add(
                f"SELECT d.page_id, d.y, d.x, coalesce(v, 255.0)::DOUBLE AS v FROM (SELECT page_id, y, unnest(range(w + {2 * b})) AS x FROM (SELECT *, unnest(range(h + {2 * b})) AS y FROM dims)) d "
                f"LEFT JOIN cur p ON p.page_id = d.page_id AND p.y + {b} = d.y AND p.x + {b} = d.x"
            )
    return f"""WITH {", ".join(parts)} SELECT page_id::VARCHAR AS doc_id, 1 AS page_num, '{approach}' AS approach, {len(chain)} AS step, '{chain[-1][0]}' AS name,
  (max(y) + 1)::INT AS height, (max(x) + 1)::INT AS width, {channels} AS channels, md5(unhex(string_agg(repeat(lpad(hex(v::BIGINT), 2, '0'), {channels}), '' ORDER BY y, x))) AS md5 FROM c{n} GROUP BY page_id"""


for _approach in PIPELINES:

    @query(f"pipeline_{_approach}", chain_sql(_approach))
    def _pipeline(spark: SparkSession, sf_dir: str, approach: str = _approach) -> DataFrame:
        from ..operators.images import processed

        return processed(as_images(spark, sf_dir), approach).withColumn("md5", F.md5("data")).drop("data")


@query("pipeline_steps", " UNION ALL ".join(f"({chain_sql('mixed_period', k + 1)})" for k in range(len(PIPELINES["mixed_period"]))))
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image after each step of a chain."""
    from ..operators.images import processed

    return processed(as_images(spark, sf_dir), "mixed_period", steps=True).withColumn("md5", F.md5("data")).drop("data")


@query("img_analysis")
def img_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.images import analysis, metrics

    return analysis(metrics(as_images(spark, sf_dir)))


@query(
    "img_quality",
    f"""WITH {fx.PIXELS_SQL} {LAPLACIAN_SQL}, l AS (SELECT page_id, least(var_pop(l) / 1000, 1.0)::DOUBLE AS noise FROM laplacian GROUP BY page_id),
metrics AS (SELECT page_id, avg(v) AS brightness, stddev_pop(v) AS contrast, count(*) AS pixels, max(x) + 1 AS w, max(y) + 1 AS h, any_value(noise) AS noise, 'modern_german' AS doc_type
  FROM pixels JOIN l USING (page_id) GROUP BY page_id), {ADVICE_STEPS}
SELECT page_id::VARCHAR AS doc_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(noise, 6) AS noise_level, w::INT AS width, h::INT AS height,
  quality AS image_quality, inverted AS has_inverted_text, doc_type AS document_type, 0.5::DOUBLE AS confidence, array_to_string(advised, ',') AS recommended FROM advice""",
)
def img_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("brightness", "contrast", "noise_level")]
    out = img_analysis(spark, sf_dir)
    return out.select("doc_id", *rounded, "width", "height", "image_quality", "has_inverted_text", "document_type", "confidence", F.array_join("recommended", ",").alias("recommended"))


KNOWN_TEXT = "Verordnung über die Berufsausbildung zum Koch\nBundesministerium für Arbeit\nStand vom 1. März 1938\nHerausgegeben von Dr. Muster.\n" + "der die das und " * 10


@query(
    "process_batch",
    f"""WITH {fx.PIXELS_SQL}, p AS (SELECT DISTINCT page_id::VARCHAR AS doc_id FROM pixels)
SELECT doc_id, doc_id = '0' AS good, CASE WHEN doc_id <> '0' THEN 'No text could be extracted from document' END AS error, CASE WHEN doc_id = '0' THEN {len(KNOWN_TEXT)} END AS text_length,
  1 AS ocr_attempts_count, 'direct' AS successful_approach, CASE WHEN doc_id = '0' THEN 'official_document' ELSE 'modern_german' END AS analysis_document_type, CASE WHEN doc_id = '0' THEN DATE '1938-03-01' END AS date,
  CASE WHEN doc_id = '0' THEN 'Bundesministerium für Arbeit' END AS publisher, '1-end' AS pages_processed, CASE WHEN doc_id = '0' THEN 'success' ELSE 'failed' END AS status FROM p
UNION ALL SELECT 'none.png', false, 'File not found: none.png', NULL, 0, NULL, NULL, NULL, NULL, '1-end', 'failed'""",
)
def process_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one known text, blank ones, and a missing file."""
    from ..config import ProcessingConfig
    from ..operators import ocr, process

    pages = as_images(spark, sf_dir).withColumns({"error": F.lit(None).cast("string"), "is_pdf": F.lit(False)})
    wanted = pages.select(F.col("doc_id").alias("path"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("error"))
    wanted = wanted.unionByName(spark.createDataFrame([("none.png", 1, "File not found: none.png")], wanted.schema))
    backend = ocr.SidecarBackend(json.dumps({"0#1": KNOWN_TEXT}))
    out = process.records(wanted, process.read_pages(pages, backend, ProcessingConfig(), choice="direct"))
    return out.select(
        "doc_id", F.col("error").isNull().alias("good"), "error", "text_length", "ocr_attempts_count", "successful_approach", "analysis_document_type", "date", "publisher", "pages_processed", "status"
    )


@query(
    "display_names",
    f"WITH {fx.METRICS_SQL} SELECT page_id, array_to_string(list_transform(string_split(doc_type, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS shown FROM metrics",
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.metrics(spark, sf_dir).select("page_id", texts.display_name(F.col("doc_type")).alias("shown"))


TYPED = "CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'a' WHEN 3 THEN ' S ' WHEN 4 THEN '1' WHEN 5 THEN '5' WHEN 6 THEN '6' WHEN 7 THEN 'x' END"


@query(
    "choice_parsing",
    f"""{ADVICE_SQL}, picked AS (SELECT page_id, CASE page_id % 9 WHEN 2 THEN 'all_recommended' WHEN 3 THEN 'skip_analysis' WHEN 4 THEN advised[1] WHEN 5 THEN advised[1:5][5] END AS choice,
  page_id % 9 IN (0, 1, 2, 3, 4, 8) OR (page_id % 9 = 5 AND len(advised) >= 5) AS valid FROM advice)
SELECT page_id, choice, valid FROM picked""",
)
def choice_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed at the sight of the first five recommendations."""
    out, given = measured(spark, sf_dir)
    choice = recommend.parsed_choice(F.expr(TYPED), F.slice(recommend.recommended(*given), 1, 5))
    return out.select("page_id", choice["choice"].alias("choice"), choice["valid"].alias("valid"))


@query(
    "page_span",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '-end' WHEN 1 THEN doc_id || '-end' ELSE doc_id || '-' || doc_id % 4 * 10 END AS pages FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations)",
)
def page_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.doc_pages(spark, sf_dir).select("doc_id").distinct()
    last = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, 0).otherwise(F.col("doc_id") % 4 * 10)
    return ids.select("doc_id", texts.page_span(F.col("doc_id"), last).alias("pages"))


@query(
    "page_errors",
    f"""WITH {fx.PAGES_SQL} SELECT doc_id, string_agg(page_num || ':' || (page_num % 3 <> 0)::VARCHAR || ':' || CASE WHEN page_num % 3 = 0 THEN 'torn' ELSE '' END, ',' ORDER BY page_num) AS results
  FROM doc_pages GROUP BY doc_id""",
)
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's success and error in its document's record."""
    pages = fx.doc_pages(spark, sf_dir).withColumn("error", F.when(F.col("page_num") % 3 == 0, "torn"))
    shown = F.transform("page_results", lambda p: F.concat_ws(":", p["page_num"].cast("string"), p["success"].cast("string"), F.coalesce(p["error"], F.lit(""))))
    return assemble.documents(pages).select("doc_id", F.array_join(shown, ",").alias("results"))


@query(
    "ocr_confidence_by_quality",
    "SELECT doc_id, round(" + CONFIDENCE_SQL.replace("* CASE WHEN len(", "* (CASE doc_id % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 1.1 ELSE 1.0 END)::DOUBLE * CASE WHEN len(") + ", 6)::DOUBLE AS confidence FROM documents",
)
def ocr_confidence_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("doc_id") % 3 == 0, "poor").when(F.col("doc_id") % 3 == 1, "excellent").otherwise("fair")
    return fx.documents(spark, sf_dir).select("doc_id", F.round(scoring.ocr_confidence(F.col("text"), quality), 6).alias("confidence"))


@query(
    "metadata_json",
    f"""{RECORD_SQL} SELECT doc_id, 15::BIGINT AS n_keys, title, year(date)::VARCHAR AS year, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, publisher, author, document_type, CAST(NULL AS VARCHAR) AS profession,
  round({MEAN}, 6)::DOUBLE AS overall, text[1:1000] || CASE WHEN length(text) > 1000 THEN '...' ELSE '' END AS preview, round(score, 6)::DOUBLE AS date_score, round(title_score, 6)::DOUBLE AS title_score,
  'standard' AS successful_approach, 3::BIGINT AS attempts, 'official_document' AS kind, 'good' AS quality FROM record""",
)
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of the exported record, read back from its JSON."""
    told = {"ocr_attempts_count": F.lit(3), "successful_approach": F.lit("standard"), "analysis_document_type": F.lit("official_document"), "analysis_quality": F.lit("good")}
    found = extract.metadata(fx.corpus(spark, sf_dir)).withColumns(told | {"processing_metadata": F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"))})
    # One parse gives all keys; only counting them takes another.
    read = export.as_json(found).select("value", F.from_json("value", read_back(*export.KEYS)).alias("r"))
    number = lambda v: F.round(v, 6)
    return read.select(
        F.try_element_at("r.processing_metadata", F.lit("doc_id")).cast("long").alias("doc_id"),
        F.size(F.json_object_keys("value")).cast("long").alias("n_keys"),
        *[F.col(f"r.{k}").alias(k) for k in ("title", "year", "date", "publisher", "author", "document_type", "profession")],
        number(F.col("r.overall_confidence")).alias("overall"),
        F.col("r.raw_text_preview").alias("preview"),
        number(F.try_element_at("r.confidence_scores", F.lit("date"))).alias("date_score"),
        number(F.try_element_at("r.confidence_scores", F.lit("title"))).alias("title_score"),
        F.col("r.successful_approach").alias("successful_approach"),
        F.col("r.ocr_attempts_count").alias("attempts"),
        F.col("r.analysis_document_type").alias("kind"),
        F.col("r.analysis_quality").alias("quality"),
    )


@query(
    "ocr_attempts",
    f"""WITH {fx.PIXELS_SQL}, p AS (SELECT DISTINCT page_id FROM pixels)
SELECT page_id::VARCHAR AS doc_id, rk, approach, error IS NULL AS success, text_length, error FROM p, (VALUES
  (1, 'direct', 27, NULL), (2, 'nope', 0, 'Unknown approach: nope'), (3, 'light', 27, NULL)) a(rk, approach, text_length, error) WHERE page_id = 0
UNION ALL SELECT page_id::VARCHAR, rk, approach, error IS NULL, 0, error FROM p, (VALUES (1, 'direct', NULL), (2, 'nope', 'Unknown approach: nope'), (3, 'light', NULL)) a(rk, approach, error) WHERE page_id > 0""",
)
def ocr_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over approaches: an excluded one leaves no row, an unknown one fails, a short text gives way to another language's."""
    from ..config import ProcessingConfig
    from ..operators import ocr

    pages = as_images(spark, sf_dir).withColumns({"approaches": recommend.names(["direct", "newspaper", "nope", "light"]), "image_quality": F.lit("good")})
    backend = ocr.SidecarBackend(json.dumps({"0#1#deu": "kurz", "0#1#deu_frak": "ein längerer Text in Fraktur"[:27]}))
    out = ocr.attempts(pages, backend, ProcessingConfig().but(excluded_approaches=("newspaper",)))
    return out.select("doc_id", "rk", "approach", "success", "text_length", "error")


def drawn_pages(content: bytes, dpi: int):
    """A stand-in for a rasteriser: as many pages as the content's length says; every third one cannot be drawn."""
    import numpy

    if len(content) % 5 == 0:
        raise ValueError("no PDF")

    def page(number: int):
        if number % 3 == 0:
            raise ValueError("torn")
        return numpy.zeros((number, dpi // 100, 3), numpy.uint8)

    return len(content) % 5, page


@query(
    "pdf_pages",
    """WITH d AS (SELECT doc_id::VARCHAR AS doc_id, octet_length(encode(text)) % 5 AS n FROM documents)
SELECT doc_id, NULL::INT AS page_num, NULL::INT AS height, 'PDF processing failed: ' || CASE n WHEN 0 THEN 'no PDF' ELSE 'No pages could be converted from PDF' END AS error FROM d WHERE n < 2
UNION ALL SELECT doc_id, i::INT, CASE WHEN i % 3 <> 0 THEN i::INT END, CASE WHEN i % 3 = 0 THEN 'torn' END FROM (SELECT doc_id, unnest(range(2, least(n, 3) + 1)) AS i FROM d WHERE n >= 2)""",
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 to 3 of documents that stand for PDF files, with a stand-in for the rasteriser."""
    found = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.pdf_pages(found, 2, 3, 300, drawn_pages).select("doc_id", "page_num", F.col("image.height").alias("height"), "error")


# Settings by preset (mode, approaches tried, early exit, workers, interactive, intermediate images, language, threshold, timeout).
SETTINGS_SQL = """SELECT * FROM (VALUES
  ('interactive', 6, 0.8::DOUBLE, 4, true, true, 'deu', 0.7::DOUBLE, 300),
  ('production', 4, 0.75, 4, true, false, 'deu', 0.7, 300),
  ('archive', 3, 0.7, 8, false, false, 'deu', 0.7, 300),
  ('research', 8, 0.8, 4, true, false, 'deu', 0.7, 300),
  ('era 1920-1933', 8, 0.8, 4, true, true, 'deu_frak', 0.6, 300),
  ('era 1933-1945', 8, 0.8, 4, true, true, 'deu_frak', 0.6, 300),
  ('era 1945-1970', 6, 0.8, 4, true, true, 'deu', 0.65, 300),
  ('era 1970-1990', 4, 0.8, 4, true, true, 'deu', 0.75, 300),
  ('era 1990-2025', 4, 0.8, 4, true, true, 'deu', 0.75, 300),
  ('for research', 8, 0.8, 4, true, true, 'deu', 0.5, 300),
  ('for archive', 3, 0.7, 8, false, false, 'deu', 0.7, 120),
  ('example', 5, 0.8, 4, true, true, 'deu', 0.6, 300),
  ('clamped', 6, 0.8, 4, true, true, 'deu', 1.0, 300)) t(preset, approaches, early_exit, workers, interactive, intermediate, language, threshold, timeout)"""


@query("settings", SETTINGS_SQL)
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import config as c

    made = {m: c.ProcessingConfig(processing_mode=m) for m in ("interactive", "production", "archive")}
    made |= {"research": c.ProcessingConfig(processing_mode="research"), "for research": c.for_research(), "for archive": c.for_archive(), "example": c.example(), "clamped": c.ProcessingConfig(confidence_threshold=7)}
    made |= {f"era {e}": c.for_era(e) for e in c.ERAS}
    rows = [
        (n, x.max_approaches_to_try, x.early_exit_confidence, x.max_workers, x.enable_interactive_mode, x.save_intermediate_images, x.ocr_language, x.confidence_threshold, x.processing_timeout_seconds)
        for n, x in made.items()
    ]
    return spark.createDataFrame(rows, "preset string, approaches int, early_exit double, workers int, interactive boolean, intermediate boolean, language string, threshold double, timeout int")
