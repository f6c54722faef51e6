"""One query for each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_codec, exact_dedup, image_copies, lm_ppm, mixture, near_dedup, quality_mil, secret_scan, token_counts, url_rules
from .common import map_batches, read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024, keep=["doc_id"], with_table=True)


@query
def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], digests=True, with_ids=False)


# The rules of the query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, rule string")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules, keep=["page_id"])


ORACLES["op3_url_rules"] = f"""
WITH rules(verdict, rule) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, rule[strpos(rule, '/'):] AS p FROM rules),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest[length(h) + 1:], '^[^?#]*') AS path FROM hosts),
found AS (
  SELECT urls.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM parts
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit FROM urls)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM found
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(read(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixture.by_position(mixture.plan(read(spark, sf_dir, "documents"), keep=["doc_id"]))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op9_mixture"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS o FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN most / weight <= level THEN most
    ELSE max(CASE WHEN most / weight > level THEN level END) OVER () * weight END AS target FROM levels),
due AS (
  SELECT *, round(target)::BIGINT AS due, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM targets),
placed AS (
  SELECT docs.*, source_size, target, due, passes,
    sum(size) OVER (PARTITION BY docs.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs JOIN due ON docs.source IS NOT DISTINCT FROM due.source)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(size, due - passes * source_size - start)))::BIGINT AS taken FROM placed
"""


@query
def op2_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.score(read(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@query
def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_mil.classify(docs, labels, remainder("doc_id", 4) == 2, keep=["doc_id"])


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


#: Pixels of a picture's side, cells of its texture's side, and how much the vector's values and the texture weigh.
SIDE, CELLS, PLAIN, TEXTURE = 96, 24, 28, 36
#: What is done to a query's picture, by its number.
EDITS = ("crop", "noise", "brightness", "quarter turn", "larger", "smaller")


@lru_cache
def mixture_of(n: int) -> np.ndarray:
    return np.random.default_rng(17).normal(0, 1, (CELLS**2, n)) / 8


def drawn(values: list[float]) -> np.ndarray:
    """A vector as a grey picture: its values as a coarse pattern, and a fixed mixture of them as a fine one."""
    v = np.array(values, float)
    v = np.concatenate([v, np.zeros(-len(v) % 8)])
    v = 8 * v / max(1e-9, float(np.linalg.norm(v)))
    mixed = mixture_of(len(v)) @ v
    plain = image_copies.resized(v.reshape(8, -1), SIDE, SIDE) if len(v) else np.zeros((SIDE, SIDE))
    return np.clip(np.round(128 + PLAIN * plain + TEXTURE * image_copies.resized(mixed.reshape(CELLS, CELLS), SIDE, SIDE)), 0, 255).astype(np.uint8)


def edited(picture: np.ndarray, edit: str, seed: int) -> np.ndarray:
    if edit == "crop":
        return picture[10:84, 14:92]
    if edit == "quarter turn":
        return np.rot90(picture)
    if edit in ("larger", "smaller"):
        side = int(SIDE * (1.3 if edit == "larger" else 0.8))
        return image_copies.resized(picture.astype(float), side, side).round()
    changed = picture + np.random.default_rng(seed).normal(0, 4, picture.shape) if edit == "noise" else picture * 0.8 + 30
    return np.clip(changed, 0, 255).round()


def pictures(vectors: DataFrame) -> DataFrame:
    """vec_id, edit, picture: each vector drawn as a grey PGM file, and for the queries (vec_id divisible by 20) an edited
    copy beside it. edit is null for a picture itself.

    No table holds images, so these stand for a media column.
    """

    def make():
        def function(batch):
            out = []
            for i, edit, x in zip(batch.column("vec_id").to_pylist(), batch.column("edit").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                picture = drawn(x or [])
                out.append(image_copies.pgm(np.ascontiguousarray(picture if edit is None else edited(picture, edit, i))))
            return [out]

        return function

    number = (F.pmod(F.floor(F.col("vec_id") / 20), F.lit(len(EDITS))) + 1).cast("int")
    edits = F.when(F.col("vec_id") % 20 == 0, F.array(F.lit(None).cast("string"), F.element_at(F.array(*map(F.lit, EDITS)), number)))
    rows = vectors.select("vec_id", "embedding", F.explode(F.coalesce(edits, F.array(F.lit(None).cast("string")))).alias("edit"))
    return map_batches(rows, [("picture", T.BinaryType())], make, ["vec_id", "edit"])


@query
def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query its copies among all pictures: how many, the best one, and the agreeing matches with its own original."""
    images = pictures(read(spark, sf_dir, "embeddings")).withColumn("key", F.struct("vec_id", "edit"))
    rows, links = image_copies.find(images, F.col("edit").isNotNull(), "key", "picture", F.col("edit").isNull())
    found = image_copies.summary(rows.withColumn("class_id", F.col("class_id.vec_id")), links)
    asked = found.filter("is_query").select(F.col("id.vec_id").alias("vec_id"), F.col("id.edit").alias("edit"), "image", "n_corners", "n_copies", "best_copy", "best_agreeing")
    own = rows.filter("not is_query").select(F.col("id.vec_id").alias("vec_id"), F.col("image").alias("own"))
    links = links.select(F.col("query").alias("image"), F.col("image").alias("own"), F.col("agreeing").alias("own_agreeing"))
    return asked.join(own, "vec_id").join(links, ["image", "own"], "left").drop("image", "own")
