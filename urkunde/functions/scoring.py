"""Scores of texts and images."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, stripped_length

# Words, terms and signs that are looked for, and the order of document types.
SCORED_WORDS = ("der", "die", "das", "und", "ein", "eine", "zu", "von", "mit", "staatslich", "anerkannt", "bundesminister", "vom", "für")
TYPE_WORDS = (
    "der", "die", "das", "und", "ein", "eine", "zu", "den", "von", "mit", "ist", "auf", "für", "als", "sich", "sie", "nicht", "werden",
    "haben", "staatslich", "anerkannt", "bundesminister", "reichsminister", "vom",
)
FRAKTUR_SIGNS = ("ſ", "ß", "ff", "fi", "fl")
OFFICIAL_TERMS = ("bundesminister", "reichsminister", "ministerium", "verordnung")
DATE_SIGNS = (r"\d{1,2}\.\s*[A-Za-z]+\s*\d{4}", r"Stand\s+vom", r"vom\s+\d{1,2}\.\s*\d{1,2}\.\s*\d{4}")
DOCUMENT_TYPES = ("fraktur", "modern_german", "official_document", "mixed_period", "handwritten", "italic_heavy", "newspaper", "unknown")


def present(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text."""
    return reduce(add, [F.contains(text, F.lit(w)).cast("int") for w in words])


# What a text's score is made of (measure, the most that counts, weight), and the factors on it.
PARTS = (("length", 500.0, 0.25), ("words", 8.0, 0.35), ("structure", 20.0, 0.15), ("dates", 3.0, 0.15))
STRUCTURE = r"[\n().,:;]"
BY_QUALITY = {"poor": 0.8, "excellent": 1.1}
MOST_ODD, ODD_FACTOR = 0.3, 0.7
#: Neither a letter, digit, underscore, white space nor common punctuation.
ODD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.,:;()\-]"


def ocr_confidence(text: Column, quality: Column | None = None) -> Column:
    """0 to 1: the sum of PARTS, times a factor by image quality and one for many odd signs."""
    measures = {
        "length": F.length(strip(text)),
        "words": present(F.lower(text), SCORED_WORDS),
        "structure": F.regexp_count(text, F.lit(STRUCTURE)),
        "dates": reduce(add, [F.rlike(text, F.lit("(?U)" + p)).cast("int") for p in DATE_SIGNS]),
    }
    score = reduce(add, [F.least(measures[name] / F.lit(most), F.lit(1.0)) * weight for name, most, weight in PARTS], F.lit(0.0))
    if quality is not None:
        factors = F.create_map(*[F.lit(x) for pair in BY_QUALITY.items() for x in pair])
        score = score * F.coalesce(F.try_element_at(factors, quality), F.lit(1.0))
    odd = F.regexp_count(text, F.lit(ODD)) / F.greatest(F.length(text), F.lit(1))
    score = score * F.when(odd > MOST_ODD, ODD_FACTOR).otherwise(1.0)
    return F.when(stripped_length(text) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def document_type(sample: Column) -> Column:
    """struct(type, confidence) of a text sample; of equal scores the first type wins."""
    low = F.lower(sample)
    fraktur, german = present(sample, FRAKTUR_SIGNS), present(low, TYPE_WORDS)
    scores = {
        "fraktur": fraktur * 0.3,
        "official_document": present(low, OFFICIAL_TERMS) * 0.4,
        "modern_german": F.when(german > 3, 0.4).otherwise(0.0),
        "mixed_period": F.when((fraktur > 0) & (german > 2), 0.3).otherwise(0.0),
    }
    rated = [F.struct(scores.get(t, F.lit(0.0)).cast("double").alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, t in enumerate(DOCUMENT_TYPES)]
    top = F.array_max(F.array(*rated))
    sure = (F.length(F.coalesce(sample, F.lit(""))) > 0) & (top["score"] >= 0.3)
    return F.struct(
        F.when(sure, top["type"]).otherwise("modern_german").alias("type"),
        F.when(sure, F.least(top["score"], F.lit(1.0))).otherwise(0.5).alias("confidence"),
    )


def image_quality(contrast: Column, pixels: Column) -> Column:
    points = F.when(contrast > 60, 3).when(contrast > 40, 2).when(contrast > 20, 1).otherwise(0) + F.when(pixels > 1000000, 2).when(pixels > 500000, 1).otherwise(0)
    return F.when(points >= 4, "excellent").when(points >= 3, "good").when(points >= 2, "fair").otherwise("poor")


def is_inverted(brightness: Column) -> Column:
    return brightness < 127
