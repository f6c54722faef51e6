import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from urkunde.functions import dates, patterns
from urkunde.functions import text as texts
from urkunde.operators import extract

CASES = [
    ("Das Dokument wurde am 22. September 1938 veröffentlicht.", datetime.date(1938, 9, 22), 0.8),
    ("Berufs-Eignungsanforderungen (Stand vom 1. März 1938)", datetime.date(1938, 3, 1), 1.0),
    ("12. März 1954", datetime.date(1954, 3, 12), 0.8),
    ("vom 10. Mai 1962", datetime.date(1962, 5, 10), 1.0),
    ("15.07.1938", datetime.date(1938, 7, 15), 0.7),
    ("Stand vom 3. Januar 1945", datetime.date(1945, 1, 3), 1.0),
    ("am 31. Februar 1938", None, None),
    ("am 1.1.0000", None, None),
    ("am 1. Foobar 1938", None, None),
    ("Stand vom l. März 1938", None, None),
    ("", None, None),
    (None, None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", dates.best_date(F.col("t")).alias("d")).collect()}
    for i, (_, date, score) in enumerate(CASES):
        assert (got[i].date, got[i].score) == (date, pytest.approx(score) if score else None), CASES[i]


def test_reference_cases(spark):
    inputs = [
        "bearbeitet vom\nDeutschen Ausschuß für Technisches Schulwesen (Datsch) E.V.\nBerlin NW7",
        "Berufs-Eignungsanforderungen für den Eintritt in den Lehrberuf",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, text string")
    plain = extract.metadata(df).orderBy("i").collect()
    wide = extract.metadata(df, pack=patterns.EXTENDED_PACK).orderBy("i").collect()
    assert plain[0].publisher is None and plain[1].document_type is None
    assert "Deutschen Ausschuß" in wide[0].publisher and wide[1].document_type is not None
    repaired = df.limit(1).select(texts.repair_digits(F.lit("Stand vom l. März 1938")).alias("t")).first().t
    assert repaired == "Stand vom 1. März 1938"


def test_positions_against_re(spark):
    """Values and places of all rules on random texts, against Python's re."""
    rng = random.Random(5)
    words = [
        "Verordnung", "über", "die", "Berufsausbildung", "zum", "Bundesministerium", "für", "Arbeit", "vom", "Stand", "1.", "12.", "März", "1938", "3.4.1950", "\n", ".", "(", ")",
        "Ausbildungsverordnung", "–", "Herausgegeben", "von", "Autor:", "Satzung", "ANORDNUNG", "Prüfungsordnung", "  ", "Reichsministerium", "Deutscher", "Ausschuss", "ß", "Müller",
    ]
    data = [(i, "".join(rng.choice(words) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id int, text string")
    hits = 0
    for field in ("date", "publisher", "document_type", "title", "author"):
        got = {}
        for r in extract.match_table(df, field).collect():
            got.setdefault(r.doc_id, []).append((r.match_rk, r.pattern_name, r.value, r.start_pos, r.end_pos, r.context))
        for i, t in data:
            want = [
                (s.name, m[0], m.start(), m.end(), t[max(0, m.start() - 50) : m.end() + 50])
                for _, s in patterns.ranked(field)
                for m in re.finditer(s.regex, t, re.IGNORECASE | re.MULTILINE)
            ]
            hits += len(want)
            assert [x[1:] for x in sorted(got.get(i, []))] == want
    assert hits > 100


def test_metadata_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 2000)], "doc_id int, text string")
    got = {r.doc_id: r for r in extract.metadata(df).collect()}
    assert got[1].overall_confidence == got[2].overall_confidence == 0.0
    assert got[3].raw_text_preview == "x" * 1000 + "..."
    assert extract.metadata(df.limit(0)).count() == 0


def test_consolidate(spark):
    pages = spark.createDataFrame([(1, 1, "Verordnung\nStand vom 1. März 1938"), (1, 2, "Satzung vom 2. Mai 1940"), (2, 1, "nichts")], "doc_id int, page_num int, text string")
    got = {r.doc_id: r for r in extract.consolidate(extract.metadata(pages)).collect()}
    assert got[1].document_type.strip() == "Verordnung" and got[1].date == datetime.date(1938, 3, 1)
    assert got[2].document_type is None


def test_needed_words():
    want = {
        "standard_date": None, "vom_date": "vom", "numeric_date": None, "stand_vom_date": "stand", "bundesministerium": "bundesministerium", "reichsministerium": "reichsministerium",
        "deutscher_ausschuss": "deutscher", "doc_type_verordnung": "verordnung", "doc_type_anordnung": "anordnung", "doc_type_pruefungsordnung": None, "doc_type_satzung": "satzung",
        "title_verordnung_long": "berufsausbildung", "title_named_parenthesis": "ausbildungsverordnung", "author_herausgeber": "herausgegeben", "author_named": "autor",
        "author_ministry_named": "bundesministerium",
    }
    assert {s.name: patterns.needed(s.regex) for s in patterns.DEFAULT_PACK} == want
    assert patterns.needed(r"colou?r") == "colo" and patterns.needed(r"(?<!not )word") is None and patterns.needed(r"one|other") is None
    assert patterns.needed(r"\p{Alpha}+ ab") is None and patterns.needed(r"(word|other) last") == "last" and patterns.needed(r"x(?:inner)*outer") == "outer"


def test_odd_letters_are_matched(spark):
    """Letters that fold to i, k and s in Java's case-insensitive matching."""
    odd = ["BUNDESMİNİSTERİUM für Arbeit", "bundeſminiſterium FÜR Arbeit", "Bundesmınısterıum für Arbeit", "SATZUNG", "ſatzung der Kammer"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    for field in ("publisher", "document_type"):
        for r in df.select("i", "text", patterns.best(F.col("text"), field).alias("b"), F.size(patterns.matches(F.col("text"), field)).alias("n")).collect():
            rules = [spec for _, spec in patterns.ranked(field)]
            plain = df.filter(F.col("i") == r.i).select(*[F.regexp_extract("text", patterns.dialect(s.regex), 0) for s in rules]).first()
            first = next(((v, s.confidence) for v, s in zip(plain, rules, strict=True) if v), None)
            assert (None if r.b is None else tuple(r.b)) == first and (r.n > 0) == (first is not None)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_folded_once_and_json_is_read_once(spark):
    from urkunde.plans.queries import QUERIES

    found = plan(QUERIES["metadata_json"](spark, "/root/testdata/sf0.001"))
    assert "get_json_object" not in found and found.count("from_json(") == 1
    docs = spark.createDataFrame([(1, "Satzung")], "doc_id int, text string")
    own = plan(extract.metadata(docs).select("title", "publisher", "document_type", "author"))
    assert own.count("translate(") == 1


def test_record_agrees_with_best(spark):
    """The record's fields are the best match of each, also where the first rule of a field fails and the text has odd letters or is null."""
    texts_ = [None, "", "Deutscher Ausschuss für Technisches Schulwesen", "Autor: A\nBundesministerium für Arbeit", "Herausgegeben von B.\nAutor: C", "Bundesmınısterıum für Arbeit\n", "Satzung\nAnordnung", "\nVerordnung x"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    got = {r.doc_id: r for r in extract.metadata(df).collect()}
    for field in patterns.FIELDS:
        for r in df.select("doc_id", patterns.best(F.col("text"), field).alias("b")).collect():
            assert got[r.doc_id][field] == (r.b and r.b.value) and got[r.doc_id].confidence_scores.get(field) == (r.b and r.b.score), (field, texts_[r.doc_id])


def test_dates_without_a_bonus_need_no_places(spark):
    """Only texts with the word of a bonus are cut up for the places of their matches; the dates are those of all matches."""
    df = spark.createDataFrame([(1, "30.2.1900 29.02.2000"), (2, "31. Februar 1938 und 3.4.1950"), (3, "3.4.1950, 1. Mai 1940"), (4, "3.4.1950 VOM\n1. Mai 1940, 0.1.1950")], "doc_id int, text string")
    got = {r.doc_id: (str(r.date), r.confidence_scores.get("date")) for r in extract.metadata(df).collect()}
    assert got == {1: ("2000-02-29", 0.7), 2: ("1950-04-03", 0.7), 3: ("1940-05-01", 0.8), 4: ("1940-05-01", 1.0)}
    assert "try_make_timestamp" not in plan(extract.metadata(df)) and "arrays_zip" not in plan(extract.metadata(df))


def test_scores_are_gathered_once(spark):
    df = spark.createDataFrame([(1, "Satzung am 3.4.1950"), (2, "nichts")], "doc_id int, text string")
    assert plan(extract.metadata(df)).count("map_from_entries(") == 1
    got = {r.doc_id: r for r in extract.metadata(df).collect()}
    assert got[1].overall_confidence == (0.0 + 0.9 + 0.7) / 2 and got[2].overall_confidence == 0.0 and got[2].confidence_scores == {}
