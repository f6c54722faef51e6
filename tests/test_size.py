"""What larger tables need: tasks of bounded size, and each record worked out once."""

import pytest
from pyspark.sql import functions as F

from urkunde.operators import validate
from urkunde.plans import fixtures as fx
from urkunde.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    whole = fx.corpus(spark, SF).count()
    monkeypatch.setattr(fx, "HEADERS", 100, raising=False)
    out = fx.corpus(spark, SF)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == whole == 1500 and max(sizes) <= 150


def test_json_fields_are_read_once(spark):
    found = plan(QUERIES["metadata_json_fields"](spark, SF))
    assert "get_json_object" not in found and found.count("from_json(") == 1


def test_findings_are_worked_out_once(spark):
    found = plan(QUERIES["validate_rules"](spark, SF))
    assert found.count("score_range") == 1


def test_summary_joins_nothing(spark):
    found = plan(QUERIES["validate_summary"](spark, SF))
    assert "Join" not in found and "Aggregate" not in found and found.count("orders.parquet") <= 1 and found.count("Relation") == 1


@pytest.mark.parametrize("scores, errors, warnings", [(None, 0, 0), ({}, 0, 0), ({"title": 1.2, "date": 0.1}, 1, 1), ({"title": None}, 0, 0)])
def test_summary_counts_its_own_findings(spark, scores, errors, warnings):
    records = spark.createDataFrame([(1, None, None, None, None, scores)], "doc_id int, title string, publisher string, date date, year int, confidence_scores map<string,double>")
    assert [tuple(r) for r in validate.summary(records).collect()] == [(1, errors == 0, errors, warnings)]
    assert validate.findings(records).count() == errors + warnings
