"""Steps that sort by picture: what a task holds does not grow with the table, and nothing is shuffled again."""

import re

import pytest

from tidemark.plans import catalogue
from tidemark.sources import folders

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reading_order", "merge_repeats", "classification_from_windows"])
def test_tasks_hold_few_rows(spark, monkeypatch, capsys, name):
    usual = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(folders, "SORTED", 100)
    found = catalogue.QUERIES[name](spark, SF)
    found.explain()
    plan = capsys.readouterr().out
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan
    parts = int(re.search(r"hashpartitioning\([^)]*?(\d+)\), REPARTITION_BY_NUM", plan)[1])
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert parts == -(-rows // 100) > 4
    assert sorted(map(str, found.collect())) == usual
