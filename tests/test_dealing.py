"""Pools are dealt by their number of rows, and votes and curves read them once."""

import re

import pytest

import __spark_entry__ as entry
from plurality.sources import adapters

SF = "/root/testdata/sf0.001"


def plan_of(frame, capsys):
    frame.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("make", [adapters.pool, adapters.events_pool])
def test_tasks_grow_with_rows(spark, make, monkeypatch, capsys):
    wide = plan_of(make(spark, SF), capsys)
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 10)
    n = adapters.read(spark, SF, "lineitem" if make is adapters.pool else "events").count()
    fine = plan_of(make(spark, SF), capsys)
    tasks = lambda text: [int(x) for x in re.findall(r"hashpartitioning\(question_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)]
    assert tasks(wide) == [spark.sparkContext.defaultParallelism]
    assert tasks(fine) == [-(-n // 10)] and fine.count("Exchange") == 1


@pytest.mark.parametrize("name", ["vote_informed_softmax", "vote_informed_linear", "vote_informed_plain", "vote_majority_fixed", "vote_weighted_fixed", "best_of_n_fixed"])
def test_votes_read_the_pool_once(spark, name, capsys):
    text = plan_of(entry.queries()[name](spark, SF), capsys)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["adaptive_count_curve", "adaptive_weighted_curve", "budget_match"])
def test_curves_read_the_pool_once(spark, name, capsys):
    assert plan_of(entry.queries()[name](spark, SF), capsys).count("FileScan") == 2  # the pool and the right answers


@pytest.mark.parametrize("name", ["evaluation_report", "reports_by_model", "paired_reports", "calibration_artifact", "test_report"])
def test_evaluations_are_dealt_by_rows(spark, name, monkeypatch, capsys):
    """No shuffle of samples has the session's number of tasks, which tables do not change."""
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    n = -(-adapters.read(spark, SF, "lineitem").count() // 100)
    frame = entry.queries()[name](spark, SF)
    found = [int(x) for x in re.findall(r"hashpartitioning\([^()]*question_id[^()]*, (\d+)\)", plan_of(frame, capsys))]
    assert found and set(found) == {n}
