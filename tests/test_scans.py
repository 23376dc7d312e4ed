"""Tables are joined up once, however often their rows are read afterwards."""

import datetime

import pytest

import __spark_entry__ as entry
from salescope.catalog import models
from salescope.fixtures import view
from salescope.operators import cleaning

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["recommendation", "scenario_metric", "run_decisions", "decision_results"])
def test_decisions_read_lines_that_are_written_once(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "l_orderkey" not in plan and "product_id" in plan


def test_cleaning_reads_the_table_once(spark):
    typed = cleaning.typed_sales(view(spark, SF, "raw_sales"))
    assert "l_orderkey" not in _plan(typed)
    assert typed.columns == view(spark, SF, "raw_sales").columns


def test_the_cleaning_report_reads_the_table_once(spark):
    raw = view(spark, SF, "raw_sales")
    assert "l_orderkey" in _plan(raw) and "l_orderkey" not in _plan(cleaning.cleaning_counts(raw))


def test_only_rows_that_may_have_copies_are_grouped_whole(spark, frame, monkeypatch):
    seen, grouped = [], cleaning.dedupe_rows
    monkeypatch.setattr(cleaning, "dedupe_rows", lambda df, copies=None: seen.append(df.count()) or grouped(df, copies))
    once = [(f"2024-01-{1 + i % 28:02d}", i, i / 8) for i in range(500)]
    odd = [(None, None, None), ("2024-01-01", 1000, 0.0), ("2024-01-01", 1000, -0.0), ("2024-01-01", 1000, float("nan"))]
    rows = frame("date string, quantity int, unit_price double", [*once, *once[:9], *once[:2], *odd, *odd])
    found = {tuple(map(repr, r)) for r in cleaning.distinct_with_copies(rows).collect()}
    assert seen[0] < 30
    assert found == {tuple(map(repr, r)) for r in grouped(rows, cleaning.COPIES).collect()} and len(found) == 503
    monkeypatch.setattr(cleaning, "DIGEST_BITS", 8)
    assert {tuple(map(repr, r)) for r in cleaning.distinct_with_copies(rows).collect()} == found
    assert cleaning.typed_sales(rows).count() == 502


def test_copies_vote_on_the_order_of_day_and_month(frame):
    rows = [("13/1/2024", 1), ("14/1/2024", 2), *[("2/15/2024", 3)] * 3, ("3/4/2024", 4)]
    out = cleaning.typed_sales(frame("date string, quantity int", rows)).collect()
    assert {r.quantity: r.date for r in out} == {3.0: datetime.date(2024, 2, 15), 4.0: datetime.date(2024, 3, 4)}


def test_texts_are_coded_on_written_features(spark, monkeypatch):
    seen, coded = [], models.feats.encode_categories
    monkeypatch.setattr(models.feats, "encode_categories", lambda df: seen.append(_plan(df)) or coded(df))
    _, _, names, rows = models._prepared(spark, SF)
    assert len(seen) == 1 and "Window" not in seen[0] and "l_orderkey" not in seen[0]
    assert "category_encoded" in names and "revenue" not in rows.columns
