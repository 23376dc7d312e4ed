import datetime as dt

import pytest
from pyspark.sql import functions as F

from salescope.operators import contracts, decisions
from salescope.operators.cleaning import clean_sales
from salescope.operators.decision_log import DecisionLog
from salescope.operators.signals import signals


@pytest.fixture
def clean(sales):
    return clean_sales(sales)


@pytest.fixture
def prices(frame):
    return frame("product_id string, current_price double, proposed_price double",
                 [("P001", 100.0, 110.0), ("P002", 100.0, 100.0), ("NONE", 1.0, 2.0)])


def test_elasticity_recovers_a_known_slope(frame):
    rows, price, units = [], 100.0, 1000.0
    for i in range(20):
        rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), "A", price, units))
        step = 0.1 if i % 2 else -0.08
        price, units = price * (1 + step), units * (1 - 1.5 * step)
    df = frame("date date, product_id string, unit_price double, quantity double", rows)
    assert decisions.price_elasticity(df).first()["estimated_elasticity"] == -1.5


@pytest.mark.parametrize("rows", [
    [(dt.date(2024, 1, 1 + i), "A", 10.0 + i, 5.0) for i in range(9)],
    [(dt.date(2024, 1, 1 + i), "A", 10.0, 5.0 + i % 3) for i in range(20)],
    [(dt.date(2024, 1, 1 + i), "A", 10.0 + i % 3, 5.0) for i in range(20)],
    [(dt.date(2024, 1, 1), "A", 10.0 + i % 3, 5.0 + i % 2) for i in range(20)],
])
def test_elasticity_default(frame, rows):
    df = frame("date date, product_id string, unit_price double, quantity double", rows)
    assert decisions.price_elasticity(df).first()["estimated_elasticity"] == -1.2


def test_pricing(clean, prices):
    out = decisions.simulate_pricing(clean, prices)
    by_id = {r["product_id"]: r for r in out.collect()}
    assert len(by_id) == 3 and "NONE" in by_id["NONE"]["error"] and by_id["NONE"]["scenarios"] is None
    assert by_id["P001"]["price_change_pct"] == 10.0
    assert -3.0 <= by_id["P001"]["estimated_elasticity"] <= -0.3
    same = {s["scenario"]: s for s in by_id["P002"]["scenarios"]}
    assert set(same) == {"Conservative", "Expected", "Optimistic"}
    for s in same.values():
        assert s["revenue_change"] == s["profit_change"] == s["demand_change_pct"] == 0
    assert decisions.scenario_rows(out, "product_id").count() == 6


def test_forecast_replaces_history_unless_zero(clean, prices, frame):
    forecast = frame("product_id string, demand_30d double", [("P001", 500.0), ("P002", 0.0)])
    base = {r["product_id"]: r["base_demand_30d"] for r in decisions.simulate_pricing(clean, prices, forecast).collect()}
    plain = {r["product_id"]: r["base_demand_30d"] for r in decisions.simulate_pricing(clean, prices).collect()}
    assert base["P001"] == 500 and base["P002"] == plain["P002"] > 0


def test_inventory(clean, frame):
    p = frame("product_id string, current_inventory int, proposed_purchase int", [("P001", 10, 0), ("P002", 10, 100000)])
    out = decisions.simulate_inventory(clean, p)
    rows = {(r["product_id"], r["scenario"]): r for r in decisions.scenario_rows(out, "product_id").collect()}
    assert rows[("P001", "Expected")]["stockout_risk"] and not rows[("P002", "Optimistic")]["stockout_risk"]
    assert rows[("P001", "Expected")]["surplus_units"] == 0
    assert rows[("P002", "Conservative")]["stock_cover_days"] > rows[("P002", "Optimistic")]["stock_cover_days"]
    verdicts = {r["recommendation"] for r in decisions.with_recommendation(out).collect()}
    assert verdicts == {"Review required"}


def test_marketing(clean, frame):
    p = frame("category string, current_spend double, proposed_spend double",
              [("Office", 1000.0, 1200.0), (None, 0.0, 100.0), ("Unknown", 1.0, 2.0)])
    rows = {r["category"]: r for r in decisions.simulate_marketing(clean, p).collect()}
    assert rows["Office"]["spend_change_pct"] == 20.0
    assert rows["All Categories"]["spend_change_pct"] == 0 and rows["All Categories"]["error"] is None
    assert "marketing" in rows["Unknown"]["error"]
    roas = {s["scenario"]: s["effective_roas"] for s in rows["Office"]["scenarios"]}
    assert roas["Conservative"] <= roas["Expected"] <= roas["Optimistic"] == rows["Office"]["historical_roas"]


@pytest.mark.parametrize("expected,careful,verdict", [
    (10.0, 5.0, "Favorable"), (10.0, -5.0, "Proceed with Caution"), (-1.0, 5.0, "Reconsider"), (None, None, "Insufficient data")])
def test_recommendation(spark, expected, careful, verdict):
    kind = "array<struct<scenario:string,net_impact:double>>"
    rows = None if expected is None else [("Conservative", careful), ("Expected", expected)]
    df = spark.createDataFrame([(rows,)], f"scenarios {kind}")
    assert decisions.with_recommendation(df).first()["recommendation"] == verdict


def test_contract_round_trip(spark, clean, prices, frame, tmp_path):
    made = contracts.run_decisions(clean, {
        "Pricing": prices, "Inventory": frame("product_id string, current_inventory int, proposed_purchase int", [("P001", 10, 5)])})
    log = DecisionLog(spark, str(tmp_path / "log"))
    assert log.count() == 0
    log.save(made)
    rows = log.all().collect()
    assert log.count() == 3 and {r["status"] for r in rows} == {"Simulated"}
    first = next(r for r in rows if r["decision_type"] == "Pricing" and r["input"]["product"] == "Lamp")
    assert first["input"]["price_change"] == "10.0%" and "estimated_elasticity" in first["historical_evidence"]
    assert len(first["scenario_results"]) == 18 and first["recommendation"]["recommendation"]

    goal = first["expected_outcome"]["projected_revenue"]
    outcome = frame("decision_id string, actual_outcome struct<description:string,metric:string,value:double>",
                    [(first["decision_id"], ("", "projected_revenue", goal * 0.9))])
    log.record_outcomes(outcome)
    got = log.get(first["decision_id"]).first()
    assert got["status"] == "Completed" and log.count() == 3
    report = contracts.outcome_report(log.latest()).collect()
    assert len(report) == 1 and report[0]["difference_pct"] == pytest.approx(-10.0)
    labels = {r["label"] for r in log.summary().collect()}
    assert "Lamp: Price 10.0%" in labels and "Lamp: Purchase 5 units" in labels

    log.save(made.where(F.col("decision_id") == first["decision_id"]))
    assert log.get(first["decision_id"]).first()["actual_outcome"] is None

    ids = frame("decision_id string", [(first["decision_id"],)])
    smaller = log.compact(str(tmp_path / "log2"))
    log.delete(ids)
    assert log.count() == 2 and log.get(first["decision_id"]).count() == 0 and smaller.count() == 3
    for act in (lambda: log.delete(ids), lambda: log.record_outcomes(outcome)):
        with pytest.raises(ValueError, match="not found"):
            act()
    with pytest.raises(ValueError, match="decision_id"):
        log.save(made.withColumn("decision_id", F.lit("")))


def test_newest_decisions_first(spark, clean, prices, tmp_path):
    log = DecisionLog(spark, str(tmp_path / "log"))
    one = contracts.run_decisions(clean, {"Pricing": prices.where("product_id = 'P001'")})
    two = contracts.run_decisions(clean, {"Pricing": prices.where("product_id = 'P002'")})
    log.save(one)
    log.save(two)
    assert [r["input"]["product"] for r in log.all().collect()] == ["Desk", "Lamp"]


def test_ids_survive_recomputation(clean, prices):
    sim = decisions.simulate_pricing(clean, prices)
    ids = lambda: sorted(r[0] for r in contracts.decision_contracts(sim, "Pricing", run="x").select("decision_id").collect())
    assert ids() == ids() and len(set(ids())) == 2


def test_unknown_type_and_json(spark, clean, prices):
    with pytest.raises(ValueError, match="Unknown decision type"):
        contracts.run_decisions(clean, {"Hiring": prices})
    made = contracts.run_decisions(clean, {"Pricing": prices}).drop("date")
    back = contracts.from_json_columns(contracts.to_json_columns(made), made.schema)
    a = {r["decision_id"]: r["expected_outcome"] for r in made.collect()}
    assert a.keys() == {r["decision_id"] for r in back.collect()}
    assert {k: set(v) for k, v in a.items()} == {r["decision_id"]: set(r["expected_outcome"]) for r in back.collect()}


def test_outcomes_without_a_match_give_no_row(frame):
    df = frame("decision_id string, expected_outcome map<string,double>, actual_outcome struct<description:string,metric:string,value:double>", [
        ("a", {"m": 0.0}, ("", "m", 5.0)), ("b", {"m": 1.0}, ("", "x", 5.0)), ("c", {"m": 1.0}, None), ("d", {"m": 1.0}, ("only text", None, None))])
    rows = contracts.outcome_report(df).collect()
    assert [(r["decision_id"], r["difference"], r["difference_pct"]) for r in rows] == [("a", 5.0, None)]


def test_signals_need_enough_rows(clean):
    got = signals(clean).collect()
    assert {"returns"} <= {r["type"] for r in got}
    assert signals(clean.limit(99)).count() == 0
    assert signals(clean.where("month(date) = 1 and line_id < 50")).count() == 0


def test_margin_and_revenue_signals(frame):
    rows = [(dt.date(2024, m, d), 100.0 * (2 if m > 3 else 1), 0.4 if m <= 3 else 0.2) for m in range(1, 7) for d in range(1, 21)]
    got = {r["type"]: r for r in signals(frame("date date, revenue double, profit_margin double", rows)).collect()}
    assert got["margin"]["change_pct"] == 50.0 and got["revenue"]["change_pct"] == 100.0
    assert got["revenue"]["severity"] == "info" and "50.0%" in got["margin"]["what"]


def test_failed_proposals_are_told_of(sales):
    from salescope.operators import cleaning, contracts

    spark, sales = sales.sparkSession, cleaning.derive(sales)
    rows = [("P001", 100.0, 110.0)] * 3 + [("NONE", 100.0, 90.0)]
    offers = spark.createDataFrame(rows, "product_id string, current_price double, proposed_price double")
    got = contracts.run_results(sales, {contracts.PRICING: offers}).collect()
    assert sorted(r["status"] for r in got) == ["error"] + ["success"] * 3
    failed = next(r for r in got if r["status"] == "error")
    assert failed["contract"] is None and failed["error"] == "No data found for product NONE"
    assert '"product_id":"NONE"' in failed["simulation_details"]
    made = [r for r in got if r["status"] == "success"]
    assert len({r["contract"]["decision_id"] for r in made}) == 3
    assert all(r["contract"]["decision_type"] == "Pricing" and "scenarios" in r["simulation_details"] for r in made)
    assert contracts.run_decisions(sales, {contracts.PRICING: offers}).count() == 3
    with pytest.raises(ValueError, match="Unknown"):
        contracts.run_results(sales, {"Other": offers})
