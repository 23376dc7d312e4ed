"""Decision contracts: one nested row per simulated decision."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decisions import EVIDENCE, recommendation, simulate_inventory, simulate_marketing, simulate_pricing

PRICING, INVENTORY, MARKETING = "Pricing", "Inventory", "Marketing"
SIMULATED, COMPLETED = "Simulated", "Completed"

# What a contract keeps of each proposal, as key -> column.
INPUTS = {
    PRICING: {"product": "product_name", "current_price": "current_price", "proposed_price": "proposed_price",
              "price_change": "price_change_pct"},
    INVENTORY: {"product": "product_name", "current_inventory": "current_inventory",
                "proposed_purchase": "proposed_purchase", "capital_required": "capital_required"},
    MARKETING: {"category": "category", "current_spend": "current_spend", "proposed_spend": "proposed_spend",
                "spend_change": "spend_change_pct"},
}
PERCENT_INPUTS = ("price_change", "spend_change")


def _map(pairs: list[tuple[str, Column]]) -> Column:
    """A map without the keys whose value is null."""
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def _numbers(decisions: DataFrame) -> list[str]:
    fields = decisions.schema["scenarios"].dataType.elementType.fields
    return [f.name for f in fields if isinstance(f.dataType, T.NumericType)]


def _input(kind: str) -> Column:
    def text(key: str, column: str) -> Column:
        value = F.col(column).cast("string")
        return F.concat(value, F.lit("%")) if key in PERCENT_INPUTS else value

    return _map([(k, text(k, c)) for k, c in INPUTS[kind].items()])


def expected_outcome(decisions: DataFrame) -> Column:
    """The numeric metrics of the expected scenario."""
    expected = F.get(F.filter("scenarios", lambda s: s["scenario"] == "Expected"), F.lit(0))
    return _map([(m, expected[m].cast("double")) for m in _numbers(decisions)])


def evidence(decisions: DataFrame) -> Column:
    """The figures of the past a decision rests on, picked by name."""
    return _map([(c, F.col(c).cast("double")) for c in EVIDENCE if c in decisions.columns])


def scenario_results(decisions: DataFrame) -> Column:
    """All scenario metrics as (scenario, metric, value); flags count as 0 and 1."""
    names = [f.name for f in decisions.schema["scenarios"].dataType.elementType.fields if f.name != "scenario"]

    def rows(s: Column) -> Column:
        return F.array(*[
            F.struct(s["scenario"].alias("scenario"), F.lit(n).alias("metric"), s[n].cast("double").alias("value"))
            for n in names
        ])

    return F.flatten(F.transform("scenarios", rows))


#: Equal proposals are dealt over so many groups before they are numbered.
SALTS = 1_024


def _with_id(decisions: DataFrame, kind: str, run: str) -> DataFrame:
    """Adds ``_id``: a digest of the run, the proposal and its number among equal ones.

    It is no random number, so a task that runs again after losing an executor writes the same ids. It has 128 bits:
    eight hex digits would repeat within some ten thousand decisions. Equal proposals are decisions of their own;
    they are numbered by digest and salt, so many of them are no single task.
    """
    content = F.to_json(F.struct(*[c for c in decisions.columns if c not in ("scenarios", "assumptions", "risks", "monitoring")]))
    dealt = decisions.withColumns({
        "_content": F.sha2(content, 256), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    place = F.row_number().over(Window.partitionBy("_content", "_salt").orderBy("_salt"))
    digest = F.sha2(F.concat_ws("|", F.lit(run), F.lit(kind), "_content", F.col("_salt").cast("string"), place.cast("string")), 256)
    return dealt.withColumn("_id", F.upper(F.substring(digest, 1, 32))).drop("_content", "_salt")


def _contract(decisions: DataFrame, kind: str, notes: str) -> list[Column]:
    return [
        F.col("_id").alias("decision_id"),
        F.current_timestamp().alias("date"),
        F.lit(kind).alias("decision_type"),
        _input(kind).alias("input"),
        expected_outcome(decisions).alias("expected_outcome"),
        evidence(decisions).alias("historical_evidence"),
        scenario_results(decisions).alias("scenario_results"),
        F.col("assumptions").alias("key_assumptions"),
        F.col("risks").alias("risk_indicators"),
        F.col("monitoring").alias("monitoring_triggers"),
        recommendation(decisions).alias("recommendation"),
        F.lit(notes).alias("user_notes"),
        F.lit(None).cast("struct<description:string,metric:string,value:double>").alias("actual_outcome"),
        F.lit(SIMULATED).alias("status"),
    ]


def decision_contracts(decisions: DataFrame, kind: str, notes: str = "", run: str | None = None) -> DataFrame:
    """Contracts for the proposals that could be simulated; :func:`decision_results` tells of the others, too."""
    ok = _with_id(decisions.where(F.col("error").isNull()), kind, run or uuid.uuid4().hex)
    return ok.select(*_contract(ok, kind, notes))


def decision_results(decisions: DataFrame, kind: str, notes: str = "", run: str | None = None) -> DataFrame:
    """(decision_type, status, error, contract, simulation_details): one row per proposal, those that failed included.

    ``status`` is success or error. A failed proposal has its error and no contract. ``simulation_details`` is all that
    the simulation gave, as JSON text, so results of all types go into one table.
    """
    every = _with_id(decisions, kind, run or uuid.uuid4().hex)
    ok = F.col("error").isNull()
    details = F.to_json(F.struct(*[F.col(f"`{c}`") for c in decisions.columns if c != "error"]))
    return every.select(
        F.lit(kind).alias("decision_type"), F.when(ok, "success").otherwise("error").alias("status"), "error",
        F.when(ok, F.struct(*_contract(every, kind, notes))).alias("contract"), details.alias("simulation_details"),
    )


def _simulated(sales: DataFrame, proposals: dict[str, DataFrame], forecast: DataFrame | None, make) -> DataFrame:
    unknown = sorted(set(proposals) - set(INPUTS))
    if unknown:
        raise ValueError(f"Unknown decision type: {', '.join(unknown)}")
    run = uuid.uuid4().hex
    out = None
    for kind, rows in proposals.items():
        if kind == PRICING:
            simulated = simulate_pricing(sales, rows, forecast)
        elif kind == INVENTORY:
            simulated = simulate_inventory(sales, rows, forecast)
        else:
            simulated = simulate_marketing(sales, rows)
        made = make(simulated, kind, run)
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("No proposals were given.")
    return out


def run_decisions(
    sales: DataFrame, proposals: dict[str, DataFrame], forecast: DataFrame | None = None, notes: str = ""
) -> DataFrame:
    """Contracts for proposals of several types; an unknown type fails."""
    return _simulated(sales, proposals, forecast, lambda df, kind, run: decision_contracts(df, kind, notes, run))


def run_results(
    sales: DataFrame, proposals: dict[str, DataFrame], forecast: DataFrame | None = None, notes: str = ""
) -> DataFrame:
    """As :func:`run_decisions`, with a row and the details of the simulation for every proposal, failed ones included."""
    return _simulated(sales, proposals, forecast, lambda df, kind, run: decision_results(df, kind, notes, run))


def decision_label() -> Column:
    """A short text per decision from its type and inputs."""
    got = lambda key, other: F.coalesce(F.col("input")[key], F.lit(other))
    kind = F.col("decision_type")
    return (
        F.when(kind == PRICING, F.concat(got("product", "Unknown"), F.lit(": Price "), got("price_change", "")))
        .when(kind == INVENTORY, F.concat(
            got("product", "Unknown"), F.lit(": Purchase "), got("proposed_purchase", "0"), F.lit(" units")))
        .when(kind == MARKETING, F.concat(got("category", "All"), F.lit(": Spend "), got("spend_change", "")))
        .otherwise(F.lit("—"))
    )


def outcome_report(decisions: DataFrame) -> DataFrame:
    """Expected against actual for decisions with a recorded metric that was expected.

    The expectation is looked up in the decision's own map: no join is needed.
    """
    metric, actual = F.col("actual_outcome")["metric"], F.col("actual_outcome")["value"]
    rows = decisions.select(
        "decision_id", metric.alias("metric"), F.try_element_at("expected_outcome", metric).alias("expected"),
        actual.alias("actual"),
    ).where(F.col("expected").isNotNull() & F.col("actual").isNotNull())
    gap = F.col("actual") - F.col("expected")
    return rows.withColumns({
        "difference": gap,
        "difference_pct": F.when(F.col("expected") != 0, gap / F.abs("expected") * 100.0),
    })


def to_json_columns(decisions: DataFrame) -> DataFrame:
    """Nested fields as JSON text, for exchange with other tools."""
    nested = [f.name for f in decisions.schema.fields
              if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return decisions.withColumns({c: F.to_json(c) for c in nested})


def from_json_columns(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """The reverse of :func:`to_json_columns` for a given contract schema."""
    nested = {f.name: f.dataType for f in schema.fields
              if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) and f.name in texts.columns}
    return texts.withColumns({c: F.from_json(c, t) for c, t in nested.items()})


