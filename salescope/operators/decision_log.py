"""A log of decisions as an append-only Parquet table with a latest-state view.

Saving, recording an outcome and deleting each append events; nothing is rewritten,
so writers do not block each other. The state of a decision is found with ``max_by``
aggregates, which combine on the map side: many events of one decision are no burden.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model_store import exists
from .contracts import COMPLETED, SIMULATED, decision_label

CONTRACT = {
    "decision_id": "string", "date": "timestamp", "decision_type": "string", "input": "map<string,string>",
    "expected_outcome": "map<string,double>", "historical_evidence": "map<string,double>",
    "scenario_results": "array<struct<scenario:string,metric:string,value:double>>",
    "key_assumptions": "array<string>", "risk_indicators": "array<string>", "monitoring_triggers": "array<string>",
    "recommendation": "struct<recommendation:string,confidence:string,explanation:string>",
    "user_notes": "string", "actual_outcome": "struct<description:string,metric:string,value:double>",
    "status": "string",
}
EVENT = {**CONTRACT, "op": "string", "version": "bigint", "seq": "bigint"}
EVENT_DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT.items())
SAVE, OUTCOME, DELETE = "save", "outcome", "delete"


class DecisionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # ---- writing ----

    def _append(self, events: DataFrame, op: str) -> None:
        """Events of one call share a version; ``seq`` keeps their order within it."""
        stamped = events.withColumns({
            "op": F.lit(op), "version": F.lit(time.time_ns()), "seq": F.monotonically_increasing_id()})
        columns = [
            (F.col(n) if n in stamped.columns else F.lit(None)).cast(kind).alias(n) for n, kind in EVENT.items()
        ]
        stamped.select(*columns).write.mode("append").partitionBy("op").parquet(self.path)

    def save(self, contracts: DataFrame) -> None:
        """Insert or replace by id; an empty id fails before anything is written."""
        blank = F.col("decision_id").isNull() | (F.trim("decision_id") == "")
        if not contracts.where(blank).isEmpty():
            raise ValueError("Every decision needs a decision_id before it can be saved.")
        self._append(contracts.withColumn("status", F.coalesce("status", F.lit(SIMULATED))), SAVE)

    def _known(self, ids: DataFrame) -> None:
        unknown = ids.select("decision_id").join(self.latest().select("decision_id"), "decision_id", "left_anti")
        first = unknown.first()
        if first is not None:
            raise ValueError(f"Decision {first['decision_id']} was not found.")

    def record_outcomes(self, outcomes: DataFrame) -> None:
        """Rows (decision_id, actual_outcome); the decisions become completed."""
        self._known(outcomes)
        self._append(outcomes.select("decision_id", "actual_outcome"), OUTCOME)

    def delete(self, ids: DataFrame) -> None:
        self._known(ids)
        self._append(ids.select("decision_id"), DELETE)

    def compact(self, path: str) -> "DecisionLog":
        """The current decisions as a new log at another path."""
        fresh = DecisionLog(self.spark, path)
        current = self.latest().withColumn("op", F.lit(SAVE))
        current.select(*EVENT).write.mode("errorifexists").partitionBy("op").parquet(path)
        return fresh

    # ---- reading ----

    def events(self) -> DataFrame:
        """All events; columns a log written earlier lacks read as null."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], EVENT_DDL)
        return self.spark.read.schema(EVENT_DDL).parquet(self.path)

    def latest(self) -> DataFrame:
        """One row per living decision: the last save, with the outcome recorded after it."""
        events = self.events()
        at = F.struct("version", "seq")
        contract = list(CONTRACT)
        kept = [c for c in contract if c != "decision_id"]

        def when(op: str, value):
            return F.when(F.col("op") == op, value)

        state = events.groupBy("decision_id").agg(
            F.max_by(when(SAVE, F.struct(*kept)), when(SAVE, at)).alias("c"),
            F.max(when(SAVE, at)).alias("saved"), F.max(when(DELETE, at)).alias("deleted"),
            F.max_by(when(OUTCOME, F.col("actual_outcome")), when(OUTCOME, at)).alias("o"),
            F.max(when(OUTCOME, at)).alias("told"),
        )
        alive = state.where(
            F.col("saved").isNotNull() & (F.col("deleted").isNull() | (F.col("saved") > F.col("deleted"))))
        later = F.coalesce(F.col("told") > F.col("saved"), F.lit(False))
        return alive.select("decision_id", "c.*", "saved", "o", later.alias("later")).withColumns({
            "actual_outcome": F.when(F.col("later"), F.col("o")).otherwise(F.col("actual_outcome")),
            "status": F.when(F.col("later"), F.lit(COMPLETED)).otherwise(F.col("status")),
        }).select(*contract, F.col("saved.version").alias("version"), F.col("saved.seq").alias("seq"))

    def all(self) -> DataFrame:
        """Newest first."""
        return self.latest().orderBy(F.desc("version"), F.desc("seq")).drop("version", "seq")

    def get(self, decision_id: str) -> DataFrame:
        """The decision with this id, or no row. The id filter reaches the files."""
        return self.latest().where(F.col("decision_id") == decision_id).drop("version", "seq")

    def count(self) -> int:
        return self.latest().count()

    def summary(self) -> DataFrame:
        """One short row per decision, newest first."""
        return self.all().select(
            F.col("decision_id").alias("id"), F.date_format("date", "yyyy-MM-dd").alias("day"),
            F.col("decision_type").alias("type"), decision_label().alias("label"),
            F.coalesce(F.col("recommendation.recommendation"), F.lit("—")).alias("recommendation"),
            F.coalesce("status", F.lit("—")).alias("status"),
        )

