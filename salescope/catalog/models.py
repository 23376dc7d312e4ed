"""Models on order lines and their evaluation."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import features as feats
from ..operators import models as ops
from ..operators.series import forecast_totals
from ..plans.registry import query
from ..plans.session import written


def _prepared(spark, sf):
    """Train and test rows with a feature vector, and the feature names.

    The order lines are written before their features are worked out, and the features before texts are coded: each of
    these steps reads its rows several times.
    """
    keep = ("date", "product_id", "order_id", "line_id")
    unseen = set(feats.NOT_FEATURES).difference(keep)
    sales = view(spark, sf, "sales")
    lines = feats.ml_features(written(sales.select(*[c for c in sales.columns if c not in unseen]), "sales", "zstd"))
    used = [c for c in lines.columns if c in (*keep, *feats.ENCODED, "quantity") or c in feats.feature_names(lines)]
    lines = written(lines.select(*used), "lines", "zstd")
    rows = feats.chronological_split(feats.select_features(lines, keep=keep, least=False))
    names = [c for c in rows.columns if c not in (
        "date", "product_id", "order_id", "line_id", "quantity", "is_test")]
    made = ops.assemble(rows, names, keep=("order_id", "line_id", "is_test"))
    return made.where("not is_test").drop("is_test"), made.where("is_test").drop("is_test"), names, rows


def _linear(spark, sf):
    train, _, names, _ = _prepared(spark, sf)
    return ops.train_linear(train, names).weights


def _forest(spark, sf):
    train, _, names, _ = _prepared(spark, sf)
    return ops.train_forest(train, names).weights


def _bagged(spark, sf):
    train, _, names, _ = _prepared(spark, sf)
    return ops.train_bagged(train, names).weights


def _boosted(spark, sf):
    train, _, names, _ = _prepared(spark, sf)
    return ops.train_boosted(train, names).weights


def _all(spark, sf):
    train, test, names, _ = _prepared(spark, sf)
    return ops.predictions(ops.train_all(train, names), test)


def _floored(spark, sf):
    train, test, names, _ = _prepared(spark, sf)
    return ops.predict_nonneg(ops.train_linear(train, names).model, test).drop("features")


def _row_forecast(spark, sf):
    train, _, names, rows = _prepared(spark, sf)
    days = ops.row_forecast(ops.train_linear(train, names), rows, names)
    return forecast_totals(days, "product_id")


query("linear_regression")(_linear)
query("random_forest")(_forest)
query("bagged_trees_alt")(_bagged)
query("boosted_trees")(_boosted)
query("train_all")(lambda spark, sf: ops.fit_band(ops.compare_models(_all(spark, sf))))
query("predict_nonneg")(_floored)
query("prediction_sample")(lambda spark, sf: ops.prediction_sample(_floored(spark, sf), ["order_id", "line_id"]))
query("top_features")(lambda spark, sf: ops.top_features(_forest(spark, sf)))
query("row_forecast")(_row_forecast)


def _guesses(spark, sf):
    """Two simple rules standing in for models."""
    rows = view(spark, sf, "sales").select(
        "order_id", "line_id", F.col("quantity").cast("double").alias("label"), "discount", "inventory_units")
    one = rows.select("order_id", "line_id", "label", F.lit("stock").alias("model"),
                      (F.col("inventory_units") / 64.0).alias("prediction"))
    two = rows.select("order_id", "line_id", "label", F.lit("discount").alias("model"),
                      (F.col("discount") * 2.5 + 12.0).alias("prediction"))
    return one.unionByName(two)


_GUESS = """select order_id, line_id, cast(quantity as double) as label, 'stock' as model, inventory_units/64e0 as prediction from sales
union all select order_id, line_id, cast(quantity as double), 'discount', discount*2.5e0+12e0 from sales"""


def _metrics(key):
    return f"""select {key} R4[avg(abs(e))] as mae, R4[sqrt(sum(e*e)/count(*))] as rmse,
R4[1e0-sum(e*e)/(var_pop(label)*count(*))] as r2, R4[avg(e)] as mean_error, R4[stddev_pop(e)] as std_error,
R4[min(e)] as max_overestimate, R4[max(e)] as max_underestimate
from (select *, label-prediction as e from ({_GUESS}) g) h {'group by model' if key else ''}"""


query("regression_metrics", _metrics("model,"))(lambda spark, sf: ops.regression_metrics(_guesses(spark, sf), "model"))
query("compare_models", f"select model, mae, rmse, r2, mean_error, std_error from ({_metrics('model,')}) m")(
    lambda spark, sf: ops.compare_models(_guesses(spark, sf)))
query("prediction_analysis", f"""
select order_id, line_id, model, label as actual, R2[prediction] as predicted, R2[label-prediction] as error,
       R2[abs(label-prediction)] as abs_error,
       case when label <> 0 then R2[abs(label-prediction)/abs(label)*100e0] else 0e0 end as pct_error from ({_GUESS}) g""")(
    lambda spark, sf: ops.prediction_analysis(_guesses(spark, sf), "order_id", "line_id", "model"))
query("fit_band", f"""
select model, r2, case when r2 >= 0.8 then 'strong' when r2 >= 0.5 then 'moderate' when r2 >= 0.2 then 'weak'
       else 'very limited' end as predictive_power,
       case when rmse < mae*1.5e0 then 'relatively rare' else 'somewhat common' end as large_errors, r2 < 0.5 as limited
from ({_metrics('model,')}) m""")(
    lambda spark, sf: ops.fit_band(ops.compare_models(_guesses(spark, sf))).select(
        "model", "r2", "predictive_power", "large_errors", "limited"))
