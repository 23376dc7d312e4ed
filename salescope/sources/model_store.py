"""Saving, loading and listing fitted models below a folder all executors share."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def save_model(spark: SparkSession, folder: str, name: str, model, metadata: dict | None = None) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(metadata or {})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_model(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The model and its metadata, or None if there is no such model."""
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/model"):
        return None
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    about = spark.read.text(f"{path}/about").first()["value"]
    return {"model": model, "metadata": json.loads(about)}


def list_models(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
