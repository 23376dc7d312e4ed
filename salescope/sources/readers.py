"""Reading business tables and bringing them to the canonical columns."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import blank_to_null, number_text, parse_date
from ..schema import NUMERIC_COLUMNS, TEXT_COLUMNS
from .files import read_groups, union_by_name
from .headers import map_columns, normalize_headers

# Readable formats and the name shown for each.
SEPARATORS = {"csv": ",", "tsv": "\t"}
FORMATS = {"csv": "CSV", "tsv": "TSV", "json": "JSON", "jsonl": "JSON", "ndjson": "JSON", "parquet": "Parquet"}


@dataclass
class Loaded:
    """A table as read, with what was learnt about its headers."""

    df: DataFrame
    file_type: str
    mappings: list[dict] = field(default_factory=list)
    uncertain: list[dict] = field(default_factory=list)


def _delimited(spark: SparkSession, path, sep: str) -> list[DataFrame]:
    """A table for each header that the files have, all columns as text, so no second pass is spent on guessing types."""

    def read(files: list[str], base: str | None) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        df = (reader.option("basePath", base) if base else reader).csv(files)
        return df.select(*[blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])

    return read_groups(spark, path, read)


def read_csv(spark: SparkSession, path) -> DataFrame:
    """Files may have their columns in any order; columns of one name are one column."""
    return union_by_name(_delimited(spark, path, ","))


def read_tsv(spark: SparkSession, path) -> DataFrame:
    return union_by_name(_delimited(spark, path, "\t"))


def read_json(spark: SparkSession, path) -> DataFrame:
    """One JSON array per file. Such a file is not splittable: many files, or JSON
    lines, spread the work."""
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path) -> DataFrame:
    return spark.read.json(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def suffix_of(path) -> str:
    """The suffix all paths share; paths of several formats fail."""
    paths = [path] if isinstance(path, str) else list(path)
    found = sorted({os.path.splitext(str(p).rstrip("/"))[1].lstrip(".").lower() for p in paths})
    if len(found) > 1:
        raise ValueError(f"One call reads files of one format, not of several: {', '.join(found)}.")
    return found[0] if found else ""


def type_columns(df: DataFrame, probe: bool = True) -> DataFrame:
    """Ids as text, the date as a day, text columns of numbers as doubles.

    With ``probe`` one aggregate over the numeric text columns decides which of them
    hold numbers only; the others stay text, so validation can point at them.
    Without it they are all read as numbers and what is none becomes null.
    """
    texts = [c for c in TEXT_COLUMNS if c in df.columns]
    numbers = [c for c in NUMERIC_COLUMNS if c in df.columns and dict(df.dtypes)[c] == "string"]
    if probe and numbers:
        bad = [F.count_if(F.col(c).isNotNull() & number_text(F.col(c)).isNull()).alias(c) for c in numbers]
        found = df.agg(*bad).first()
        numbers = [c for c in numbers if found[c] == 0]
    changes = {c: F.col(c).cast("string") for c in texts}
    changes |= {c: number_text(F.col(c)) for c in numbers}
    if "date" in df.columns:
        changes["date"] = parse_date(df, "date")
    return df.withColumns(changes) if changes else df


def read_business_table(
    spark: SparkSession, path, file_type: str = "auto", probe: bool = True, columns: Sequence[str] = (),
) -> Loaded:
    """Read one format, map the headers, type the columns.

    ``path`` is a path, a glob, a folder or a list of paths of one format. Delimited files are read by their own headers.
    Headers of ``columns`` that no file has become columns of nulls.
    """
    kind = suffix_of(path) if file_type == "auto" else file_type.lower()
    readers = {"json": read_json, "jsonl": read_jsonl, "ndjson": read_jsonl, "parquet": read_parquet}
    if kind not in FORMATS:
        raise ValueError(f"Unsupported file type. Choose one of: {', '.join('.' + k for k in FORMATS)}.")
    try:
        raw = _delimited(spark, path, SEPARATORS[kind]) if kind in SEPARATORS else [readers[kind](spark, path)]
        there = {c.strip().lower() for t in raw for c in t.columns}
        absent = [c for c in columns if c.strip().lower() not in there]
        raw[0] = raw[0].withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else raw[0]
        named, mappings, uncertain = map_tables(raw)
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"This {FORMATS[kind]} file could not be read: {e}") from e
    return Loaded(type_columns(named, probe), FORMATS[kind], mappings, uncertain)


def map_tables(tables: list[DataFrame]) -> tuple[DataFrame, list[dict], list[dict]]:
    """Headers are mapped in each table by itself, then rows of all are put together by the names that came out."""
    mapped = [map_columns(normalize_headers(t)) for t in tables]

    def once(found: list[dict]) -> list[dict]:
        return [m for i, m in enumerate(found) if m not in found[:i]]

    return (
        union_by_name([df for df, _, _ in mapped]),
        once([m for _, found, _ in mapped for m in found]), once([u for _, _, found in mapped for u in found]),
    )


def is_return_export(name: str, columns: list[str]) -> bool:
    """A return report by its cancel date column or by its file name."""
    return "cancel_return_date" in columns or re.search("return|refund", os.path.basename(name), re.I) is not None


def load_report(loaded: Loaded) -> DataFrame:
    """Rows, columns, names and mappings of a loaded table as one row."""
    df = loaded.df
    return df.agg(F.count(F.lit(1)).alias("rows_loaded")).withColumns({
        "columns_loaded": F.lit(len(df.columns)).cast("bigint"),
        "column_names": F.lit(", ".join(df.columns)),
        "file_type": F.lit(loaded.file_type),
        "column_mappings": F.lit("; ".join(f"{m['source']} -> {m['field']} ({m['match']})" for m in loaded.mappings)),
        "uncertain_columns": F.lit(", ".join(u["source"] for u in loaded.uncertain)),
    })
