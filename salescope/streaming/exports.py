"""Picking up new export files exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_sales
from ..operators.quality import report, validate
from ..sources.readers import read_business_table

#: Folders that the digests of rows seen before are spread over.
SEEN_FOLDERS = 64


def incremental_load(
    spark: SparkSession, folder: str, columns: Sequence[str], out: str, issues_out: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1_000,
):
    """Load, validate and clean the CSV files that came since the last call.

    The stream carries names of files only, at most ``files_per_batch`` at a time; the files of a batch are read by their own
    headers. Columns of ``columns`` that no file of a batch has are null. The checkpoint remembers which
    files were read. Every batch writes below its own number and replaces what an interrupted try of the same batch
    left, so a batch counts once however often it runs. Only a valid batch is cleaned and written; its issues are
    written either way.

    A row that an earlier batch loaded is left out: digests of loaded rows are kept beside ``out``, by folders of equal
    digest, so the rows that come through do not depend on how they are spread over files and batches.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.csv*").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length")
    )
    seen = f"{out.rstrip('/')}_seen"

    def take(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.where("length > 0").select("path").collect()]
        if not paths:
            return
        named = read_business_table(spark, paths, "csv", columns=columns).df
        fresh = unseen(named, seen, number)
        issues = validate(prepare(fresh) if prepare else fresh)
        issues.write.mode("overwrite").parquet(f"{issues_out}/batch={number}")
        found = report(spark.read.parquet(f"{issues_out}/batch={number}")).first()
        if found["is_valid"]:
            clean_sales(prepare(fresh) if prepare else fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")
            remember(fresh, seen, number)

    return (
        files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def with_digest(df: DataFrame) -> DataFrame:
    """Adds the digest of a row's filled columns, by name, and the folder it belongs to."""
    parts = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in sorted(df.columns)]
    filled = F.filter(F.array(*parts), lambda x: x["v"].isNotNull())
    digest = F.sha2(F.to_json(filled), 256)
    return df.withColumns({"__digest": digest, "__folder": F.pmod(F.xxhash64(digest), F.lit(SEEN_FOLDERS)).cast("int")})


def unseen(df: DataFrame, seen: str, batch: int) -> DataFrame:
    """Rows whose digest no batch but this one has remembered."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return df
    before = spark.read.schema("__digest string, batch long, __folder int").parquet(seen).where(F.col("batch") != batch)
    return with_digest(df).join(before, ["__folder", "__digest"], "left_anti").select(*[f"`{c}`" for c in df.columns])


def remember(df: DataFrame, seen: str, batch: int) -> None:
    """Writes the digests of a batch below its number; a batch that runs again replaces them."""
    rows = with_digest(df).select("__digest", "__folder").distinct()
    rows.repartition("__folder").write.mode("overwrite").partitionBy("__folder").parquet(f"{seen}/batch={batch}")
