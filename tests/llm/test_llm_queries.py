import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from salescope.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_all_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages_keep_the_columns(spark, odd):
    labels = [(3, 1, 0), (4, 1, 0)]
    import tempfile

    folder = tempfile.mkdtemp(prefix="llm-")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        docs = spark.createDataFrame(made.collect(), made.schema)
        if name != "packing":
            assert docs.columns == odd.columns, name
    assert docs.count() > 0 and "sequence_id" in docs.columns


@pytest.mark.parametrize("labels", [[], [(12, 1, 1)]])
def test_no_labels_to_learn_from_drop_nothing(spark, odd, tmp_path, labels):
    """12 is in the held-out fold: crc32 of "12" is a multiple of 5."""
    import zlib

    assert zlib.crc32(b"12") % 5 == 0
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, odd, str(tmp_path))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_pipeline_on_the_smallest_tables(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF).collect()
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and len({r.doc_id for r in out}) > 100
