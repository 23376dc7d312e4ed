import datetime as dt

from pyspark.sql import functions as F

from salescope.streaming import demand, exports

HEAD = "Order Date,Order No,Qty,Selling Price\n"


def load(spark, base):
    q = exports.incremental_load(
        spark, f"{base}/in", ["Order Date", "Order No", "Qty", "Selling Price"], f"{base}/clean", f"{base}/issues",
        f"{base}/state")
    q.awaitTermination()


def test_files_are_picked_up_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = "".join(f"2024-01-{d:02d},A{d},2,{d}.5\n" for d in range(1, 11))
    (tmp_path / "in" / "one.csv").write_text(HEAD + lines)
    load(spark, tmp_path)
    load(spark, tmp_path)
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert clean.count() == 10 and {"revenue", "net_price"} <= set(clean.columns)

    (tmp_path / "in" / "two.csv").write_text(HEAD + "2024-02-01,B1,many,3\n")
    (tmp_path / "in" / "three.csv").write_text(HEAD + "")
    load(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 10
    rules = {r["rule"] for r in spark.read.parquet(f"{tmp_path}/issues").where("severity = 'error'").collect()}
    assert "non_numeric" in rules


def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 40, start + dt.timedelta(hours=5 * i), float(i % 3), "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "event_id int, ts timestamp, value double, kind string")


def test_stream_equals_batch(spark, tmp_path):
    batch = events(spark)
    batch.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/ev")
    q = (demand.daily_totals(stream, "ts", "value", "kind").writeStream.outputMode("complete")
         .format("memory").queryName("totals").start())
    q.processAllAvailable()
    q.stop()
    want = demand.daily_totals(batch, "ts", "value", "kind")
    assert spark.table("totals").exceptAll(want).count() == 0 and want.count() == spark.table("totals").count()


def test_stream_drops_repeats(spark, tmp_path):
    batch = events(spark)
    batch.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/ev")
    q = (demand.drop_repeats(stream, "ts", "event_id", late="60 days").writeStream.outputMode("append")
         .format("memory").queryName("once").start())
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 40
    assert demand.drop_repeats(batch, "ts", "event_id").count() == 40


def test_late_days_are_closed(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")

    put("a", [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 20), 1.0)])
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/ev")
    q = (demand.daily_totals(stream, "ts", "value").writeStream.outputMode("append").format("memory")
         .queryName("closed").start())
    q.processAllAvailable()
    put("b", [(dt.datetime(2024, 1, 1, 5), 9.0)])
    q.processAllAvailable()
    q.stop()
    rows = spark.table("closed").where(F.col("day") == dt.date(2024, 1, 1)).collect()
    assert [r["total"] for r in rows] == [1.0]


def test_stream_reads_by_header_and_loads_a_row_once(spark, tmp_path):
    """The same rows, spread over files and batches in two ways, with columns in two orders."""
    rows = [(f"2024-01-{d:02d}", f"A{d}", 2, d + 0.5) for d in range(1, 13)]

    def lines(part, swapped):
        head = "Selling Price,Qty,Order No,Order Date\n" if swapped else HEAD
        return head + "".join((f"{p},{q},{o},{d}\n" if swapped else f"{d},{o},{q},{p}\n") for d, o, q, p in part)

    def arrive(base, batches):
        (base / "in").mkdir(parents=True)
        for n, files in enumerate(batches):
            for k, (part, swapped) in enumerate(files):
                (base / "in" / f"f{n}-{k}.csv").write_text(lines(part, swapped))
            load(spark, base)
        return sorted(map(repr, spark.read.parquet(f"{base}/clean").select("date", "order_id", "quantity", "unit_price").collect()))

    one = arrive(tmp_path / "one", [[(rows, False), (rows[:4], True)]])
    many = arrive(tmp_path / "many", [[(rows[:7], True)], [(rows[5:], False)], [(rows[3:9], True)]])
    assert one == many and len(one) == 12


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "order_id string, quantity int")
    seen = f"{tmp_path}/seen"
    assert exports.unseen(df, seen, 0).count() == 2
    exports.remember(df, seen, 0)
    assert exports.unseen(df, seen, 0).count() == 2 and exports.unseen(df, seen, 1).count() == 0
    exports.remember(df.limit(1), seen, 0)
    assert [r["order_id"] for r in exports.unseen(df.withColumn("note", F.lit(None).cast("string")), seen, 1).collect()] == ["b"]
