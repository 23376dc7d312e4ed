import datetime as dt
import json

import pytest

from salescope.sources import exports, headers, model_store, readers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_marketplace_headers_are_mapped():
    mapped, uncertain = headers.map_headers([
        "order_date", "sub_order_num", "quanity", "total_taxable_sale_value", "end_customer_state_new", "hsn_code",
        "platform_note"])
    got = {m["source"]: (m["field"], m["match"]) for m in mapped}
    assert got["order_date"][0] == "date"
    assert got["sub_order_num"][0] == "order_id"
    assert got["quanity"] == ("quantity", "similar name")
    assert got["total_taxable_sale_value"][0] == "revenue"
    assert got["end_customer_state_new"] == ("region", "recognized name")
    assert got["hsn_code"][0] == "category"
    assert "platform_note" not in got and not uncertain


def test_two_headers_for_one_field_fail():
    with pytest.raises(ValueError, match="order_id"):
        headers.map_headers(["order_id", "order number"])


def test_close_rivals_stay_uncertain():
    mapped, uncertain = headers.map_headers(["product cose"])
    assert not mapped
    assert set(uncertain[0]["candidates"]) == {"product_id", "cost_per_unit"}


def test_pruned_similarity_equals_full_similarity():
    from difflib import SequenceMatcher

    for key in ("quanity", "prodct name", "sale ammount", "stock quantitty", "zzz", "unit pric"):
        full = sorted(
            ((f, max(SequenceMatcher(None, key, headers.key_of(n)).ratio() for n in [f.replace("_", " "), *others]))
             for f, others in headers.ALIASES.items()), key=lambda s: -s[1])
        best, second = full[0], full[1]
        if best[1] >= .9 and best[1] - second[1] >= .07:
            expected = (best[0], headers.CLOSE, [])
        else:
            expected = (None, None, [f for f, s in full[:3] if s >= .9])
        assert headers.judge(key) == expected


def test_catalog_and_table_forms_agree(spark):
    names = ["Order Date", "quanity", "prodct name", "note", "product cose", "SKU!"]
    df = spark.createDataFrame([(1, n) for n in names], "export_id int, header string")
    known = {r["header"]: r["field"] for r in headers.map_known(df).collect()}
    similar = {r["header_key"]: (r["field"], list(r["candidates"])) for r in headers.map_similar(df).collect()}
    assert known["Order Date"] == "date" and known["SKU!"] == "product_id" and known["note"] is None
    assert similar["quanity"] == ("quantity", [])
    assert similar["note"] == (None, [])
    assert set(similar["product cose"][1]) == {"product_id", "cost_per_unit"}


def test_duplicate_headers_after_trimming_fail(spark):
    df = spark.createDataFrame([("a", "b")], ["date", " Date "])
    with pytest.raises(ValueError, match="date"):
        headers.normalize_headers(df)


@pytest.mark.parametrize("name,text", [
    ("s.tsv", "date\tquantity\trevenue\n2024-01-01\t3\t10.5\n"),
    ("s.csv", "date,quantity,revenue\n2024-01-01,3,10.5\n"),
    ("s.json", json.dumps([{"date": "2024-01-01", "quantity": 3, "revenue": 10.5}])),
    ("s.jsonl", '{"date": "2024-01-01", "quantity": 3, "revenue": 10.5}\n'),
    ("s.ndjson", '{"date": "2024-01-01", "quantity": 3, "revenue": 10.5}\n'),
])
def test_formats(spark, tmp_path, name, text):
    row = readers.read_business_table(spark, write(tmp_path, name, text)).df.first()
    assert (row["date"], row["quantity"], row["revenue"]) == (dt.date(2024, 1, 1), 3, 10.5)


def test_parquet_and_unsupported_formats(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("2024-01-01", 3, 1.0)], ["date", "quantity", "revenue"]).write.parquet(path)
    assert readers.read_business_table(spark, path).df.first()["quantity"] == 3
    with pytest.raises(ValueError, match=".parquet"):
        readers.read_business_table(spark, "x.docx")


def test_missing_tokens_and_text_numbers(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Order Date,Qty,Price\n2024-01-01,1,2.5\nbad,N/A,x\n")
    loaded = readers.read_business_table(spark, path)
    types = dict(loaded.df.dtypes)
    assert types["quantity"] == "double" and types["unit_price"] == "string"
    second = loaded.df.where("date is null").first()
    assert second["quantity"] is None and second["unit_price"] == "x"
    assert readers.load_report(loaded).first()["rows_loaded"] == 2
    assert [m["field"] for m in loaded.mappings] == ["date", "quantity", "unit_price"]


def test_sales_and_returns_together(spark, tmp_path):
    sold = write(tmp_path, "sales.csv", "date,order_id,quantity,revenue\n2024-01-01,A,1,100\n2024-01-02,B,1,50\n")
    back = write(tmp_path, "back.csv",
                 "date,order_id,quantity,revenue,cancel_return_date\n2024-01-03,A,1,25,2024-01-04\n2024-01-03,OLD,1,5,2024-01-04\n")
    got = exports.load_exports(spark, [sold, back])
    rows = {r["order_id"]: r for r in got.sales.collect()}
    assert len(rows) == 2 and sum(r["revenue"] for r in rows.values()) == 150
    assert (rows["A"]["returns"], rows["A"]["returned_revenue"], rows["B"]["returns"]) == (1, 25, 0)
    s = got.summary.first()
    assert (s["rows"], s["matched_rows"], s["unmatched_rows"], s["unmatched_value"]) == (2, 1, 1, 5.0)


def test_export_guards(spark, tmp_path):
    back = write(tmp_path, "refunds.csv", "order_id,quantity,revenue\nA,1,25\n")
    with pytest.raises(ValueError, match="a sales file is needed"):
        exports.load_exports(spark, [back])
    one = write(tmp_path, "one.csv", "date,quantity,revenue\n2024-01-01,1,2\n")
    two = write(tmp_path, "two.csv", "date,quantity,unit_price\n2024-01-01,1,2\n")
    with pytest.raises(ValueError, match="different business columns"):
        exports.load_exports(spark, [one, two])
    with pytest.raises(ValueError):
        exports.load_exports(spark, [])


def test_model_store(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], ["x", "label"])
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = LinearRegression().fit(train)
    folder = str(tmp_path / "models")
    assert model_store.list_models(spark, folder) == []
    assert model_store.load_model(spark, folder, "none") is None
    model_store.save_model(spark, folder, "linear", model, {"rows": 10})
    loaded = model_store.load_model(spark, folder, "linear")
    assert loaded["metadata"] == {"rows": 10}
    assert loaded["model"].coefficients[0] == pytest.approx(2.0)
    assert model_store.list_models(spark, folder) == ["linear"]


def test_files_of_any_header_order_are_read_by_name(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.csv", "Order Date,Order No,Qty\n2024-01-01,A1,2\n")
    write(tmp_path / "in", "b.csv", "Qty,Order Date,Order No\n7,2024-01-02,B1\n")
    write(tmp_path / "in", "c.csv", "﻿Quantity,Note,Order No\n9,\"x, y\",C1\n")
    write(tmp_path / "in", "empty.csv", "")
    write(tmp_path / "in", "_hidden.csv", "zzz\n1\n")
    (tmp_path / "in" / "d.csv.gz").write_bytes(gzip.compress(b"Order No,Qty,Order Date\nD1,4,2024-01-04\n"))
    loaded = readers.read_business_table(spark, str(tmp_path / "in"), "csv")
    rows = {r["order_id"]: r for r in loaded.df.collect()}
    assert {k: r["quantity"] for k, r in rows.items()} == {"A1": 2, "B1": 7, "C1": 9, "D1": 4}
    assert rows["B1"]["date"] == dt.date(2024, 1, 2) and rows["C1"]["date"] is None
    assert {m["source"] for m in loaded.mappings} == {"order date", "order no", "qty"}
    with pytest.raises(ValueError, match="no file"):
        readers.read_business_table(spark, str(tmp_path / "none*.csv"))
    with pytest.raises(ValueError, match="empty"):
        readers.read_business_table(spark, str(tmp_path / "in" / "empty.csv"))


def test_folders_of_partitions_keep_their_columns(spark, tmp_path):
    for region, head in (("North", "date,quantity"), ("South", "quantity,date")):
        folder = tmp_path / "s.csv" / f"region={region}"
        folder.mkdir(parents=True)
        write(folder, "part.csv", head + "\n" + ("2024-01-01,3" if region == "North" else "4,2024-01-02") + "\n")
    got = readers.read_business_table(spark, str(tmp_path / "s.csv")).df.collect()
    assert {(r["region"], r["quantity"], r["date"].day) for r in got} == {("North", 3, 1), ("South", 4, 2)}


def test_collisions_of_similar_names(spark):
    rows = [(1, "Quantity"), (1, "quanity"), (2, "quanity"), (2, "prodct name"), (3, "Qty"), (3, "note")]
    df = spark.createDataFrame(rows, "export_id int, header string")
    assert [tuple(r) for r in headers.header_collisions(df, "export_id").collect()] == [(1, "quantity", 2)]
    assert {(r["header"], r["field"], r["match"]) for r in headers.map_catalog(df).where("export_id < 3").collect()} == {
        ("Quantity", "quantity", headers.CANONICAL), ("quanity", "quantity", headers.CLOSE), ("prodct name", "product_name", headers.CLOSE)}


def test_json_lines_are_packed_in_short_files(spark, monkeypatch):
    from salescope.catalog import sources
    from salescope.fixtures import view
    from salescope.plans.registry import QUERIES

    seen, read = [], sources.readers.read_business_table
    monkeypatch.setattr(sources.readers, "read_business_table", lambda spark, path: seen.append(path) or read(spark, path))
    monkeypatch.setattr(sources, "LINES", 1_000)
    sf = "/root/testdata/sf0.001"
    raw = view(spark, sf, "raw_sales")
    out = QUERIES["src_jsonl"](spark, sf)
    files = spark.read.json(seen[0]).inputFiles()
    assert len(files) > raw.count() // 1_000 and all(".json." in f for f in files)
    columns = ["order_id", "line_id", "product_name", "unit_price", "returns"]
    assert sorted(map(repr, out.select(columns).collect())) == sorted(map(repr, raw.select(columns).collect()))
