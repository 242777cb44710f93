"""The raw CSV contract."""

import pytest
from pyspark.sql import functions as F

from larder.sources import contract, raw, sinks, snapshot


def record(table, **changes):
    plain = {"bigint": "1", "decimal(18,2)": "10.00", "date": "2025-01-01", "timestamp": "2025-01-01T12:00:00+05:00", "string": "x"}
    values = {f.name: plain[f.dataType.simpleString()] for f in contract.schema(table)}
    for column, allowed in contract.ALLOWED.get(table, {}).items():
        values[column] = str(allowed[0])
    return {**values, **changes}


def write(folder, name, *records, header=None):
    path = folder / name
    names = header or list(records[0])
    path.write_text("\n".join([",".join(names)] + [",".join(r[n] for n in names) for r in records]) + "\n")
    return str(path)


def test_every_table_loads(spark, tmp_path):
    for table in contract.FIELDS:
        df = raw.load_table(spark, table, [write(tmp_path, f"{table}.csv", record(table))])
        assert df.count() == 1 and df.schema == contract.schema(table)


def test_several_files_and_decimals(spark, tmp_path):
    a = write(tmp_path, "a.csv", record("Order_Items"))
    b = write(tmp_path, "b.csv", record("Order_Items", Order_Item_ID="2"))
    df = raw.load_table(spark, "Order_Items", [a, b])
    assert df.count() == 2 and dict(df.dtypes)["Unit_Price"] == "decimal(18,2)"
    with pytest.raises(raw.IngestionError, match="distinct"):
        raw.load_table(spark, "Order_Items", [a, a])
    with pytest.raises(raw.IngestionError, match="missing"):
        raw.load_table(spark, "Order_Items", [str(tmp_path / "absent.csv")])


@pytest.mark.parametrize(
    "table, changes, message",
    [
        ("Order_Items", {"Quantity": "not-a-number"}, "invalid source types"),
        ("Order_Items", {"Quantity": "1.5"}, "invalid source types"),
        ("Order_Items", {"Unit_Price": "10.001"}, "invalid source types"),
        ("Orders", {"Order_DateTime": "2025-99-99"}, "invalid source types"),
        ("Orders", {"Order_DateTime": "2025-01-01T12:00:00+00:00"}, "invalid source types"),
        ("Order_Items", {"Item_ID": ""}, "required IDs"),
        ("Order_Items", {"Item_ID": "0"}, "required IDs"),
        ("Orders", {"Order_Status": "Unknown"}, "unsupported enums"),
    ],
)
def test_contract_violations_stop_the_load(spark, tmp_path, table, changes, message):
    with pytest.raises(raw.IngestionError, match=message):
        raw.load_table(spark, table, [write(tmp_path, "t.csv", record(table, **changes))])


def test_dirty_but_typed_values_stay(spark, tmp_path):
    lines = raw.load_table(spark, "Order_Items", [write(tmp_path, "l.csv", record("Order_Items", Quantity="-1"))])
    assert lines.first()["Quantity"] == -1
    orders = raw.load_table(spark, "Orders", [write(tmp_path, "o.csv", record("Orders", Order_DateTime="", Promotion_ID=""))])
    assert orders.first()["Order_DateTime"] is None and orders.first()["Promotion_ID"] is None


def test_shape_header_and_empty_input(spark, tmp_path):
    names = contract.schema("Order_Items").fieldNames()
    good = write(tmp_path, "good.csv", record("Order_Items"))
    turned = write(tmp_path, "turned.csv", record("Order_Items"), header=names[::-1])
    with pytest.raises(raw.IngestionError, match="column order"):
        raw.load_table(spark, "Order_Items", [good, turned])
    short = tmp_path / "short.csv"
    short.write_text(",".join(names) + "\n1,2\n")
    with pytest.raises(raw.IngestionError, match="malformed"):
        raw.load_table(spark, "Order_Items", [str(short)])
    text = raw.read_text(spark, names, [str(short)])
    assert raw.corrupt_records(text).count() == 1
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(names) + "\n")
    with pytest.raises(raw.IngestionError, match="no records"):
        raw.load_table(spark, "Order_Items", [str(empty)])
    partial = tmp_path / "partial.csv"
    partial.write_text("Order_Item_ID\n1\n")
    with pytest.raises(raw.IngestionError, match="invalid columns"):
        raw.load_table(spark, "Order_Items", [str(partial)])


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Category_ID,Category_Name\n1,"two\nlines, ""quoted"""\n')
    got = raw.load_table(spark, "Menu_Categories", [str(path)], quoted_lines=True).first()
    assert got["Category_Name"] == 'two\nlines, "quoted"'


def test_altered_snapshot_is_rejected(spark, tmp_path):
    folder = str(tmp_path / "snap")
    snapshot.write_clean({"menu": spark.range(10).toDF("Item_ID")}, folder)
    snapshot.write_manifest(spark, folder, ["menu"])
    snapshot.verify_manifest(spark, folder, ["menu"])
    snapshot.write_clean({"menu2": spark.range(3).toDF("Item_ID")}, folder)
    extra = next((tmp_path / "snap" / "menu2").glob("*.parquet"))
    (tmp_path / "snap" / "menu" / extra.name).write_bytes(extra.read_bytes())
    with pytest.raises(ValueError, match="hash mismatch"):
        snapshot.verify_manifest(spark, folder, ["menu"])
    with pytest.raises(ValueError, match="version"):
        snapshot.verify_manifest(spark, folder, ["menu"], version="other")


def test_views_need_a_whole_snapshot(spark, tmp_path):
    folder, tables = str(tmp_path / "bound"), {"v_menu": "menu", "v_lines": "lines"}
    snapshot.write_clean({"menu": spark.range(10).toDF("Item_ID"), "lines": spark.range(7).toDF("Order_ID")}, folder)
    snapshot.write_manifest(spark, folder, ["menu", "lines"])
    assert sorted((r["view"], r["rows"]) for r in snapshot.bind(spark, folder, tables).collect()) == [("v_lines", 7), ("v_menu", 10)]
    assert spark.sql("SELECT count(*) FROM v_menu JOIN v_lines ON Item_ID = Order_ID").first()[0] == 7
    with pytest.raises(ValueError, match="lines"):
        snapshot.bind(spark, folder, tables, version="other")
    with pytest.raises(Exception, match="absent"):
        snapshot.bind(spark, folder, {"v_none": "absent"})
    next((tmp_path / "bound" / "lines").glob("*.parquet")).write_bytes(next((tmp_path / "bound" / "menu").glob("*.parquet")).read_bytes())
    with pytest.raises(Exception, match="lines"):
        snapshot.bind(spark, folder, tables)


def test_partitioned_write_prunes_and_splits(spark, tmp_path):
    sales = spark.range(3000).select("id", (F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7)).alias("Location_ID"))
    counts = {r["Location_ID"]: r["rows"] for r in snapshot.write_partitioned(sales, str(tmp_path / "p"), rows_per_file=400).collect()}
    assert sum(counts.values()) == 3000
    assert len(list((tmp_path / "p" / "Location_ID=1").glob("*.parquet"))) >= counts[1] // 400


def test_reports_stay_out_of_raw_data(spark, tmp_path):
    with pytest.raises(ValueError, match="raw data"):
        sinks.write_report(spark.range(1), str(tmp_path / "data/raw/x"))
    exported = sinks.neutralise(spark.createDataFrame([("=1+1", 2), ("@x", 3), ("fine", 4)], "t string, n int")).collect()
    assert [r["t"] for r in exported] == ["'=1+1", "'@x", "fine"]


def test_replicated_references_resolve(spark):
    orders = spark.createDataFrame([(1, 1), (2, 2)], "Order_ID long, Customer_ID long")
    lines = spark.createDataFrame([(1, 1, 4), (2, 2, 4)], "Order_Item_ID long, Order_ID long, Item_ID long")
    many = raw.replicate(orders, 5, {"Order_ID": 100_000})
    kept = raw.replicate(lines, 5, {"Order_Item_ID": 1_000_000, "Order_ID": 100_000})
    assert many.select("Order_ID").distinct().count() == 10 == kept.select("Order_Item_ID").distinct().count()
    assert kept.join(many, "Order_ID", "left_anti").count() == 0
