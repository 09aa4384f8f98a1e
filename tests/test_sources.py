import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from commercium.sources import cleaning, columns, readers, staging, star


def feed(spark):
    rows = [
        ("2024-01-05", "A", "10", "90.5", "100", "EMEA"),
        ("no date", "A", "10", "90", "100", "EMEA"),
        ("2024-01-06", "B", "many", "90", "100", "EMEA"),
        ("2024-01-07", "B", "0", "90", "100", "EMEA"),
        ("2024-01-08", "B", "3", "-1", "100", "EMEA"),
        ("2024-01-09", None, "3", "80", "100", "EMEA"),
        ("2024-02-09", "C", "3", "80", "0", None),
    ]
    names = [" Order Date ", "Product SKU", "QTY", "Selling Price", "List Price", "Region"]
    return spark.createDataFrame(rows, names)


def test_names_aliases_and_order(spark):
    resolved = columns.canonical_columns(feed(spark))
    assert resolved.columns == ["order_date", "sku", "quantity", "net_price", "list_price", "region"]


def test_first_alias_wins(spark):
    df = spark.createDataFrame([(1, 2)], ["price", "net_price"])
    assert columns.resolve_aliases(df, columns.ORDER_ALIASES).columns == ["price", "net_price"]


def test_missing_columns_are_all_named(spark):
    df = spark.createDataFrame([(1,)], ["sku"])
    with pytest.raises(ValueError, match="quantity.*net_price"):
        columns.require_columns(df, ["quantity", "sku", "net_price"])
    with pytest.raises(ValueError, match="order_date"):
        columns.canonical_columns(df)


def test_cleaning_coerces_filters_and_counts(spark):
    seen = Observation("clean")
    clean = cleaning.clean_orders(columns.canonical_columns(feed(spark)), seen)
    rows = {r["sku"]: r for r in clean.collect()}
    assert set(rows) == {"A", "C"}
    assert rows["A"]["order_date"] == datetime.date(2024, 1, 5) and rows["A"]["net_price"] == 90.5
    assert rows["C"]["region"] == "Unknown" and rows["A"]["channel"] == "Unknown"
    assert seen.get == {"rows_read": 7, "rows_removed": 5}
    typed = cleaning.coerce_types(columns.canonical_columns(feed(spark)), cleaning.ORDER_TYPES)
    counts = cleaning.removal_counts(typed, columns.ORDER_REQUIRED, ["quantity", "net_price"]).first()
    assert tuple(counts) == (7, 2, 5)


def test_discount_sources(spark):
    both = spark.createDataFrame([(90.0, 100.0, 1.0), (90.0, 0.0, 1.0)], ["net_price", "list_price", "discount_pct"])
    got = [r["calculated_discount_pct"] for r in cleaning.derive_discount(both).collect()]
    assert got[0] == pytest.approx(10.0) and got[1] is None
    stored = cleaning.derive_discount(both.drop("list_price")).first()
    assert stored["calculated_discount_pct"] == 1.0
    neither = cleaning.derive_discount(both.select("net_price")).first()
    assert neither["calculated_discount_pct"] is None


def test_revenue_overrides_the_stored_one(spark):
    df = spark.createDataFrame([(3, 2.5, 99.0)], ["quantity", "net_price", "revenue"])
    assert cleaning.derive_revenue(df).first()["revenue"] == 7.5


def test_csv_and_table_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.25), ("b", None)], "k string, v double")
    path = readers.export_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_csv(spark, path, df.schema).collect())) == [("a", 1.25), ("b", None)]
    assert readers.read_csv(spark, path).dtypes == [("k", "string"), ("v", "double")]
    target = str(tmp_path / "table")
    readers.replace_table(df, target)
    again = readers.replace_table(df.where("k = 'a'"), target)
    assert again.count() == 1 and readers.read_table(spark, target, ["v"]).columns == ["v"]
    tables = readers.replace_tables({"one": df, "two": df}, str(tmp_path))
    assert {n: t.count() for n, t in tables.items()} == {"one": 2, "two": 2}


def test_views_and_queries(spark):
    df = spark.createDataFrame([(1,), (2,)], ["n"])
    assert readers.register_views(spark, {"numbers_view": df}) == ["numbers_view"]
    assert readers.read_table(spark, "numbers_view").count() == 2
    assert readers.read_query(spark, "select sum(n) as s from {numbers}", numbers=df).first()["s"] == 3


def test_index_file_takes_the_first_value_column(spark):
    df = spark.createDataFrame([("2024-01-01", "101.5"), ("bad", "1"), ("2024-02-01", ".")], ["date", "SERIES"])
    rows = readers.load_index(df).collect()
    assert [tuple(r) for r in rows] == [(datetime.date(2024, 1, 1), 101.5)]
    with pytest.raises(ValueError):
        readers.load_index(df.select("SERIES"))


def test_load_check(spark):
    df = spark.range(12).withColumn("x", F.col("id") * 2)
    rows = readers.load_check(df, ["id"]).collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0]["table_rows"] == 12 and rows[0]["column_list"] == "id,x"


def test_staged_tables_live_in_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    staged = staging.stage(spark.range(10).withColumn("k", F.col("id") % 3), "unit", cluster_by="k")
    if folder:
        assert folder.removeprefix("file:") in staged.inputFiles()[0]
    assert staged.count() == 10


def test_unused_lookups_stay_out_of_the_plan(spark, root):
    plan = star.pricing_orders(spark, root, ["sku", "net_price"])._jdf.queryExecution().toString()
    assert "Join" not in plan
    full = star.pricing_orders(spark, root)
    assert full.count() == star.star_table(spark, root, "lineitem").count()
    assert full.where("region is null or business_unit is null or order_date is null").count() == 0


class _Session:
    """Just the settings that decide where staged tables go."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.folder = folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_its_shared_folder():
    assert staging.shared_folder(_Session("yarn", "hdfs:///scratch")) == "hdfs:///scratch"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session("yarn"))


def test_csv_columns_are_found_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("region,quantity,sku\nEU,3,S1\nUS,many,S2\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), "sku string, region string, quantity bigint").collect()
    assert [tuple(r) for r in rows] == [("S1", "EU", 3), ("S2", "US", None)]


def test_csv_folders_are_read_by_each_files_header(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a b+c%.csv").write_text("region,quantity,sku\nEU,3,S1\nUS,many,S2\n")
    (folder / "b.csv").write_text("sku,region,quantity\nS3,EU,4\n")
    (folder / "c.csv").write_text("region,quantity,sku\n\"A, B\",5,S4\n")
    (folder / "d.csv").write_text("sku,region\nS5,EU\n")
    (folder / "e.csv").write_text("sku,region,quantity\n")
    schema = "sku string, region string, quantity bigint"
    rows = readers.read_csv(spark, str(folder), schema, each_header=True)
    assert rows.dtypes == [("sku", "string"), ("region", "string"), ("quantity", "bigint")]
    assert sorted(map(tuple, rows.collect())) == [
        ("S1", "EU", 3), ("S2", "US", None), ("S3", "EU", 4), ("S4", "A, B", 5), ("S5", "EU", None),
    ]
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(folder), "sku string, colour string", each_header=True)
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(folder), each_header=True)


def test_first_lines_are_found_in_files_of_several_blocks(spark, tmp_path):
    """Later blocks have first rows too, and small files share a task."""
    folder = tmp_path / "feed"
    folder.mkdir()
    swapped = ["sku,quantity", "quantity,sku"]
    for n in range(6):
        body = (f"S{i},{i}" if n % 2 == 0 else f"{i},S{i}" for i in range(2_000))
        (folder / f"{n}.csv").write_text("\n".join([swapped[n % 2], *body]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.read_csv(spark, str(folder), "sku string, quantity bigint", each_header=True)
        assert rows.where(F.concat(F.lit("S"), "quantity") == F.col("sku")).count() == rows.count() == 12_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dates_are_read_in_several_ways(spark):
    written = ["2024-03-04", "03/04/2024", "4 Mar 2024", "Mar 4, 2024", "2024/3/4", "20240304", "not a date", "", None]
    df = spark.createDataFrame([(x,) for x in written], "order_date string")
    read = [r[0] for r in cleaning.coerce_types(df, cleaning.ORDER_TYPES).collect()]
    assert read == [datetime.date(2024, 3, 4)] * 6 + [None] * 3


def test_bad_cells_are_removed_and_missing_categories_named(spark):
    rows = [("2024-01-02", "S", "3", "2.5", None), ("never", "S", "3", "2.5", "EU"), ("2024-01-02", "S", "n/a", "2", "EU"), ("2024-01-02", "S", "1", "-1", "EU")]
    df = spark.createDataFrame(rows, "order_date string, sku string, quantity string, net_price string, region string")
    kept = cleaning.clean_orders(df).collect()
    assert [(r["quantity"], r["region"], r["channel"]) for r in kept] == [(3.0, "Unknown", "Unknown")]
