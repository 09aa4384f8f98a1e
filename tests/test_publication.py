"""Swapped tables, the mart's runs and digests, orders, dates, distinct counts and the fits of a selection."""

import datetime

import pytest
from pyspark.sql import functions as F

from commercium import registry
from commercium.operators import ordered
from commercium.plans import elasticity, mart, profiles
from commercium.sources import cleaning, readers


def test_a_table_can_replace_itself(spark, tmp_path):
    target = str(tmp_path / "table")
    readers.replace_table(spark.range(10).selectExpr("id as n"), target)
    again = readers.read_table(spark, target)
    assert readers.replace_table(again.where("n < 4"), target).count() == 4
    assert readers.read_table(spark, target).count() == 4 and again.count() == 10


def test_a_load_that_fails_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "table")
    readers.replace_table(spark.range(10).selectExpr("id as n"), target)
    with pytest.raises(Exception, match="broken"):
        readers.replace_table(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("n")), target)
    assert readers.read_table(spark, target).count() == 10


def test_a_run_that_fails_leaves_the_mart(spark, tmp_path):
    folder = str(tmp_path / "mart")
    first = spark.createDataFrame([("a", 1.25), ("b", None), ("b", None)], "k string, v double")
    manifest = mart.publish_mart(spark, {"executive_kpis": first, "regional_risk": first}, folder)
    assert manifest.where("status = 'published'").count() == 2
    broken = first.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        mart.publish_mart(spark, {"executive_kpis": first.limit(1), "regional_risk": broken}, folder)
    assert mart.read_result(spark, folder, "executive_kpis", verify=True).count() == 3
    assert mart.read_manifest(spark, folder).count() == len(mart.MART_AREAS)
    mart.publish_mart(spark, {"executive_kpis": first.limit(1)}, folder)
    assert mart.read_result(spark, folder, "executive_kpis", verify=True).count() == 1
    with pytest.raises(KeyError):
        mart.read_result(spark, folder, "regional_risk")


def test_digests_know_bags_of_rows(spark):
    rows = [(k % 5, f"s{k % 3}", k / 7) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, v double")
    digest = mart.value_digest(df)
    assert mart.value_digest(df.repartition(7).select("v", "b", "a")) == digest
    assert mart.value_digest(df.withColumn("v", F.col("v") + 1e-13)) == digest
    assert mart.value_digest(df.union(df.limit(1))) != digest
    assert mart.value_digest(df.withColumn("v", F.col("v") + 1e-5)) != digest
    assert mart.value_digest(df.limit(0)) == "0:0"


def test_published_values_are_those_of_the_queries(spark, root, tmp_path):
    folder = str(tmp_path / "mart")
    places = {"digits": 6, "revenue": 2}
    names = {"executive_kpis": {}, "regional_risk": places, "discount_profile": places}
    results = registry.mart_results(spark, root)
    manifest = mart.publish_mart(spark, {n: results[n] for n in names}, folder)
    digests = {r["name"]: r["digest"] for r in manifest.collect()}
    for name, places in names.items():
        asked, own = (registry.rounded(df, **places) for df in (registry.QUERIES[name](spark, root), results[name]))
        assert mart.value_digest(asked) == mart.value_digest(own), name
        assert mart.value_digest(mart.read_result(spark, folder, name)) == digests[name]


def test_order_is_checked_inside_slices_and_across_their_borders(spark):
    rows = [(None, 1), (1, 9), (1, 3), (2, None), (2, 5), (7, 0)]
    df = spark.createDataFrame(rows, "a int, b int").coalesce(1)
    order = [("a", True, True), ("b", False, True)]
    assert ordered.order_breaks(df, order) == 0
    assert ordered.order_breaks(df, [("a", True, False), ("b", False, True)]) == 1
    assert ordered.order_breaks(df, [("a", True, True), ("b", True, False)]) == 2
    many = spark.range(1000).withColumn("id", F.when(F.col("id") == 600, 5).otherwise(F.col("id"))).repartitionByRange(8, "id")
    assert ordered.order_breaks(many.orderBy("id"), [("id", True, True)]) == 0
    assert ordered.order_breaks(spark.range(1000, numPartitions=8), [("id", False, True)]) == 999


@pytest.mark.parametrize(
    "name, order",
    [
        ("backlog_analysis", [("backlog_days", False, True), ("region", True, False), ("backlog_rank", True, False)]),
        ("initiative_ranking", [("rank", True, False)]),
        ("otd_analysis", [("quarter", True, False), ("business_unit", True, False)]),
        ("aos_summary", [("avg_aos", False, True)]),
        ("lifecycle_analysis", [("avg_aos", False, True)]),
        ("region_dashboard", [("avg_aos", False, True)]),
        ("owner_dashboard", [("avg_aos", False, True)]),
    ],
)
def test_reports_are_in_order(spark, root, name, order):
    assert ordered.order_breaks(registry.QUERIES[name](spark, root), order) == 0


def test_day_and_month_are_read_alike_in_a_column(spark):
    def read(*written):
        df = spark.createDataFrame([(x,) for x in written], "order_date string")
        return [r[0] for r in cleaning.coerce_types(df, cleaning.ORDER_TYPES).collect()]

    d = datetime.date
    assert read("03/04/2024", "13/04/2024", None) == [d(2024, 4, 3), d(2024, 4, 13), None]
    assert read("03/04/2024", "04/13/2024") == [d(2024, 3, 4), d(2024, 4, 13)]
    assert read("03/04/2024", "2024-05-06") == [d(2024, 3, 4), d(2024, 5, 6)]
    assert read("13/04/2024", "14/04/2024", "04/15/2024") == [d(2024, 4, 13), d(2024, 4, 14), None]


def test_distinct_counts_take_one_pass(spark):
    day = datetime.date(2024, 1, 5)
    rows = [("S1", "EU", None, "A", day, day, 100.0), ("S2", "EU", "web", "A", None, day, None), (None, None, "web", "B", day, None, 90.0)]
    df = spark.createDataFrame(rows, "sku string, region string, channel string, customer_tier string, quarter date, order_date date, ppi_index double")
    out = profiles.fact_profile(df)
    assert out.first().asDict() == {
        "observations": 3, "first_order": day, "last_order": day, "index_min": 90.0, "index_max": 100.0,
        "skus": 2, "regions": 1, "channels": 1, "customer_tiers": 2, "quarters": 1,
    }
    assert profiles.fact_profile(df.limit(0)).first()["observations"] == 0
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_selection_fits_the_preferred_model_alone(spark, monkeypatch):
    asked = []

    def results(data, specifications):
        asked.append([s.name for s in specifications])
        rows = [(s.name, -0.1 * k, 0.5) for k, s in enumerate(specifications, 1)]
        return spark.createDataFrame(rows, "model string, elasticity double, p_value double")

    monkeypatch.setattr(elasticity, "robustness_results", results)
    data = spark.createDataFrame([(1.0,)], "log_net_price double")
    assert elasticity.preferred_result(data).first()["model"] == "4. SKU + time + commercial controls"
    assert asked == [["4. SKU + time + commercial controls"]]
    assert elasticity.preferred_result(data, ["no such"]).first()["model"] == elasticity.MEDIAN_MODEL
    assert len(asked[1]) == 8  # without list prices two specifications are left out
