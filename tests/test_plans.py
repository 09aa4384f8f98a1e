"""Plans at scale: pruning, pushdown, no single-partition work on facts, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from commercium.operators import ordered, regression
from commercium.plans import lifecycle, pricing, risk, scenarios
from commercium.registry import QUERIES
from commercium.sources import star


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    changed = {}

    def apply(**settings):
        for key, value in settings.items():
            name = key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield apply
    for name, value in changed.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def no_broadcast(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


def test_scans_read_only_needed_columns(spark, root):
    plan = executed(QUERIES["price_vs_index"](spark, root))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any(set(re.findall(r"(\w+):", s)) == {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"} for s in schemas)
    assert "customer" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.range(100).select(F.col("id").alias("quantity"), F.lit(1.0).alias("net_price"), F.lit("s").alias("sku")).write.parquet(path)
    from commercium.sources.cleaning import keep_usable

    plan = executed(keep_usable(spark.read.parquet(path), ["sku"], ["quantity", "net_price"]))
    assert "GreaterThan(quantity,0)" in plan and "IsNotNull(sku)" in plan


@pytest.mark.parametrize("name", ["initiative_scores", "backlog_analysis", "discount_offenders", "top5_discount_offenders",
                                  "price_realization", "segment_opportunities", "discount_profile", "sku_scenarios"])
def test_no_single_partition_exchange(spark, root, name):
    assert "SinglePartition" not in executed(QUERIES[name](spark, root))


def test_global_order_collects_only_slice_totals(spark, root):
    plan = executed(QUERIES["sku_pareto"](spark, root))
    below = [plan[m.end():].splitlines()[1] for m in re.finditer("Exchange SinglePartition", plan)]
    # What is gathered is grouped by slice: at most one row per shuffle partition.
    assert below and all("HashAggregate(keys=[_slice" in line for line in below)


def test_index_is_broadcast_and_the_fact_does_not_shuffle(spark, root, no_broadcast):
    orders = star.pricing_orders(spark, root, ["sku", "net_price", "quantity", "order_date"])
    staged = spark.createDataFrame(orders.limit(10).collect(), orders.schema)
    plan = executed(pricing.orders_with_monthly_index(staged, star.raw_material_index(spark, root)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_global_maximum_is_a_subquery(spark, root):
    scored = lifecycle.scored_initiatives(star.initiatives(spark, root))
    plan = executed(risk.initiative_risk(scored, star.initiatives(spark, root, ["backlog_days"])))
    assert "Subquery" in plan and "Window" not in plan


def test_scenarios_expand_after_the_aggregate(spark, root):
    plan = executed(QUERIES["pricing_scenarios"](spark, root))
    assert plan.index("Generate") < plan.index("HashAggregate")  # printed above means run later


def skewed(spark, rows=60000):
    """A third of the rows share one key."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("long").alias("k"),
        F.concat(F.lit("payload-"), F.col("id").cast("string"), F.lit("x" * 40)).alias("pad"),
        F.col("id").alias("id"),
    )


def split_settings(conf):
    conf(
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return executed(df)


def test_adaptive_execution_splits_a_hot_rank_value(spark, conf, no_broadcast):
    split_settings(conf)
    df = skewed(spark).repartition(16)
    ranked = ordered.value_ranks(df, "k", rank="r")
    assert "skew=true" in final_plan(ranked)
    hot = ranked.where("k = 7").select("r").distinct().collect()
    assert [r["r"] for r in hot] == [df.where("k > 7").count() + 1]
    assert ranked.count() == 60000


def test_adaptive_execution_splits_a_hot_absorbed_level(spark, conf, no_broadcast):
    df = skewed(spark).select(
        F.concat(F.lit("S"), F.col("k")).alias("sku"), (F.rand(1) + F.col("id") % 7).alias("p"), F.rand(2).alias("y"), "pad"
    ).repartition(16)
    fit = regression.fixed_effects_ols(df, "y", ["p"], "sku", [], "sku")
    split_settings(conf)
    with_residuals = regression.residuals(df, fit)
    assert "skew=true" in final_plan(with_residuals)
    assert with_residuals.count() == 60000


def test_hot_group_is_combined_before_the_shuffle(spark):
    df = skewed(spark).repartition(4)
    counted = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert "partial_count" in executed(counted)
    slices = ordered.running_totals(counted, [F.col("n").desc(), F.col("k").asc()], ["n"])
    assert slices.agg(F.max(F.col("n_before") + F.col("n"))).first()[0] == 60000


def hot_star(spark, folder, rows=60000):
    """Star tables in which one part, one order and one customer own a third of the rows."""

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def hot(spread):
        return F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % spread).cast("long")

    ids = spark.range(0, rows, 1, 16)
    save(ids.select(
        hot(4000).alias("l_orderkey"), hot(2000).alias("l_partkey"), (F.col("id") % 50).alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        (F.col("id") % 1000 + 1.0).alias("l_extendedprice"), ((F.col("id") % 11) / 100).alias("l_discount"), F.lit(0.01).alias("l_tax"),
        F.lit("R").alias("l_returnflag"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        F.lit("1997-03-04 00:00:00").cast("timestamp_ntz").alias("l_shipdate")), "lineitem")
    save(spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("o_orderkey"), hot(900).alias("o_custkey"),
        F.lit("1997-02-03 00:00:00").cast("timestamp_ntz").alias("o_orderdate")), "orders")
    save(spark.range(900).select(F.col("id").alias("c_custkey"), (F.col("id") % 4).cast("int").alias("c_nationkey"),
                                 F.lit("SEG").alias("c_mktsegment")), "customer")
    save(spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("TYPE").alias("p_type"), F.lit("Brand#1").alias("p_brand"),
                                  F.lit(5).alias("p_size")), "part")
    save(spark.range(4).select(F.col("id").cast("int").alias("n_nationkey"), F.lit(0).alias("n_regionkey")), "nation")
    save(spark.range(1).select(F.lit(0).alias("r_regionkey"), F.lit("EUROPE").alias("r_name")), "region")


def test_hot_keys_of_the_star_joins_are_split(spark, conf, no_broadcast, tmp_path):
    hot_star(spark, str(tmp_path))
    split_settings(conf)
    result = QUERIES["price_realization"](spark, str(tmp_path))
    plan = final_plan(result)
    assert plan.count("skew=true") >= 2
    assert result.agg(F.sum("total_units")).first()[0] == 120000
    semi = pricing.top_half_sku_orders(star.pricing_orders(spark, str(tmp_path), ["sku", "net_price"]))
    assert "skew=true" in final_plan(semi)
    assert semi.where("sku = 'SKU-1'").count() >= 20000


def test_wide_sums_per_sku_are_made_where_its_rows_lie_together(spark, conf, monkeypatch):
    """One wide sum for each SKU leaves the tasks, not one for nearly each row; a hot SKU is split and combined."""
    split_settings(conf)
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB")
    orders = skewed(spark, 30000).select(
        F.concat(F.lit("S"), F.col("k")).alias("sku"), F.lit("B").alias("business_unit"), F.lit(8.0).alias("net_price"),
        F.lit(10.0).alias("list_price"), F.lit(20.0).alias("discount_pct"), (F.col("id") % 5 + 1).alias("quantity"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("O"), F.col("id"))).alias("order_id"),
    ).repartition(16)
    staged, write = [], scenarios.stage
    monkeypatch.setattr(scenarios, "stage", lambda df, label: staged.append(df) or write(df, label))
    found = {r["sku"]: r for r in scenarios.sku_opportunities(orders).collect()}
    plan = final_plan(staged[0])
    # Printed above means run later: the sums of the tasks meet after the rows of a SKU.
    assert plan.index("ENSURE_REQUIREMENTS") < plan.index("REBALANCE_PARTITIONS_BY_COL")
    assert "skewed" in plan
    assert len(found) == orders.select("sku").distinct().count()
    quantity = sum(i % 5 + 1 for i in range(30000) if i % 3 == 0 or i % 5000 == 7)
    seen = sum(1 for i in range(0, 30000, 2) if i % 3 == 0 or i % 5000 == 7)
    hot = found["S7"]
    assert (hot["baseline_quantity"], hot["baseline_revenue"], hot["orders"]) == (quantity, 8.0 * quantity, seen)
