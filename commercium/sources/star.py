"""Canonical analytics tables derived from a star schema of parquet files.

Attributes are looked up by primary key with left joins, so a line item is
never dropped or repeated and a lookup that no wanted column needs can be left
out of the plan.  Large lookups join by shuffle, where adaptive execution
splits a hot key; whether a side is small enough to broadcast is Spark's
decision from its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commercium.functions import exact_mean, exact_sum, month_start, quarter_label


def star_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def _regions(spark: SparkSession, root: str) -> DataFrame:
    nation = star_table(spark, root, "nation").select("n_nationkey", "n_regionkey")
    region = star_table(spark, root, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "region"
    )


def _order_lookup(spark: SparkSession, root: str, wanted: set[str]) -> DataFrame:
    orders = star_table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date")
    )
    if not wanted & {"customer_tier", "region"}:
        return orders.select("o_orderkey", "order_date")
    customer = star_table(spark, root, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("customer_tier")
    )
    orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    if "region" in wanted:
        regions = _regions(spark, root)
        orders = orders.join(regions, orders.c_nationkey == regions.n_nationkey, "left")
    keep = [c for c in ("o_orderkey", "order_date", "customer_tier", "region") if c in orders.columns]
    return orders.select(*keep)


def _pick(expressions: dict[str, Column], columns: Sequence[str] | None) -> list[Column]:
    return [expressions[c].alias(c) for c in (columns or expressions)]


PRICING_COLUMNS = [
    "order_id",
    "order_date",
    "business_unit",
    "sku",
    "region",
    "channel",
    "customer_tier",
    "list_price",
    "net_price",
    "discount_pct",
    "quantity",
    "revenue",
]


def pricing_orders(
    spark: SparkSession, root: str, columns: Sequence[str] | None = PRICING_COLUMNS
) -> DataFrame:
    """Order lines with price, discount and commercial attributes."""
    wanted = set(columns)
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    expressions = {
        "order_id": F.concat(F.lit("ORD-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")),
        "order_date": F.col("order_date"),
        "business_unit": F.col("p_type"),
        "product_family": F.col("p_brand"),
        "sku": F.concat(F.lit("SKU-"), F.col("l_partkey")),
        "region": F.col("region"),
        "channel": F.when(F.col("l_linestatus") == "O", "Direct").otherwise("Distributor"),
        "customer_tier": F.col("customer_tier"),
        "list_price": unit_price,
        "net_price": unit_price * (1 - F.col("l_discount")),
        "discount_pct": F.col("l_discount") * 100,
        "quantity": F.col("l_quantity").cast("bigint"),
        "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }
    fact = star_table(spark, root, "lineitem")
    if wanted & {"order_date", "customer_tier", "region"}:
        lookup = _order_lookup(spark, root, wanted)
        fact = fact.join(lookup, fact.l_orderkey == lookup.o_orderkey, "left")
    if wanted & {"business_unit", "product_family"}:
        part = star_table(spark, root, "part").select("p_partkey", "p_type", "p_brand")
        fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")
    return fact.select(*_pick({c: expressions[c] for c in columns}, columns))


def raw_material_index(spark: SparkSession, root: str) -> DataFrame:
    """Monthly input-cost index: mean unit price of the lines shipped in the month."""
    line = star_table(spark, root, "lineitem")
    return line.groupBy(
        month_start(F.col("l_shipdate").cast("date")).alias("observation_date")
    ).agg(exact_mean(F.col("l_extendedprice") / F.col("l_quantity")).alias("ppi_index"))


INITIATIVE_COLUMNS = [
    "initiative_id",
    "initiative_name",
    "business_unit",
    "product_family",
    "region",
    "owner",
    "priority",
    "lifecycle_stage",
    "quarter",
    "checkpoint",
    "planned_revenue",
    "actual_revenue",
    "planned_otd_pct",
    "actual_otd_pct",
    "backlog_days",
    "customer_adoption_pct",
    "gross_margin_pct",
    "budget_utilization_pct",
]


def _plan_and_actuals() -> dict[str, Column]:
    return {
        "planned_revenue": F.col("l_extendedprice"),
        "actual_revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")),
        "planned_otd_pct": F.lit(95),
        "actual_otd_pct": 82 + F.col("l_tax") * 200,
        "backlog_days": (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 91,
        "customer_adoption_pct": (F.col("p_size") * 2).cast("double"),
        "gross_margin_pct": 15 + F.col("l_discount") * 350,
        "budget_utilization_pct": 60 + F.col("l_quantity"),
    }


def initiatives(
    spark: SparkSession, root: str, columns: Sequence[str] | None = INITIATIVE_COLUMNS
) -> DataFrame:
    """Initiative observations: plan, actuals and execution measures per checkpoint."""
    wanted = set(columns)
    key = F.col("l_suppkey")
    expressions = {
        "initiative_id": F.concat(F.lit("INIT-"), key),
        "initiative_name": F.col("s_name"),
        "business_unit": F.concat(F.lit("BU-"), key % 4),
        "product_family": F.col("p_brand"),
        "region": F.col("region"),
        "owner": F.concat(F.lit("PMM_"), key % 20),
        "priority": F.when(key % 3 == 0, "High").when(key % 3 == 1, "Medium").otherwise("Low"),
        "lifecycle_stage": F.when(key % 5 == 0, "Launch")
        .when(key % 5 == 2, "Mature")
        .when(key % 5 == 4, "Decline")
        .otherwise("Growth"),
        "quarter": quarter_label(F.col("order_date")),
        "checkpoint": F.concat(F.lit("Month"), (F.month("order_date") - 1) % 3 + 1),
        **_plan_and_actuals(),
    }
    fact = star_table(spark, root, "lineitem")
    if wanted & {"quarter", "checkpoint"}:
        lookup = _order_lookup(spark, root, {"order_date"})
        fact = fact.join(lookup, fact.l_orderkey == lookup.o_orderkey, "left")
    if wanted & {"initiative_name", "region"}:
        supplier = star_table(spark, root, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        if "region" in wanted:
            regions = _regions(spark, root)
            supplier = supplier.join(
                regions, supplier.s_nationkey == regions.n_nationkey, "left"
            )
        fact = fact.join(supplier, fact.l_suppkey == supplier.s_suppkey, "left")
    if wanted & {"product_family", "customer_adoption_pct"}:
        part = star_table(spark, root, "part").select("p_partkey", "p_brand", "p_size")
        fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")
    return fact.select(*_pick({c: expressions[c] for c in columns}, columns))


def _company_lines(spark: SparkSession, root: str) -> DataFrame:
    line = star_table(spark, root, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    supplier = star_table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    regions = _regions(spark, root).withColumnRenamed("region", "company")
    companies = supplier.join(regions, supplier.s_nationkey == regions.n_nationkey, "left")
    part = star_table(spark, root, "part").select(
        "p_partkey", F.col("p_brand").alias("product_family"), "p_size"
    )
    return line.join(companies, line.l_suppkey == companies.s_suppkey, "left").join(
        part, line.l_partkey == part.p_partkey, "left"
    )


def competitor_pricing(spark: SparkSession, root: str) -> DataFrame:
    """Mean unit price per product family and company; the first company is our own."""
    prices = (
        _company_lines(spark, root)
        .groupBy("product_family", "company")
        .agg(exact_mean(F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_price_usd"))
    )
    return with_own(spark, root, prices)


def with_own(spark: SparkSession, root: str, prices: DataFrame) -> DataFrame:
    own = star_table(spark, root, "region").agg(F.min("r_name")).scalar()
    return prices.withColumn("is_own", (F.col("company") == own).cast("int"))


def market_share(spark: SparkSession, root: str) -> DataFrame:
    """Revenue share of each company in its product family."""
    revenue = (
        _company_lines(spark, root)
        .groupBy("product_family", "company")
        .agg(exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    )
    return revenue_shares(revenue)


def revenue_shares(revenue: DataFrame) -> DataFrame:
    """Percent of each company in the revenue of its product family."""
    family = Window.partitionBy("product_family")
    return revenue.select(
        "product_family",
        "company",
        (F.col("revenue") * 100 / exact_sum("revenue", family)).alias("market_share_pct"),
    )


def industry_of(family: Column) -> Column:
    return F.concat(F.lit("IND-"), F.substring(family, 7, 10).cast("int") % 5)


def product_industry(spark: SparkSession, root: str) -> DataFrame:
    """Industry and stated market position of every product family."""
    family = F.col("product_family")
    return (
        star_table(spark, root, "part")
        .select(F.col("p_brand").alias("product_family"))
        .distinct()
        .select(
            family,
            industry_of(family).alias("industry"),
            F.when(F.substring(family, 7, 10).cast("int") % 3 == 0, "Challenger")
            .otherwise("Leader")
            .alias("market_position"),
        )
    )


def industry_growth(spark: SparkSession, root: str) -> DataFrame:
    """Year-on-year revenue growth per industry."""
    fact = star_table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount"
    )
    lookup = _order_lookup(spark, root, {"order_date"})
    part = star_table(spark, root, "part").select("p_partkey", "p_brand")
    yearly = (
        fact.join(lookup, fact.l_orderkey == lookup.o_orderkey, "left")
        .join(part, fact.l_partkey == part.p_partkey, "left")
        .groupBy(industry_of(F.col("p_brand")).alias("industry"), F.year("order_date").alias("year"))
        .agg(exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    )
    return yearly_growth(yearly)


def yearly_growth(yearly: DataFrame) -> DataFrame:
    """Growth over the year before in percent, of (industry, year, revenue)."""
    before = F.lag("revenue").over(Window.partitionBy("industry").orderBy("year"))
    return yearly.select(
        "industry", "year", (F.lit(100) * (F.try_divide(F.col("revenue"), before) - 1)).alias("growth_pct")
    )


def decision_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with all that the decision surface asks of them, from one read of the fact.

    ``region`` is that of the customer, ``company`` that of the supplier.
    """
    line = star_table(spark, root, "lineitem")
    lookup = _order_lookup(spark, root, {"order_date", "region"})
    supplier = star_table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    regions = _regions(spark, root).withColumnRenamed("region", "company")
    companies = supplier.join(regions, supplier.s_nationkey == regions.n_nationkey, "left").select("s_suppkey", "company")
    part = star_table(spark, root, "part").select("p_partkey", "p_brand", "p_size")
    fact = (
        line.join(lookup, line.l_orderkey == lookup.o_orderkey, "left")
        .join(companies, line.l_suppkey == companies.s_suppkey, "left")
        .join(part, line.l_partkey == part.p_partkey, "left")
    )
    return fact.select(
        F.col("p_brand").alias("product_family"),
        "region",
        "company",
        quarter_label(F.col("order_date")).alias("quarter"),
        F.year("order_date").alias("year"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        *[c.alias(name) for name, c in _plan_and_actuals().items()],
    )


def raw_order_feed(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as an untyped feed: free-form column names, text values."""

    def text(value: Column) -> Column:
        return value.cast("decimal(28,10)").cast("string")

    line = star_table(spark, root, "lineitem")
    lookup = _order_lookup(spark, root, {"order_date", "customer_tier", "region"})
    part = star_table(spark, root, "part").select("p_partkey", "p_type")
    fact = line.join(lookup, line.l_orderkey == lookup.o_orderkey, "left").join(
        part, line.l_partkey == part.p_partkey, "left"
    )
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    return fact.select(
        F.col("order_date").cast("string").alias(" Order Date "),
        F.concat(F.lit("SKU-"), F.col("l_partkey")).alias("Product SKU"),
        F.col("l_quantity").cast("bigint").cast("string").alias("QTY"),
        text(unit_price * (1 - F.col("l_discount"))).alias("Selling Price"),
        text(unit_price).alias("List Price"),
        F.col("p_type").alias("Business Unit"),
        F.col("region").alias("Region"),
        F.when(F.col("l_linestatus") == "O", "Direct").otherwise("Distributor").alias("Channel"),
        F.col("customer_tier").alias("Customer Segment"),
    )
