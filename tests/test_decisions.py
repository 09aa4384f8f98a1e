import pytest
from pyspark.sql import functions as F

from commercium.functions import exact_mean, exact_sum, mean_of_parts, sum_of_parts, sum_parts
from commercium.plans import decisions, mart, profiles
from commercium.registry import QUERIES


@pytest.fixture(scope="module")
def surface(spark, root):
    return QUERIES["decision_surface"](spark, root).cache()


def test_surface_has_one_row_per_key_and_known_labels(surface):
    assert surface.groupBy(*decisions.KEYS).count().where("count > 1").count() == 0
    assert {r[0] for r in surface.select("priority_band").distinct().collect()} <= {"High Priority", "Medium Priority", "Low Priority"}
    actions = {r[0] for r in surface.select("recommended_action").distinct().collect()}
    assert actions <= {decisions.ACTION_EXECUTION, decisions.ACTION_DELIVERY, decisions.ACTION_PROFIT, decisions.ACTION_PRICE,
                       decisions.ACTION_VALIDATE, decisions.ACTION_GROWTH, decisions.ACTION_MONITOR}


def test_execution_outranks_commercial_moves(surface):
    weak = surface.where("execution_score < 0.6999")
    assert weak.count() > 0 and weak.where(f"recommended_action <> '{decisions.ACTION_EXECUTION}'").count() == 0


def test_rules_are_parameters(spark, root):
    from commercium import registry

    orders = registry._orders(spark, root, "product_family", "region", "order_date", "revenue", "quantity", "discount_pct")
    from commercium.sources import star

    strict = decisions.decision_surface(
        decisions.pricing_surface(orders),
        decisions.execution_surface(registry._scored(spark, root)),
        registry._summary(spark, root),
        star.product_industry(spark, root),
        star.industry_growth(spark, root),
        decisions.DecisionRules(high_from=101.0, medium_from=101.0, execution_floor=2.0),
    )
    assert {tuple(r) for r in strict.select("priority_band", "recommended_action").distinct().collect()} == {
        ("Low Priority", decisions.ACTION_EXECUTION)
    }


def test_mix_shares_add_up(surface):
    assert decisions.decision_priority(surface).agg({"combinations": "sum"}).first()[0] == surface.count()
    assert decisions.action_mix(surface).agg({"share_pct": "sum"}).first()[0] == pytest.approx(100.0)


def test_mart_reports_published_and_missing(spark, tmp_path):
    result = spark.range(7)
    manifest = mart.publish_mart(spark, {"executive_kpis": result}, str(tmp_path), "csv")
    rows = {r["name"]: (r["rows"], r["status"]) for r in manifest.collect()}
    assert rows["executive_kpis"] == (7, "published") and rows["regional_risk"] == (None, "missing")
    path = {r["name"]: r["path"] for r in manifest.collect()}["executive_kpis"]
    assert path.endswith("/Product_Lifecycle/Dashboards/executive_kpis")
    assert spark.read.option("header", True).csv(str(tmp_path / path)).count() == 7
    assert mart.read_result(spark, str(tmp_path), "executive_kpis", "csv").count() == 7
    with pytest.raises(ValueError):
        mart.publish_mart(spark, {"other": result}, str(tmp_path))


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    got = {r["column_name"]: tuple(r)[1:] for r in profiles.null_profile(df).collect()}
    assert got == {"a": ("int", 1, 3), "b": ("string", 2, 3)}


def test_groupings_of_the_cube_equal_those_of_the_lines(spark, root):
    from commercium import registry
    from commercium.plans import lifecycle
    from commercium.sources import star

    def bag(df):
        return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)

    cube = decisions.line_cube(lifecycle.scored_initiatives(star.decision_lines(spark, root)))
    assert sum("lineitem" in f for f in cube.inputFiles()) == 1
    cube = cube.cache()
    orders = registry._orders(spark, root, "product_family", "region", "order_date", "revenue", "quantity", "discount_pct")
    assert bag(decisions.cube_pricing(cube)) == bag(decisions.pricing_surface(orders))
    assert bag(decisions.cube_execution(cube)) == bag(decisions.execution_surface(registry._scored(spark, root)))
    companies = decisions.cube_companies(cube)
    prices = star.with_own(spark, root, companies.drop("revenue"))
    assert bag(prices) == bag(star.competitor_pricing(spark, root))
    assert bag(star.revenue_shares(companies)) == bag(star.market_share(spark, root))
    yearly = decisions.cube_yearly(cube, star.industry_of(F.col("product_family")))
    assert bag(star.yearly_growth(yearly)) == bag(star.industry_growth(spark, root))


def test_the_surface_reads_no_fact_but_the_cube(surface):
    read = surface._jdf.queryExecution().analyzed().toString()
    assert "l_extendedprice" not in read and "o_orderdate" not in read


def test_parts_of_odd_values_add_up(spark):
    rows = [(1, None), (1, 0.1), (1, 0.2), (2, 1e16), (2, 0.5), (3, None), (4, float("nan")), (4, 1.0), (5, -0.3), (5, 0.3)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("i", F.monotonically_increasing_id() % 3)
    parts = df.groupBy("k", "i").agg(*sum_parts(F.col("v"), "v")).groupBy("k")
    got = parts.agg(sum_of_parts("v").alias("s"), mean_of_parts("v").alias("m"))
    want = df.groupBy("k").agg(exact_sum("v").alias("s"), exact_mean("v").alias("m"))
    assert [str(r) for r in got.orderBy("k").collect()] == [str(r) for r in want.orderBy("k").collect()]
