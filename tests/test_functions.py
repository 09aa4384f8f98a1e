import datetime
import math
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from commercium.functions import (
    clip,
    exact_mean,
    exact_sum,
    month_start,
    quarter_label,
    quarter_start,
    ratio,
    round_half_even,
    round_half_up,
)
from commercium.functions import scalars


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_half_up_decides_ties_on_the_decimal_value(spark):
    cases = [(1.005, 1.01), (1.0049999999999, 1.0), (2.675, 2.68), (-0.125, -0.13), (45.004, 45.0), (1163249.5049999998, 1163249.51)]
    for x, expected in cases:
        assert value(spark, round_half_up(F.lit(x), 2)) == expected


def test_half_up_rounds_once_and_keeps_what_has_no_places(spark):
    for x, expected in [(1.00499996, 1.0), (1.0049, 1.0), (1234567890123.25, 1234567890123.25), (1e33, 1e33), (float("inf"), float("inf")), (0, 0.0)]:
        assert value(spark, round_half_up(F.lit(x), 2)) == expected
    assert math.isnan(value(spark, round_half_up(F.lit(float("nan")), 2)))
    assert value(spark, round_half_up(F.lit(None).cast("double"), 2)) is None


def test_half_up_writes_digits_out_only_near_a_half(spark, monkeypatch):
    generator = random.Random(3)
    values = [generator.uniform(-1, 1) * 10 ** generator.randint(-5, 14) for _ in range(500)]
    halves = [(generator.randrange(10**6) + 0.5) / 100 for _ in range(500)]
    near = [math.nextafter(h, toward) for h in halves for toward in (0, math.inf)]
    rows = spark.createDataFrame([(v,) for v in [*values, *halves, *near, 0.0, -0.0, -0.001]], "v double")
    both = rows.select(round_half_up(F.col("v"), 2).alias("a"), scalars._round_written(F.col("v"), 2).alias("b")).collect()
    assert [math.copysign(1, r.a) * abs(r.a) for r in both] == [r.b for r in both]
    monkeypatch.setattr(scalars, "_round_written", lambda number, digits: F.raise_error(F.lit("written out")).cast("double"))
    plain = spark.createDataFrame([(1.234,), (-7.0,), (99999.991,), (0.0,)], "v double")
    assert [r.v for r in plain.select(round_half_up(F.col("v"), 2).alias("v")).collect()] == [1.23, -7.0, 99999.99, 0.0]


def test_exact_sums_do_not_depend_on_order_or_partitions(spark):
    """Values of very unlike size, where a plain sum shows the order of its rows."""
    generator = random.Random(7)
    values = [round(generator.uniform(-1, 1) * 10 ** generator.randint(-6, 10), 6) for _ in range(5_000)]
    true = sum((Decimal(str(v)) for v in values), Decimal(0))
    seen = set()
    for parts in (1, 3, 17):
        generator.shuffle(values)
        rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        seen.add(tuple(rows.agg(exact_sum("v"), exact_mean("v")).first()))
    assert seen == {(float(true), float(true) / len(values))}


def test_exact_sums_of_nothing_and_of_what_has_no_decimals(spark):
    rows = spark.createDataFrame(
        [("none", None), ("some", None), ("some", 0.1), ("some", 0.2), ("large", 1e300), ("large", 1.0),
         ("infinite", float("inf")), ("infinite", 1.0), ("nan", float("nan"))],
        "k string, v double",
    )
    got = {k: (s, m) for k, s, m in rows.groupBy("k").agg(exact_sum("v"), exact_mean("v")).collect()}
    assert got["none"] == (None, None)
    assert got["some"] == (0.3, 0.15)
    assert got["large"] == (1e300, 5e299)
    assert got["infinite"] == (float("inf"), float("inf"))
    assert math.isnan(got["nan"][0])
    assert [tuple(r) for r in rows.limit(0).agg(exact_sum("v"), exact_mean("v")).collect()] == [(None, None)]


def test_exact_sums_over_a_window(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 5.0), ("b", None)], "k string, v double")
    shown = rows.select("k", exact_sum("v", Window.partitionBy("k")).alias("s")).distinct().collect()
    assert sorted(map(tuple, shown)) == [("a", 0.3), ("b", 5.0)]


def test_half_even_matches_binary_rounding(spark):
    for x, digits, expected in [(0.8125, 3, 0.812), (0.8135, 3, 0.814), (2.5, 0, 2.0), (8.345, 2, 8.35)]:
        assert value(spark, round_half_even(F.lit(x), digits)) == round(x * 10**digits) / 10**digits
        assert value(spark, round_half_even(F.lit(x), digits)) == expected


def test_clip_keeps_null_and_bounds(spark):
    assert value(spark, clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert [value(spark, clip(F.lit(x), 0.0, 1.0)) for x in (-1.0, 0.4, 7.0)] == [0.0, 0.4, 1.0]


def test_ratio_is_null_on_zero_denominator(spark):
    assert value(spark, ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, ratio(F.lit(1), F.lit(4))) == 0.25


def test_calendar_keys(spark):
    day = F.lit(datetime.date(2024, 5, 17))
    assert value(spark, quarter_start(day)) == datetime.date(2024, 4, 1)
    assert value(spark, quarter_label(day)) == "2024Q2"
    assert value(spark, month_start(day)) == datetime.date(2024, 5, 1)
