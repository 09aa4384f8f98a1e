import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commercium.operators import ordered


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(6)


def test_running_totals_match_a_sequential_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in rng.sample(range(100000), 3000)]
    df = table(spark, rows, "g string, k long, m long")
    got = ordered.running_totals(df, [F.col("k").desc()], ["m"], ["g"]).collect()
    expected, totals = {}, defaultdict(int)
    for g, k, m in sorted(rows, key=lambda r: -r[1]):
        expected[(g, k)] = totals[g]
        totals[g] += m
    assert {(r["g"], r["k"]): r["m_before"] for r in got} == expected
    assert all(r["m_total"] == totals[r["g"]] for r in got)


def test_running_totals_use_several_slices(spark):
    df = spark.range(0, 200000).withColumn("m", F.lit(1))
    got = ordered.running_totals(df, [F.col("id").asc()], ["m"])
    assert got.where("m_before <> id or m_total <> 200000").count() == 0


def test_ranks_with_ties_hot_values_and_nulls(spark):
    rng = random.Random(2)
    values = [5.0] * 400 + [rng.choice([1.0, 2.5, 9.0, None]) for _ in range(600)]
    rows = [(rng.choice(["x", "y"]), i, v) for i, v in enumerate(values)]
    df = table(spark, rows, "g string, i long, v double")
    got = ordered.value_ranks(df, "v", ["g"], rank="r", dense_rank="d")
    assert got.count() == len(rows)
    df.createOrReplaceTempView("ranked_input")
    expected = spark.sql(
        "select i, rank() over (partition by g order by v desc) r, "
        "dense_rank() over (partition by g order by v desc) d from ranked_input"
    )
    assert {tuple(r) for r in got.select("i", "r", "d").collect()} == {tuple(r) for r in expected.collect()}


def test_top_ranked_keeps_ties(spark):
    rows = [("a", v) for v in (9, 9, 8, 7, 7, 7, 6)] + [("b", v) for v in (1, 1, 1, 1, 1, 1, 0)]
    got = ordered.top_ranked(table(spark, rows, "g string, v long"), "v", 5, ["g"], "r").collect()
    assert sorted(map(tuple, got)) == sorted(
        [("a", 9, 1), ("a", 9, 1), ("a", 8, 3), ("a", 7, 4), ("a", 7, 4), ("a", 7, 4)] + [("b", 1, 1)] * 6
    )


def test_number_rows(spark):
    df = table(spark, [(i, (i * 7919) % 101) for i in range(1000)], "i long, v long")
    got = ordered.number_rows(df, [F.col("v").desc(), F.col("i").asc()], "n").collect()
    in_order = sorted(got, key=lambda r: r["n"])
    assert [r["n"] for r in in_order] == list(range(1, 1001))
    assert [(r["v"], r["i"]) for r in in_order] == sorted(((r["v"], r["i"]) for r in got), key=lambda t: (-t[0], t[1]))


def test_number_copies_expands_a_hot_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_RUN_CHUNK", 100)
    rows = [("a", 3, "hot")] * 1001 + [("a", v, f"t{v}") for v in range(10)] + [("b", 1, "z"), ("b", 1, "y")]
    df = table(spark, rows, "g string, v long, t string")
    got = ordered.number_copies(df, [F.col("v").desc(), F.col("t").asc()], "n", ["g"]).collect()
    assert len(got) == len(rows)
    for g in "ab":
        numbered = sorted((r["n"], r["v"], r["t"]) for r in got if r["g"] == g)
        assert [n for n, _, _ in numbered] == list(range(1, len(numbered) + 1))
        assert [(v, t) for _, v, t in numbered] == sorted(
            ((v, t) for k, v, t in rows if k == g), key=lambda p: (-p[0], p[1])
        )


@pytest.mark.parametrize("p", [0.0, 0.01, 0.05, 0.5, 0.9, 0.99, 1.0])
def test_quantiles_interpolate_like_numpy(spark, p):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=501).round(2), "b": np.array([4.0]), "c": np.repeat([1.0, 8.0], [300, 200])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)]
    got = ordered.quantiles(table(spark, rows, "g string, v double"), "v", {"q": p}, ["g"])
    for r in got.collect():
        assert r["q"] == pytest.approx(np.quantile(values[r["g"]], p), abs=1e-12)


def test_previous_in_order_crosses_slices(spark):
    df = spark.range(0, 50000).withColumn("v", F.col("id") * 2)
    got = ordered.previous_in_order(df, [F.col("id").asc()], "v", "p")
    assert got.where("id > 0 and p <> v - 2").count() == 0
    assert got.where("id > 0 and p is null").count() == 0
    assert got.where("id = 0").first()["p"] is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-3, 3)), min_size=1, max_size=60), st.floats(0, 1))
def test_ranks_and_quantiles_of_any_small_table(spark, rows, p):
    df = spark.createDataFrame([(g, float(v), i) for i, (g, v) in enumerate(rows)], "g string, v double, i long")
    ranks = {r["i"]: (r["r"], r["d"]) for r in ordered.value_ranks(df, "v", ["g"], "r", "d").collect()}
    for i, (g, v) in enumerate(rows):
        above = [w for h, w in rows if h == g and w > v]
        assert ranks[i] == (len(above) + 1, len(set(above)) + 1)
    for r in ordered.quantiles(df, "v", {"q": p}, ["g"]).collect():
        assert r["q"] == pytest.approx(np.quantile([v for g, v in rows if g == r["g"]], p), abs=1e-9)
