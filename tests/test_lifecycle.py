import pytest
from pyspark.sql import functions as F

from commercium.plans import lifecycle, risk
from commercium.sources import star

INPUT = (
    "initiative_id string, initiative_name string, business_unit string, product_family string, region string, "
    "owner string, priority string, lifecycle_stage string, quarter string, checkpoint string, "
    "planned_revenue double, actual_revenue double, planned_otd_pct int, actual_otd_pct double, backlog_days bigint, "
    "customer_adoption_pct double, gross_margin_pct double, budget_utilization_pct double"
)


def row(i, planned, actual, otd, backlog, adoption, margin, budget, quarter="2024Q1", region="R1"):
    return (f"I{i}", f"Initiative {i}", "BU", "Family", region, "Owner", "High", "Launch", quarter, "Month1",
            planned, actual, 95, otd, backlog, adoption, margin, budget)


# Three published watchlist rows, inputs and scores.
PUBLISHED = [
    (row(1, 122255.95, 103933.56, 82.8, 78, 42.4, 33.1, 87.0),
     (0.85, 0.872, 0.133, 0.424, 0.662, 0.74, 0.674, 0.502, "Red", "High", 40.63)),
    (row(2, 186453.17, 156363.61, 86.5, 75, 30.1, 42.1, 82.7, "2025Q4"),
     (0.839, 0.911, 0.167, 0.301, 0.842, 0.654, 0.68, 0.539, "Red", "High", 39.19)),
    (row(3, 181344.47, 164639.81, 80.2, 80, 55.5, 38.2, 88.0, "2025Q3"),
     (0.908, 0.844, 0.111, 0.555, 0.764, 0.76, 0.711, 0.478, "Red", "High", 38.8)),
]
FIELDS = ["revenue_attainment", "otd_attainment", "backlog_score", "adoption_score", "margin_score", "budget_score",
          "aos_health", "execution_score", "status", "risk_category", "risk_score"]


def frame(spark, rows):
    return spark.createDataFrame(rows, INPUT)


def test_published_rows_score_as_published(spark):
    scored = lifecycle.initiative_scores(frame(spark, [r for r, _ in PUBLISHED]))
    got = {r["initiative_id"]: r for r in risk.initiative_risk(scored).collect()}
    for source, expected in PUBLISHED:
        assert tuple(got[source[0]][f] for f in FIELDS) == expected
    assert got["I1"]["revenue_variance_pct"] == pytest.approx(-14.986910657518102)
    assert got["I1"]["otd_variance_pct"] == pytest.approx(-12.2)


def test_components_are_clipped(spark):
    scored = lifecycle.scored_initiatives(
        frame(spark, [row(1, 100.0, 900.0, 200.0, 500, 150.0, 90.0, 300.0), row(2, 100.0, -5.0, -1.0, 0, -3.0, -2.0, 100.0)])
    ).orderBy("initiative_id").collect()
    assert [scored[0][f] for f in FIELDS[:6]] == [1.25, 1.1, 0.0, 1.0, 1.0, 0.0]
    assert [scored[1][f] for f in FIELDS[:6]] == [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_bands_include_their_lower_edge(spark):
    scores = spark.createDataFrame([(0.90,), (0.8999999,), (0.75,), (0.7499999,)], ["s"])
    got = [r[0] for r in scores.select(lifecycle._band(F.col("s"), "Green", "Amber", "Red")).collect()]
    assert got == ["Green", "Amber", "Amber", "Red"]


def test_rank_uses_unrounded_health_within_quarter(spark):
    rows = [row(i, 100.0, 100.0 + i * 1e-4, 95.0, 10, 50.0, 30.0, 90.0, q) for i, q in [(1, "q1"), (2, "q1"), (3, "q2")]]
    got = {r["initiative_id"]: (r["priority_rank"], r["aos_health"]) for r in lifecycle.initiative_scores(frame(spark, rows)).collect()}
    assert got["I1"][1] == got["I2"][1]
    assert (got["I2"][0], got["I1"][0], got["I3"][0]) == (1, 2, 1)


def test_scores_write_only_what_they_are_made_of(spark, root, monkeypatch):
    written, kept = [], lifecycle.stage
    monkeypatch.setattr(lifecycle, "stage", lambda df, *rest: written.append(df.columns) or kept(df, *rest))
    rows = star.initiatives(spark, root)
    scores = lifecycle.initiative_scores(rows)
    assert written == [rows.columns]
    assert scores.columns == [*lifecycle.health_measures(rows).columns, "priority_rank"]


def test_quick_risk_level_is_another_rule(spark):
    rows = [row(1, 100.0, 100.0, 95.0, 0, 0, 0, 0), row(2, 100.0, 80.0, 90.0, 45, 0, 0, 0), row(3, 100.0, 50.0, 80.0, 400, 0, 0, 0)]
    rows = [tuple(float(v) if 15 <= n else v for n, v in enumerate(r)) for r in rows]
    got = [r["risk_level"] for r in lifecycle.quick_risk_level(frame(spark, rows)).orderBy("initiative_id").collect()]
    assert got == ["Low", "Medium", "High"]


@pytest.mark.parametrize(
    "rows",
    [
        # Published means per dimension and the index they give.
        [("A", 0.8457844827586207, 34.25, 49.25), ("B", 0.8699366666666667, 23.31833333333333, 35.04),
         ("C", 0.8779230769230768, 20.459935897435898, 31.22)],
        [("I", 0.8443291666666667, 29.520833333333332, 49.34), ("J", 0.8666516666666666, 26.945, 44.51),
         ("K", 0.8798229166666667, 25.0125, 41.1), ("L", 0.8635222222222222, 22.925, 39.25)],
    ],
)
def test_dimension_index_reproduces_published_scores(spark, rows):
    scored = spark.createDataFrame(
        [(k, a, b, 90.0, 1.0, "I") for k, a, b, _ in rows],
        "region string, aos_health double, backlog_days double, actual_otd_pct double, actual_revenue double, initiative_id string",
    )
    got = [(r["region"], r["risk_score"]) for r in risk.regional_risk(scored).collect()]
    assert got == [(k, s) for k, _, _, s in rows]


def test_watchlist_lists_rows_and_quantile_is_inclusive(spark):
    base = frame(spark, [row(i % 4, 100.0, 60.0 + i, 80.0, 60 - i, 50.0, 30.0, 90.0) for i in range(40)])
    scored = risk.initiative_risk(lifecycle.scored_initiatives(base))
    watch = risk.executive_watchlist(scored).collect()
    assert len(watch) == 25
    assert [r["risk_score"] for r in watch] == sorted((r["risk_score"] for r in watch), reverse=True)
    high = risk.high_risk_initiatives(scored)
    threshold = scored.selectExpr("percentile(risk_score, 0.9)").first()[0]
    assert high.count() == scored.where(F.col("risk_score") >= threshold).count() > 0


def test_summary_counts_and_dropped_null_keys(spark):
    rows = [row(1, 100.0, 100.0, 95.0, 0, 90.0, 45.0, 100.0), row(1, 100.0, 50.0, 80.0, 80, 10.0, 10.0, 60.0),
            row(2, 100.0, 100.0, 95.0, 0, 90.0, 45.0, 100.0, region=None)]
    scored = lifecycle.scored_initiatives(frame(spark, rows))
    got = {r["region"]: r for r in lifecycle.aos_summary(scored).collect()}
    assert (got["R1"]["initiatives"], got["R1"]["observations"], got["R1"]["green_count"], got["R1"]["red_count"]) == (1, 2, 1, 1)
    assert None in got
    assert [r["region"] for r in lifecycle.plcm_summary(scored).collect()] == ["R1"]
