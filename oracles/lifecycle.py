"""Oracles of the lifecycle and risk queries."""

from oracles.common import SCORED, r, rounded, with_tables


def _scored(body: str) -> str:
    return with_tables(body, *SCORED)


def _risk(body: str) -> str:
    return with_tables(body, *SCORED, "risk")


def _avg(column: str, digits: int = 2) -> str:
    return r(f"favg({column})", digits)


_ATTAINMENT = r("favg(revenue_attainment) * 100", 2)
_REVENUE = r("fsum(actual_revenue)", 2)


def _status(green: str, amber: str, red: str) -> str:
    return ", ".join(
        f"count(*) filter (status = '{band}') as {name}"
        for band, name in (("Green", green), ("Amber", amber), ("Red", red))
    )


_LIFECYCLE = f"""
select lifecycle_stage, business_unit, count(distinct initiative_id) as initiatives,
       {_avg('aos_health', 3)} as avg_aos, {_ATTAINMENT} as revenue_attainment_pct,
       {_avg('actual_otd_pct')} as avg_otd, {_avg('backlog_days')} as avg_backlog,
       {_avg('customer_adoption_pct')} as avg_adoption, {_avg('gross_margin_pct')} as avg_margin,
       {_REVENUE} as total_revenue
from scored group by lifecycle_stage, business_unit"""


def _dimension(column: str) -> str:
    score = "(1 - avg_aos) * 60 + avg_backlog / (select max(avg_backlog) from means) * 40"
    return _scored(f""",
means as (select {column}, favg(aos_health) as avg_aos, favg(backlog_days) as avg_backlog,
                 favg(actual_otd_pct) as avg_otd, fsum(actual_revenue) as revenue,
                 count(distinct initiative_id) as initiatives
          from scored group by {column})
select {column}, {r('avg_aos', 6)} as avg_aos, {r('avg_backlog', 6)} as avg_backlog,
       {r('avg_otd', 6)} as avg_otd, {r('revenue', 2)} as revenue, initiatives,
       round_even(({score}) * 100, 0) / 100 as risk_score
from means""")


def _worst(column: str) -> str:
    return f"""(select {column} from (
  select {column}, round_even(((1 - avg_aos) * 60 + avg_backlog / max(avg_backlog) over () * 40) * 100, 0) / 100 as s
  from (select {column}, favg(aos_health) as avg_aos, favg(backlog_days) as avg_backlog
        from scored group by {column}) m) t order by s desc, {column} desc limit 1)"""


LIFECYCLE = {
    "table_round_trip": _scored(_LIFECYCLE),
    "initiative_scores": _scored("""
select * exclude (raw_health),
       dense_rank() over (partition by quarter order by raw_health desc) as priority_rank
from scored"""),
    "quick_risk_level": with_tables("""
select initiative_id, actual_revenue, planned_revenue, actual_otd_pct, backlog_days,
       case when score >= 0.9::double then 'Low' when score >= 0.75::double then 'Medium' else 'High' end as risk_level
from (select *, actual_revenue / planned_revenue * 0.5::double + actual_otd_pct / 95 * 0.3::double
                + (1 - least(backlog_days, 90) / 90) * 0.2::double as score from initiatives) i""", "initiatives"),
    "revenue_attainment": _scored(f"""
select initiative_id, initiative_name, business_unit, region, quarter, planned_revenue, actual_revenue,
       {r('actual_revenue - planned_revenue', 2)} as revenue_variance,
       {r('actual_revenue / planned_revenue * 100', 2)} as revenue_attainment_pct, status, risk_category
from scored"""),
    "aos_summary": _scored(f"""
select business_unit, region, count(distinct initiative_id) as initiatives, count(*) as observations,
       {_avg('aos_health', 3)} as avg_aos, {_ATTAINMENT} as revenue_attainment_pct,
       {_avg('actual_otd_pct')} as avg_otd_pct, {_avg('backlog_days')} as avg_backlog_days,
       {_REVENUE} as total_revenue, {_status('green_count', 'amber_count', 'red_count')}
from scored group by business_unit, region"""),
    "otd_analysis": _scored(f"""
select business_unit, region, quarter, {_avg('planned_otd_pct')} as planned_otd,
       {_avg('actual_otd_pct')} as actual_otd, {_avg('actual_otd_pct - planned_otd_pct')} as otd_variance,
       {_avg('backlog_days')} as avg_backlog, count(*) filter (actual_otd_pct >= 95) as on_time_initiatives,
       count(*) as total_records
from scored group by business_unit, region, quarter"""),
    "backlog_analysis": _scored("""
select initiative_id, initiative_name, business_unit, region, quarter, backlog_days, status, risk_category,
       row_number() over (partition by region order by backlog_days desc, initiative_id, initiative_name,
                          business_unit, quarter, status, risk_category) as backlog_rank
from scored"""),
    "lifecycle_analysis": _scored(_LIFECYCLE),
    "executive_kpis": _scored(f"""
select count(distinct initiative_id) as total_initiatives, count(*) as observations,
       {_avg('aos_health', 3)} as avg_aos, {_avg('actual_otd_pct')} as avg_otd,
       {_avg('backlog_days')} as avg_backlog, {_REVENUE} as total_revenue, {_status('green', 'amber', 'red')}
from scored"""),
    "region_dashboard": _scored(f"""
select region, count(distinct initiative_id) as initiatives, {_avg('aos_health', 3)} as avg_aos,
       {_avg('actual_otd_pct')} as avg_otd, {_avg('backlog_days')} as avg_backlog, {_REVENUE} as total_revenue
from scored group by region"""),
    "owner_dashboard": _scored(f"""
select owner, count(distinct initiative_id) as initiatives, {_avg('aos_health', 3)} as avg_aos,
       {_avg('actual_otd_pct')} as avg_otd, {_REVENUE} as total_revenue
from scored group by owner"""),
    "plcm_summary": _scored(f"""
select business_unit, region, count(distinct initiative_id) as initiatives,
       count(initiative_id) as observations, round_even(favg(aos_health) * 1000, 0) / 1000 as avg_aos,
       {_avg('revenue_attainment', 6)} as avg_revenue_attainment, {_avg('actual_otd_pct', 6)} as avg_otd,
       {_avg('backlog_days', 6)} as avg_backlog, {_REVENUE} as total_revenue
from scored group by business_unit, region"""),
    "initiative_ranking": _scored(rounded("""
select *, row_number() over (order by avg_aos desc, initiative_id, initiative_name, business_unit) as rank
from (select initiative_id, initiative_name, business_unit, round(favg(aos_health), 10) as avg_aos,
             fsum(actual_revenue) as total_revenue, favg(actual_otd_pct) as avg_otd,
             favg(backlog_days) as avg_backlog
      from scored group by initiative_id, initiative_name, business_unit) a""",
        {"initiative_id": None, "initiative_name": None, "business_unit": None, "avg_aos": 6,
         "total_revenue": 2, "avg_otd": 6, "avg_backlog": 6, "rank": None})),
    "initiative_risk": _risk("select * from risk"),
    "executive_watchlist": _risk("""
select * from risk order by risk_score desc, initiative_id, initiative_name, business_unit, product_family,
  region, owner, priority, lifecycle_stage, quarter, checkpoint, planned_revenue, actual_revenue limit 25"""),
    "high_risk_initiatives": _risk("""
select * from risk where risk_score >= (select quantile_cont(risk_score, 0.9) from risk)"""),
    "regional_risk": _dimension("region"),
    "business_unit_risk": _dimension("business_unit"),
    "owner_performance": _scored(f"""
select owner, count(distinct initiative_id) as initiatives, {_avg('aos_health', 6)} as avg_aos,
       {_avg('actual_otd_pct', 6)} as avg_otd, {r('fsum(actual_revenue)', 2)} as revenue
from scored group by owner"""),
    "risk_headline": _risk(f"""
select count(distinct initiative_id) as total_initiatives, count(*) as observations,
       {_avg('aos_health', 6)} as avg_aos, {_status('green', 'amber', 'red')},
       (select initiative_name from risk order by risk_score desc, initiative_name desc limit 1)
         as highest_risk_initiative,
       {_worst('region')} as highest_risk_region,
       {_worst('business_unit')} as highest_risk_business_unit
from risk"""),
}
