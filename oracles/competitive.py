"""Oracles of the competitive and decision queries."""

from oracles.common import SCORED, SUMMARY, r, rounded, with_tables


def _summary(body: str) -> str:
    return with_tables(body, *SUMMARY)


def _final(body: str) -> str:
    return with_tables(body, *SUMMARY, "final")


_OPPORTUNITY = """
select product_family, own_price, competitor_avg_price, price_gap_usd, price_gap_pct,
       competitor_avg_price - own_price as potential_price_increase_usd,
       (competitor_avg_price - own_price) / own_price * 100 as potential_price_increase_pct,
       market_share_pct, market_share_rank, market_position,
       case when price_gap_pct <= -0.5 then 'Consider Price Increase'
            when price_gap_pct < 0 then 'Evaluate Moderate Price Increase'
            when price_gap_pct = 0 then 'Maintain Price'
            else 'Avoid Further Price Increase' end as pricing_recommendation,
       case when market_share_rank is null then 'Market Share Data Unavailable'
            when market_share_rank <= 2 then 'Strong Market Position'
            when market_share_rank = 3 then 'Growth Required'
            else 'Weak Market Position' end as market_position_signal,
       case when price_gap_pct < 0 and market_share_rank = 3
              then 'Increase Price Carefully While Defending Share'
            when price_gap_pct < 0 and market_share_rank is null then 'Potential Pricing Headroom'
            when price_gap_pct > 0 then 'Maintain Pricing Discipline'
            else 'Maintain Current Position' end as strategic_recommendation
from summary"""
_OPPORTUNITY_COLUMNS = {
    "product_family": None,
    "own_price": 6,
    "competitor_avg_price": 6,
    "price_gap_usd": 6,
    "price_gap_pct": 6,
    "potential_price_increase_usd": 6,
    "potential_price_increase_pct": 6,
    "market_share_pct": 6,
    "market_share_rank": None,
    "market_position": None,
    "pricing_recommendation": None,
    "market_position_signal": None,
    "strategic_recommendation": None,
}

_PRIORITY = r(
    "coalesce(commercial_score, 0) * 25 + execution_score * 25 + health_score * 25 "
    "+ adoption_score * 15 + evidence_score * 10",
    2,
)
_SURFACE = """,
pricing_surface as (
  select product_family, region, concat(year(order_date), 'Q', quarter(order_date)) as quarter,
         fsum(revenue) / nullif(sum(quantity), 0) as avg_sell_price, favg(discount_pct) as avg_discount_pct,
         fsum(revenue) as order_revenue
  from pricing_orders group by all),
execution as (
  select product_family, region, quarter, favg(aos_health) as health_score,
         favg(execution_score) as execution_score, favg(customer_adoption_pct) as adoption_pct,
         favg(gross_margin_pct) as gross_margin_pct, favg(backlog_days) as backlog_days,
         favg(revenue_attainment) as revenue_attainment
  from scored group by all),
growth as (
  select industry, arg_max(growth_pct, year) as industry_growth_pct
  from industry_growth where growth_pct is not null group by industry),
joined as (
  select e.*, p.avg_sell_price, p.avg_discount_pct, p.order_revenue, s.price_gap_pct, s.market_share_pct,
         s.strategic_action, i.industry, g.industry_growth_pct,
         least(greatest(0.5::double - s.price_gap_pct / 10, 0), 1) as commercial_score,
         e.adoption_pct / 100 as adoption_score,
         case when s.market_share_pct is not null then 1.0::double else 0.0::double end as evidence_score
  from execution e
  left join pricing_surface p on e.product_family = p.product_family and e.region = p.region and e.quarter = p.quarter
  left join summary s on e.product_family = s.product_family
  left join product_industry i on e.product_family = i.product_family
  left join growth g on i.industry = g.industry),
prioritised as (
  select *, PRIORITY as priority_score
  from joined),
surface as (
  select *,
         case when priority_score >= 75 then 'High Priority' when priority_score >= 60 then 'Medium Priority'
              else 'Low Priority' end as priority_band,
         case when execution_score < 0.70::double then 'Fix Execution First'
              when backlog_days >= 60 then 'Clear Delivery Backlog'
              when gross_margin_pct < 28 or avg_discount_pct > 5.5::double then 'Restore Profitability'
              when price_gap_pct < 0 and market_share_pct is not null then 'Controlled Price Increase'
              when price_gap_pct < 0 then 'Validate Pricing Headroom'
              when health_score >= 0.75::double and adoption_pct >= 55 then 'Scale Growth'
              else 'Protect and Monitor' end as recommended_action
  from prioritised)
""".replace("PRIORITY", _PRIORITY)


def _surface(body: str) -> str:
    return with_tables(_SURFACE + body, "pricing_orders", *SCORED, *SUMMARY, "industry_growth")


COMPETITIVE = {
    "market_share_rank": with_tables(f"""
select industry, m.product_family, company, {r('market_share_pct', 6)} as market_share_pct,
       rank() over (partition by industry order by market_share_pct desc) as market_share_rank
from market_share m join product_industry p on m.product_family = p.product_family""",
        "company_lines", "market_share", "product_industry"),
    "industry_growth": with_tables(
        rounded("select * from industry_growth", {"industry": None, "year": None, "growth_pct": 6}),
        "industry_growth"),
    "competitive_summary": _summary("select * from summary"),
    "ci_action_subsets": _summary("""
select case strategic_action when 'Growth Opportunity' then 'growth_opportunities'
            when 'Potential Price Advantage' then 'price_advantages' else 'monitor_pricing' end as subset,
       product_family, own_price, competitor_avg_price, price_gap_pct, market_share_pct, market_share_rank
from summary"""),
    "pricing_opportunity": _summary(rounded(_OPPORTUNITY, _OPPORTUNITY_COLUMNS)),
    "ci_positive_headroom": _summary(rounded(
        f"select * from ({_OPPORTUNITY}) o where potential_price_increase_usd > 0",
        {"product_family": None, "own_price": 6, "competitor_avg_price": 6, "potential_price_increase_usd": 6,
         "potential_price_increase_pct": 6, "strategic_recommendation": None})),
    "competitor_recommendation": with_tables(rounded("""
select *, case when avg_price_usd < (select favg(avg_price_usd) from competitor_pricing) then 'Increase Price'
               when avg_price_usd > (select favg(avg_price_usd) from competitor_pricing) * 1.05::double
                 then 'Reduce Price'
               else 'Maintain' end as recommendation
from competitor_pricing""",
        {"product_family": None, "company": None, "avg_price_usd": 6, "is_own": None, "recommendation": None}),
        "company_lines", "competitor_pricing"),
    "ci_final": _final("select * from final"),
    "ci_final_subsets": _final("""
select 'pricing_opportunities' as subset, * from final
 where regexp_matches(final_recommendation, 'price increase|pricing headroom', 'i')
union all select 'high_priority', * from final where regexp_matches(final_recommendation, 'high priority', 'i')
union all select 'pricing_discipline', * from final where regexp_matches(final_recommendation, 'maintain|hold', 'i')
"""),
    "ci_metrics": _final(f"""
select count(*) as total_products,
       count(*) filter (regexp_matches(final_recommendation, 'high priority', 'i')) as high_priority,
       count(*) filter (regexp_matches(final_recommendation, 'pricing headroom', 'i')) as pricing_headroom,
       count(*) filter (regexp_matches(final_recommendation, 'maintain|hold', 'i')) as monitoring,
       count(*) filter (strategic_action = 'Growth Opportunity') as growth_opportunities,
       count(*) filter (strategic_action = 'Potential Price Advantage') as price_advantages,
       count(*) filter (strategic_action = 'Monitor Pricing') as monitor_pricing,
       count(market_share_pct) as with_market_share, {r('favg(price_gap_pct)', 6)} as average_price_gap_pct
from final"""),
    "decision_surface": _surface(rounded("select * from surface", {
        "product_family": None, "region": None, "quarter": None, "health_score": 4, "execution_score": 4,
        "adoption_pct": 4, "gross_margin_pct": 4, "backlog_days": 4, "revenue_attainment": 4,
        "avg_sell_price": 4, "avg_discount_pct": 4, "order_revenue": 4, "price_gap_pct": 4,
        "market_share_pct": 4, "strategic_action": None, "industry": None, "industry_growth_pct": 4,
        "commercial_score": 4, "adoption_score": 4, "evidence_score": 4, "priority_score": 4,
        "priority_band": None, "recommended_action": None})),
    "decision_priority": _surface(rounded("""
select priority_band, count(*) as combinations, favg(priority_score) as avg_score,
       min(priority_score) as min_score, max(priority_score) as max_score
from surface group by priority_band""",
        {"priority_band": None, "combinations": None, "avg_score": 4, "min_score": 4, "max_score": 4})),
    "decision_mix": _surface(rounded("""
select product_family, count(*) as combinations,
       favg(case when recommended_action in ('Fix Execution First', 'Clear Delivery Backlog') then 1.0::double
                else 0.0::double end) * 100 as execution_led_pct,
       favg(priority_score) as avg_priority_score, favg(execution_score) as avg_execution_score,
       favg(gross_margin_pct) as avg_gross_margin_pct, favg(adoption_pct) as avg_adoption_pct
from surface group by product_family""",
        {"product_family": None, "combinations": None, "execution_led_pct": 4, "avg_priority_score": 4,
         "avg_execution_score": 4, "avg_gross_margin_pct": 4, "avg_adoption_pct": 4})),
    "action_mix": _surface(rounded("""
select recommended_action, count(*) as combinations,
       count(*) / (select count(*) from surface) * 100 as share_pct
from surface group by recommended_action""",
        {"recommended_action": None, "combinations": None, "share_pct": 4})),
}
