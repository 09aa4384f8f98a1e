"""Shared table expressions and rounding of the oracle queries."""


def r(expression: str, digits: int = 4) -> str:
    """Round half away from zero on the value's 15 significant digits, as a double.

    Sums and means under it are compensated ones (fsum, favg), so that the order of the
    rows does not show.
    """
    text = f"printf('%.14e', cast({expression} as double))"
    return f"cast(round(cast({text} as decimal(38,20)), {digits}) as double)"


def even(expression: str, digits: int) -> str:
    """Round half to even in binary floating point."""
    scale = f"cast({10**digits} as double)"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"


def rounded(select: str, columns: dict[str, int | None]) -> str:
    """Project ``columns`` of a query; a number of digits rounds the column."""
    items = [c if d is None else f"{r(c, d)} as {c}" for c, d in columns.items()]
    return f"select {', '.join(items)} from ({select}) result"


def with_tables(body: str, *tables: str) -> str:
    """Prefix a query with the table expressions it names, in order."""
    return "with " + ",\n".join(f"{t} as ({TABLES[t]})" for t in tables) + "\n" + body


TABLES = {
    "pricing_orders": """
select concat('ORD-', l_orderkey, '-', l_linenumber) as order_id,
       cast(o_orderdate as date) as order_date,
       p_type as business_unit,
       p_brand as product_family,
       concat('SKU-', l_partkey) as sku,
       r_name as region,
       case when l_linestatus = 'O' then 'Direct' else 'Distributor' end as channel,
       c_mktsegment as customer_tier,
       l_extendedprice / l_quantity as list_price,
       l_extendedprice / l_quantity * (1 - l_discount) as net_price,
       l_discount * 100 as discount_pct,
       cast(l_quantity as bigint) as quantity,
       l_extendedprice * (1 - l_discount) as revenue
from lineitem
left join orders on l_orderkey = o_orderkey
left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join part on l_partkey = p_partkey""",
    "raw_material_index": """
select cast(date_trunc('month', l_shipdate) as date) as observation_date,
       favg(l_extendedprice / l_quantity) as ppi_index
from lineitem group by 1""",
    "initiatives": """
select concat('INIT-', l_suppkey) as initiative_id,
       s_name as initiative_name,
       concat('BU-', l_suppkey % 4) as business_unit,
       p_brand as product_family,
       r_name as region,
       concat('PMM_', l_suppkey % 20) as owner,
       case l_suppkey % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end as priority,
       case l_suppkey % 5 when 0 then 'Launch' when 2 then 'Mature' when 4 then 'Decline'
            else 'Growth' end as lifecycle_stage,
       concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as quarter,
       concat('Month', (month(o_orderdate) - 1) % 3 + 1) as checkpoint,
       l_extendedprice as planned_revenue,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) as actual_revenue,
       95 as planned_otd_pct,
       82 + l_tax * 200 as actual_otd_pct,
       (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 91 as backlog_days,
       cast(p_size * 2 as double) as customer_adoption_pct,
       15 + l_discount * 350 as gross_margin_pct,
       60 + l_quantity as budget_utilization_pct
from lineitem
left join orders on l_orderkey = o_orderkey
left join supplier on l_suppkey = s_suppkey
left join nation on s_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join part on l_partkey = p_partkey""",
    "components": """
select *,
       least(greatest(actual_revenue / planned_revenue, 0), 1.25::double) as c_revenue,
       least(greatest(actual_otd_pct / planned_otd_pct, 0), 1.10::double) as c_otd,
       least(greatest(1 - backlog_days / 90, 0), 1) as c_backlog,
       least(greatest(customer_adoption_pct / 100, 0), 1) as c_adoption,
       least(greatest(gross_margin_pct / 50, 0), 1) as c_margin,
       least(greatest(1 - abs(budget_utilization_pct - 100) / 50, 0), 1) as c_budget
from initiatives""",
    "measured": """
select *,
       c_revenue * 0.35::double + c_otd * 0.2::double + c_backlog * 0.15::double
         + c_adoption * 0.1::double + c_margin * 0.1::double + c_budget * 0.1::double as raw_health,
       c_otd * 0.5::double + c_backlog * 0.5::double as raw_execution
from components""",
    "scored": f"""
select initiative_id, initiative_name, business_unit, product_family, region, owner, priority,
       lifecycle_stage, quarter, checkpoint, planned_revenue, actual_revenue, planned_otd_pct,
       actual_otd_pct, backlog_days, customer_adoption_pct, gross_margin_pct,
       budget_utilization_pct,
       {even('c_revenue', 3)} as revenue_attainment,
       {even('c_otd', 3)} as otd_attainment,
       {even('c_backlog', 3)} as backlog_score,
       {even('c_adoption', 3)} as adoption_score,
       {even('c_margin', 3)} as margin_score,
       {even('c_budget', 3)} as budget_score,
       {even('raw_health', 3)} as aos_health,
       {even('raw_execution', 3)} as execution_score,
       (actual_revenue - planned_revenue) / planned_revenue * 100 as revenue_variance_pct,
       actual_otd_pct - planned_otd_pct as otd_variance_pct,
       case when raw_health >= 0.90::double then 'Green' when raw_health >= 0.75::double then 'Amber'
            else 'Red' end as status,
       case when raw_health >= 0.90::double then 'Low' when raw_health >= 0.75::double then 'Medium'
            else 'High' end as risk_category,
       raw_health
from measured""",
    "risk": f"""
select * exclude (raw_health),
       {even('''(1 - aos_health) * 50
         + backlog_days / (select max(backlog_days) from scored) * 20
         + (100 - actual_otd_pct) / 100 * 15 + (1 - revenue_attainment) * 15''', 2)} as risk_score
from scored""",
    "company_lines": """
select p_brand as product_family, p_size, r_name as company, l_extendedprice, l_quantity, l_discount
from lineitem
left join supplier on l_suppkey = s_suppkey
left join nation on s_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join part on l_partkey = p_partkey""",
    "competitor_pricing": """
select product_family, company, favg(l_extendedprice / l_quantity) as avg_price_usd,
       cast(company = (select min(r_name) from region) as int) as is_own
from company_lines group by all""",
    "market_share": """
select product_family, company, rev * 100 / sum(rev) over (partition by product_family) as market_share_pct
from (select product_family, company, fsum(l_extendedprice * (1 - l_discount)) as rev
      from company_lines group by all) t""",
    "product_industry": """
select distinct p_brand as product_family,
       concat('IND-', cast(substr(p_brand, 7) as int) % 5) as industry,
       case when cast(substr(p_brand, 7) as int) % 3 = 0 then 'Challenger' else 'Leader' end as market_position
from part""",
    "industry_growth": """
select industry, year, 100 * (rev / lag(rev) over (partition by industry order by year) - 1) as growth_pct
from (select concat('IND-', cast(substr(p_brand, 7) as int) % 5) as industry,
             cast(year(o_orderdate) as int) as year,
             fsum(l_extendedprice * (1 - l_discount)) as rev
      from lineitem left join orders on l_orderkey = o_orderkey
      left join part on l_partkey = p_partkey group by all) t""",
    "families": f"""
select product_family,
       {r('max(case when is_own = 1 then avg_price_usd end)', 2)} as own_price,
       {r('favg(case when is_own <> 1 then avg_price_usd end)', 2)} as competitor_avg_price
from competitor_pricing group by product_family""",
    "own_shares": f"""
select m.product_family, {r('m.market_share_pct', 2)} as market_share_pct, m.market_share_rank
from (select *, rank() over (partition by product_family order by market_share_pct desc) as market_share_rank
      from market_share) m
join competitor_pricing c on c.product_family = m.product_family and c.company = m.company and c.is_own = 1""",
    "gaps": f"""
select f.product_family, own_price, competitor_avg_price,
       {r('own_price - competitor_avg_price', 2)} as price_gap_usd,
       {r('(own_price - competitor_avg_price) / competitor_avg_price * 100', 2)} as price_gap_pct,
       market_share_pct, market_share_rank, market_position
from families f left join own_shares s on f.product_family = s.product_family
left join product_industry p on f.product_family = p.product_family""",
    "summary": """
select *, case when price_gap_pct < 0 and market_share_pct is not null then 'Growth Opportunity'
               when price_gap_pct < 0 then 'Potential Price Advantage'
               else 'Monitor Pricing' end as strategic_action
from gaps""",
    "final": """
select *,
       case when price_gap_pct < 0 and market_share_rank is not null then 'Increase Price Carefully'
            when price_gap_pct < 0 then 'Evaluate Price Increase'
            when price_gap_pct = 0 then 'Maintain Current Price'
            else 'Hold / Avoid Price Increase' end as pricing_recommendation,
       case when market_share_rank is not null then 'Strong Competitive Position'
            else 'Market Share Data Unavailable' end as competitive_position,
       case when price_gap_pct < 0 and market_share_rank is not null
              then 'High Priority: Price Increase with Share Protection'
            when price_gap_pct < 0 then 'Evaluate Pricing Headroom'
            else 'Maintain Pricing Discipline' end as final_recommendation
from summary""",
}

SCORED = ["initiatives", "components", "measured", "scored"]
SUMMARY = [
    "company_lines",
    "competitor_pricing",
    "market_share",
    "product_industry",
    "families",
    "own_shares",
    "gaps",
    "summary",
]
