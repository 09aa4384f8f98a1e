"""Oracles of the source, cleaning and pricing queries."""

from oracles.common import SCORED, SUMMARY, r, rounded, with_tables

_QUARTER = "cast(date_trunc('quarter', order_date) as date)"
_LABEL = "concat(year({0}), 'Q', quarter({0}))"

_FEED = """
feed as (
select cast(cast(o_orderdate as date) as varchar) as order_date,
       concat('SKU-', l_partkey) as sku,
       cast(cast(l_quantity as bigint) as varchar) as quantity,
       cast(cast(l_extendedprice / l_quantity * (1 - l_discount) as decimal(28,10)) as varchar) as net_price,
       cast(cast(l_extendedprice / l_quantity as decimal(28,10)) as varchar) as list_price,
       p_type as business_unit,
       r_name as region,
       case when l_linestatus = 'O' then 'Direct' else 'Distributor' end as channel,
       c_mktsegment as customer_tier
from lineitem
left join orders on l_orderkey = o_orderkey
left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join part on l_partkey = p_partkey),
typed as (
select try_cast(order_date as date) as order_date, sku, try_cast(quantity as double) as quantity,
       try_cast(net_price as double) as net_price, try_cast(list_price as double) as list_price,
       business_unit, region, channel, customer_tier
from feed)
"""
_USABLE = "order_date is not null and sku is not null and quantity > 0 and net_price > 0"

_TYPED = {
    "order_date": "date",
    "sku": "string",
    "quantity": "double",
    "net_price": "double",
    "list_price": "double",
    "business_unit": "string",
    "region": "string",
    "channel": "string",
    "customer_tier": "string",
}
_SUMMARY_TYPES = {
    "product_family": "string",
    "own_price": "double",
    "competitor_avg_price": "double",
    "price_gap_usd": "double",
    "price_gap_pct": "double",
    "market_share_pct": "double",
    "market_share_rank": "bigint",
    "market_position": "string",
    "strategic_action": "string",
}


def _null_profile(table: str, types: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, '{t}' as data_type, "
        f"count(*) - count({c}) as missing_values, count(*) as total_rows from {table}"
        for c, t in types.items()
    )


_REALIZATION = f"""
select business_unit, region, channel, customer_tier, {_QUARTER} as quarter,
       {r('fsum(revenue) / nullif(sum(quantity), 0)')} as avg_sell_price,
       {r('favg(list_price)')} as avg_list_price,
       {r('favg(discount_pct)', 6)} as avg_discount_pct,
       {r('fsum(revenue)', 2)} as total_revenue,
       cast(sum(quantity) as bigint) as total_units
from pricing_orders group by all"""

_MATRIX = f"""
select channel, customer_tier, region, {r('favg(discount_pct)', 2)} as avg_discount_pct,
       {r('stddev_samp(discount_pct)', 2)} as discount_variance, count(*) as order_count
from pricing_orders group by all"""

_MONTHLY = """
select order_id, order_date, business_unit, sku, region, channel, customer_tier, net_price, quantity,
       m.month, m.ppi_index, concat(year(order_date), 'Q', quarter(order_date)) as quarter,
       ln(quantity) as log_quantity, ln(net_price) as log_net_price, ln(m.ppi_index) as log_ppi
from pricing_orders
join (select date_trunc('month', observation_date)::date as month,
             arg_max(ppi_index, observation_date) as ppi_index
      from raw_material_index group by 1) m
  on date_trunc('month', order_date)::date = m.month"""

_HEADLINE = {
    "order_id": None,
    "order_date": None,
    "business_unit": None,
    "sku": None,
    "region": None,
    "channel": None,
    "customer_tier": None,
    "net_price": 4,
    "quantity": None,
    "quarter": None,
    "log_quantity": 8,
    "log_net_price": 8,
    "log_ppi": 8,
}

_CREEP = f"""
select region, quarter, avg_discount,
       avg_discount - lag(avg_discount, 4) over (partition by region order by quarter) as yoy_discount_change
from (select region, {_QUARTER} as quarter, favg(discount_pct) as avg_discount
      from pricing_orders group by all) q"""

_OFFENDERS = """
select *, rank() over (partition by region order by avg_discount_pct desc) as discount_rank_in_region
from (select region, sku, business_unit, round(favg(discount_pct), 10) as avg_discount_pct,
             count(*) as order_count
      from pricing_orders group by region, sku, business_unit) s"""
_OFFENDER_COLUMNS = {
    "region": None,
    "sku": None,
    "business_unit": None,
    "avg_discount_pct": 6,
    "order_count": None,
    "discount_rank_in_region": None,
}


def _orders(body: str) -> str:
    return with_tables(body, "pricing_orders")


def _both(body: str) -> str:
    return with_tables(body, "pricing_orders", "raw_material_index")


_CREEP_COLUMNS = {"region": None, "quarter": None, "avg_discount": 6, "yoy_discount_change": 6}
_DISCOUNT = "(1 - net_price / list_price) * 100"

PRICING = {
    "scan_orders": _orders("select * exclude (product_family) from pricing_orders"),
    "canonical_orders": f"with {_FEED} select * from feed",
    "coerce_clean": f"""with {_FEED}
select * replace (coalesce(region, 'Unknown') as region, coalesce(channel, 'Unknown') as channel,
                  coalesce(customer_tier, 'Unknown') as customer_tier)
from typed where {_USABLE}""",
    "clean_removals": f"""with {_FEED}
select count(*) as rows_read, count(*) filter ({_USABLE}) as rows_kept,
       count(*) - count(*) filter ({_USABLE}) as rows_removed from typed""",
    "load_check": _orders("""
select order_id, sku, quantity, net_price, (select count(*) from pricing_orders) as table_rows,
       4 as table_columns, 'order_id,sku,quantity,net_price' as column_list
from pricing_orders order by order_id, sku, quantity, net_price limit 5"""),
    "null_profile": f"with {_FEED} {_null_profile('typed', _TYPED)}",
    "competitive_null_profile": with_tables(_null_profile("summary", _SUMMARY_TYPES), *SUMMARY),
    "fact_profile": _both(f"""
select count(*) as observations, min(order_date) as first_order, max(order_date) as last_order,
       {r('min(ppi_index)')} as index_min, {r('max(ppi_index)')} as index_max,
       count(distinct sku) as skus, count(distinct region) as regions,
       count(distinct channel) as channels, count(distinct customer_tier) as customer_tiers,
       count(distinct quarter) as quarters
from ({_MONTHLY}) j"""),
    "csv_round_trip": _orders(_MATRIX),
    "csv_scan_orders": _orders("select * exclude (product_family) from pricing_orders"),
    "view_scan": _orders("""
select region, channel, count(*) as orders, cast(sum(quantity) as bigint) as units,
       max(discount_pct) as max_discount_pct
from pricing_orders where quantity > 0 group by region, channel"""),
    "price_realization": _orders(_REALIZATION),
    "price_realization_preview": _orders(
        _REALIZATION + " order by quarter, business_unit, region, channel, customer_tier limit 50"
    ),
    "discount_matrix": _orders(_MATRIX),
    "ppi_quarterly": with_tables(f"""
select quarter, {r('ppi_index')} as ppi_index, {_LABEL.format('quarter')} as quarter_label,
       {r('ln(ppi_index)', 8)} as log_ppi
from (select date_trunc('quarter', observation_date)::date as quarter, favg(ppi_index) as ppi_index
      from raw_material_index group by 1) q""", "raw_material_index"),
    "index_file": with_tables(f"""
select observation_date, {r('ppi_index')} as ppi_index from raw_material_index
where observation_date is not null and ppi_index is not null""", "raw_material_index"),
    "ppi_monthly_last": with_tables(f"""
select date_trunc('month', observation_date)::date as month,
       {r('arg_max(ppi_index, observation_date)')} as ppi_index
from raw_material_index group by 1""", "raw_material_index"),
    "price_vs_index": _both(f"""
select business_unit, o.quarter, {r('favg(list_price)', 2)} as avg_list_price, {r('ppi_index', 2)} as ppi_index
from (select *, {_QUARTER} as quarter from pricing_orders) o
join (select date_trunc('quarter', observation_date)::date as quarter, favg(ppi_index) as ppi_index
      from raw_material_index group by 1) p on o.quarter = p.quarter
group by business_unit, o.quarter, p.ppi_index"""),
    "orders_with_monthly_index": _both(rounded(_MONTHLY, {**_HEADLINE, "month": None, "ppi_index": 4})),
    "orders_with_quarterly_index": _both(rounded(f"""
select order_id, order_date, business_unit, sku, region, channel, customer_tier, net_price, quantity,
       q.quarter, q.ppi, ln(q.ppi) as log_ppi, ln(quantity) as log_quantity, ln(net_price) as log_net_price
from pricing_orders
join (select {_LABEL.format('observation_date')} as quarter, favg(ppi_index) as ppi
      from raw_material_index group by 1) q on {_LABEL.format('order_date')} = q.quarter""",
        {**_HEADLINE, "ppi": 4})),
    "index_match_rate": _both("""
select count(*) as orders, count(m.month) as matched_orders
from pricing_orders left join (select distinct date_trunc('month', observation_date)::date as month
                               from raw_material_index) m
  on date_trunc('month', order_date)::date = m.month"""),
    "discount_creep": _orders(rounded(_CREEP, _CREEP_COLUMNS)),
    "discount_creep_changes": _orders(
        rounded(f"select * from ({_CREEP}) c where yoy_discount_change is not null", _CREEP_COLUMNS)
    ),
    "discount_offenders": _orders(rounded(_OFFENDERS, _OFFENDER_COLUMNS)),
    "top5_discount_offenders": _orders(
        rounded(f"select * from ({_OFFENDERS}) o where discount_rank_in_region <= 5", _OFFENDER_COLUMNS)
    ),
    "asp_moving_avg": _orders(rounded(f"""
select *, avg(avg_sell_price) over (partition by business_unit order by quarter
                                    rows between 1 preceding and current row) as asp_2q_moving_avg
from (select business_unit, {_QUARTER} as quarter, fsum(revenue) / nullif(sum(quantity), 0) as avg_sell_price
      from pricing_orders group by all) q""",
        {"business_unit": None, "quarter": None, "avg_sell_price": 4, "asp_2q_moving_avg": 4})),
    "sku_pareto": _orders(f"""
select sku, business_unit, {r('total_revenue', 2)} as total_revenue,
       rank() over (order by total_revenue desc) as revenue_rank,
       {r('''100.0 * sum(total_revenue) over (order by total_revenue desc, sku, business_unit
             rows unbounded preceding) / sum(total_revenue) over ()''', 1)} as cumulative_revenue_pct
from (select sku, business_unit, round(fsum(revenue), 6) as total_revenue
      from pricing_orders group by sku, business_unit) s"""),
    "pricing_baseline": _orders(f"""
select count(*) as orders, cast(sum(quantity) as bigint) as quantity,
       {r('fsum(quantity * net_price)', 2)} as revenue,
       {r('fsum(quantity * net_price) / sum(quantity)')} as weighted_avg_price,
       count(distinct sku) as skus
from pricing_orders where quantity > 0 and net_price > 0"""),
    "discount_profile": _orders(f"""
select business_unit, count(*) as orders, {r('fsum(quantity * net_price)', 2)} as revenue,
       {r(f'favg({_DISCOUNT})', 6)} as avg_discount_pct,
       {r(f'median({_DISCOUNT})', 6)} as median_discount_pct,
       {r(f'max({_DISCOUNT})', 6)} as max_discount_pct
from pricing_orders where quantity > 0 and net_price > 0 and list_price > 0 group by business_unit"""),
    "top_half_sku_orders": _orders("""
select order_id, sku, quantity, net_price from pricing_orders where sku in (
  select sku from (select sku, row_number() over (order by price_sum desc, sku) as n, count(*) over () as skus
                   from (select sku, round(fsum(net_price), 6) as price_sum from pricing_orders group by sku) s) t
  where n <= greatest(1, floor(skus * 0.5)))"""),
    "trimmed_orders": _orders("""
select order_id, sku, quantity, net_price from pricing_orders
where quantity > (select quantile_cont(cast(quantity as double), 0.05) from pricing_orders)"""),
    "discount_capped_orders": _orders(f"""
select order_id, sku, net_price, list_price, {_DISCOUNT} as calculated_discount
from pricing_orders where {_DISCOUNT} <= 30"""),
    "discount_capped_orders_tight": _orders(f"""
select order_id, sku, net_price, list_price, {_DISCOUNT} as calculated_discount
from pricing_orders where {_DISCOUNT} <= 5.5::double"""),
    "winsorised_orders": _orders(f"""
, logs as (select order_id, sku, ln(quantity) as q, ln(net_price) as p from pricing_orders
         where quantity > 0 and net_price > 0),
bounds as (select quantile_cont(q, 0.01) as q1, quantile_cont(q, 0.99) as q99,
                  quantile_cont(p, 0.01) as p1, quantile_cont(p, 0.99) as p99 from logs)
select order_id, sku, {r('least(greatest(q, q1), q99)', 8)} as log_quantity,
       {r('least(greatest(p, p1), p99)', 8)} as log_net_price
from logs, bounds"""),
}
