"""SQL with the same results as the named queries, for DuckDB over the same tables."""

from oracles.competitive import COMPETITIVE
from oracles.elasticity import ELASTICITY
from oracles.lifecycle import LIFECYCLE
from oracles.pricing import PRICING
from oracles.scenarios import SCENARIOS

ORACLES: dict[str, str] = {**PRICING, **LIFECYCLE, **SCENARIOS, **ELASTICITY, **COMPETITIVE}

# Published result -> (pillar, area, query that holds it).
_SCENARIO_AREA = ("Pricing", "Pricing_Scenarios")
_DASHBOARD_AREA = ("Product_Lifecycle", "Dashboards")
_RISK_AREA = ("Product_Lifecycle", "Risk")
_MART = {
    "overall_pricing_scenarios": (*_SCENARIO_AREA, "overall_scenarios"),
    "business_unit_pricing_scenarios": (*_SCENARIO_AREA, "business_unit_scenarios"),
    "region_pricing_scenarios": (*_SCENARIO_AREA, "region_scenarios"),
    "sku_pricing_scenarios": (*_SCENARIO_AREA, "sku_scenarios"),
    "pricing_scenarios": (*_SCENARIO_AREA, "pricing_scenarios"),
    "segment_pricing_opportunities": (*_SCENARIO_AREA, "segment_opportunities"),
    "sku_pricing_opportunities": (*_SCENARIO_AREA, "sku_opportunities"),
    "discount_profile": (*_SCENARIO_AREA, "discount_profile"),
    "elasticity_sensitivity": (*_SCENARIO_AREA, "elasticity_sensitivity"),
    "robustness_results": ("Pricing", "Robustness", "robustness_results"),
    "robustness_summary": ("Pricing", "Robustness", "robustness_summary"),
    "executive_kpis": (*_DASHBOARD_AREA, "executive_kpis"),
    "business_unit_dashboard": (*_DASHBOARD_AREA, "aos_summary"),
    "region_dashboard": (*_DASHBOARD_AREA, "region_dashboard"),
    "owner_dashboard": (*_DASHBOARD_AREA, "owner_dashboard"),
    "lifecycle_dashboard": (*_DASHBOARD_AREA, "lifecycle_analysis"),
    "business_unit_risk": (*_RISK_AREA, "business_unit_risk"),
    "executive_watchlist": (*_RISK_AREA, "executive_watchlist"),
    "high_risk_initiatives": (*_RISK_AREA, "high_risk_initiatives"),
    "owner_performance": (*_RISK_AREA, "owner_performance"),
    "regional_risk": (*_RISK_AREA, "regional_risk"),
    "competitive_intelligence_summary": ("Competitive_Intelligence", "Dashboards", "competitive_summary"),
    "competitive_intelligence_final": ("Competitive_Intelligence", "Dashboards", "ci_final"),
    "pricing_opportunity_analysis": ("Competitive_Intelligence", "Reports", "pricing_opportunity"),
    "decision_surface": ("Competitive_Intelligence", "Battlecards", "decision_surface"),
}
ORACLES["mart_manifest"] = " union all ".join(
    f"select '{pillar}' as pillar, '{area}' as area, '{name}' as name, "
    f"(select count(*) from ({ORACLES[query]}) q) as rows, 'published' as status"
    for name, (pillar, area, query) in _MART.items()
)
