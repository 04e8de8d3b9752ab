"""What kinds of signals there are: class, adoption, proxy and direction of every type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Signal types by class, and the types that count as adoption, proxy, or not as "up".
CLASSES = {
    "attention": "search_growth wiki_pageview_growth social_discussion_growth media_coverage_growth newsletter_mentions",
    "developer": "github_stars github_forks github_contributors github_commit_velocity github_issue_velocity package_downloads stackoverflow_questions model_downloads",
    "talent": "job_posting_growth job_title_emergence salary_premium",
    "capital": "funding_round funding_total_growth valuation_change institutional_activity insider_buying",
    "product": "product_launch app_ranking_growth website_traffic_growth review_volume_growth feature_request_frequency",
    "commercial": "revenue_acceleration transaction_growth customer_count_growth contract_award",
    "market": "trading_volume_anomaly price_momentum short_interest_change liquidity_change",
    "industrial": "manufacturing_expansion capex_announcement patent_activity supply_shortage lead_time_change",
    "trade": "import_growth export_growth hs_code_volume_change freight_rate_change supplier_count_change",
    "demand_pain": "customer_complaint_frequency unmet_need_mentions churn_signal",
    "policy": "regulatory_catalyst government_subsidy tariff_change standard_adoption",
    "macro": "policy_rate inflation_rate industrial_production producer_price_index housing_starts unemployment_rate macro_indicator",
    "filing": "sec_filing_activity insider_transaction annual_report_filed quarterly_report_filed",
}
ADOPTION = "github_contributors github_commit_velocity package_downloads model_downloads customer_count_growth transaction_growth revenue_acceleration app_ranking_growth import_growth export_growth hs_code_volume_change job_posting_growth".split()
PROXY = "wiki_pageview_growth search_growth media_coverage_growth social_discussion_growth".split()
DOWN = "churn_signal unemployment_rate".split()
CONTEXT = "supply_shortage lead_time_change customer_complaint_frequency short_interest_change freight_rate_change tariff_change policy_rate inflation_rate macro_indicator".split()


def taxonomy(spark: SparkSession) -> DataFrame:
    """signal_type, signal_class, is_adoption, taxonomy_proxy, bullish (up, down, context): a row for each known type."""
    rows = [(t, c, t in ADOPTION, t in PROXY, "down" if t in DOWN else "context" if t in CONTEXT else "up") for c, types in CLASSES.items() for t in types.split()]
    return spark.createDataFrame(rows, "signal_type string, signal_class string, is_adoption boolean, taxonomy_proxy boolean, bullish string")


def classified(signals: DataFrame) -> DataFrame:
    """`signals` (signal_type) with the taxonomy's columns; unknown types are 'manual', 'context'."""
    dim = F.broadcast(taxonomy(signals.sparkSession))  # a row for each type: fixed size
    out = signals.join(dim, "signal_type", "left")
    return out.fillna({"signal_class": "manual", "is_adoption": False, "taxonomy_proxy": False, "bullish": "context"})
