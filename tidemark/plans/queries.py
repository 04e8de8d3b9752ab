"""All queries of the library by name, and the SQL they are held against."""

from __future__ import annotations

from . import alert_queries, analysis_queries, geo_queries, listing_queries, market_queries, opportunity_queries, page_queries, relevance_queries, report_queries, series_queries, stream_queries, text_queries, trend_queries, upkeep_queries

MODULES = (
    series_queries,
    trend_queries,
    text_queries,
    opportunity_queries,
    analysis_queries,
    market_queries,
    geo_queries,
    relevance_queries,
    alert_queries,
    listing_queries,
    page_queries,
    upkeep_queries,
    report_queries,
    stream_queries,
)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
