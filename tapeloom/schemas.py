"""Declared schemas. Nothing is inferred; text inputs are read as strings and cast."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

_DDL = {
    "security_aliases": "security_id bigint, alias string, alias_type string, event_at timestamp, observed_at timestamp not null",
    "filings": "filing_id bigint, feed string, symbol string, security_id bigint, isin string, subject string, description string, link string, attachment_url string, dedup_key string, content_hash string, raw map<string,string>, source string, event_at timestamp, observed_at timestamp not null",
    "documents": "doc_id bigint, filing_id bigint, url string, sha256 string, bytes bigint, fetch_status string, attempts int, next_attempt_at timestamp, event_at timestamp, observed_at timestamp not null",
    "filing_classifications": "filing_id bigint, category string, materiality int, sentiment double, confidence double, routine boolean, summary string, entities string, engine string, rule_trace string, model_version string, event_at timestamp, observed_at timestamp not null",
    "price_daily": "symbol string, trade_date date, series string, open double, high double, low double, close double, prev_close double, vwap double, volume double, turnover double, trades double, delivery_qty double, delivery_pct double, source string, event_at timestamp, observed_at timestamp not null",
    "financials_quarterly": "symbol string, period_end date, basis string, audited boolean, revenue double, other_income double, total_income double, expenses double, finance_costs double, depreciation double, pbt double, tax double, pat double, eps_basic double, raw map<string,string>, filing_id bigint, event_at timestamp, observed_at timestamp not null",
    "scores": "agent string, symbol string, score double, label string, confidence double, components string, model_version string, as_of timestamp, event_at timestamp, observed_at timestamp not null",
    "market_flow": "day date, category string, buy_value double, sell_value double, net_value double, event_at timestamp, observed_at timestamp not null",
    "large_deals": "day date, symbol string, client string, side string, qty double, price double, kind string, event_at timestamp, observed_at timestamp not null",
    "surveillance": "as_of date, symbol string, framework string, stage string, detail string, event_at timestamp, observed_at timestamp not null",
    "promoter_pledge": "symbol string, record_id string, shp_date date, promoter_pct double, encumbered_shares double, encumbered_pct double, encumbered_pct_of_total double, event_at timestamp, observed_at timestamp not null",
    "signals": "signal_id bigint, symbol string, profile string, stance string, conviction double, confidence double, horizon string, entry_low double, entry_high double, target_low double, target_high double, invalidation double, size_pct double, thesis_for array<string>, thesis_against array<string>, view_changer string, risk_verdict string, model_version string, as_of timestamp, event_at timestamp, observed_at timestamp not null",
    "signal_performance": "signal_id bigint, window string, stance string, profile string, entry_price double, exit_price double, ret double, index_ret double, excess double, event_at timestamp, observed_at timestamp not null",
    "alerts": "alert_id bigint, severity string, category string, symbol string, message string, evidence_ref string, channels map<string,string>, event_at timestamp, observed_at timestamp not null",
    "holidays": "day date, segment string, name string, event_at timestamp, observed_at timestamp not null",
}

# the master and operational logs: current state and system time only
_LOG_DDL = {
    "securities": "security_id bigint, symbol string, isin string, company_name string, series string, is_sme boolean, listing_date date, face_value double, status string, industry string, observed_at timestamp not null, updated_at timestamp",
    "outbox": "id bigint, topic string, payload string, created_at timestamp",
    "consumer_offsets": "consumer string, topic string, last_acked_id bigint",
    "dead_letters": "id bigint, consumer string, topic string, payload string, error string, attempts int",
    "feed_state": "feed string, priority string, last_polled_at timestamp, last_changed_at timestamp, last_status string, entries_seen bigint, entries_new bigint, consecutive_errors bigint",
    "agent_runs": "run_id bigint, agent string, status string, started_at timestamp, finished_at timestamp",
    "http_audit": "request_id bigint, url string, status int, observed_at timestamp",
}


DDL = {**_DDL, **_LOG_DDL}


def schema(table: str) -> StructType:
    """Declared schema of a table; needs an active session to parse its DDL."""
    return StructType.fromDDL(DDL[table])


KEYS = {
    "securities": ["isin"],
    "security_aliases": ["alias", "alias_type", "security_id"],
    "filings": ["content_hash"],
    "filing_classifications": ["filing_id", "model_version"],
    "price_daily": ["symbol", "trade_date"],
    "financials_quarterly": ["symbol", "period_end", "basis"],
    "market_flow": ["day", "category"],
    "large_deals": ["day", "symbol", "client", "side", "qty", "kind"],
    "surveillance": ["as_of", "symbol", "framework"],
    "promoter_pledge": ["symbol", "record_id"],
    "signal_performance": ["signal_id", "window"],
    "holidays": ["day", "segment"],
}


def bitemporal_violations() -> list[str]:
    """Fact tables lacking a nullable ``event_at`` or a mandatory ``observed_at``."""
    bad = []
    for name in _DDL:
        fields = {f.name: f for f in schema(name).fields}
        if "event_at" not in fields or "observed_at" not in fields or fields["observed_at"].nullable:
            bad.append(name)
    return bad


def empty(spark: SparkSession, table: str):
    return spark.createDataFrame([], schema(table))
