"""One query per operator, over the tables of :mod:`tapeloom.driver.tables`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeloom import constants as K
from tapeloom.driver.tables import AS_OF, Tables
from tapeloom.functions import calendar as cal
from tapeloom.operators import asof, indicators as ind, keyed, pit, resolve
from tapeloom.plans import alerts, backtest, evaluate, flow, fundamental, fusion, master, performance, risk, rules, technical, views
from tapeloom.sources import buckets, documents, feeds, xbrl
from tapeloom.sources.sinks import shared_dir
from tapeloom.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW = datetime.fromisoformat(AS_OF).replace(tzinfo=timezone.utc)


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def now():
    return F.lit(AS_OF).cast("timestamp")


def poll_now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def q6(x, scale: float = 1e6):
    """Six decimals by one product and one floor, so both engines round alike."""
    return F.floor(x * scale + 0.5).cast("double") / scale


def r6(*names: str):
    return [q6(F.col(n)).alias(n) for n in names]


def ts(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---------------------------------------------------------------- tables as of the instant

def live_bars(t):
    return t.bars.where(F.col("trade_date") <= F.lit(AS_OF).cast("date"))


def live_index(t):
    return t.index_bars.where(F.col("trade_date") <= F.lit(AS_OF).cast("date"))


def live_quarters(t):
    return fundamental.with_visibility(t.quarters).where(F.col("visible_on") <= F.lit(AS_OF).cast("date")).drop("visible_on")


def live_filings(t):
    return pit.pit(t.filings, now())


def live_heads(t):
    """Filings without their texts."""
    return pit.pit(t.filing_heads, now())


def live_classes(t):
    return pit.pit(t.classifications, now())


# ---------------------------------------------------------------- bars and indicators

@query
def daily_bars(t):
    return t.bars.select("symbol", "trade_date", "series", *r6("open", "high", "low", "close", "delivery_pct"),
                         "volume", "turnover", "trades", "delivery_qty")


@query
def sma_stack(t):
    w = ind.by_date()
    return t.bars.select("symbol", "trade_date", *[q6(ind.sma(F.col("close"), n, w)).alias(f"sma{n}") for n in (20, 50, 200)])


@query
def zscore_volume(t):
    return t.bars.select("symbol", "trade_date", ind.zscore(F.col("volume"), 20, ind.by_date()).alias("vol_z")).select(
        "symbol", "trade_date", *r6("vol_z"))


@query
def range_52w(t):
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-249, 0)
    return t.bars.select("symbol", "trade_date", F.max("close").over(w).alias("hi52"), F.min("close").over(w).alias("lo52")).select(
        "symbol", "trade_date", *r6("hi52", "lo52"))


@query
def upper_median_turnover(t):
    return ind.with_upper_median(t.bars, "turnover", 20, "median_turnover").select("symbol", "trade_date", "median_turnover")


@query
def rsi_wilder(t):
    return ind.with_rsi(asof.number_bars(t.bars)).select("symbol", "trade_date", *r6("rsi"))


@query
def atr_wilder(t):
    return ind.with_atr(asof.number_bars(t.bars)).select("symbol", "trade_date", q6(F.col("atr"), 1e4).alias("atr"))


@query
def adx_wilder(t):
    return ind.with_adx(asof.number_bars(t.bars)).select("symbol", "trade_date", *r6("adx", "plus_di", "minus_di"))


@query
def relative_strength(t):
    """Last bar of every symbol against the last index bar, both 63 bars back by position."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    bars = t.bars.withColumn("ret63", F.col("close") / F.lag("close", K.RS_BARS).over(w) - 1)
    last = bars.groupBy("symbol").agg(F.max_by("ret63", "trade_date").alias("ret63"))
    idx = technical.index_returns(t.index_bars).agg(F.max_by("idx_ret63", "trade_date").alias("idx_ret63"))
    return last.crossJoin(F.broadcast(idx)).withColumn("excess", F.col("ret63") - F.col("idx_ret63")).select(
        "symbol", *r6("ret63", "idx_ret63", "excess"))


@query
def delivery_trend(t):
    return ind.with_delivery_points(t.bars, "delivery_pct", 20, "delivery_pts").select("symbol", "trade_date", "delivery_pts")


_TECH = ["trend", "momentum", "rel_strength", "vol_delivery", "range_pos", "rs_excess", "pct_off_52w_high", "atr_stop"]


def technical_all(t):
    return technical.technical_scores(live_bars(t), live_index(t), latest_only=False)


@query
def technical_score(t):
    return technical_all(t).select("symbol", "as_of", "score", "label", *r6("confidence", *_TECH), *big("bar_no"))


@query
def technical_leaderboard(t):
    """Symbols that traded on the market's newest date, best score first."""
    t.store("bars", "index_bars")
    rows = technical.technical_scores(t.bars, t.index_bars, latest_only=True)
    return rows.select("symbol", "as_of", "score", "label", *r6("confidence", "trend", "range_pos")).orderBy(F.col("score").desc(), "symbol")


@query
def liquid_universe(t):
    return evaluate.liquid_universe(t.bars, 50).select("symbol", *r6("median_turnover"))


@query
def sparkline(t):
    return views.sparkline(t.bars).select("symbol", "trade_date", *r6("close", "position"))


# ---------------------------------------------------------------- as-of and performance

def quarter_grid(t):
    days = t.quarters.select(F.col("period_end").alias("day")).distinct()
    return t.securities.select("symbol").crossJoin(F.broadcast(days))


@query
def asof_backward(t):
    return asof.asof_backward(quarter_grid(t), t.bars, "day", ["trade_date", "close"], unique=True).select(
        "symbol", "day", F.col("trade_date").alias("bar_date"), *r6("close"))


@query
def asof_forward(t):
    return asof.asof_forward(quarter_grid(t), t.bars, "day", ["trade_date", "close"], unique=True).select(
        "symbol", "day", F.col("trade_date").alias("bar_date"), *r6("close"))


@query
def forward_returns(t):
    return asof.forward_returns(t.bars, K.FORWARD_WINDOWS).select("symbol", "trade_date", *r6("ret_1w", "ret_4w", "ret_12w"))


def measured(t):
    t.store("bars", "index_bars", "signals")
    return performance.measure(t.signals, t.bars, t.index_bars)


@query
def signal_performance(t):
    return measured(t).select("signal_id", "window", "stance", "profile", *r6("entry_price", "exit_price", "ret", "index_ret", "excess"))


@query
def performance_pending(t):
    """Second run over signals already measured for the shortest window."""
    done = measured(t).where(F.col("window") == "1w")
    return performance.measure(t.signals, t.bars, t.index_bars, done).groupBy("window").agg(F.count(F.lit(1)).alias("n"))


@query
def performance_summary(t):
    return performance.summarize(measured(t)).select("stance", "window", "n", *r6("avg_excess_pct", "hit_rate_pct"))


def live_events(t):
    return fusion.classified_events(t.filing_heads, t.classifications)


@query
def walk_forward(t):
    t.store("bars", "index_bars", "quarters")
    obs = backtest.observations(t.bars, t.index_bars, t.quarters, live_events(t))
    return obs.select("symbol", "d", "stance", "conviction", "confidence",
                      *r6("ret_1w", "ret_4w", "ret_12w", "excess_1w", "excess_4w", "excess_12w"))


@query
def walk_forward_summary(t):
    t.store("bars", "index_bars", "quarters")
    obs = backtest.observations(t.bars, t.index_bars, t.quarters, live_events(t), profile="momentum")
    return backtest.summarize(obs).select("stance", "window", "observations", *r6("avg_excess", "hit_rate", "avg_ret"))


@query
def buy_and_hold(t):
    return backtest.buy_and_hold(t.index_bars).select(*r6("buy_hold_pct"))


# ---------------------------------------------------------------- fundamentals

def fundamentals(t):
    return fundamental.fundamental_scores(live_quarters(t))


@query
def quarterly_growth(t):
    return fundamentals(t).select("symbol", "as_of", *r6("rev_yoy", "pat_yoy", "rev_qoq", "pat_qoq", "growth_pts"))


@query
def margin_trajectory(t):
    return fundamentals(t).select("symbol", "as_of", *r6("op_margin", "margin_pts"))


@query
def quality_flags(t):
    return fundamentals(t).select("symbol", "as_of", F.size("flags").cast("bigint").alias("n_flags"), F.array_join("flags", "\n").alias("flags"), *r6("quality_pts"))


@query
def fundamental_score(t):
    return fundamentals(t).select("symbol", "as_of", "basis", "score", "label", "confidence", "weight_covered", *big("n_quarters"))


@query
def fundamental_states(t):
    return fundamental.fundamental_states(t.quarters).select("symbol", "visible_on", "score", "label", "confidence", *big("n_quarters"))


@query
def revision_dedup_misfile(t):
    return xbrl.keep_revision(t.store("revisions").revisions).select("symbol", "period_end", "basis", "doc", *r6("revenue"))


@query
def xbrl_quarters(t):
    f = t.quarters.select(
        F.concat(F.lit("d"), F.col("filing_id").cast("string")).alias("doc"), F.col("filing_id").alias("doc_no"), "filing_id", "symbol",
        "event_at",
    )
    rows = xbrl.load_financials(t.result_facts, f)
    return rows.select("doc", "symbol", "period_start", "period_end", "basis", "audited",
                       *r6("revenue", "other_income", "total_income", "expenses", "finance_costs", "pbt", "tax", "pat"))


@query
def shp_facts(t):
    return xbrl.holding_instances(t.holding_facts).select("doc", "promoter_pct", "encumbered_shares", "encumbered_pct", "encumbered_pct_of_total")


# ---------------------------------------------------------------- point in time, dedup, keys

@query
def pit_filings(t):
    since = datetime(2001, 6, 1, tzinfo=timezone.utc)
    rows = pit.pit_filings(t.filing_heads, NOW, feed="announcements", since=since, limit=None)
    return rows.select("filing_id", "symbol", "subject", ts("event_at"), ts("observed_at"))


@query
def pit_classified(t):
    rows = pit.pit_classified(t.filing_heads, t.classifications, NOW, model_version=K.CLASSIFIER_VERSION, min_materiality=5,
                              since=datetime(2000, 1, 1, tzinfo=timezone.utc), limit=200)
    return rows.select("filing_id", "symbol", "category", *big("materiality"), ts("event_at"))


@query
def pit_classified_all(t):
    rows = pit.pit_classified(t.filing_heads, t.classifications, NOW, model_version=K.CLASSIFIER_VERSION, min_materiality=5,
                              since=datetime(2000, 1, 1, tzinfo=timezone.utc), limit=None)
    return rows.select("filing_id", "symbol", "category", *big("materiality"), ts("event_at"))


@query
def poison_check(t):
    """Counts per feed with future observations mixed in: they must not show."""
    late = t.filing_heads.withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 4000 DAYS"))
    both = t.filing_heads.unionByName(late)
    return pit.pit(both, now()).groupBy("feed").agg(F.count(F.lit(1)).alias("n"))


def typed_entries(t):
    return feeds.entries_to_filings(t.raw_entries, keep=["filing_id", "observed_at"])


@query
def rss_entries(t):
    e = typed_entries(t)
    return e.select(
        "filing_id", "symbol_hint", "subject", "content_hash", "dedup_key", "attachment_url", ts("event_at"),
        F.try_element_at("fields", F.lit("PERIOD")).alias("period"), F.try_element_at("fields", F.lit("_text")).alias("free_text"),
        F.size(F.map_keys("fields")).cast("bigint").alias("n_fields"),
    )


@query
def filing_dedup_two_layer(t):
    return keyed.dedup_filings(typed_entries(t)).select("filing_id", "feed", "dedup_key", "content_hash")


@query
def filing_dedup_stored(t):
    """Second poll: entries observed after the stored ones, two keys deep."""
    e = typed_entries(t)
    cut = F.lit("1998-06-01").cast("timestamp")
    stored = keyed.dedup_filings(e.where(F.col("observed_at") < cut))
    return keyed.dedup_filings(e.where(F.col("observed_at") >= cut), stored).select("filing_id", "feed")


@query
def first_wins_insert(t):
    key = ["day", "symbol", "side", "kind"]
    return keyed.insert_first_wins(t.deals, key, ["seq", "price", "qty"]).select(*key, "client", "qty", *r6("price"))


@query
def last_wins_upsert(t):
    key = ["symbol", "agent"]
    of = lambda d: t.stored_scores.where(F.col("as_of") == F.lit(d).cast("timestamp"))
    out = keyed.upsert_last_wins(of("2001-07-01"), of("2001-07-28"), key, ["score_id"], update=["score", "as_of"])
    return out.select("symbol", "agent", "score", "score_id", ts("as_of"))


@query
def bucketed_upsert(t):
    """Two days of scores through the stored table: the second rewrites the buckets of its keys only."""
    key, root = ["symbol", "agent"], f"{shared_dir(t.spark)}/scores-{uuid.uuid4().hex}"
    of = lambda d: t.stored_scores.where(F.col("as_of") == F.lit(d).cast("timestamp"))
    buckets.upsert_state(of("2001-07-01"), root, key, ["score_id"], buckets=16)
    buckets.upsert_state(of("2001-07-28"), root, key, ["score_id"], update=["score", "as_of"])
    return buckets.read_state(t.spark, root).select("symbol", "agent", "score", "score_id", ts("as_of"))


@query
def uniqueness_check(t):
    return keyed.uniqueness_violations(typed_entries(t), ["feed", "dedup_key"]).where(F.col("dedup_key").isNotNull()).select(
        "feed", "dedup_key", F.col("count").alias("n"))


@query
def exact_document_dedup(t):
    files = t.documents.select(F.concat(F.lit("https://files.example/"), F.col("doc_id"), F.lit(".txt")).alias("url"),
                               F.encode("text", "utf-8").alias("content"))
    return documents.catalogue(files).select("sha256", F.col("bytes").cast("bigint").alias("bytes"), "copies", "url", "path", "fetch_status", "fetch_error")


@query
def resolve_entity(t):
    n = F.col("event_id") % 5
    u = F.col("user_id").cast("string")
    token = (
        F.when(n == 0, F.concat(F.lit(" s"), u)).when(n == 1, F.concat(F.lit("IN"), F.lpad(u, 10, "0")))
        .when(n == 2, F.concat(F.lit("old"), u)).when(n == 3, F.concat(F.lit("Former Supplier#"), F.lpad(u, 9, "0"))).otherwise("??")
    )
    df = t.event_base.select("event_id", token.alias("token"))
    return resolve.resolve_token(df, "token", t.securities, t.aliases).select("event_id", "security_id")


@query
def resolve_name(t):
    df = t.raw_entries.select("filing_id", F.regexp_replace("title", "#  ", "#").alias("title"))
    return resolve.resolve_name(df, "title", t.securities, t.aliases).select("filing_id", "security_id")


@query
def attached_filings(t):
    """Symbol attach: file-name token first, company name second."""
    e = typed_entries(t)
    by_link = resolve.resolve_token(e, "symbol_hint", t.securities, t.aliases).withColumnRenamed("security_id", "_link_id")
    both = resolve.resolve_name(by_link, "company_title", t.securities, t.aliases)
    sid = F.coalesce("_link_id", "security_id")
    names = t.securities.select(F.col("security_id").alias("_sid"), F.col("symbol").alias("_sym"))
    out = both.withColumn("_sid", sid).join(names, "_sid", "left")
    return out.select("filing_id", F.col("_sid").alias("security_id"), F.coalesce("symbol_hint", "_sym").alias("symbol"))


@query
def securities_merge(t):
    stored = t.securities.where(F.col("security_id") % 10 != 7)
    return master.merge_snapshot(stored, t.snapshot).select("symbol", "security_id", "outcome", "old_symbol", "old_name", "face_value")


@query
def rename_aliases(t):
    return master.alias_rows(master.merge_snapshot(t.securities, t.snapshot))


@query
def industry_accretion(t):
    stated = resolve.industry_by_symbol(t.filing_heads, F.col("stated_industry"))
    return master.accrete_industry(t.securities, stated).select("security_id", "symbol", "old_industry", "industry")


@query
def document_state(t):
    docs = t.attempts.select("doc_id").distinct()
    return master.document_state(docs, t.attempts).select("doc_id", "fetch_status", *big("attempts"), ts("next_attempt_at"))


@query
def due_documents(t):
    state = master.document_state(t.attempts.select("doc_id").distinct(), t.attempts)
    return master.due_documents(state, F.lit("2024-01-20").cast("timestamp"), 100).select("doc_id", *big("attempts"))


@query
def due_documents_all(t):
    state = master.document_state(t.attempts.select("doc_id").distinct(), t.attempts)
    return master.due_documents(state, F.lit("2024-01-20").cast("timestamp"), None).select("doc_id", *big("attempts"))


@query
def pledge_worklist_all(t):
    held = t.pledge.where(F.col("record_id") == "R2")
    return master.pledge_worklist(live_heads(t), held, t.stored_scores, None).select("symbol", *big("tier"))


@query
def pledge_worklist(t):
    held = t.pledge.where(F.col("record_id") == "R2")
    return master.pledge_worklist(live_heads(t), held, t.stored_scores, 200).select("symbol", *big("tier"))


# ---------------------------------------------------------------- events, flow, risk

@query
def event_score(t):
    return fusion.event_scores(live_events(t), now()).select(
        "symbol", *r6("event_score", "event_conf"), F.size("evidence").cast("bigint").alias("n"))


@query
def peer_event_score(t):
    return fusion.peer_event_scores(live_events(t), t.securities, now()).select(
        "symbol", *r6("peer_score", "peer_conf"), F.size("peer_evidence").cast("bigint").alias("n"))


@query
def large_deal_net(t):
    return flow.net_deals(t.deals, now()).select("symbol", F.round("net_rs", 4).alias("net_rs"))


@query
def promoter_delta(t):
    return flow.promoter_delta(t.filings, now()).select("symbol", *r6("promoter_pct", "promoter_delta"))


def flow_all(t):
    return flow.flow_scores(live_bars(t), t.deals, live_filings(t), t.surveillance, now())


@query
def flow_score(t):
    return flow_all(t).select("symbol", "score", "label", "confidence", "weight_covered", *r6("deal_ratio", "promoter_delta", "surv_pts"), *big("insider_n"))


def risk_all(t):
    known = t.surveillance.where(F.col("as_of") <= now().cast("date"))
    universe = t.securities.select("symbol").union(known.select("symbol")).distinct()
    return risk.risk_verdicts(universe, live_bars(t), live_heads(t), live_classes(t), t.surveillance, t.pledge, live_quarters(t), now())


@query
def risk_verdict(t):
    return risk_all(t).select(
        "symbol", "verdict", "score", F.size("hard_blocks").cast("bigint").alias("n_hard"),
        F.size("penalties").cast("bigint").alias("n_soft"), F.size("unavailable").cast("bigint").alias("n_unavailable"),
        *r6("median_turnover", "lock_ratio", "mcap_cr"))


@query
def risk_reasons(t):
    line = lambda c: F.array_join(c, "\n").alias(c)
    return risk_all(t).select("symbol", "verdict", line("hard_blocks"), line("penalties"), line("unavailable"))


@query
def risk_universe(t):
    return risk.risk_universe(t.stored_scores, t.surveillance, now())


# ---------------------------------------------------------------- fusion

def fused(t):
    t.store("bars", "index_bars", "quarters", "filing_heads", "classifications", "securities", "deals")
    events = fusion.fold_peers(
        fusion.event_scores(live_events(t), now()), fusion.peer_event_scores(live_events(t), t.securities, now())
    )
    inputs = fusion.fusion_inputs(fundamentals(t), technical_all(t), flow_all(t), risk_all(t), events, now())
    return fusion.fuse(inputs, fusion.profile_table(t.spark))


@query
def fuse_profiles(t):
    return fused(t).select("symbol", "profile", "stance", "conviction", "confidence", "weight_covered", "risk_verdict", "horizon")


@query
def stance_levels(t):
    return fused(t).where(F.col("profile").isin("default", "short")).select(
        "symbol", "profile", "stance", "entry_low", "entry_high", "target_low", "target_high", "invalidation", "size_pct")


def unnumbered(c: str):
    """Lines without the ids of scores, which are hashes."""
    return F.transform(c, lambda x: F.regexp_replace(x, r"score#-?\d+", "score#"))


@query
def thesis_bullets(t):
    rows = fusion.with_thesis(fused(t))
    return rows.select("symbol", "profile", F.array_join(unnumbered("thesis_for"), "\n").alias("thesis_for"),
                       F.array_join(unnumbered("thesis_against"), "\n").alias("thesis_against"), "view_changer",
                       F.array_join("event_filings", ",").alias("event_filings"))


def _issued(t):
    return t.signals.where(F.col("as_of") <= now())


def _candidates(t):
    return fused(t).withColumn("as_of", now())


@query
def hysteresis_issue(t):
    return fusion.issue(_candidates(t), _issued(t)).select("symbol", "profile", "stance", "conviction", "model_version")


@query
def issue_stats(t):
    c = _candidates(t)
    return fusion.issue_stats(c, fusion.issue(c, _issued(t)))


@query
def hysteresis_replay(t):
    """Stored signals replayed with small moves: which ones would have been issued."""
    c = t.signals.withColumn("conviction", F.floor(F.col("conviction") / 10)).withColumn(
        "stance", F.when(F.col("conviction") >= 40, "hold").otherwise("exit"))
    return fusion.replay_hysteresis(c.select("signal_id", "symbol", "profile", "stance", "conviction", "model_version", "as_of")).select(
        "signal_id", "symbol", "profile", "issued")


@query
def latest_scores_pivot(t):
    return fusion.latest_scores(t.stored_scores)


@query
def issue_universe(t):
    fam = t.stored_scores.where(F.col("agent").isin("a3", "a4", "a5"))
    return fam.groupBy("symbol").agg(F.countDistinct("agent").alias("families")).where(F.col("families") >= 2)


# ---------------------------------------------------------------- rules and evaluation

def ruled(t):
    return rules.classify(t.filings)


@query
def classify_rules(t):
    """Whole subject and description of every filing."""
    return ruled(t).select("filing_id", "category", *big("materiality"), "sentiment", "confidence", "routine", "rule")


@query
def classify_finality(t):
    return rules.finalize(ruled(t)).select("filing_id", "category", *big("materiality"), "sentiment", *r6("confidence"), "routine", "rule_trace")


@query
def validate_model_json(t):
    return rules.validate_model_output(t.model_raw, "raw").select(
        "filing_id", "error", "m_category", *r6("m_materiality", "m_sentiment", "m_confidence"), "m_summary")


@query
def merge_model_output(t):
    checked = rules.validate_model_output(t.model_raw, "raw").drop("raw", "feed", "event_at")
    both = ruled(t).join(checked, "filing_id", "left")
    return rules.merge_model_output(both).select(
        "filing_id", "category", *big("materiality"), *r6("sentiment", "confidence"), "routine", "engine", "rule_trace", "summary")


def eval_rows(t):
    current = t.classifications.where(F.col("model_version") == K.CLASSIFIER_VERSION)
    return evaluate.predictions(t.label_rows, current)


@query
def eval_accuracy_spearman(t):
    return evaluate.classifier_report(eval_rows(t)).select("labelled", *r6("accuracy", "spearman"), "verdict")


@query
def eval_misses(t):
    return evaluate.misses(eval_rows(t))


@query
def stratified_sample(t):
    c = t.classifications.where(F.col("model_version") == K.CLASSIFIER_VERSION).drop("event_at", "observed_at")
    rows = t.filing_heads.select("filing_id", "feed", "symbol", "subject").join(c, "filing_id")
    return evaluate.stratified_sample(rows).select("stratum", "filing_id", "feed", "subject", *big("rn"))


@query
def coverage_diff(t):
    expected = t.filing_heads.where(F.col("feed") == "announcements").select("filing_id", F.col("event_at").cast("date").alias("day"), "link")
    held = t.filing_heads.where((F.col("feed") == "announcements") & (F.col("source") == "rss")).select("link")
    covered = evaluate.coverage(held, expected, ["link"])
    return evaluate.coverage_report(covered, ["day"]).select("day", "expected", "held", *r6("coverage_pct"))


@query
def reconcile_tolerance(t):
    return evaluate.reconcile(t.quarters, t.theirs)


@query
def reconcile_gate(t):
    return evaluate.reconcile_report(evaluate.reconcile(t.quarters, t.theirs)).select("symbols", *r6("within_pct"), "verdict")


# ---------------------------------------------------------------- calendar

def learned(t):
    """Days with an order count divisible by eleven play the holidays learned later."""
    per_day = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    events = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    both = per_day.unionByName(events).where(F.col("n") % 11 == 0)
    return both.select("day", F.concat(F.lit("learned "), F.col("n").cast("string")).alias("name"))


@query
def holiday_overlay(t):
    return cal.overlay_holidays(cal.seed_holidays(t.spark), learned(t))


@query
def trading_calendar(t):
    book = cal.overlay_holidays(cal.seed_holidays(t.spark), learned(t))
    return cal.trading_days(t.spark, "1995-01-01", "2026-12-31", book).select(
        "day", "holiday", "is_trading", "next_trading_day", "prev_trading_day")


@query
def session_state(t):
    df = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    book = cal.overlay_holidays(cal.seed_holidays(t.spark), learned(t))
    return cal.session_state(df, "ts", book).select("event_id", "session_state")


# ---------------------------------------------------------------- views

@query
def feed_state(t):
    return views.feed_state(t.polls).select("feed", ts("last_polled_at"), ts("last_changed_at"), "last_status",
                                            *big("entries_seen", "entries_new", "consecutive_errors"))


def more_feeds(t):
    """The configured feeds and one that was never polled."""
    return views.feed_table(t.spark).union(t.spark.createDataFrame([("pilot_feed", "P1")], "feed string, priority string"))


@query
def view_feeds(t):
    return views.feeds_view(more_feeds(t), views.feed_state(t.polls)).select(
        "feed", "priority", "last_status", *big("entries_seen"))


@query
def view_health(t):
    return views.health(more_feeds(t), views.feed_state(t.polls), poll_now())


@query
def view_filings(t):
    rows = views.symbol_filings(t.filing_heads, t.classifications, NOW, since=datetime(2001, 1, 1, tzinfo=timezone.utc), limit=None)
    return rows.select("filing_id", "symbol", "feed", "subject", "category", *big("materiality"), ts("event_at"))


@query
def view_pulse(t):
    rows = views.pulse(t.filing_heads, t.classifications, NOW, datetime(2001, 7, 1, tzinfo=timezone.utc), limit=None)
    return rows.select("filing_id", "symbol", "category", *big("materiality"), "sentiment", "confidence", "summary", "engine", ts("event_at"))


@query
def view_signals(t):
    news = views.adverse_news(live_heads(t), live_classes(t), now())
    rows = views.signals_view(_issued(t), news, profile="default", min_conviction=20.0, limit=25)
    return rows.select("symbol", "signal_id", "stance", "conviction", "upside_pct", "reco", "news_category", *big("news_materiality", "news_days_ago"))


@query
def view_signals_any_profile(t):
    news = views.adverse_news(live_heads(t), live_classes(t), now())
    rows = views.signals_view(_issued(t), news, profile=None, limit=None)
    return rows.select("symbol", "signal_id", "profile", "reco", views.stance_sort_key().cast("bigint").alias("stance_key"))


@query
def view_company(t):
    return views.company_ratios(live_bars(t), live_quarters(t)).select("symbol", *r6("price", "high_52w", "low_52w", "eps_ttm", "pe_ttm", "mcap_cr"))


@query
def shareholding_series(t):
    return views.shareholding_series(live_filings(t)).select("symbol", "filing_id", "as_on", *r6("promoter_pct", "public_pct", "promoter_delta"))


@query
def quarter_sheet(t):
    return views.quarter_sheet(live_quarters(t)).select("symbol", "metric", *r6(*[f"q{i}" for i in range(1, 9)]))


@query
def peer_board(t):
    t.store("bars", "index_bars", "quarters", "signals")
    return views.peer_board(t.securities, technical_all(t), fundamentals(t), _issued(t)).select(
        "symbol", "peer", "industry", "a4", "a3", "stance", "conviction")


@query
def view_stats(t):
    docs = master.document_state(t.attempts.select("doc_id").distinct(), t.attempts)
    return views.stats(t.filing_heads, docs, t.outbox).select("name", "label", *r6("value"))


@query
def audit_histogram(t):
    return views.audit_histogram(t.audit, F.lit("2024-01-30 23:59:00").cast("timestamp"))


@query
def view_metrics(t):
    acked = t.outbox.where(F.col("id") % 2 == 0).groupBy("topic").agg(F.max("id").alias("last_acked_id")).withColumn("consumer", F.lit("a2"))
    acked = acked.withColumn("last_acked_id", F.floor(F.col("last_acked_id") / 2))
    return views.metrics(t.filing_heads, t.outbox, views.feed_table(t.spark), views.feed_state(t.polls), t.classifications, t.audit, acked, poll_now())


@query
def view_alerts(t):
    return views.alerts_view(t.alert_log, "high", 50).select("alert_id", "severity", "category", "symbol", "message", ts("observed_at"))


@query
def alert_routing(t):
    c = alerts.route_classified(t.classifications.select("filing_id", "category", "materiality", "sentiment", "routine"))
    s = alerts.route_signals(t.signals.select("signal_id", "stance"))
    return c.select(F.col("filing_id").alias("ref"), "category", "severity").unionByName(
        s.select(F.col("signal_id").alias("ref"), "category", "severity"))


@query
def alert_messages(t):
    c = t.classifications.where(F.col("model_version") == K.CLASSIFIER_VERSION).drop("event_at", "observed_at")
    routed = alerts.route_classified(t.filing_heads.select("filing_id", "symbol").join(c, "filing_id"))
    standing = keyed.latest_per_key(_issued(t).where(F.col("profile") == "default"), ["symbol"], "as_of", "signal_id")
    return alerts.render_event_alerts(routed, standing, t.securities).select("filing_id", "severity", "message")


@query
def signal_messages(t):
    routed = alerts.route_signals(fusion.with_thesis(fused(t)).where(F.col("profile") == "default")
                                  .withColumns({"signal_id": F.substring("symbol", 2, 20).cast("bigint"), "thesis_for": unnumbered("thesis_for")}))
    return alerts.render_signal_alerts(routed, t.securities).select("symbol", "severity", "message")


@query
def alert_digest(t):
    rows = alerts.digest(t.alert_log, F.lit("2024-01-04 12:00:00").cast("timestamp"), "post_close")
    return rows.select("kind", *big("highs", "stances"), "text")


@query
def alert_rate_limit(t):
    return stateful.limit_alerts(t.alert_log).select("alert_id", "sent")
