"""Read views: every one is a lazy DataFrame over point-in-time tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import py_round, with_rounded
from tapeloom.functions.text import labelled_number
from tapeloom.operators.keyed import latest_per_key, top_per_key
from tapeloom.operators.pit import pit_classified, pit_filings, trailing
from tapeloom.plans.flow import holding_text
from tapeloom.plans.risk import market_cap_crore


def feed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.FEEDS, "feed string, priority string")


def feed_state(polls: DataFrame) -> DataFrame:
    """Counters per feed from the poll log (feed, poll_id, moment, status, seen, new).

    The error streak is the number of failures after the feed's last success: two mergeable
    aggregates and a broadcast of one row per configured feed, so a feed with most of the log
    stays distributed. Of polls at one moment the one with the largest id is the last.
    """
    ok = F.col("status") == "ok"
    base = polls.groupBy("feed").agg(
        F.max("moment").alias("last_polled_at"),
        F.max(F.when(ok & (F.col("new") > 0), F.col("moment"))).alias("last_changed_at"),
        F.max_by("status", F.struct("moment", "poll_id")).alias("last_status"),
        F.sum(F.when(ok, F.col("seen")).otherwise(0)).alias("entries_seen"),
        F.sum(F.when(ok, F.col("new")).otherwise(0)).alias("entries_new"),
        F.max(F.when(ok, F.col("moment"))).alias("_ok"),
    )
    errors = polls.where(F.col("status") == "error").join(F.broadcast(base.select("feed", "_ok")), "feed").where(
        F.col("_ok").isNull() | (F.col("moment") > F.col("_ok"))
    ).groupBy("feed").agg(F.count(F.lit(1)).alias("consecutive_errors"))
    return base.drop("_ok").join(errors, "feed", "left").withColumn("consecutive_errors", F.coalesce("consecutive_errors", F.lit(0)))


def feeds_view(feeds: DataFrame, state: DataFrame) -> DataFrame:
    """Every known feed with its state; feeds never polled show status ``never``."""
    return feeds.join(state, "feed", "left").withColumn("last_status", F.coalesce("last_status", F.lit("never")))


def health(feeds: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Named problems, one row each."""
    df = feeds.join(state, "feed", "left")
    age = F.floor((F.unix_micros(now) - F.unix_micros("last_polled_at")) / 1e6)
    limit = F.lit(K.STALE_AFTER_DEFAULT_SEC)
    for p, s in K.STALE_AFTER_SEC.items():
        limit = F.when(F.col("priority") == p, s).otherwise(limit)
    never = F.col("last_polled_at").isNull()
    problems = F.array_compact(
        F.array(
            F.when(never, F.lit("never polled")),
            F.when(~never & (age > limit), F.concat(F.lit("last poll "), age.cast("string"), F.lit("s ago"))),
            F.when(F.col("consecutive_errors") >= K.MAX_CONSECUTIVE_ERRORS,
                   F.concat(F.col("consecutive_errors").cast("string"), F.lit(" consecutive errors"))),
        )
    )
    return df.select("feed", F.explode(problems).alias("problem"))


def symbol_filings(
    filings: DataFrame, classifications: DataFrame, as_of: datetime, *, symbol: str | None = None,
    feed: str | None = None, since: datetime | None = None, limit: int | None = 100,
    version: str = K.CLASSIFIER_VERSION,
) -> DataFrame:
    """Filings with their classification tag where one exists."""
    f = pit_filings(filings, as_of, symbol=symbol, feed=feed, since=since, limit=limit)
    tags = classifications.where(F.col("model_version") == version).select("filing_id", "category", "materiality")
    return f.join(tags, "filing_id", "left")


def pulse(
    filings: DataFrame, classifications: DataFrame, as_of: datetime, since: datetime, *,
    min_materiality: int = 5, limit: int | None = 50, version: str = K.CLASSIFIER_VERSION,
) -> DataFrame:
    rows = pit_classified(
        filings, classifications, as_of, model_version=version, min_materiality=min_materiality, since=since, limit=limit
    )
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.col("subject")) if "summary" in rows.columns else F.col("subject")
    return rows.select("filing_id", "symbol", "category", "materiality", "sentiment", "confidence",
                       summary.alias("summary"), "engine", "event_at", "link")


def adverse_news(filings: DataFrame, classifications: DataFrame, now: Column, version: str = K.CLASSIFIER_VERSION) -> DataFrame:
    """(symbol, news_*): weightiest adverse event of the last seven days."""
    c = classifications.where(
        (F.col("model_version") == version) & trailing(F.col("observed_at"), now, "7 DAYS")
        & (F.col("materiality") >= 7) & (F.col("sentiment") <= -0.3)
    ).select("filing_id", "category", "materiality", "sentiment", "observed_at")
    rows = filings.where(F.col("symbol").isNotNull()).select("filing_id", "symbol").join(c, "filing_id")
    top = top_per_key(rows, ["symbol"], [F.col("materiality").desc(), F.col("filing_id")])
    days = F.floor((F.unix_micros(now) - F.unix_micros("observed_at")) / 86400e6).cast("int")
    return top.select("symbol", F.col("category").alias("news_category"), F.col("materiality").alias("news_materiality"),
                      F.col("sentiment").alias("news_sentiment"), days.alias("news_days_ago"))


def recommendation() -> Column:
    """Displayed recommendation: the stance, held back by adverse news."""
    s, news = F.col("stance"), F.col("news_category").isNotNull()
    out = F.when(s == "suppressed", "AVOID").when(news & s.isin("buy", "accumulate"), "CAUTION").when(news & (s == "hold"), "SELL RISK")
    for stance, label in (("buy", "BUY"), ("accumulate", "ADD"), ("hold", "HOLD"), ("reduce", "REDUCE"), ("exit", "SELL")):
        out = out.when(s == stance, label)
    return out.otherwise(F.upper(s))


def signals_view(
    signals: DataFrame, news: DataFrame, *, profile: str | None = "default", stance: str | None = None,
    min_conviction: float = 0.0, limit: int | None = 50,
) -> DataFrame:
    """Newest signal per symbol: top rows by conviction and every row with adverse news.

    ``profile=None`` takes the newest signal of any profile, as the console listing does.
    """
    rows = signals if profile is None else signals.where(F.col("profile") == profile)
    last = latest_per_key(rows, ["symbol"], "as_of", "signal_id").where(F.col("conviction") >= min_conviction)
    if stance is not None:
        last = last.where(F.col("stance") == stance)
    df = last.join(news, "symbol", "left").withColumns(
        {
            "upside_pct": F.when(
                (F.col("target_low") != 0) & (F.col("entry_high") > 0),
                py_round(100.0 * (F.col("target_low") / F.nullif("entry_high", F.lit(0.0)) - 1.0), 1),
            ),
            "reco": recommendation(),
        }
    )
    # two bounded-order reads instead of one global rank: the top rows and the flagged rest
    order = [F.col("conviction").desc(), F.col("symbol")]
    if limit is None:
        return df
    top = df.orderBy(*order).limit(limit)
    flagged = df.where(F.col("news_category").isNotNull()).join(top.select("symbol"), "symbol", "left_anti")
    return top.unionByName(flagged)


def stance_sort_key() -> Column:
    out = F.lit(-1)
    for i, s in enumerate(("suppressed", "exit", "reduce", "hold", "accumulate", "buy")):
        out = F.when(F.col("stance") == s, i).otherwise(out)
    return out


def shareholding_series(filings: DataFrame, keep: int = 8) -> DataFrame:
    """Newest ``keep`` promoter and public percentages per symbol with the promoter change."""
    text = holding_text()
    stated = F.nullif(F.regexp_extract(text, r"AS ON DATE\s*:\s*([0-9]{2}-[A-Za-z]{3}-[0-9]{4})", 1), F.lit(""))
    rows = filings.where((F.col("feed") == "shareholding_pattern") & F.col("symbol").isNotNull()).select(
        "symbol", "event_at", "filing_id",
        F.coalesce(stated, F.date_format("event_at", "yyyy-MM-dd"), F.lit("?")).alias("as_on"),
        labelled_number(text, "PR_AND_PRGRP").alias("promoter_pct"), labelled_number(text, "PUBLIC_VAL").alias("public_pct"),
    ).where(F.col("promoter_pct").isNotNull())
    order = [F.col("event_at").desc_nulls_last(), F.col("filing_id").desc()]
    # one row more than shown, so the oldest shown row still has its change
    top = top_per_key(rows, ["symbol"], order, keep + 1)
    w = Window.partitionBy("symbol").orderBy(*order)
    delta = F.col("promoter_pct") - F.lead("promoter_pct").over(w)
    top = top.withColumns({"_delta": delta, "_rn": F.row_number().over(w)}).where(F.col("_rn") <= keep)
    return with_rounded(top, {"promoter_delta": (F.col("_delta"), 2)}).drop("_rn", "_delta")


def company_ratios(bars: DataFrame, quarters: DataFrame) -> DataFrame:
    """Price, 52-week closes, TTM earnings, PE and market value per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    recent = bars.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= 260) & (F.col("close") != 0))
    price = recent.groupBy("symbol").agg(
        F.max_by("close", "trade_date").alias("price"), F.max("close").alias("high_52w"), F.min("close").alias("low_52w")
    )
    q = top_per_key(quarters.where(F.col("basis") == "consolidated"), ["symbol"], [F.col("period_end").desc()], 4)
    ttm = q.groupBy("symbol").agg(
        F.sum("eps_basic").alias("_eps"), F.count_if(F.col("eps_basic") != 0).alias("_n"),
        F.max_by("paidup", "period_end").alias("_paidup"), F.max_by("face", "period_end").alias("_face"),
    )
    eps = F.when(F.col("_n") == 4, F.col("_eps"))
    return price.join(ttm, "symbol", "left").select(
        "symbol", "price", "high_52w", "low_52w", eps.alias("eps_ttm"),
        (F.col("price") / F.nullif(eps, F.lit(0.0))).alias("pe_ttm"),
        market_cap_crore(F.col("_paidup"), F.col("_face"), F.col("price")).alias("mcap_cr"),
    )


def quarter_sheet(quarters: DataFrame, keep: int = 8) -> DataFrame:
    """Metrics as rows and the newest periods as columns ``q1`` (newest) to ``q8``.

    Consolidated rows when a symbol has any, else all its rows.
    """
    has = F.max((F.col("basis") == "consolidated").cast("int")).over(Window.partitionBy("symbol"))
    rows = quarters.withColumn("_c", has).where((F.col("_c") == 0) | (F.col("basis") == "consolidated"))
    w = Window.partitionBy("symbol").orderBy(F.col("period_end").desc(), "basis")
    rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    cells = rows.select(
        "symbol", F.concat(F.lit("q"), F.col("_rn").cast("string")).alias("_q"),
        (F.col("revenue") / K.CRORE).alias("revenue_cr"), (F.col("pat") / K.CRORE).alias("pat_cr"), F.col("eps_basic").alias("eps"),
    ).unpivot(["symbol", "_q"], ["revenue_cr", "pat_cr", "eps"], "metric", "value")
    return cells.groupBy("symbol", "metric").pivot("_q", [f"q{i}" for i in range(1, keep + 1)]).agg(F.first("value"))


def peer_board(securities: DataFrame, technical: DataFrame, fundamental: DataFrame, signals: DataFrame, keep: int = 8) -> DataFrame:
    """Best peers by default-profile conviction for every symbol, at most ``keep`` each.

    Only the ``keep + 1`` strongest scored members of an industry can be anyone's top peers,
    so the industry join is bounded by that number.
    """
    last = latest_per_key(signals.where(F.col("profile") == "default"), ["symbol"], "as_of", "signal_id")
    members = (
        securities.where(F.coalesce("industry", F.lit("")) != "").select("symbol", "industry")
        .join(technical.select("symbol", F.col("score").alias("a4")), "symbol", "left")
        .join(fundamental.select("symbol", F.col("score").alias("a3")), "symbol", "left")
        .join(last.select("symbol", "stance", "conviction"), "symbol", "left")
    )
    known = members.where(F.coalesce("a4", "a3", "conviction").isNotNull())
    order = [F.coalesce("conviction", F.lit(0.0)).desc(), F.col("peer")]
    pool = top_per_key(known.withColumnRenamed("symbol", "peer"), ["industry"], order, keep + 1)
    pairs = securities.select("symbol", "industry").join(pool, "industry").where(F.col("symbol") != F.col("peer"))
    return top_per_key(pairs, ["symbol"], order, keep)


def alerts_view(alerts: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    rows = alerts if severity is None else alerts.where(F.col("severity") == severity)
    return rows.orderBy(F.col("observed_at").desc(), F.col("alert_id").desc()).limit(limit)


def stats(filings: DataFrame, documents: DataFrame, outbox: DataFrame) -> DataFrame:
    """Long table (name, label, value) of totals."""
    total = filings.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100.0 * F.count("security_id") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("pct"),
    )
    pairs = F.explode(
        F.array(
            F.struct(F.lit("filings").alias("name"), F.col("n").cast("double").alias("value")),
            F.struct(F.lit("resolved_pct").alias("name"), F.col("pct").alias("value")),
        )
    )
    head = total.select(pairs.alias("p")).select("p.name", F.lit("").alias("label"), "p.value")
    by = lambda df, col, name: df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(name).alias("name"), "label", "value"
    )
    events = outbox.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("events").alias("name"), F.lit("").alias("label"), "value")
    return head.unionByName(by(filings, "source", "filings_by_source")).unionByName(events).unionByName(
        by(documents, "fetch_status", "documents")
    )


def audit_histogram(audit: DataFrame, now: Column) -> DataFrame:
    """Requests of the last hour by status, most frequent first."""
    status = F.coalesce(F.col("status").cast("string"), F.lit("transport_error"))
    recent = audit.where((F.col("observed_at") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("observed_at") <= now))
    return recent.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "status")


def consumer_lag(outbox: DataFrame, acked: DataFrame, consumer: str, topic: str) -> DataFrame:
    head = outbox.where(F.col("topic") == topic).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_head"))
    last = acked.where((F.col("consumer") == consumer) & (F.col("topic") == topic)).agg(
        F.coalesce(F.max("last_acked_id"), F.lit(0)).alias("_acked")
    )
    return head.crossJoin(F.broadcast(last)).select((F.col("_head") - F.col("_acked")).alias("lag"))


def metrics(
    filings: DataFrame, outbox: DataFrame, feeds: DataFrame, state: DataFrame, classifications: DataFrame,
    audit: DataFrame, acked: DataFrame, now: Column,
) -> DataFrame:
    """(name, labels, value) rows for a scraper."""
    one = lambda df, name, value: df.select(F.lit(name).alias("name"), F.lit("").alias("labels"), value.cast("double").alias("value"))
    tag = F.concat(F.lit('feed="'), F.col("feed"), F.lit('",priority="'), F.col("priority"), F.lit('"'))
    joined = state.join(feeds, "feed")
    age = F.floor((F.unix_micros(now) - F.unix_micros("last_polled_at")) / 1e6)
    per_feed = joined.select(
        tag.alias("labels"),
        F.explode(
            F.array(
                F.struct(F.lit("feed_poll_age_seconds").alias("name"), age.cast("double").alias("value")),
                F.struct(F.lit("feed_entries_new_total").alias("name"), F.col("entries_new").cast("double").alias("value")),
                F.struct(F.lit("feed_consecutive_errors").alias("name"), F.col("consecutive_errors").cast("double").alias("value")),
            )
        ).alias("m"),
    ).select("m.name", "labels", "m.value")
    http = audit_histogram(audit, now).select(
        F.lit("http_requests_last_hour").alias("name"), F.concat(F.lit('status="'), F.col("status"), F.lit('"')).alias("labels"), F.col("n").cast("double").alias("value")
    )
    engines = classifications.groupBy("engine").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("classifications_total").alias("name"), F.concat(F.lit('engine="'), F.col("engine"), F.lit('"')).alias("labels"), "value"
    )
    lag = consumer_lag(outbox, acked, "a2", "filing.received")
    out = one(filings.agg(F.count(F.lit(1)).alias("n")), "filings_total", F.col("n"))
    for part in (
        one(outbox.agg(F.count(F.lit(1)).alias("n")), "outbox_events_total", F.col("n")),
        per_feed, http, engines, one(lag, "consumer_lag_events", F.col("lag")),
    ):
        out = out.unionByName(part)
    return out


def sparkline(bars: DataFrame, keep: int = 90) -> DataFrame:
    """Min-max scaled closes of the newest ``keep`` bars per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    rows = bars.where(F.col("close").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    all_ = Window.partitionBy("symbol")
    lo, hi = F.min("close").over(all_), F.max("close").over(all_)
    pos = F.when(hi == lo, 0.5).otherwise((F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return rows.select("symbol", "trade_date", "close", pos.alias("position"))


def _newest(df: DataFrame, key: str, order: list[Column], n: int, item: Column, name: str) -> DataFrame:
    """(key, name): the first ``n`` rows of every key in order, as an array of ``item``."""
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("item")))), lambda x: x["item"])
    return top.groupBy(key).agg(rows.alias(name))


def company_detail(
    securities: DataFrame, signals: DataFrame, scores: DataFrame, quarters: DataFrame, filings: DataFrame, bars: DataFrame, now: Column,
    *, n_signals: int = 20, n_quarters: int = 12, n_filings: int = 15, n_closes: int = 90,
) -> DataFrame:
    """One row per symbol: what the detail pane shows, as known at ``now``.

    ``signals`` holds the newest signal of each profile among the newest ``n_signals``, ``scores``
    the newest score of each agent, ``quarters`` and ``filings`` (90 days) newest first, ``closes``
    oldest first. Every array is bounded by its parameter.
    """
    crore = lambda c: F.when(F.col(c) != 0, py_round(F.col(c) / K.CRORE, 1))
    issued = signals.where(F.col("as_of") <= now)
    recent = top_per_key(issued, ["symbol"], [F.col("as_of").desc(), F.col("signal_id").desc()], n_signals)
    newest = latest_per_key(recent, ["symbol", "profile"], "as_of", "signal_id")
    marks = latest_per_key(scores.where((F.col("as_of") <= now) & F.col("agent").isin("a3", "a4", "a5", "a6")), ["symbol", "agent"], "as_of", "score_id")
    seen = filings.where((F.col("observed_at") <= now) & (F.col("event_at") >= now - F.expr("INTERVAL 90 DAYS")))
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    parts = [
        _newest(newest, "symbol", [F.col("profile")], len(K.PROFILES), F.struct(
            "profile", "stance", "conviction", "confidence", "horizon", "entry_low", "entry_high", "target_low", "target_high", "invalidation", "risk_verdict", "signal_id", "as_of"), "signals"),
        _newest(marks, "symbol", [F.col("agent")], 4, F.struct(
            "agent", "score", optional(marks, "label").alias("label"), optional(marks, "confidence").alias("confidence"), "as_of"), "scores"),
        _newest(quarters, "symbol", [F.col("period_end").desc(), F.col("basis")], n_quarters, F.struct(
            "period_end", "basis", crore("revenue").alias("revenue_cr"), crore("pat").alias("pat_cr"), "filing_id"), "quarters"),
        _newest(seen, "symbol", [F.col("event_at").desc(), F.col("filing_id")], n_filings, F.struct("filing_id", "feed", "subject", "event_at"), "filings"),
        _newest(bars.where(F.col("trade_date") <= now.cast("date")), "symbol", [F.col("trade_date").desc()], n_closes, F.struct("trade_date", "close"), "_closes"),
    ]
    df = securities.select("symbol", "company_name", "industry")
    for side in parts:
        df = df.join(side, "symbol", "left")
    return df.withColumn("closes", F.reverse("_closes")).drop("_closes")


def health_status(problems: DataFrame, runs: DataFrame, agent: str = "a1_poller") -> DataFrame:
    """One row: overall status, last finished pass of the agent and the number of problems."""
    n = problems.agg(F.count(F.lit(1)).alias("problems"))
    last = runs.where(F.col("agent") == agent).agg(F.max("finished_at").alias("last_pass"))
    return n.crossJoin(F.broadcast(last)).select(F.when(F.col("problems") > 0, "degraded").otherwise("ok").alias("status"), "last_pass", "problems")
