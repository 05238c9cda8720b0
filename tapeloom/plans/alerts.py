"""Alert routing, message text and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions.text import fixed, general, html_escape, shortest, value_range
from tapeloom.operators.pit import trailing


def route_classified(events: DataFrame) -> DataFrame:
    """Classified filings worth an alert, with their severity."""
    m = F.coalesce("materiality", F.lit(0))
    return events.where((m >= 6) & ~F.coalesce("routine", F.lit(False))).select(
        "*", F.when(m >= 8, "high").otherwise("medium").alias("severity")
    )


def route_signals(signals: DataFrame) -> DataFrame:
    """Stance changes that are decisions."""
    return signals.where(F.col("stance").isin("buy", "exit", "suppressed")).select(
        "*", F.lit("medium").alias("severity"), F.concat(F.lit("signal_"), F.col("stance")).alias("category")
    )


def classified_message(materiality: Column, category: Column, sentiment: Column) -> Column:
    """Short text of a classified filing; unknown parts read ``None``."""
    text = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(F.lit("materiality "), F.coalesce(materiality, F.lit(0)).cast("string"), F.lit(" filing ("), text(category),
                    F.lit("), sentiment "), text(shortest(sentiment)))


def render_event_alerts(routed: DataFrame, standing: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds ``message``: what happened, the expected impact and the standing view.

    ``standing`` holds the newest default-profile signal per symbol.
    """
    s = standing.select("symbol", F.col("stance").alias("_stance"), F.col("conviction").alias("_conviction"),
                        F.col("confidence").alias("_confidence"), F.col("invalidation").alias("_stop"))
    names = securities.select("symbol", F.col("company_name").alias("_name"))
    df = routed.join(s, "symbol", "left").join(names, "symbol", "left")
    sent = F.coalesce("sentiment", F.lit(0.0))
    impact = F.when(sent > 0.15, "📈 positive").when(sent < -0.15, "📉 negative").otherwise("➖ neutral")
    has = F.col("_stance").isNotNull()
    name = F.when(F.coalesce("_name", F.lit("")) != "", F.concat(F.lit(" · "), html_escape(F.substring("_name", 1, 40)))).otherwise("")
    caution = F.when(
        (sent < -0.3) & F.col("_stance").isin("buy", "accumulate"),
        "⚠️ <b>Adverse news against a long stance — review before acting</b>",
    ).when(
        (sent < -0.3) & (F.col("_stance") == "hold"),
        "⚠️ <b>Sell risk — adverse news while holding; review the position</b>",
    )
    lines = [
        F.concat(F.when(F.col("materiality") >= 8, "🔴").otherwise("🟠"), F.lit(" <b>"), html_escape(F.coalesce("symbol", F.lit("?"))), F.lit("</b>"), name),
        F.concat(F.lit("<b>Event:</b> "), html_escape(F.col("category")), F.lit("  (materiality "), F.col("materiality").cast("string"), F.lit("/10)")),
        F.concat(F.lit("<b>Expected impact:</b> "), impact),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("<b>What happened:</b> "), html_escape(F.substring("summary", 1, 180)))),
        F.when(has, F.concat(F.lit("<b>Standing view:</b> "), F.initcap("_stance"), F.lit(" (conviction "), general(F.col("_conviction")),
                             F.lit(", confidence "), fixed(100.0 * F.coalesce("_confidence", F.lit(0.0)), 0), F.lit("%)")))
        .otherwise("<i>No standing signal for this symbol yet</i>"),
        caution,
        F.when(F.col("_stop").isNotNull(), F.concat(F.lit("<b>Stop:</b> "), general(F.col("_stop")))),
        F.concat(F.lit("<i>evidence: filing #"), F.col("filing_id").cast("string"), F.lit("</i>")),
    ]
    return df.withColumn("message", F.concat_ws("\n", *lines)).drop("_stance", "_conviction", "_confidence", "_stop", "_name")


def render_signal_alerts(routed: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds ``message`` for stance changes: the decision first, one parameter per line."""
    names = securities.select("symbol", F.col("company_name").alias("_name"))
    df = routed.join(names, "symbol", "left")
    icon = F.when(F.col("stance") == "buy", "🟢").when(F.col("stance") == "exit", "🔴").when(F.col("stance") == "suppressed", "🚫").otherwise("🟡")
    bold = lambda label, value: F.concat(F.lit(f"<b>{label}:</b> "), value)
    lines = [
        F.concat(icon, F.lit(" <b>"), F.initcap("stance"), F.lit(": "), html_escape(F.col("symbol")), F.lit("</b>"),
                 F.when(F.coalesce("_name", F.lit("")) != "", F.concat(F.lit(" · "), html_escape(F.substring("_name", 1, 40)))).otherwise("")),
        bold("Horizon", F.concat(F.col("horizon"), F.lit(" ("), F.col("profile"), F.lit(")"))),
        F.concat(bold("Conviction", general(F.col("conviction"))), F.lit("/100 · "),
                 bold("Confidence", fixed(100.0 * F.coalesce("confidence", F.lit(0.0)), 0)), F.lit("%")),
        bold("Risk check", F.col("risk_verdict")),
        F.when(F.col("entry_low").isNotNull(), bold("Entry zone", value_range(F.col("entry_low"), F.col("entry_high")))),
        F.when(F.col("target_low").isNotNull(), bold("Target zone", value_range(F.col("target_low"), F.col("target_high")))),
        F.when(F.col("invalidation").isNotNull(), bold("Stop loss", general(F.col("invalidation")))),
        F.when(F.col("size_pct").isNotNull(), F.concat(bold("Position size", general(F.col("size_pct"))), F.lit("% of capital"))),
        F.when(F.size("thesis_for") > 0, bold("Why", html_escape(F.substring(F.get("thesis_for", F.lit(0)), 1, 140)))),
        F.when(F.coalesce("view_changer", F.lit("")) != "", bold("View changes if", html_escape(F.substring("view_changer", 1, 120)))),
        F.concat(F.lit("<i>evidence: signal #"), F.col("signal_id").cast("string"), F.lit("</i>")),
    ]
    return df.withColumn("message", F.concat_ws("\n", *lines)).drop("_name")


def digest(alerts: DataFrame, now: Column, kind: str, hours: int = 20, keep: int = 15, show: int = 8) -> DataFrame:
    """One row: counts and text of the newest high alerts and stance changes of the window."""
    recent = alerts.where(trailing(F.col("observed_at"), now, f"{hours} HOURS"))
    order = [F.col("observed_at").desc(), F.col("alert_id").desc()]

    def section(rows: DataFrame, head: str, width: int) -> DataFrame:
        top = rows.orderBy(*order).limit(keep)
        line = F.struct(
            "observed_at", "alert_id",
            F.concat(F.lit("  "), F.coalesce("symbol", F.lit("?")), F.lit(": "), F.substring("message", 1, width)).alias("line"),
        )
        newest = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(line))), 1, show), lambda x: x["line"])
        return top.agg(F.count(F.lit(1)).alias("n"), newest.alias("lines")).select(
            "n", F.when(F.col("n") > 0, F.concat(F.array(F.concat(F.lit(f"{head} ("), F.col("n").cast("string"), F.lit("):"))), F.col("lines")))
            .otherwise(F.array().cast("array<string>")).alias("lines"),
        )

    highs = section(recent.where((F.col("severity") == "high") & (F.col("category") != "digest")), "High-materiality events", 80)
    moves = section(recent.where(F.col("category").startswith("signal_")), "Stance changes", 70)
    both = highs.toDF("highs", "_a").crossJoin(F.broadcast(moves.toDF("stances", "_b")))
    quiet = F.array(F.lit("quiet window — no high-materiality events, no stance changes"))
    body = F.when(F.col("highs") + F.col("stances") == 0, quiet).otherwise(F.concat("_a", "_b"))
    return both.select(
        F.lit(kind).alias("kind"), "highs", "stances",
        F.array_join(F.concat(F.array(F.lit(f"{kind} digest")), body), "\n").alias("text"),
    )
