"""Queries that run the file readers: files and messages built as text from the given tables, parsed again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.driver.queries import big, learned, live_bars, live_filings, live_quarters, more_feeds, now, poll_now, q6, query, r6, ts
from tapeloom.driver.tables import Tables
from tapeloom.functions import calendar as cal, text as X
from tapeloom.plans import flow, rules, views
from tapeloom.sources import feeds, flows, masters, prices, sinks, xbrl


def txt(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def grouped(number: Column) -> Column:
    """A whole number below a million as text with a comma after the thousands, '-' or blank."""
    plain = F.concat(F.lit(" "), txt(F.floor(number / 1000)), F.lit(","), F.lpad(txt(number % 1000), 3, "0"), F.lit(".5 "))
    return F.when(number % 7 == 0, "-").when(number % 7 == 1, "").otherwise(plain)


def stamp(x: str) -> Column:
    return F.date_format(x, "dd-MMM-yyyy")


def as_csv(t: Tables, df: DataFrame, name: str, header: bool = True) -> str:
    path = f"{sinks.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("header", header).csv(path)
    return path


def json_rows(df: DataFrame, body: Column, schema: str) -> DataFrame:
    """Rows of a JSON text column, parsed by the reader's schema."""
    return df.select(F.to_json(body).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*")


@query
def announcements_json(t):
    e = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    n = F.col("event_id")
    body = F.struct(
        F.when(n % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("https://f.example/"), txt(n), F.lit(".pdf"))).alias("attchmntFile"),
        F.when(n % 8 != 0, txt(n)).alias("seq_id"), F.concat(F.lit(" s"), txt("user_id")).alias("symbol"), F.lit("").alias("sm_isin"),
        F.col("event_type").alias("desc"), F.when(n % 3 == 0, "body text").alias("attchmntText"),
        F.date_format("ts", "dd-MMM-yyyy HH:mm:ss").alias("an_dt"), F.concat(F.lit("IND"), txt(n % 5)).alias("smIndustry"))
    rows = feeds.announcements_to_filings(json_rows(e, body, feeds.ANNOUNCEMENT_SCHEMA))
    return rows.select("symbol", "isin", "subject", "description", "dedup_key", "content_hash", feeds.industry_statement().alias("industry"), ts("event_at"), "source")


@query
def price_csv(t):
    n = F.col("l_partkey")
    series = F.element_at(F.array(*[F.lit(s) for s in ("EQ", "BE", "GB", "SM", "ST", "BZ", "N1")]), F.col("l_linenumber").cast("int"))
    rows = t.lineitem.select(
        F.concat(F.lit(" S"), txt("l_suppkey"), F.lit(" ")).alias("SYMBOL"), series.alias(" SERIES"), grouped(n).alias(" OPEN_PRICE"),
        grouped(n + 1).alias(" HIGH_PRICE"), grouped(n + 2).alias(" LOW_PRICE"), txt("l_linenumber").alias(" CLOSE_PRICE"),
        txt(F.col("l_orderkey")).alias(" NO_OF_TRADES"), F.when(n % 2 == 0, "x").otherwise(txt(n % 100)).alias(" DELIV_PER"))
    bars = prices.equity_bars(prices.read_text_csv(t.spark, as_csv(t, rows, "prices")), F.lit("2001-07-27").cast("date"))
    sums = [F.sum(c).alias(c) for c in ("open", "high", "low", "close", "trades", "delivery_pct")] + [F.count(c).alias(f"n_{c}") for c in ("open", "delivery_pct", "volume")]
    return bars.groupBy("symbol", "series", "source").agg(F.count(F.lit(1)).alias("n"), *sums)


@query
def index_csv(t):
    n = F.col("o_custkey")
    names = F.array(*[F.lit(s) for s in [*K.KEEP_INDICES, "Nifty Other"]])
    rows = t.orders.select(
        F.element_at(names, (n % (len(K.KEEP_INDICES) + 1) + 1).cast("int")).alias("Index Name"), grouped(n).alias("Open Index Value"),
        grouped(n + 3).alias("Closing Index Value"), txt(n).alias("Volume"), txt("o_orderkey").alias("Turnover (Rs. Cr.)"))
    bars = prices.index_bars(prices.read_text_csv(t.spark, as_csv(t, rows, "indices")), F.lit("2001-07-27").cast("date"))
    return bars.groupBy("symbol", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("open", "close", "volume", "turnover")], F.count("high").alias("n_high"), F.count("prev_close").alias("n_prev"))


@query
def market_flow_json(t):
    n = F.col("o_custkey")
    body = F.struct(
        F.when(n % 2 == 0, "FII/FPI *").when(n % 3 == 0, "DII").alias("category"), F.when(n % 11 == 5, "bad").otherwise(stamp("o_orderdate")).alias("date"),
        grouped(n).alias("buyValue"), grouped(n + 1).alias("sellValue"), txt(n).alias("netValue"))
    rows = flows.market_flow(json_rows(t.orders, body, flows.FLOW_SCHEMA))
    return rows.groupBy("day", "category").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("buy_value", "sell_value", "net_value")])


@query
def large_deals_csv(t):
    """The same deals in the bulk and the block file; each file also repeats lines."""
    n = F.col("l_partkey")
    rows = t.lineitem.where("l_linenumber <= 2").select(
        F.upper(stamp("l_shipdate")).alias("Date"), F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("S"), txt("l_suppkey"))).alias("Symbol"),
        F.lit("x").alias("Security Name"), F.concat(F.lit("Client "), txt(n % 50)).alias("Client Name"),
        F.when(n % 2 == 0, "Buy").otherwise("Sell").alias("Buy/Sell"), F.concat(txt(F.col("l_quantity").cast("int")), F.lit(",000")).alias("Quantity Traded"),
        txt(F.col("l_linenumber")).alias("Trade Price / Wght. Avg. Price"))
    both = flows.read_large_deals(t.spark, as_csv(t, rows.union(rows.where(F.col("Date").isNotNull())), "bulk"), as_csv(t, rows, "block"))
    return both.groupBy("symbol", "client", "side", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.min("day").alias("first_day"))


@query
def surveillance_json(t):
    k = F.col("s_suppkey")
    member = lambda sym, stage: F.struct(sym.alias("symbol"), stage.alias("asmSurvIndicator"), F.col("s_name").alias("companyName"))
    stages = F.concat(F.lit("Stage "), txt(k % 3))
    sym = F.concat(F.lit(" S"), txt(k % 40))
    asm = F.struct(
        F.struct(F.array(member(sym, stages), member(F.lit(" "), stages), member(sym, F.lit("Stage late"))).alias("data")).alias("longterm"),
        F.struct(F.when(k % 2 == 0, F.array(member(sym, F.lit(None).cast("string")))).alias("data")).alias("shortterm"))
    gsm = F.struct(sym.alias("symbol"), F.concat(F.lit("G"), txt(k % 4)).alias("gsmStage"), F.when(k % 5 != 0, "C").alias("survCode"), F.lit("d").alias("survDesc"))
    rows = flows.surveillance(json_rows(t.supplier, asm, flows.ASM_SCHEMA), json_rows(t.supplier.where(k % 3 == 0), gsm, flows.MEMBER), F.lit("2001-07-27").cast("date"))
    return rows.select("symbol", "framework", "stage", "as_of")


def _listing(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2001-01-01").cast("date"), (k % 900).cast("int"))
    when = F.when(k % 4 == 0, F.upper(F.date_format(day, "dd-MMM-yyyy"))).when(k % 4 == 1, F.date_format(day, "dd-MMM-yy")).when(k % 4 == 2, F.date_format(day, "dd-MM-yyyy")).otherwise("soon")
    return t.customer.select(
        F.concat(F.lit("S"), txt(k)).alias("SYMBOL"), F.concat(F.lit(" Co "), txt(k), F.lit(" ")).alias("NAME_OF_COMPANY"), F.when(k % 6 == 0, " ").otherwise("EQ").alias(" SERIES"),
        when.alias(" DATE_OF_LISTING"), F.concat(F.lit("INE"), txt(k)).alias(" ISIN_NUMBER"), F.when(k % 3 == 0, "0").otherwise("1,0").alias(" FACE_VALUE"))


@query
def listing_csv(t):
    """The first candidate is missing, the second too short, the third is taken."""
    full, root = as_csv(t, _listing(t).coalesce(1), "listing"), sinks.shared_dir(t.spark)
    stub = as_csv(t, _listing(t).where("SYMBOL = 'S1'").coalesce(1), "listing-stub")
    rows = masters.first_accepted(t.spark, [f"{root}/none-{uuid.uuid4().hex}", stub, full])
    return masters.listing_snapshot(rows, False).select("symbol", "isin", "company_name", "series", "is_sme", "listing_date", "face_value")


@query
def rename_files(t):
    """Symbol and name changes as aliases of known securities that are not stored yet."""
    k = F.col("s_suppkey")
    symbols = t.supplier.select(
        F.lit("Co"), F.concat(F.lit("OLD"), txt(k)), F.when(k % 5 == 0, F.concat(F.lit("OLD"), txt(k))).otherwise(F.concat(F.lit(" S"), txt(k))), F.lit("05-AUG-2001"))
    renames = t.supplier.select(F.concat(F.lit("S"), txt(k)).alias("NCH_SYMBOL"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Former "), F.col("s_name"))).alias("NCH_PREV_NAME"))
    a = masters.change_aliases(masters.symbol_changes(t.spark, as_csv(t, symbols, "renames", header=False)), t.securities, "old_symbol", t.aliases)
    b = masters.change_aliases(masters.name_changes(t.spark, as_csv(t, renames, "names")), t.securities, "old_name", t.aliases)
    return a.unionByName(b)


@query
def holidays_json(t):
    """One document of all order days of a kind; there are as many as the calendar has."""
    days = t.orders.where("o_custkey % 50 = 7").select("o_orderdate").distinct()
    item = F.struct(F.when(F.dayofmonth("o_orderdate") == 13, "bad").otherwise(F.upper(stamp("o_orderdate"))).alias("tradingDate"), F.when(F.dayofmonth("o_orderdate") % 2 == 0, "feast").alias("description"))
    doc = days.agg(F.to_json(F.struct(F.collect_list(item).alias("CM"), F.collect_list(item).alias("FO"))).alias("value"))
    path = f"{sinks.shared_dir(t.spark)}/holidays-{uuid.uuid4().hex}"
    doc.write.text(path)
    return masters.read_holidays(t.spark, path)


@query
def results_index(t):
    n = F.col("o_orderkey")
    day = F.col("o_orderdate")
    link = F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" http://x/"), txt(n), F.lit(".xml")))
    classic = t.orders.where(n % 2 == 0).select(
        link.alias("xbrl"), stamp("o_orderdate").alias("toDate"), F.concat(stamp("o_orderdate"), F.lit(" 10:30:00")).alias("broadCastDate"),
        F.when(n % 3 == 0, "First Quarter").alias("relatingTo"), F.lit("Consolidated").alias("consolidated"))
    integrated = t.orders.where(n % 2 == 1).select(
        link.alias("xbrl"), F.upper(stamp("o_orderdate")).alias("qe_Date"), F.when(n % 3 == 0, "").otherwise(stamp("o_orderdate")).alias("broadcast_Date"),
        F.date_format(F.date_add(day, 1), "dd-MMM-yyyy").alias("creation_Date"), F.lit("Standalone").alias("consolidated"))
    return xbrl.results_index(classic, integrated).select("xbrl", ts("to_date"), ts("broadcast"), "subject")


@query
def latest_submission(t):
    n = F.col("o_orderkey")
    index = t.orders.select(
        F.concat(F.lit("S"), txt("o_custkey")).alias("symbol"), F.when(n % 9 != 0, F.lpad(txt(n), 9, "0")).alias("recordId"),
        F.when(n % 4 == 0, "-").otherwise(F.concat(F.lit("http://x/"), txt(n))).alias("xbrl"), F.when(n % 7 != 0, stamp("o_orderdate")).alias("broadcastDate"))
    return xbrl.latest_submission(index).select("symbol", "record_id", "xbrl", ts("event_at"))


@query
def text_markers(t):
    """Direction of a sentiment, escaped text and value ranges."""
    n = F.col("event_id")
    lo = F.when(n % 6 != 0, (n % 1000) / 4)
    e = t.events.select(
        n, ((n % 41) / 20.0 - 1.0).alias("sentiment"), F.concat(F.col("event_type"), F.lit(" <b> & "), txt(n)).alias("raw"), lo.alias("lo"), F.when(n % 4 != 0, lo + 0.5).alias("hi"))
    return e.select("event_id", X.direction(F.col("sentiment")).alias("direction"), X.html_escape(F.col("raw")).alias("escaped"), X.value_range(F.col("lo"), F.col("hi")).alias("value_range"))


@query
def muhurat_days(t):
    """Orders moved to the years of the evening session, and their distance from it."""
    year = F.year("o_orderdate") % 4 + 2023
    return t.orders.select(year.alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("muhurat", cal.muhurat_date(F.col("year"))).select(*big("year"), "n", "muhurat")


@query
def freshness_split(t):
    return t.filing_heads.groupBy("feed", rules.fresh(F.col("observed_at"), now()).alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


@query
def score_events(t):
    """Topic rows beside the stored scores and signals, one topic for each family."""
    out = feeds.outbox_rows(t.signals, "signal.issued", "symbol", "profile", "stance", "signal_id")
    for agent, topic in (("a3", "fundamental.scored"), ("a4", "technical.scored"), ("a5", "flow.scored"), ("a6", "risk.assessed")):
        rows = feeds.outbox_rows(t.stored_scores.where(F.col("agent") == agent), topic, "symbol", "score", "score_id")
        out = out.unionByName(rows)
    return out


@query
def report_sink(t):
    """A written report, read back."""
    path = f"{sinks.shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(sinks.report_row(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_counts"), path)
    back = t.spark.read.schema("name string, body string").json(path)
    return back.select("name", F.get_json_object("body", "$.event_type").alias("event_type"), F.get_json_object("body", "$.n").cast("bigint").alias("n"))



# ---------------------------------------------------------------- chained views

def lines(array: str, line) -> Column:
    return F.array_join(F.transform(array, line), "\n").alias(array)


@query
def company_detail(t):
    t.store("bars", "quarters")
    rows = views.company_detail(t.securities, t.signals, t.stored_scores, live_quarters(t), t.filing_heads, t.bars, now())
    cat = lambda *parts: F.concat_ws(" ", *parts)
    return rows.select(
        "symbol", "company_name", "industry",
        lines("signals", lambda x: cat(x["profile"], x["stance"], X.shortest(x["conviction"]), txt(x["signal_id"]))),
        lines("scores", lambda x: cat(x["agent"], X.shortest(x["score"]), F.date_format(x["as_of"], "yyyy-MM-dd"))),
        lines("quarters", lambda x: cat(txt(x["period_end"]), x["basis"], X.shortest(x["revenue_cr"]), X.shortest(x["pat_cr"]))),
        lines("filings", lambda x: cat(txt(x["filing_id"]), x["feed"])), lines("closes", lambda x: cat(txt(x["trade_date"]), X.shortest(q6(x["close"])))))


@query
def health_status(t):
    problems = views.health(more_feeds(t), views.feed_state(t.polls), poll_now())
    runs = t.polls.select(F.lit("a1_poller").alias("agent"), (F.col("moment") + F.expr("INTERVAL 3 SECONDS")).alias("finished_at"))
    return views.health_status(problems, runs).select("status", ts("last_pass"), "problems")


@query
def flow_context(t):
    """Flow scores with the newest net value of each investor category."""
    market = t.orders.groupBy(F.col("o_orderdate").alias("day"), F.when(F.col("o_custkey") % 2 == 0, "FII/FPI").otherwise("DII").alias("category")).agg(F.sum(F.col("o_custkey").cast("double")).alias("net_value"))
    rows = flow.flow_scores(live_bars(t), t.deals, live_filings(t), t.surveillance, now(), market)
    return rows.select("symbol", "score", F.element_at("market_context", "FII/FPI").alias("fii"), F.element_at("market_context", "DII").alias("dii"))


@query
def adjacent_trading_days(t):
    """Every ship date and its neighbours, moved a century past the calendar table as well."""
    dates = t.lineitem.select(F.col("l_shipdate").alias("d")).union(t.lineitem.select(F.add_months("l_shipdate", 1200)))
    return cal.adjacent_trading_days(dates, "d", cal.overlay_holidays(cal.seed_holidays(t.spark), learned(t)))


@query
def financials_upsert(t):
    """Parsed results laid over stored quarters: half of these are older figures of the same keys."""
    t.store("quarters")
    docs = t.quarters.select(F.concat(F.lit("d"), txt("filing_id")).alias("doc"), F.col("filing_id").alias("doc_no"), "filing_id", "symbol", "event_at")
    new = xbrl.load_financials(t.result_facts, docs)
    old = t.quarters.where("filing_id % 2 = 0").select(
        "symbol", "period_end", "basis", F.concat(F.lit("s"), txt("filing_id")).alias("doc"), F.lit(-1).cast("bigint").alias("doc_no"), F.lit(-1.0).alias("revenue"),
        F.lit(None).cast("bigint").alias("security_id"), F.create_map(F.lit("k"), F.lit("v")).alias("raw"))
    old = old.union(old.where("doc_no < 0").select(F.concat(F.lit("Z"), F.col("symbol")), *old.columns[1:]))
    rows = xbrl.store_financials(new, old, t.securities)
    return rows.select("symbol", "period_end", "basis", "doc", "security_id", *r6("revenue"), F.size("raw").cast("bigint").alias("n_raw"), F.element_at("raw", "DateOfEndOfReportingPeriod").alias("raw_end"))
