"""File sources on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import documents, feeds, flows, masters, prices, sinks, xbrl

def day():
    return F.lit("2026-08-05").cast("date")


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rss_file(spark, tmp_path):
    item = ("<item><title>Bharti Airtel Limited</title><link>https://f.example/corporate/BHARTIARTL_05082026000335_x.pdf</link>"
            "<pubDate>05-Aug-2026 00:03:49</pubDate><description>Press release |SUBJECT: Acquisition</description></item>")
    blank = "<item><title>M and M</title><link>https://f.example/x/BRSR_1_20260804_233837946.xml</link><pubDate></pubDate><description></description></item>"
    path = put(tmp_path / "feed.xml", f"<rss><channel>{item}{blank}</channel></rss>")
    rows = feeds.entries_to_filings(feeds.read_rss(spark, path, "announcements")).orderBy("company_title").collect()
    assert rows[0]["symbol_hint"] == "BHARTIARTL" and rows[0]["subject"] == "Acquisition" and rows[0]["event_at"] == dt.datetime(2026, 8, 4, 18, 33, 49)
    assert rows[1]["subject"] == "M and M" and rows[1]["event_at"] == dt.datetime(2026, 8, 4, 18, 8, 37) and rows[1]["description"] is None


def test_announcement_rows_meet_the_feed_key(spark, tmp_path):
    rows = [{"attchmntFile": "https://f.example/a.pdf", "seq_id": "1", "symbol": "acme", "desc": "Update", "an_dt": "05-Aug-2026 10:00:00", "smIndustry": "Steel"},
            {"attchmntFile": " ", "seq_id": "2", "symbol": "ACME"}, {"symbol": "NOKEY"}]
    df = feeds.announcements_to_filings(feeds.read_announcements(spark, put(tmp_path / "a.json", json.dumps(rows))))
    got = {r["dedup_key"]: r for r in df.collect()}
    assert set(got) == {"https://f.example/a.pdf", "seq:2"} and got["https://f.example/a.pdf"]["symbol"] == "ACME"
    assert got["https://f.example/a.pdf"]["raw"]["smIndustry"] == "Steel"


def test_price_files(spark, tmp_path):
    eq = put(tmp_path / "eq.csv", "SYMBOL, SERIES, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, DELIV_PER\n"
             "ACME, EQ, 10, 12, 9, 11, 1000, 1.5, 60.5\nBOND, GB, 1, 1, 1, 1, 1, 1, 1\nILLQ, BE, -, , 9, x, 5, 1, -\n")
    got = {r["symbol"]: r for r in prices.equity_bars(prices.read_text_csv(spark, eq), day()).collect()}
    assert set(got) == {"ACME", "ILLQ"} and got["ACME"]["close"] == 11.0 and got["ACME"]["delivery_pct"] == 60.5
    assert got["ILLQ"]["open"] is None and got["ILLQ"]["close"] is None and got["ILLQ"]["delivery_pct"] is None and got["ILLQ"]["low"] == 9.0
    ix = put(tmp_path / "ix.csv", "Index Name,Open Index Value,High Index Value,Low Index Value,Closing Index Value,Points Change,Volume,Turnover (Rs. Cr.)\n"
             "Nifty 500,1,2,0.5,1.5,3,10,20\nOther,1,1,1,1,1,1,1\n")
    rows = prices.index_bars(prices.read_text_csv(spark, ix), day()).collect()
    assert [(r["symbol"], r["close"], r["prev_close"], r["turnover"]) for r in rows] == [("IDX:Nifty 500", 1.5, None, 20.0)]


def test_flow_files(spark, tmp_path):
    f = put(tmp_path / "f.json", json.dumps([{"category": "FII/FPI *long name", "date": "05-Aug-2026", "buyValue": "1,234.5", "netValue": "-"}, {"category": "DII", "date": "bad"}]))
    rows = flows.read_market_flow(spark, f).collect()
    assert [(r["category"], r["buy_value"], r["net_value"]) for r in rows] == [("FII/FPI *long name", 1234.5, None)]
    head = "Date,Symbol,Security Name,Client Name,Buy/Sell,Quantity Traded,Trade Price / Wght. Avg. Price\n"
    bulk = put(tmp_path / "bulk.csv", head + '05-AUG-2026,ACME,Acme,Fund,BUY,"1,000",10.5\n05-AUG-2026,ACME,Acme,Fund,BUY,"1,000",10.5\n')
    block = put(tmp_path / "block.csv", head + "05-AUG-2026,ACME,Acme,Fund,SELL,500,10\n")
    got = flows.read_large_deals(spark, bulk, block).orderBy("kind").collect()
    assert [(r["kind"], r["side"], r["qty"], r["day"]) for r in got] == [("block", "SELL", 500.0, dt.date(2026, 8, 5)), ("bulk", "BUY", 1000.0, dt.date(2026, 8, 5))]
    asm = put(tmp_path / "asm.json", json.dumps({"longterm": {"data": [{"symbol": "A", "asmSurvIndicator": "Stage I"}, {"symbol": "A", "asmSurvIndicator": "Stage II"}]}, "shortterm": {"data": [{"symbol": "B", "asmSurvIndicator": "Stage I"}]}}))
    gsm = put(tmp_path / "gsm.json", json.dumps([{"symbol": "C", "gsmStage": "III", "survCode": "X", "survDesc": "y"}, {"symbol": " "}]))
    s = {(r["symbol"], r["framework"]): r["stage"] for r in flows.read_surveillance(spark, asm, gsm, day()).collect()}
    assert s == {("A", "asm_lt"): "Stage I", ("B", "asm_st"): "Stage I", ("C", "gsm"): "III"}


def test_master_files(spark, tmp_path):
    stub = put(tmp_path / "stub.csv", "SYMBOL,NAME_OF_COMPANY\nX,Y\n")
    full = put(tmp_path / "full.csv", "SYMBOL,NAME_OF_COMPANY, SERIES, DATE_OF_LISTING, ISIN_NUMBER, FACE_VALUE\n" + "".join(f"S{i},Co {i},SM,05-AUG-2024,INE{i},0\n" for i in range(12)))
    rows = masters.first_accepted(spark, [str(tmp_path / "none.csv"), stub, full])
    snap = masters.listing_snapshot(rows, True)
    assert snap.count() == 12 and snap.first()["face_value"] is None and snap.first()["listing_date"] == dt.date(2024, 8, 5)
    assert masters.first_accepted(spark, [stub]) is None
    ch = put(tmp_path / "sc.csv", "Acme,OLD,NEW,05-AUG-2024\nAcme,SAME,SAME,05-AUG-2024\n")
    sec = spark.createDataFrame([(1, "NEW")], "security_id bigint, symbol string")
    none = spark.createDataFrame([], "security_id bigint, alias string, alias_type string")
    alias = masters.change_aliases(masters.symbol_changes(spark, ch), sec, "old_symbol", none)
    assert [tuple(r) for r in alias.collect()] == [(1, "OLD", "old_symbol")]
    assert masters.change_aliases(masters.symbol_changes(spark, ch), sec, "old_symbol", alias).count() == 0
    nc = put(tmp_path / "nc.csv", "NCH_SYMBOL,NCH_PREV_NAME,NCH_NEW_NAME,NCH_DT\nNEW,Old Name,New Name,05-AUG-2024\n")
    assert masters.name_changes(spark, nc).first()["old"] == "Old Name"
    h = put(tmp_path / "h.json", json.dumps({"CM": [{"tradingDate": "15-Jan-2026", "description": "Election"}, {"tradingDate": "bad"}, {"tradingDate": "26-Jan-2026"}], "FO": [{"tradingDate": "01-Jan-2026"}]}))
    assert [(r["day"].day, r["name"]) for r in masters.read_holidays(spark, h).orderBy("day").collect()] == [(15, "Election"), (26, "holiday")]


RESULT = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:c="urn:c">
<c:Symbol contextRef="OneD">acme</c:Symbol><c:RevenueFromOperations contextRef="PrevD">900000</c:RevenueFromOperations>
<c:DateOfStartOfReportingPeriod contextRef="OneD">2026-04-01</c:DateOfStartOfReportingPeriod>
<c:DateOfEndOfReportingPeriod contextRef="OneD">2026-06-30</c:DateOfEndOfReportingPeriod>
<c:NatureOfReportStandaloneConsolidated contextRef="OneD">{basis}</c:NatureOfReportStandaloneConsolidated>
<c:WhetherResultsAreAuditedOrUnaudited contextRef="OneD">Unaudited</c:WhetherResultsAreAuditedOrUnaudited>
<c:{rev} contextRef="OneD">1000000</c:{rev}><c:ProfitLossForPeriod contextRef="OneD">150000</c:ProfitLossForPeriod></xbrl>"""


def test_result_files(spark, tmp_path):
    put(tmp_path / "a.xml", RESULT.format(basis="Consolidated", rev="RevenueFromOperations"))
    put(tmp_path / "b.xml", RESULT.format(basis="Non-Consolidated", rev="InterestEarned"))
    put(tmp_path / "c.xml", "<xbrl><Other contextRef='x'>1</Other></xbrl>")
    put(tmp_path / "d.xml", "not xml")
    facts = xbrl.read_facts(spark, str(tmp_path))
    assert [(r["doc"][-5], r["error"].split(":")[0]) for r in facts.where("error IS NOT NULL").collect()] == [("d", "unreadable")]
    rows = {r["doc"][-5]: r for r in xbrl.result_instances(facts).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert (a["symbol"], a["revenue"], a["pat"], a["basis"], a["audited"], a["quarterly"]) == ("ACME", 1e6, 150000.0, "consolidated", False, True)
    assert rows["b"]["basis"] == "standalone" and rows["b"]["revenue"] == 1e6


def shp(body, context="Prom_1", member=True):
    m = "<m>in:ShareholdingOfPromoterAndPromoterGroupMember</m>" if member else "<m>other</m>"
    return (f"<xbrl xmlns='urn:x' xmlns:c='urn:c'><context id='{context}'>{m}</context><context id='Other'><m>o</m></context>"
            f"<c:ShareholdingAsAPercentageOfTotalNumberOfShares contextRef='Other'>1</c:ShareholdingAsAPercentageOfTotalNumberOfShares>{body}</xbrl>")


def fact(name, value, context="Prom_1"):
    return f"<c:{name} contextRef='{context}'>{value}</c:{name}>"


P, E, O, N = ("ShareholdingAsAPercentageOfTotalNumberOfShares", "EncumberedSharesHeldAsPercentageOfTotalNumberOfShares",
              "PledgedOrEncumberedSharesHeldAsPercentageOfTotalNumberOfShares", "NumberOfSharesEncumbered")


@pytest.mark.parametrize("xml,expect", [
    (shp(fact(P, 0.3125) + fact(E, 0.24) + fact(N, 4811200)), (31.25, 4811200.0, 24.0, 7.5)),
    (shp(fact(P, 0.41) + fact(O, 0.55)), (41.0, None, 55.0, 22.55)),
    (shp("", member=False), (0.0, None, 0.0, 0.0)),
    (shp(fact(P, 0.5) + fact("WhetherAnySharesHeldByPromotersAreEncumbered", "false")), (50.0, None, 0.0, 0.0)),
    (shp(fact(P, 0.5) + fact("WhetherAnySharesHeldByPromotersAreEncumbered", "true")), (50.0, None, None, None)),
    (shp(fact(P, 55.0, "ShareholdingOfPromoterAndPromoterGroupI") + fact(E, 0.1, "ShareholdingOfPromoterAndPromoterGroupI"), "ShareholdingOfPromoterAndPromoterGroupI", False), (55.0, None, 10.0, 5.5)),
    ("<xbrl/>", None),
])
def test_holding_files(spark, tmp_path, xml, expect):
    put(tmp_path / "s.xml", xml)
    rows = xbrl.holding_instances(xbrl.read_facts(spark, str(tmp_path))).collect()
    assert [tuple(r)[1:] for r in rows] == ([] if expect is None else [expect])


REV = "symbol string, period_end date, basis string, doc string, doc_no bigint, revenue double"


def revision(spark, revenues, others=(100.0, 110.0, 90.0)):
    q = dt.date(2025, 3, 31)
    rows = [("X", q, "consolidated", f"d{i}", i, r) for i, r in enumerate(revenues)]
    rows += [("X", dt.date(2024, 3 * i + 3, 28), "consolidated", f"o{i}", 100 + i, o) for i, o in enumerate(others)]
    got = xbrl.keep_revision(spark.createDataFrame(rows, REV)).where(F.col("period_end") == F.lit(q)).collect()
    assert len(got) == 1
    return got[0]["doc"]


def test_revision_guard_matches_a_plain_fold(spark):
    import itertools

    def fold(revenues, others):
        med = sorted(o for o in others if o)[len([o for o in others if o]) // 2] if any(others) else None
        kept = 0
        for i in range(1, len(revenues)):
            n, o = revenues[i], revenues[kept]
            if n and o and max(n, o) > 5 * min(n, o) and med is not None and abs(o - med) < abs(n - med):
                continue
            kept = i
        return f"d{kept}"

    cases = [[100.0, 104.0], [100.0, 1000.0], [1000.0, 100.0], [100.0, None], [100.0, 0.0, 900.0], [10.0, 104.0, 1000.0, 300.0], [700.0, 20.0, 130.0, 900.0]]
    cases += [list(c) for c in itertools.islice(itertools.permutations([20.0, 100.0, 600.0, 900.0]), 0, 24, 5)]
    for c in cases:
        assert revision(spark, c) == fold(c, (100.0, 110.0, 90.0)), c
    assert revision(spark, [100.0, 1000.0], others=()) == "d1"


def test_document_catalogue(spark, tmp_path):
    for name, text in (("a.pdf", "same"), ("b.pdf", "same"), ("c.xml", "other"), ("big.bin", "x" * 100)):
        put(tmp_path / name, text)
    rows = documents.catalogue(documents.read_binary(spark, str(tmp_path)), cap=50).collect()
    assert sorted((r["copies"], r["bytes"], r["fetch_status"]) for r in rows) == [(1, 5, "fetched"), (1, 100, "failed"), (2, 4, "fetched")]
    assert all(r["path"].startswith(r["sha256"][:2] + "/" + r["sha256"]) for r in rows if r["fetch_status"] == "fetched")
    large = next(r for r in rows if r["fetch_status"] == "failed")
    assert large["url"].endswith("big.bin") and large["fetch_error"] == "too large: 100 bytes" and large["sha256"] is None and large["path"] is None


def test_clients_with_a_long_common_beginning_stay_apart(spark):
    name = "C" * 2000
    rows = spark.createDataFrame([("01-Jan-2026", "X", name + end, "BUY", "10", "5") for end in "ab"], "DATE string, SYMBOL string, `CLIENT NAME` string, `BUY/SELL` string, `QUANTITY TRADED` string, `TRADE PRICE / WGHT. AVG. PRICE` string")
    got = flows.large_deals(rows, "bulk").dropDuplicates(["day", "symbol", "client", "side", "qty", "kind"])
    assert sorted(r["client"][-1] for r in got.collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    first = sinks.write_version(df, str(tmp_path / "t"), "1")
    assert spark.read.parquet(first).count() == 1
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path / "t"), "1")
    sinks.append_facts(df, str(tmp_path / "f"))
    sinks.append_facts(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert json.loads(sinks.report_row(df, "r").first()["body"]) == {"n": 1, "s": "a"}
    assert sinks.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert feeds.outbox_rows(df, "filing.received", "n").first()["payload"] == '{"n":1}'


def test_results_index(spark):
    classic = spark.createDataFrame([("http://x/a.xml", "30-Jun-2026", "15-Jul-2026 10:00:00", "First Quarter", "Consolidated")], "xbrl string, toDate string, broadCastDate string, relatingTo string, consolidated string")
    integrated = spark.createDataFrame([("http://x/b.xml", "30-JUN-2026", None, "20-Jul-2026", "Standalone"), ("", "30-JUN-2026", None, None, None)], "xbrl string, qe_Date string, broadcast_Date string, creation_Date string, consolidated string")
    rows = {r["xbrl"]: r for r in xbrl.results_index(classic, integrated).collect()}
    assert len(rows) == 2 and rows["http://x/a.xml"]["subject"] == "First Quarter results (Consolidated)"
    assert rows["http://x/b.xml"]["to_date"] == rows["http://x/a.xml"]["to_date"]
    idx = spark.createDataFrame([("A", "1", "http://x/1", "01-Jul-2026"), ("A", "2", "-", "02-Jul-2026"), ("B", "3", "-", "01-Jul-2026")], "symbol string, recordId string, xbrl string, broadcastDate string")
    assert {r["symbol"]: r["record_id"] for r in xbrl.latest_submission(idx).collect()} == {"A": "1", "B": "none"}


def test_medians_of_other_periods(spark):
    """Against sorting the other periods' values, with ties, negative values, zeros, nulls and periods without values."""
    import random

    rng = random.Random(9)
    day = lambda p: dt.date(2020 + p // 4, p % 4 * 3 + 1, 28)
    rows = [(f"S{s}", day(rng.randrange(6)), rng.choice([None, 0.0, 5.0, 5.0, 7.5, -3.0, rng.uniform(-1e3, 1e6), float(rng.randrange(4))])) for s in range(30) for _ in range(rng.choice((1, 2, 9, 40)))]
    rows += [("HOT", day(rng.randrange(5)), rng.uniform(1, 1e9)) for _ in range(3000)]
    asked = sorted({(s, p) for s, p, _ in rows} | {("S1", day(7)), ("NONE", day(0))})
    want = {}
    for s, p in asked:
        others = sorted(v for t, q, v in rows if t == s and q != p and v)
        if others:
            want[s, p] = others[len(others) // 2]
    df = spark.createDataFrame(rows, "symbol string, period_end date, revenue double").repartition(3)
    got = xbrl.other_period_medians(df, spark.createDataFrame(asked, "symbol string, period_end date")).collect()
    assert {(r["symbol"], r["period_end"]): r["_median"] for r in got} == want and len(got) == len(want)
