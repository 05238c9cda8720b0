"""Vocabularies, weights, thresholds and text patterns.

Everything in this module is a fixed value that results depend on. The operators read
these tables; none of them carries its own copy.
"""

from __future__ import annotations

# ---- Fixed values: disclosure categories ------------------------------------------------
CATEGORIES = [
    "order_win", "capex", "capacity_expansion", "ma", "demerger",
    "fundraise", "debt_raise", "credit_rating_change", "results", "guidance",
    "dividend_bonus_split_buyback", "management_change", "auditor_resignation",
    "regulatory_action", "litigation", "insider_trade",
    "pledge_creation_release", "plant_shutdown", "fire_accident",
    "clarification_to_rumour", "other",
]

# ---- Fixed values: lowest materiality a category may carry ------------------------------
MATERIALITY_FLOORS = {
    "auditor_resignation": 9,
    "regulatory_action": 7,
    "plant_shutdown": 7,
    "fire_accident": 6,
    "credit_rating_change": 6,
    "ma": 6,
    "demerger": 6,
    "clarification_to_rumour": 5,
    "order_win": 4,
    "fundraise": 4,
    "pledge_creation_release": 4,
}

# ---- Fixed values: routine text patterns (name, case-insensitive pattern) ---------------
ROUTINE_PATTERNS = [
    ("nav_declaration", r"declaration of nav|net asset value"),
    ("trading_window", r"trading window|window closure"),
    ("newspaper_ad", r"newspaper (publication|advertisement)|copies of newspaper"),
    ("reg74_certificate", r"regulation 74 ?\(5\)|74\(5\) of sebi"),
    ("investor_meet", r"(analyst|institutional investor)s? meet|con\.? ?call|earnings call|investor presentation"),
    ("share_certificate", r"loss of share certificate|duplicate share certificate|issue of duplicate"),
    ("board_meeting_intimation", r"(prior )?intimation of board meeting|board meeting intimation|intimation.{0,30}(of )?board meeting|board meeting.{0,20}scheduled"),
    ("compliance_routine", r"change in company secretary and compliance officer|compliance certificate"),
    ("monitoring_agency", r"monitoring agency report"),
    ("disclosure_routine", r"spdi|large corporate|initial disclosure|annual disclosure"),
]

# ---- Fixed values: signal patterns (pattern, category, materiality, sentiment, conf) ----
SIGNAL_PATTERNS = [
    (r"resignation.{0,40}(statutory )?auditor|auditor.{0,30}resign", "auditor_resignation", 9, -0.9, 0.95),
    (r"(sebi|nclt|nclat|enforcement directorate|\bed\b|income tax|gst).{0,60}(order (passed|dated)|final order|interim order|penalt|search|raid|show.?cause|investigation|prohibit|debar)", "regulatory_action", 7, -0.7, 0.8),
    (r"corporate insolvency|\bcirp\b|insolvency resolution|liquidation order", "litigation", 7, -0.7, 0.85),
    (r"(plant|factory|unit|operations?).{0,30}(shut ?down|suspension|halt|closure)", "plant_shutdown", 7, -0.7, 0.8),
    (r"\bfire\b|accident|explosion|mishap", "fire_accident", 6, -0.6, 0.7),
    (r"(credit )?rating.{0,30}(downgrade|revised downward|negative)", "credit_rating_change", 7, -0.8, 0.9),
    (r"(credit )?rating.{0,30}(upgrade|revised upward|positive)", "credit_rating_change", 6, 0.8, 0.9),
    (r"(credit )?rating|icra|crisil|care ratings|india ratings", "credit_rating_change", 6, 0.0, 0.6),
    (r"(order|contract|loi|letter of (intent|award)|work order).{0,60}(received|award|bagg|secured|won|worth)", "order_win", 5, 0.7, 0.8),
    (r"capacity (expansion|addition)|new (plant|facility|unit)|greenfield|brownfield", "capacity_expansion", 5, 0.6, 0.7),
    (r"\bcapex\b|capital expenditure", "capex", 5, 0.5, 0.7),
    (r"(scheme of )?(amalgamation|merger|acquisition|acquire|takeover|slump sale)", "ma", 6, 0.3, 0.8),
    (r"demerger|de-merger|spin.?off|scheme of arrangement", "demerger", 6, 0.2, 0.8),
    (r"\bqip\b|qualified institutional|preferential (issue|allotment)|rights issue|warrants?\b.{0,30}(issue|allot|convert)|fund.?rais", "fundraise", 5, 0.1, 0.8),
    (r"(ncd|non.?convertible debenture|commercial paper|\bCP-(NI|RI)\b|bond issue|debt.{0,20}(raise|issue))", "debt_raise", 3, 0.0, 0.7),
    (r"buy.?back", "dividend_bonus_split_buyback", 6, 0.6, 0.85),
    (r"dividend|bonus (issue|share)|stock split|sub.?division of (equity )?shares", "dividend_bonus_split_buyback", 4, 0.5, 0.8),
    (r"(un)?audited financial results|financial results|statement of (standalone|consolidated)", "results", 5, 0.0, 0.85),
    (r"guidance|outlook (revised|raised|lowered)", "guidance", 6, 0.0, 0.7),
    (r"(resignation|appointment|cessation|steps? down).{0,50}(managing director|\bmd\b|\bceo\b|\bcfo\b|chairman|whole.?time director|key managerial)", "management_change", 5, -0.2, 0.75),
    (r"litigation|arbitral|arbitration|legal proceedings|court (order|case)|writ petition", "litigation", 5, -0.5, 0.7),
    (r"clarification.{0,40}(rumou?r|news (item|report)|price movement)", "clarification_to_rumour", 5, 0.0, 0.8),
    (r"insider trading|sast|substantial acquisition|disclosure under regulation (29|31)|trading plan", "insider_trade", 3, 0.0, 0.7),
    (r"(pledge|encumbrance).{0,30}(creat|invok|releas|revok)|reason for encumbrance", "pledge_creation_release", 4, -0.4, 0.8),
]

# ---- Fixed values: qualifier patterns ---------------------------------------------------
NON_STATUTORY_AUDITOR = r"(internal|secretarial|cost) auditor"
STATUTORY_AUDITOR = r"statutory auditor"
REGULATION_CITATION = r"sebi \("
ENFORCEMENT_MARKER = r"order (passed|dated)|final order|interim order|penalt|show.?cause|search|raid|investigation|debar"

# ---- Fixed values: feed priors (category, materiality, sentiment, confidence, routine) --
FEED_PRIORS = {
    "insider_trading": ("insider_trade", 3, 0.0, 0.9, False),
    "encumbrance": ("pledge_creation_release", 5, -0.4, 0.9, False),
    "financial_results": ("results", 5, 0.0, 0.9, False),
    "integrated_financials": ("results", 4, 0.0, 0.85, False),
    "sast_reg29": ("insider_trade", 3, 0.0, 0.85, False),
    "sast_reg31": ("pledge_creation_release", 4, -0.3, 0.85, False),
    "buyback": ("dividend_bonus_split_buyback", 2, 0.2, 0.9, True),
    "offer_documents": ("fundraise", 4, 0.1, 0.7, False),
    "corporate_actions": ("dividend_bonus_split_buyback", 3, 0.3, 0.7, False),
    "related_party": ("other", 2, 0.0, 0.85, True),
    "shareholding_pattern": ("other", 2, 0.0, 0.85, True),
    "secretarial_compliance": ("other", 1, 0.0, 0.9, True),
    "annual_reports": ("other", 2, 0.0, 0.9, True),
    "deviation_variation": ("other", 2, -0.1, 0.8, True),
    "board_meetings": ("other", 1, 0.0, 0.85, True),
    "voting_results": ("other", 1, 0.0, 0.85, True),
    "investor_complaints": ("other", 1, 0.0, 0.9, True),
    "share_transfers": ("other", 1, 0.0, 0.9, True),
    "brsr": ("other", 1, 0.0, 0.9, True),
    "unitholding_patterns": ("other", 1, 0.0, 0.9, True),
    "corporate_governance": ("other", 1, 0.0, 0.9, True),
    "circulars": ("other", 1, 0.0, 0.85, True),
}

# ---- Fixed values: feeds whose name alone decides the class -----------------------------
AUTHORITATIVE_FEEDS = [
    "sast_reg29", "sast_reg31", "insider_trading", "encumbrance",
    "board_meetings", "circulars", "shareholding_pattern", "related_party",
    "secretarial_compliance", "investor_complaints", "share_transfers",
    "brsr", "unitholding_patterns", "corporate_governance", "voting_results",
    "annual_reports", "buyback",
]

# ---- Fixed values: feed list with polling priority --------------------------------------
FEEDS = [
    ("announcements", "P0"), ("financial_results", "P0"), ("board_meetings", "P0"),
    ("corporate_actions", "P0"), ("insider_trading", "P0"), ("sast_reg29", "P1"),
    ("sast_reg31", "P1"), ("encumbrance", "P0"), ("shareholding_pattern", "P1"),
    ("related_party", "P0"), ("buyback", "P1"), ("integrated_financials", "P1"),
    ("annual_reports", "P2"), ("corporate_governance", "P2"),
    ("secretarial_compliance", "P2"), ("deviation_variation", "P1"),
    ("investor_complaints", "P2"), ("voting_results", "P2"), ("share_transfers", "P2"),
    ("offer_documents", "P2"), ("brsr", "P2"), ("unitholding_patterns", "P2"),
    ("circulars", "P1"),
]
STALE_AFTER_SEC = {"P0": 300, "P1": 1800, "P2": 7200}
STALE_AFTER_DEFAULT_SEC = 3600
MAX_CONSECUTIVE_ERRORS = 3

# ---- Fixed values: classifier -----------------------------------------------------------
CLASSIFIER_VERSION = "rules-v5"
RULE_FINAL_CONFIDENCE = 0.75
DEGRADED_FACTOR = 0.8
FRESH_HOURS = 6

# ---- Fixed values: technical score ------------------------------------------------------
MIN_BARS = 60
FULL_CONFIDENCE_BARS = 250
MIN_MEDIAN_TURNOVER_LAKH = 10.0
RANGE_BARS = 250
RS_BARS = 63
LAKH = 1e5
CRORE = 1e7

# ---- Fixed values: risk thresholds ------------------------------------------------------
PENNY_CLOSE = 5.0
MICROCAP_CRORE = 300.0
LOCK_RATIO_HARD = 0.20
PLEDGE_HARD_PCT = 25.0
PLEDGE_PENALTY_PCT = 10.0
RISK_UNAVAILABLE = [
    "going_concern (needs audit-report text)",
    "free_float (needs full shareholding parse)",
    "portfolio_caps (needs holdings source — Phase 5)",
]
RISK_UNAVAILABLE_PLEDGE = "pledge_pct (SHP XBRL not yet fetched)"

# ---- Fixed values: fusion ---------------------------------------------------------------
# profile: (fundamental, technical, flow, event, horizon, stop in ATR, target low R, target high R)
PROFILES = {
    "default": (30, 25, 20, 25, "3-6m", 3.0, 2.0, 3.5),
    "short": (0, 35, 20, 45, "1-5d", 1.5, 1.2, 2.0),
    "value": (50, 10, 15, 25, "6-18m", 3.0, 2.0, 3.5),
    "momentum": (10, 45, 25, 20, "2-8w", 3.0, 2.0, 3.5),
    "event_driven": (15, 15, 20, 50, "1-6w", 1.5, 1.2, 2.0),
    "quality": (45, 15, 25, 15, "6-18m", 3.0, 2.0, 3.5),
    "swing": (5, 50, 30, 15, "1-3w", 1.5, 1.2, 2.0),
    "positional": (35, 30, 15, 20, "2-6m", 3.0, 2.0, 3.5),
}
FUSION_VERSION = "fusion-v3-p3"
WEIGHT_FLOOR = 40.0
HYSTERESIS = 8.0
HALF_LIFE_DAYS = {"fundamental": 100.0, "technical": 5.0, "flow": 7.0, "event": 10.0}
EVENT_WINDOW_DAYS = 30
EVENT_TOP_K = 10
EVENT_MIN_MATERIALITY = 3
PEER_TOP_K = 8
PEER_MIN_MATERIALITY = 7
PEER_DAMPING = 0.35
PENALTY_CAP = 55.0

# ---- Fixed values: forward windows in bars ----------------------------------------------
FORWARD_WINDOWS = {"1w": 5, "4w": 20, "12w": 60}
RESULT_LAG_DAYS = 45

# ---- Fixed values: alerts ---------------------------------------------------------------
ALERT_MAX_HIGH_PER_HOUR = 12

# ---- Fixed values: price files ----------------------------------------------------------
KEEP_SERIES = ["EQ", "BE", "BZ", "SM", "ST"]
KEEP_INDICES = ["Nifty 50", "Nifty 500", "Nifty Bank", "Nifty Midcap 150", "Nifty Smallcap 250", "India VIX"]
ATTACHMENT_EXTENSIONS = ["pdf", "xml", "zip", "xls", "xlsx", "csv"]

# ---- Fixed values: results and shareholding fact names ----------------------------------
RESULT_FACTS = [
    # (fact, column, priority): 0 = general map, 1 = bank map used only where 0 is absent
    ("RevenueFromOperations", "revenue", 0),
    ("OtherIncome", "other_income", 0),
    ("Income", "total_income", 0),
    ("Expenses", "expenses", 0),
    ("FinanceCosts", "finance_costs", 0),
    ("DepreciationDepletionAndAmortisationExpense", "depreciation", 0),
    ("ProfitBeforeTax", "pbt", 0),
    ("TaxExpense", "tax", 0),
    ("ProfitLossForPeriod", "pat", 0),
    ("BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "eps_basic", 0),
    ("InterestEarned", "revenue", 1),
    ("OtherIncome", "other_income", 1),
    ("Income", "total_income", 1),
    ("ExpenditureExcludingProvisionsAndContingencies", "expenses", 1),
    ("InterestExpended", "finance_costs", 1),
    ("ProfitLossFromOrdinaryActivitiesBeforeTax", "pbt", 1),
    ("ProfitLossForThePeriod", "pat", 1),
    ("BasicEarningsPerShareAfterExtraordinaryItems", "eps_basic", 1),
]
RESULT_GATE_FACTS = ["ProfitLossForPeriod", "RevenueFromOperations", "ProfitLossForThePeriod", "InterestEarned"]
PROMOTER_MEMBER = "ShareholdingOfPromoterAndPromoterGroupMember"
PROMOTER_CONTEXT_PREFIX = "ShareholdingOfPromoterAndPromoterGroup"
PROMOTER_PCT_FACT = "ShareholdingAsAPercentageOfTotalNumberOfShares"
ENCUMBERED_PCT_FACTS = [
    "EncumberedSharesHeldAsPercentageOfTotalNumberOfShares",
    "PledgedOrEncumberedSharesHeldAsPercentageOfTotalNumberOfShares",
]
ENCUMBERED_NUM_FACTS = ["NumberOfSharesEncumbered", "PledgedOrEncumberedNumberOfShares"]
ENCUMBRANCE_FLAG_PREFIX = "WhetherAnySharesHeldByPromoters"

# ---- Fixed values: document retrieval ladder --------------------------------------------
RETRY_DELAYS_MIN = [5, 15, 45]
MAX_ATTEMPTS = 4
MAX_DOCUMENT_BYTES = 50 * 1024 * 1024

# ---- Fixed values: market session (Indian Standard Time) --------------------------------
MARKET_ZONE = "Asia/Kolkata"
SESSION_MINUTES = {"pre_open": (540, 555), "open": (555, 930), "post_close": (930, 960)}
SEED_HOLIDAYS = [
    ("2024-01-26", "Republic Day"), ("2024-03-08", "Mahashivratri"), ("2024-03-25", "Holi"),
    ("2024-03-29", "Good Friday"), ("2024-04-11", "Id-Ul-Fitr"), ("2024-04-17", "Ram Navami"),
    ("2024-05-01", "Maharashtra Day"), ("2024-05-20", "Lok Sabha Elections (Mumbai polling)"),
    ("2024-06-17", "Bakri Id"), ("2024-07-17", "Moharram"), ("2024-08-15", "Independence Day"),
    ("2024-10-02", "Mahatma Gandhi Jayanti"), ("2024-11-01", "Diwali Laxmi Pujan (muhurat only)"),
    ("2024-11-15", "Gurunanak Jayanti"), ("2024-12-25", "Christmas"),
    ("2025-02-26", "Mahashivratri"), ("2025-03-14", "Holi"), ("2025-03-31", "Id-Ul-Fitr"),
    ("2025-04-10", "Shri Mahavir Jayanti"), ("2025-04-14", "Dr. Ambedkar Jayanti"),
    ("2025-04-18", "Good Friday"), ("2025-05-01", "Maharashtra Day"),
    ("2025-08-15", "Independence Day"), ("2025-08-27", "Ganesh Chaturthi"),
    ("2025-10-02", "Mahatma Gandhi Jayanti / Dussehra"),
    ("2025-10-21", "Diwali Laxmi Pujan (muhurat only)"), ("2025-10-22", "Diwali Balipratipada"),
    ("2025-11-05", "Prakash Gurpurb Sri Guru Nanak Dev"), ("2025-12-25", "Christmas"),
    ("2026-01-26", "Republic Day"), ("2026-02-15", "Mahashivratri"), ("2026-03-03", "Holi"),
    ("2026-03-21", "Id-Ul-Fitr"), ("2026-03-31", "Shri Mahavir Jayanti"),
    ("2026-04-03", "Good Friday"), ("2026-04-14", "Dr. Ambedkar Jayanti"),
    ("2026-05-01", "Maharashtra Day"), ("2026-05-27", "Bakri Id"), ("2026-06-26", "Moharram"),
    ("2026-08-15", "Independence Day"), ("2026-09-14", "Ganesh Chaturthi"),
    ("2026-10-02", "Mahatma Gandhi Jayanti"), ("2026-10-20", "Dussehra"),
    ("2026-11-08", "Diwali Laxmi Pujan (muhurat only)"), ("2026-11-10", "Diwali Balipratipada"),
    ("2026-11-24", "Gurunanak Jayanti"), ("2026-12-25", "Christmas"),
]
MUHURAT_DATES = {2024: "2024-11-01", 2025: "2025-10-21", 2026: "2026-11-08"}

# ---- Fixed values: evaluation -----------------------------------------------------------
# (stratum, modulus, rows kept)
SAMPLE_STRATA = [("routine", 997, 30), ("rules", 991, 50), ("model", 983, 20)]
GATE_ACCURACY = 0.85
GATE_SPEARMAN = 0.7
RECONCILE_PCT = 0.02
RECONCILE_ABS_CRORE = 1.0
RECONCILE_MIN_QUARTERS = 4
GATE_RECONCILE_PCT = 95.0

# ---- Fixed values: event topics ---------------------------------------------------------
TOPICS = ["filing.received", "filing.classified", "fundamental.updated", "technical.updated",
          "flow.updated", "risk.assessed", "signal.issued"]
