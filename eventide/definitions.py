"""Fixed values that define the data model: names, thresholds, grids and word lists."""

from __future__ import annotations

# --- fixed values: trading-day horizons -------------------------------------------------
HORIZONS = {"1D": 1, "5D": 5, "10D": 10, "21D": 21}
HORIZON_ORDER = ["1D", "5D", "10D", "21D"]
LEAD_IN_DAYS = 5
WINDOW_BUFFER_DAYS = 10
MATURITY_DAYS = 35

# --- fixed values: the 16 transcript features, with category and bearish flag ------------
TRANSCRIPT_FEATURES = [
    ("mgmt_hedging", "Management Hedging Language", "Management Behavior", True),
    ("mgmt_deflection", "Q&A Deflection Rate", "Management Behavior", True),
    ("mgmt_specificity", "Guidance Specificity", "Management Behavior", False),
    ("mgmt_confidence_shift", "Confidence Shift (Prepared→Q&A)", "Management Behavior", True),
    ("analyst_skepticism", "Analyst Skepticism", "Analyst Behavior", True),
    ("analyst_surprise", "Analyst Surprise Indicators", "Analyst Behavior", False),
    ("analyst_focus_cluster", "Analyst Question Clustering", "Analyst Behavior", False),
    ("guidance_revision_dir", "Guidance Revision Direction", "Forward Guidance", False),
    ("guidance_qualifiers", "Qualifier Density", "Forward Guidance", True),
    ("new_risk_mention", "New Risk Factor Mentions", "Risk Signals", True),
    ("macro_blame", "External Blame Attribution", "Risk Signals", True),
    ("capex_language", "CapEx/Investment Tone", "Strategic Signals", False),
    ("hiring_language", "Hiring & Headcount Signals", "Strategic Signals", False),
    ("competitive_mentions", "Competitive Positioning", "Strategic Signals", True),
    ("customer_language", "Customer/Demand Descriptors", "Demand Signals", False),
    ("pricing_power", "Pricing Power Indicators", "Demand Signals", False),
]
KNOWN_FEATURES = [name for name, _, _, _ in TRANSCRIPT_FEATURES]
BEARISH = {name for name, _, _, bear in TRANSCRIPT_FEATURES if bear}

# --- fixed values: filing columns, snake names, display name, category, bearish flag -----
FILING_FEATURES = [
    ("riskScore", "risk_score", "Risk Score", "AI Analysis", True),
    ("sentimentScore", "sentiment_score", "Sentiment", "AI Analysis", False),
    ("concernLevel", "concern_level", "Concern Level", "AI Analysis", True),
    ("marketCap", "market_cap", "Market Cap", "Valuation", False),
    ("currentPrice", "current_price", "Current Price", "Valuation", False),
    ("peRatio", "pe_ratio", "P/E Ratio", "Valuation", True),
    ("forwardPE", "forward_pe", "Forward P/E", "Valuation", True),
    ("fiftyTwoWeekHigh", "fifty_two_week_high", "52W High", "Valuation", False),
    ("fiftyTwoWeekLow", "fifty_two_week_low", "52W Low", "Valuation", False),
    ("priceToHigh", "price_to_high", "Price to High", "Valuation", True),
    ("priceToLow", "price_to_low", "Price to Low", "Valuation", False),
    ("priceToTarget", "price_to_target", "Price to Target", "Valuation", False),
    ("priceToMA30", "price_to_ma30", "Price/MA30", "Technical", False),
    ("priceToMA50", "price_to_ma50", "Price/MA50", "Technical", False),
    ("rsi14", "rsi14", "RSI (14)", "Technical", True),
    ("macd", "macd", "MACD", "Technical", False),
    ("volatility30", "volatility30", "Volatility 30D", "Technical", True),
    ("return30d", "return_30d", "Prior 30D Return", "Technical", False),
    ("spxReturn7d", "spx_return_7d", "SPX 7D Return", "Market Context", False),
    ("spxReturn30d", "spx_return_30d", "SPX 30D Return", "Market Context", False),
    ("vixClose", "vix_close", "VIX Close", "Market Context", True),
    ("analystUpsidePotential", "analyst_upside_potential", "Analyst Upside", "Analyst Activity", False),
    ("analystConsensusScore", "analyst_consensus_score", "Analyst Consensus", "Analyst Activity", False),
    ("analystCoverage", "analyst_coverage", "Analyst Coverage", "Analyst Activity", False),
    ("upgradesLast30d", "upgrades_last_30d", "Upgrades (30D)", "Analyst Activity", False),
    ("downgradesLast30d", "downgrades_last_30d", "Downgrades (30D)", "Analyst Activity", True),
    ("netUpgrades", "net_upgrades", "Net Upgrades", "Analyst Activity", False),
    ("majorUpgrades", "major_upgrades", "Major Upgrades", "Analyst Activity", False),
    ("majorDowngrades", "major_downgrades", "Major Downgrades", "Analyst Activity", True),
]
FILING_RENAME = {raw: snake for raw, snake, _, _, _ in FILING_FEATURES}
FILING_TARGETS = {
    "7D": "actual7dReturn",
    "30D": "actual30dReturn",
    "7D_alpha": "actual7dAlpha",
    "30D_alpha": "actual30dAlpha",
}

# --- fixed values: multi-feature combinations ---------------------------------------------
# (name, direction, [(feature, threshold), ...])
COMBOS = [
    ("Confidence Gap + Analyst Skepticism", "bearish",
     [("mgmt_confidence_shift", 0.6), ("analyst_skepticism", 0.6)]),
    ("Guidance Raise + Low Hedging + Strong Demand", "bullish",
     [("guidance_revision_dir", 0.7), ("mgmt_hedging", 0.3), ("customer_language", 0.7)]),
    ("Deflection + Question Clustering", "bearish",
     [("mgmt_deflection", 0.6), ("analyst_focus_cluster", 0.7)]),
    ("New Risks + External Blame + Guidance Qualifiers", "bearish",
     [("new_risk_mention", 0.6), ("macro_blame", 0.6), ("guidance_qualifiers", 0.6)]),
    ("Pricing Power + CapEx Confidence", "bullish",
     [("pricing_power", 0.6), ("capex_language", 0.6)]),
]

# --- fixed values: model grids ---------------------------------------------------------------
RIDGE_GRID = [0.01, 0.1, 1.0, 10.0, 100.0]
LASSO_GRID = [0.001, 0.01, 0.05, 0.1, 0.5, 1.0]
ELASTICNET_GRID = [(a, l1) for a in (0.01, 0.1, 0.5, 1.0) for l1 in (0.1, 0.3, 0.5, 0.7, 0.9)]
SCORING_GRID_EARNINGS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0]
SCORING_GRID_FILINGS = [0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0]
MODEL_ORDER = ["OLS", "Ridge", "Lasso", "ElasticNet", "Stepwise+Ridge", "Polynomial",
               "Random Forest", "Gradient Boost"]

# --- fixed values: the eight-feature alpha model -----------------------------------------------
# feature: (weight, training mean, training standard deviation)
ALPHA_MODEL = {
    "price_to_low": (1.3191, 1.3978, 0.4174),
    "major_downgrades": (0.7783, 0.1029, 0.3812),
    "analyst_upside_potential": (-0.4069, 13.518, 10.887),
    "price_to_high": (0.3872, 0.8588, 0.0912),
    "concern_level": (-0.1165, 5.345, 1.578),
    "market_cap": (0.0822, 682892847207.0, 1043282559376.0),
    "sentiment_score": (0.0413, 0.0236, 0.1206),
    "upgrades_last_30d": (-0.0112, 0.1941, 0.4576),
}
ALPHA_CUTS = {"p10": -1.0345, "p25": -0.8114, "p75": 0.0438, "p90": 1.66}
ALPHA_MARKET_BASELINE = 0.8
MAJOR_FIRMS = ["Goldman Sachs", "Morgan Stanley", "JP Morgan", "Bank of America",
               "Citi", "Wells Fargo", "Barclays", "UBS"]

# --- fixed values: word lists named by the feature definitions ------------------------------------
LEXICONS = {
    "hedging": ["approximately", "roughly", "we believe", "potentially", "subject to",
                "could", "might", "may"],
    "definitive": ["we will", "revenue will exceed", "we are committed to"],
    "qualifiers": ["assuming", "if", "barring", "dependent on", "subject to"],
    "macro": ["macro", "fx", "supply chain", "weather", "regulation"],
    "capex": ["capital expenditure", "capex", "investment"],
    "hiring": ["headcount", "hiring", "restructuring", "efficiency"],
    "demand_positive": ["robust", "record", "backlog", "pipeline"],
    "demand_negative": ["softening", "normalizing"],
    "pricing": ["price increases", "pricing pressure", "mix shifts", "discounting"],
}
