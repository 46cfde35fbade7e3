"""Settings, as one immutable value; importing it has no side effects."""

from __future__ import annotations

from dataclasses import dataclass

# Source lists, word lists and URL patterns.
TIER1_DOMAINS = (
    "economictimes.indiatimes.com", "livemint.com", "business-standard.com", "financialexpress.com", "moneycontrol.com",
    "ndtvprofit.com", "thehindubusinessline.com", "thehindu.com", "indianexpress.com", "hindustantimes.com", "ndtv.com",
    "scroll.in", "thewire.in", "reuters.com", "bloomberg.com", "bbc.com", "tickertape.in", "screener.in", "trendlyne.com",
)
TIER2_DOMAINS = (
    "zeebiz.com", "cnbctv18.com", "firstpost.com", "news18.com", "outlookbusiness.com", "outlookindia.com",
    "businesstoday.in", "fortune.com", "forbesindia.com", "freepressjournal.in", "deccanherald.com",
    "deccanchronicle.com", "dnaindia.com", "theprint.in", "swarajyamag.com", "thequint.com", "news9live.com",
    "wionews.com", "republicworld.com", "timesnownews.com", "oneindia.com", "jagran.com", "amarujala.com",
    "equitymaster.com", "5paisa.com", "angelone.in", "groww.in",
)
TIER3_DOMAINS = (
    "prnewswire.com", "businesswire.com", "globenewswire.com", "ani-prsolutions.com", "newswire.in", "pr.com",
    "einpresswire.com", "newsvoir.com", "indiaprwire.com", "businesswireindia.com", "brandstudio", "spotlight",
    "partner-content", "advertorial", "psuconnect.in", "apnlive.com", "devdiscourse.com", "latestly.com", "mybigplunge.com",
)
ORGANIC_LABEL_DOMAINS = (
    "economictimes.indiatimes.com", "livemint.com", "business-standard.com", "thehindu.com", "moneycontrol.com",
    "ndtvprofit.com", "thehindubusinessline.com", "reuters.com", "bloomberg.com", "indianexpress.com",
)
PROMO_KEYWORDS = (
    "record", "best-ever", "strong growth", "robust", "milestone", "beats", "exceeds", "outperforms",
    "proud to announce", "pleased to share", "honored", "delighted to", "landmark", "strong", "proud", "delighted", "pleased",
)
RISK_KEYWORDS = (
    "fraud", "loss", "penalty", "lawsuit", "recall", "default", "downgrade", "misses", "below expectations",
    "regulatory", "probe", "investigation", "writeoff", "insolvency", "miss", "scam", "violation",
)
SPONSORED_URL_PATTERNS = (
    "/brandstudio/", "/spotlight/", "/advertorial/", "/sponsored/", "/brand-connect/", "/prime/", "/partner/",
    "/branded-content/", "/content-marketing/", "/native-content/", "/partner-content/",
)
#: The press-release wires are the first domains of tier 3.
PR_WIRES = 10


@dataclass(frozen=True)
class Settings:
    #: Thresholds, weights, windows and dates that results depend on.
    zone_minutes: int = 330
    open_minute: int = 9 * 60 + 15
    close_minute: int = 15 * 60 + 30
    alpha: float = 1.8
    direction_threshold: float = 0.10
    organic_floor: float = 0.3
    closed_weight: float = 1.5
    open_weight: float = 1.0
    sponsored_above: float = 0.7
    organic_below: float = 0.3
    min_articles: int = 3
    tone_scale: float = 10.0
    regime_rows: int = 60
    bull_above: float = 0.10
    bear_below: float = -0.10
    rolling_rows: int = 30
    rolling_least: int = 5
    ic_rows: int = 60
    ic_least: int = 5
    event_before: int = 2
    event_after: int = 5
    high_quantile: float = 0.8
    low_quantile: float = 0.2
    very_positive: float = 0.95
    bootstrap: int = 1000
    seed: int = 42
    train_end: str = "2024-01-01"
    holdout_start: str = "2024-07-01"


DEFAULT = Settings()
