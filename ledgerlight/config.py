"""Metric names, ratio formulas, outlier limits, strategies, calendars."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: forms handled, taxonomies read, value unit
FORMS = ("10-K", "10-Q")
TAXONOMIES = ("us-gaap", "ifrs-full", "dei")
UNIT = "USD"

# fixed values: defaults of the feature build
TOP_TAGS = 250
MIN_COMPLETENESS = 15.0
HISTORY_QUARTERS = 0
GRADIENT_QUARTERS = (1, 2, 4)
GRADIENT_SUFFIXES = ("_current", "_augment")
HORIZONS = (12, 6, 3, 1)
PRICE_RANGE = (1.0, 1000.0)
MAX_QTRS = 4

# fixed values: quarter boundaries in days -> quarter number
QUARTER_DAYS = {0: 0, 91: 1, 182: 2, 273: 3, 365: 4, 730: 8}
QUARTER_DAYS_FINE = (91, 182, 273, 365, 456, 547, 638, 730)
QUARTER_TOLERANCE_DAYS = 15
DAYS_PER_QUARTER = 91.25

# fixed values: dates a nanosecond timestamp can hold
DATE_MIN, DATE_MAX = "1677-09-22", "2262-04-11"

# fixed values: tracked metrics
KEY_METRICS = (
    "AccountsReceivableNetCurrent",
    "Assets",
    "AssetsCurrent",
    "CashAndCashEquivalentsAtCarryingValue",
    "CommonStockSharesOutstanding",
    "CostOfGoodsAndServicesSold",
    "GrossProfit",
    "InterestExpense",
    "InventoryNet",
    "LiabilitiesCurrent",
    "LongTermDebtNoncurrent",
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "StockholdersEquity",
)

# fixed values: stop words removed inside words
STOP_WORDS = ("and", "of", "the", "in", "at", "on", "to", "from", "by", "with")


@dataclass(frozen=True)
class Ratio:
    """Sum of signed numerator tags over a denominator tag; qtrs as pinned in the fixed table."""

    name: str
    numerator: tuple[tuple[int, str], ...]
    denominator: str
    num_qtrs: int
    den_qtrs: int

    @property
    def column(self) -> str:
        return f"{self.name}_{self.num_qtrs}qtrs_augment"

    @property
    def tags(self) -> list[str]:
        return [t for _, t in self.numerator] + [self.denominator]


def _ratio(name, numerator, denominator, num_qtrs, den_qtrs):
    terms = ((1, numerator),) if isinstance(numerator, str) else tuple(numerator)
    return Ratio(name, terms, denominator, num_qtrs, den_qtrs)


# fixed values: the fourteen ratios (numerator, denominator, quarters of each)
RATIOS = (
    _ratio("GrossMargin", "GrossProfit", "Revenues", 1, 1),
    _ratio("OperatingMargin", "OperatingIncomeLoss", "Revenues", 1, 1),
    _ratio("NetMargin", "NetIncomeLoss", "Revenues", 1, 1),
    _ratio("ROE", "NetIncomeLoss", "StockholdersEquity", 1, 0),
    _ratio("ROA", "NetIncomeLoss", "Assets", 1, 0),
    _ratio("CurrentRatio", "AssetsCurrent", "LiabilitiesCurrent", 0, 0),
    _ratio("QuickRatio", ((1, "AssetsCurrent"), (-1, "InventoryNet")), "LiabilitiesCurrent", 0, 0),
    _ratio("CashRatio", "CashAndCashEquivalentsAtCarryingValue", "LiabilitiesCurrent", 0, 0),
    _ratio("DebtToEquity", ((1, "LongTermDebtNoncurrent"), (1, "LiabilitiesCurrent")), "StockholdersEquity", 0, 0),
    _ratio("DebtToAssets", ((1, "LongTermDebtNoncurrent"), (1, "LiabilitiesCurrent")), "Assets", 0, 0),
    _ratio("InterestCoverage", "OperatingIncomeLoss", "InterestExpense", 1, 1),
    _ratio("AssetTurnover", "Revenues", "Assets", 1, 0),
    _ratio("InventoryTurnover", "CostOfGoodsAndServicesSold", "InventoryNet", 1, 0),
    _ratio("ReceivablesTurnover", "Revenues", "AccountsReceivableNetCurrent", 1, 0),
)

# fixed values: hard limits
MAX_ONE = ("GrossMargin", "OperatingMargin", "NetMargin", "DebtToAssets")
MIN_ZERO = (
    "GrossMargin", "CurrentRatio", "QuickRatio", "CashRatio", "DebtToAssets",
    "AssetTurnover", "InventoryTurnover", "ReceivablesTurnover",
)

# fixed values: (typical_min, typical_max, upper_bound, lower_bound) per ratio
EXPECTED_RANGES = {
    "GrossMargin": (0.20, 0.70, 1.0, None),
    "OperatingMargin": (0.05, 0.15, None, None),
    "NetMargin": (0.05, 0.15, None, None),
    "ROE": (0.10, 0.20, None, None),
    "ROA": (0.05, None, None, None),
    "CurrentRatio": (1.5, 3.0, None, 0.0),
    "QuickRatio": (1.0, 2.0, None, 0.0),
    "CashRatio": (0.2, 0.5, None, 0.0),
    "DebtToEquity": (None, 2.0, None, None),
    "DebtToAssets": (0.3, 0.6, 1.0, 0.0),
    "InterestCoverage": (2.0, None, None, None),
    "AssetTurnover": (0.30, None, None, 0.0),
    "InventoryTurnover": (4.0, 12.0, None, 0.0),
    "ReceivablesTurnover": (10.0, 12.0, None, 0.0),
}
IQR_FACTOR = 3.0


@dataclass(frozen=True)
class Strategy:
    """Pick the scores in [low, high] of a month, then the first `limit` (all when None)."""

    name: str
    low: float | None = None
    high: float | None = None
    limit: int | None = None


# fixed values: the six selection strategies
STRATEGIES = (
    Strategy("top_5", limit=5),
    Strategy("top_10", limit=10),
    Strategy("proba_0.8", low=0.8),
    Strategy("proba_0.85", low=0.85),
    Strategy("proba_0.75_to_0.85", low=0.75, high=0.85),
    Strategy("mixed", low=0.75, high=0.85, limit=10),
)

# fixed values: simulation and training parameters
MONTHLY_INVESTMENT = 10000.0
CONFIDENCE_THRESHOLDS = (0.25, 0.5, 0.75, 0.9)
COMPLETENESS_STRATEGY_MIN = 0.2
MIN_TRAIN_ROWS = 100
LAGS = (1, 2, 4, 8)
SEQUENCE_MIN, SEQUENCE_MAX = 4, 20
MOVING_AVERAGE_WINDOW = 4
PERIOD_TOLERANCE_DAYS = 90
VALUE_RTOL, VALUE_ATOL = 1e-5, 1.0
