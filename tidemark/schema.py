"""Parameters, presets and column names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Names of columns.
REQUIRED = ("InvoiceNo", "StockCode", "Quantity", "UnitPrice", "InvoiceDate")
OPTIONAL = ("Description", "CustomerID", "Country")


@dataclass(frozen=True)
class Params:
    """Settings of a whole run. max_transaction_len None keeps every transaction; max_patterns_per_window None keeps every pattern."""

    max_transaction_len: int | None = 30
    window_granularity: str = "M"
    utility_mode: str = "round"
    candidate_mining_ratio: float = 0.015
    sensitive_ratio: float = 0.015
    min_peakness_ratio: float = 1.5
    min_support_windows: int = 2
    max_selected_per_window: int = 30
    max_patterns_per_window: int | None = 3000
    enable_twu_pruning: bool = True
    local_ratio: float = 0.015
    global_ratio: float = 0.015
    beta: float = 0.25
    gamma: float = 0.75

    def __post_init__(self):
        if self.max_transaction_len is not None and self.max_transaction_len < 1:
            raise ValueError("max_transaction_len must be at least 1, or None")
        if self.window_granularity != "M":
            raise ValueError("only calendar months (M) are supported as windows")
        if self.utility_mode != "round":
            raise ValueError("only rounded utilities are supported")


#: Settings by name.
PRESETS = {
    "fast": Params(max_transaction_len=20, sensitive_ratio=0.02, candidate_mining_ratio=0.02, max_selected_per_window=10, max_patterns_per_window=1500),
    "balanced": Params(),
    "detailed": Params(max_transaction_len=50, sensitive_ratio=0.01, candidate_mining_ratio=0.01, min_peakness_ratio=1.3, max_selected_per_window=50, max_patterns_per_window=6000),
}


def validate_schema(columns: list[str]) -> dict:
    """Which of the required and optional columns there are, after trimming names."""
    names = [c.strip() for c in columns]
    missing = [c for c in REQUIRED if c not in names]
    return {"is_valid": not missing, "missing_columns": missing, "required_columns": list(REQUIRED), "optional_columns_present": [c for c in OPTIONAL if c in names]}


def require_columns(columns: list[str]) -> None:
    if missing := validate_schema(columns)["missing_columns"]:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


@dataclass(frozen=True)
class Statistics:
    """What advice on parameters looks at. Unknown figures are 0, an unknown longest transaction None."""

    num_transactions: int = 0
    num_distinct_items: int = 0
    avg_transaction_len: float = 0.0
    max_transaction_len: int | None = None


@dataclass(frozen=True)
class Rule:
    """Advice that is given where `applies` holds; severe advice makes the risk high by itself."""

    advice: str
    applies: Callable[[Statistics, Params], bool]
    severe: bool = False


#: The limits beyond which there is advice.
RULES = (
    Rule("the ratio for candidates is below 0.005, at which patterns may explode", lambda s, p: p.candidate_mining_ratio < 0.005, severe=True),
    Rule("more than 5000 transactions take a while to mine", lambda s, p: s.num_transactions > 5000),
    Rule("more than 1000 distinct items make mining long", lambda s, p: s.num_distinct_items > 1000),
    Rule("transactions of more than 30 items on average have very many subsets", lambda s, p: s.avg_transaction_len > 30),
    Rule("fewer patterns are candidates than count as sensitive", lambda s, p: p.sensitive_ratio < p.candidate_mining_ratio),
    Rule("more than 10000 patterns for each month fill memory", lambda s, p: (p.max_patterns_per_window or 0) > 10_000),
    Rule("how long the longest transaction is, is not known", lambda s, p: s.num_transactions > 0 and not s.max_transaction_len),
)


def advise(statistics: Statistics | None, params: Params) -> dict:
    """Warnings, errors and a risk level for parameters: high with severe advice or without a database, medium from two pieces of
    advice on, else low."""
    if statistics is None:
        return {"warnings": [], "errors": ["no database has been prepared"], "risk_level": "high"}
    given = [r for r in RULES if r.applies(statistics, params)]
    level = "high" if any(r.severe for r in given) else ("low", "low", "medium")[min(len(given), 2)]
    return {"warnings": [r.advice for r in given], "errors": [], "risk_level": level}
