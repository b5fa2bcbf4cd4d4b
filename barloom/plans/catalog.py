"""The reports by the titles users know them by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.plans import reports
from barloom.sources.market import Market


@dataclass(frozen=True)
class Report:
    description: str
    plan: Callable[..., DataFrame]


CATALOG: dict[str, dict[str, Report]] = {
    "MOMENTUM": {
        "Market Overview": Report(
            "Price, averages, trend and action of every stock on the newest day",
            reports.market_overview,
        ),
        "Oversold Stocks (RSI < 30)": Report(
            "Latest low RSI readings of the window", reports.oversold
        ),
        "Overbought Stocks (RSI > 70)": Report(
            "Latest high RSI readings of the window", reports.overbought
        ),
        "Long Term Trends": Report(
            "Distance and order of the long averages on the newest day", reports.long_term_trends
        ),
        "Stock Performance History": Report(
            "Return of every stock and calendar year", reports.yearly_performance
        ),
        "RSI Patterns Analysis": Report(
            "How often each stock gave either signal", reports.rsi_patterns
        ),
    },
    "MEAN_REVERSION": {
        "All Pairs Status": Report(
            "Newest ratio, z-score and signal of every pair", reports.all_pairs_status
        ),
        "Pairs Diverged High (Z > 2)": Report(
            "Latest days on which the first leg was dear", reports.pairs_high
        ),
        "Pairs Diverged Low (Z < -2)": Report(
            "Latest days on which the first leg was cheap", reports.pairs_low
        ),
        "Pair History (30 Days)": Report(
            "Daily ratio, z-score and signal of one pair", reports.pair_history
        ),
    },
}


def titles() -> list[str]:
    return [title for group in CATALOG.values() for title in group]


def run(title: str, market: Market, **parameters: object) -> DataFrame:
    """A report by title; parameters are those of the report's function."""
    for group in CATALOG.values():
        if title in group:
            return group[title].plan(market, **parameters)
    raise KeyError(f"no report {title!r}; choose one of {titles()}")
