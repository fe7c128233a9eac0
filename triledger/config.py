"""Tolerances and other settings of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from triledger.vocabulary import ENGLISH, Vocabulary


@dataclass(frozen=True)
class Config:
    words: Vocabulary = ENGLISH
    amount_tolerance: str = "5"          # ledger against statement, base currency
    fx_tolerance: str = "0.005"          # share of the amount when a foreign currency is involved
    review_below: str = "100"            # smaller residuals are not worth a verdict
    payment_tolerance: str = "1"
    payment_days: int = 7
    wrong_agent_days: int = 10
    repeat_hours: int = 72
    vote_share: float = 0.9
    chain_tolerance: str = "1"
    jump_tolerance: str = "0.01"
    docs_shown: int = 3
    txns_shown: int = 6
    # A key with more rows than this is salted in joins.
    hot_rows: int = 1_000_000
    # Larger islands of payments and receipts are matched by the distributed method.
    island_rows: int = 4_000


DEFAULT = Config()
