"""Reconciliation of statements, a deposit ledger and a sales journal on Spark."""

from triledger.config import Config
from triledger.plans.reconcile import Result, reconcile
from triledger.sources.derived import Sources

__all__ = ["Config", "Result", "Sources", "reconcile"]
