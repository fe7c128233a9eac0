"""Ordered classification rules: the first rule whose condition holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    number: int
    when: Column
    outcome: dict[str, Column]


def outcome(**values: str | Column) -> dict[str, Column]:
    return {name: F.lit(v) if isinstance(v, str) else v for name, v in values.items()}


def first_match(rules: list[Rule]) -> Column:
    """A struct with the number and the outcome of the first rule that holds."""
    chain = None
    for rule in rules:
        result = F.struct(F.lit(rule.number).alias("rule"), *[v.alias(n) for n, v in rule.outcome.items()])
        # A condition that is null does not hold, exactly as in CASE WHEN.
        chain = F.when(rule.when, result) if chain is None else chain.when(rule.when, result)
    return chain
