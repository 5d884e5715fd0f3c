"""Argument checks that run with the query, without a job of their own.

In error mode a rule is asserted where its column is evaluated, so the query that meets a row against it fails with the rule's
message. In warning mode rows against a rule are counted by an observation while the query runs, and read from it afterwards.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def asserted(value: Column, rule: Column, message: str) -> Column:
    """value, where the rule holds or is unknown; else the query fails."""
    return F.when(F.assert_true(F.coalesce(rule, F.lit(True)), message).isNull(), value)


class Watch:
    """Rows counted against rules while a query ran over a watched frame."""

    def __init__(self, observation: Observation, messages: dict[str, str]):
        self.observation, self.messages = observation, messages

    def failures(self) -> dict[str, int]:
        """Messages of the rules that rows failed, with their number. Waits for an action on the watched frame."""
        got = self.observation.get
        return {m: got[k] for k, m in self.messages.items() if got[k]}

    def warn(self) -> None:
        for message, n in self.failures().items():
            warnings.warn(f"{message} ({n} rows)", UserWarning, stacklevel=2)


def watched(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Watch]:
    """df, and the watch over it; rules: message -> what must hold (unknown counts as holding)."""
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    named = {f"r{i}": m for i, m in enumerate(rules)}
    return df.observe(seen, *(F.count_if(~F.coalesce(rules[m], F.lit(True))).alias(k) for k, m in named.items())), Watch(seen, named)


def weight_rules(w: Column) -> dict[str, Column]:
    return {"weights must be known": w.isNotNull(), "weights must not be negative": w >= 0}


def binary_rule(c: Column) -> Column:
    return c.isin(0.0, 1.0)


def checked_weight(w: Column) -> Column:
    for message, rule in weight_rules(w).items():
        w = asserted(w, rule, message)
    return w
