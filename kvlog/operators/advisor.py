"""Rules over logs and counter histories that say what to tune.

A condition is a pattern over log lines or a threshold on how fast a counter moves; a rule fires where all its conditions hold,
and gives its suggestion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogCondition:
    """Log lines that match the pattern, at least so many."""

    name: str
    pattern: str
    at_least: int = 1


@dataclass(frozen=True)
class RateCondition:
    """A counter that moves by at least ``threshold`` a second between two of its records, ``bursts`` times or more."""

    name: str
    ticker: str
    threshold: float
    bursts: int = 1


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[str, ...]
    suggestion: str


def log_conditions(lines: DataFrame, text: str, conditions: list[LogCondition]) -> DataFrame:
    """(condition, n, holds), one scan for all."""
    counts = lines.agg(*[F.sum(F.col(text).rlike(c.pattern).cast("long")).alias(c.name) for c in conditions])
    pairs = F.array(*[F.struct(F.lit(c.name).alias("condition"), F.coalesce(c.name, F.lit(0)).alias("n"), (F.coalesce(c.name, F.lit(0)) >= c.at_least).alias("holds")) for c in conditions])
    return counts.select(F.inline(pairs))


def rate_conditions(history: DataFrame, ts: str, total: str, conditions: list[RateCondition]) -> DataFrame:
    """(condition, n, holds) over records (ticker, ts, total): n is the number of bursts."""
    w = Window.partitionBy("ticker").orderBy(ts)
    seconds = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    rates = history.withColumn("_rate", (F.col(total) - F.lag(total).over(w)) / F.when(seconds > 0, seconds))
    counts = rates.agg(*[F.sum(((F.col("ticker") == c.ticker) & (F.coalesce("_rate", F.lit(0.0)) >= c.threshold)).cast("long")).alias(c.name) for c in conditions])
    pairs = F.array(*[F.struct(F.lit(c.name).alias("condition"), F.coalesce(c.name, F.lit(0)).alias("n"), (F.coalesce(c.name, F.lit(0)) >= c.bursts).alias("holds")) for c in conditions])
    return counts.select(F.inline(pairs))


def advise(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, suggestion) of the rules whose conditions all hold; facts: (condition, n, holds)."""
    held = facts.where("holds").agg(F.collect_set("condition").alias("held"))  # as many rows as conditions
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.array(*map(F.lit, r.conditions)).alias("needs"), F.lit(r.suggestion).alias("suggestion")) for r in rules])
    return held.select("held", F.inline(each)).where(F.size(F.array_except("needs", "held")) == 0).select("rule", "suggestion")
