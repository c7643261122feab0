"""Leakage-safe temporal split, and the popularity model of the training period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso
from ..schemas import DAY_MS, TARGET_EVENTS
from .layers import global_rank, user_items


@dataclass(frozen=True)
class Split:
    cutoff_ms: int
    minimum_ms: int
    maximum_ms: int
    target: str
    train: DataFrame
    targets: DataFrame


def bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("event_timestamp_ms").alias("minimum_ms"), F.max("event_timestamp_ms").alias("maximum_ms"))


def available_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("available") == 1).select("item_id")


def novel_targets(events: DataFrame, items: DataFrame, train: DataFrame, kinds: tuple[str, ...], start_ms: int, end_ms: int | None = None) -> DataFrame:
    """(visitor_id, item_id, target_events): wanted events from a time on, of available items not seen in training."""
    late = events.where((F.col("event_timestamp_ms") >= start_ms) & F.col("event_type").isin(*kinds))
    if end_ms is not None:
        late = late.where(F.col("event_timestamp_ms") < end_ms)
    counted = late.groupBy("visitor_id", "item_id").agg(F.count("*").alias("target_events"))  # before the joins: fewer rows to shuffle
    return counted.join(available_items(items), "item_id", "left_semi").join(train, ["visitor_id", "item_id"], "left_anti").select("visitor_id", "item_id", "target_events")


def temporal_split(events: DataFrame, items: DataFrame, target: str = "transaction", test_days: int = 14, cutoff_ms: int | None = None) -> Split:
    if target not in TARGET_EVENTS:
        raise ValueError(f"target must be one of: {', '.join(TARGET_EVENTS)}")
    if test_days <= 0:
        raise ValueError("test_days must be positive")
    low, high = bounds(events).first()
    if low is None:
        raise RuntimeError("the cleaned events are empty")
    cutoff = cutoff_ms if cutoff_ms is not None else high - test_days * DAY_MS
    if not low < cutoff <= high:
        raise ValueError(f"cutoff must be after {iso(low)} and no later than {iso(high)}")
    train = user_items(events, cutoff, text_time=False)
    return Split(cutoff, low, high, target, train, novel_targets(events, items, train, TARGET_EVENTS[target], cutoff))


def popularity(train: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, score, rank) of available items in training."""
    scores = train.join(available_items(items), "item_id", "left_semi").groupBy("item_id").agg(F.sum("interaction_score").alias("score"))
    return global_rank(scores, [F.desc("score"), F.col("item_id")])


def histories(train: DataFrame, visitors: DataFrame) -> DataFrame:
    return train.join(visitors.select("visitor_id").distinct(), "visitor_id", "left_semi").select("visitor_id", "item_id", F.col("interaction_score").cast("double").alias("score"))
