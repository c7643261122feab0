"""Profiles of the aggregated layer: sizes, totals, distributions and leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def sizes(gold: DataFrame, items: DataFrame) -> DataFrame:
    """One row: users, interacted items, catalog items, pairs, possible pairs, density and sparsity."""
    own = gold.agg(F.count("*").alias("user_item_pairs"), F.count_distinct("visitor_id").alias("users"), F.count_distinct("item_id").alias("interacted_items"))
    rows = own.join(items.agg(F.count("*").alias("catalog_items")))
    rows = rows.withColumn("possible_user_item_pairs", F.col("users") * F.col("interacted_items"))
    rows = rows.withColumn("observed_density", ratio(F.col("user_item_pairs"), F.col("possible_user_item_pairs")))
    return rows.withColumn("sparsity", F.lit(1.0) - F.col("observed_density"))


def totals(gold: DataFrame) -> DataFrame:
    whole = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return gold.agg(whole("view_count", "views"), whole("cart_count", "add_to_carts"), whole("purchase_count", "purchases"), whole("interaction_score", "weighted_score"))


def availability(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce(F.col("available").cast("string"), F.lit("unknown")).alias("availability")).agg(F.count("*").alias("items"))


def histogram(gold: DataFrame, entity: str) -> DataFrame:
    """(interactions, frequency): how many visitors (or items) have so many pairs."""
    if entity not in {"visitor_id", "item_id"}:
        raise ValueError("unsupported profile entity")
    return gold.groupBy(entity).agg(F.count("*").alias("interactions")).groupBy("interactions").agg(F.count("*").alias("frequency"))


def distribution(gold: DataFrame, entity: str) -> DataFrame:
    """One row: minimum, mean, nearest-rank percentiles and maximum of pairs per visitor or item."""
    if entity not in {"visitor_id", "item_id"}:
        raise ValueError("unsupported profile entity")
    per = gold.groupBy(entity).agg(F.count("*").alias("n"))
    rank = lambda f, name: F.expr(f"percentile_disc({f}) within group (order by n)").cast("long").alias(name)
    return per.agg(F.min("n").alias("min"), F.avg("n").alias("mean"), rank(0.5, "p50"), rank(0.9, "p90"), rank(0.99, "p99"), F.max("n").alias("max"))


def active_users(gold: DataFrame, n: int = 10) -> DataFrame:
    rows = gold.groupBy("visitor_id").agg(F.count("*").alias("distinct_items"), F.sum("interaction_score").alias("interaction_score"))
    return rows.orderBy(F.desc("interaction_score"), F.desc("distinct_items"), "visitor_id").limit(n)


def popular_items(gold: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    rows = gold.groupBy("item_id").agg(F.count("*").alias("users"), F.sum("interaction_score").alias("interaction_score"))
    best = rows.orderBy(F.desc("interaction_score"), F.desc("users"), "item_id").limit(n)
    return best.join(items.select("item_id", "category_id", "available"), "item_id", "left")


def popular_categories(gold: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    rows = gold.join(items.select("item_id", "category_id"), "item_id").groupBy("category_id")
    out = rows.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("visitor_id").alias("users"), F.sum("interaction_score").alias("interaction_score"))
    return out.orderBy(F.desc("interaction_score"), F.col("category_id").asc_nulls_last()).limit(n)
