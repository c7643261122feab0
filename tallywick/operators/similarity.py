"""Item pairs and cosine neighbours from capped histories; the feature layer, training and tuning share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HISTORY, MIN_COOCCURRENCE, NEIGHBORS = 30, 2, 50


def cap_history(gold: DataFrame, recency: str, max_history: int = MAX_HISTORY) -> DataFrame:
    """(visitor_id, item_id, interaction_score): each visitor's best items by score, then recency, then id. The group limit runs before the shuffle too."""
    order = Window.partitionBy("visitor_id").orderBy(F.desc("interaction_score"), F.desc(recency), "item_id")
    return gold.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_history).select("visitor_id", "item_id", "interaction_score")


def pair_stats(capped: DataFrame) -> DataFrame:
    """(item_i, item_j, dot_product, cooccurring_users) for i < j; at most max_history choose 2 pairs of a visitor."""
    a = capped.select("visitor_id", F.col("item_id").alias("item_i"), F.col("interaction_score").cast("double").alias("si"))
    b = capped.select("visitor_id", F.col("item_id").alias("item_j"), F.col("interaction_score").cast("double").alias("sj"))
    pairs = a.join(b, (a["visitor_id"] == b["visitor_id"]) & (a["item_i"] < b["item_j"]))
    return pairs.groupBy("item_i", "item_j").agg(F.sum(F.col("si") * F.col("sj")).alias("dot_product"), F.count("*").alias("cooccurring_users"))


def norms(gold: DataFrame) -> DataFrame:
    """Squared norms over the full history (so a cosine from capped dot products is a lower bound)."""
    score = F.col("interaction_score").cast("double")
    return gold.groupBy("item_id").agg(F.sum(score * score).alias("norm_squared"))


def neighbors(pairs: DataFrame, squared: DataFrame, min_cooccurrence: int = MIN_COOCCURRENCE, top: int = NEIGHBORS) -> DataFrame:
    """(source_item_id, similar_item_id, similarity, cooccurring_users, neighbor_rank): both directions from one scan of the pairs."""
    if min_cooccurrence < 1 or top < 1:
        raise ValueError("min_cooccurrence and neighbors must be at least 1")
    ni = squared.select(F.col("item_id").alias("item_i"), F.col("norm_squared").alias("ni"))
    nj = squared.select(F.col("item_id").alias("item_j"), F.col("norm_squared").alias("nj"))
    scored = pairs.where(F.col("cooccurring_users") >= min_cooccurrence).join(ni, "item_i").join(nj, "item_j")
    scored = scored.withColumn("similarity", F.col("dot_product") / F.sqrt(F.col("ni") * F.col("nj")))
    ends = F.explode(F.array(F.struct(F.col("item_i").alias("s"), F.col("item_j").alias("t")), F.struct(F.col("item_j").alias("s"), F.col("item_i").alias("t"))))
    both = scored.select(ends.alias("e"), "similarity", "cooccurring_users").select(F.col("e.s").alias("source_item_id"), F.col("e.t").alias("similar_item_id"), "similarity", "cooccurring_users")
    order = Window.partitionBy("source_item_id").orderBy(F.desc("similarity"), F.desc("cooccurring_users"), "similar_item_id")
    return both.withColumn("neighbor_rank", F.row_number().over(order)).where(F.col("neighbor_rank") <= top)


def train_similarity(gold: DataFrame, recency: str, max_history: int = MAX_HISTORY, min_cooccurrence: int = MIN_COOCCURRENCE, top: int = NEIGHBORS) -> DataFrame:
    if max_history < 2:
        raise ValueError("max_history must be at least 2")
    return neighbors(pair_stats(cap_history(gold, recency, max_history)), norms(gold), min_cooccurrence, top)


def training_report(capped: DataFrame, pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """One row: contributions, contributing visitors, distinct pairs, directed similarities."""
    per = capped.groupBy("visitor_id").agg(F.count("*").alias("n")).where("n > 1")
    a = per.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pair_contributions"), F.count("*").alias("contributing_users"))
    b = pairs.agg(F.count("*").alias("distinct_pairs"))
    c = similar.agg(F.count("*").alias("directed_similarities"))
    return a.join(b).join(c)


def cooccurrence_matrix(gold: DataFrame, top: int = 10) -> DataFrame:
    """(item_a, item_b, shared_users) among the most used items; the diagonal counts an item's visitors."""
    best = gold.groupBy("item_id").agg(F.sum("interaction_score").alias("s")).orderBy(F.desc("s"), "item_id").limit(top).select("item_id")
    kept = gold.join(F.broadcast(best), "item_id", "left_semi")
    a, b = kept.select("visitor_id", F.col("item_id").alias("item_a")), kept.select("visitor_id", F.col("item_id").alias("item_b"))
    return a.join(b, (a["visitor_id"] == b["visitor_id"]) & (F.col("item_a") <= F.col("item_b"))).groupBy("item_a", "item_b").agg(F.count("*").alias("shared_users"))
