"""Recommenders over long frames (visitor_id, item_id, score or rank); nothing is collected per visitor.

Scores are rounded to DIGITS before ranking, so that the order of floating-point sums cannot turn ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rrf
from ..schemas import CONTENT_WEIGHTS, HYBRID_WEIGHTS
from ..scratch import stage
from .scoring import DIGITS, best_lists
from .split import available_items


def pool_size(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return max(100, 10 * k)


def top(rows: DataFrame, n: int, by: str = "score", keys: tuple[str, ...] = ("visitor_id",)) -> DataFrame:
    """The n best of each visitor with their rank from 1; ties by item."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by), "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cf_candidates(history: DataFrame, similar: DataFrame, items: DataFrame, pool: int) -> DataFrame:
    """(visitor_id, item_id, score, rank): neighbours of the history weighted by it, without seen and unavailable items."""
    edges = similar.select(F.col("source_item_id"), F.col("similar_item_id"), "similarity").join(available_items(items).withColumnRenamed("item_id", "similar_item_id"), "similar_item_id", "left_semi")
    scores = history.withColumnRenamed("item_id", "source_item_id").join(edges, "source_item_id").groupBy("visitor_id", F.col("similar_item_id").alias("item_id")).agg(F.round(F.sum(F.col("score") * F.col("similarity")), DIGITS).alias("score"))
    return top(scores.join(history.select("visitor_id", "item_id"), ["visitor_id", "item_id"], "left_anti"), pool)


def unit_vectors(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """(item_id, bucket, weight): vectors of length one; a zero vector stays zero."""
    if size is not None and vectors.where((F.col("bucket") >= size) | (F.col("bucket") < 0)).limit(1).count():
        raise ValueError(f"a vector has a bucket beyond {size}")
    norm = vectors.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return vectors.join(norm, "item_id").select("item_id", "bucket", (F.col("value") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("weight"))


def content_profile(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """(visitor_id, bucket, weight): the history's vectors weighted by log(1 + score), of length one; visitors of zero norm have no row."""
    summed = history.join(vectors, "item_id").groupBy("visitor_id", "bucket").agg(F.sum(F.log1p("score") * F.col("weight")).alias("w"))
    norm = summed.groupBy("visitor_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return summed.join(norm, "visitor_id").select("visitor_id", "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def affinity(history: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """(visitor_id, <column>, affinity): the share of the visitor's weight, over history rows in the catalog."""
    known = history.join(items.select("item_id", column), "item_id").withColumn("w", F.log1p("score"))
    total = known.groupBy("visitor_id").agg(F.sum("w").alias("total"))
    own = known.where(F.col(column).isNotNull()).groupBy("visitor_id", column).agg(F.sum("w").alias("w"))
    return own.join(total, "visitor_id").select("visitor_id", column, (F.col("w") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("affinity"))


def check_content_weights(*weights: float) -> None:
    if min(weights) < 0:
        raise ValueError("content weights cannot be negative")
    if sum(weights) <= 0:
        raise ValueError("at least one content weight must be positive")


def content_lists(history: DataFrame, items: DataFrame, vectors: DataFrame, pool: int, weights: list[tuple[float, float, float]]) -> DataFrame:
    """(visitor_id, grid, item, score), arrays: the `pool` best available unseen items of each visitor with a profile, for each triple of weights and block of the catalog."""
    for triple in weights:
        check_content_weights(*triple)
    open_items = items.where(F.col("available") == 1).select("item_id", "category_id", "parent_category_id")
    shares = [affinity(history, items, c) for c in ("category_id", "parent_category_id")]
    return best_lists(content_profile(history, vectors), *shares, history, open_items, vectors, weights, pool)


def content_grid(history: DataFrame, items: DataFrame, vectors: DataFrame, pool: int, weights: list[tuple[float, float, float]]) -> DataFrame:
    """(grid, visitor_id, item_id, score, rank): the `pool` best available unseen items of each visitor with a profile, for each triple of weights."""
    lists = stage(content_lists(history, items, vectors, pool, weights))
    found = lists.select("visitor_id", F.explode(F.arrays_zip("grid", "item", "score")).alias("x")).select("x.grid", "visitor_id", F.col("x.item").alias("item_id"), "x.score")
    return top(found, pool, keys=("grid", "visitor_id"))


def content_candidates(history: DataFrame, items: DataFrame, vectors: DataFrame, pool: int, vector_weight: float = CONTENT_WEIGHTS["vector_weight"], category_weight: float = CONTENT_WEIGHTS["category_weight"], parent_weight: float = CONTENT_WEIGHTS["parent_weight"]) -> DataFrame:
    """(visitor_id, item_id, score, rank) of the `pool` best available unseen items."""
    return content_grid(history, items, vectors, pool, [(vector_weight, category_weight, parent_weight)]).drop("grid")


def fuse(cf: DataFrame, content: DataFrame, cf_weight: float = HYBRID_WEIGHTS["item_cf_weight"], content_weight: float = HYBRID_WEIGHTS["content_weight"], constant: float = HYBRID_WEIGHTS["rrf_constant"]) -> DataFrame:
    """(visitor_id, item_id, score, sources): reciprocal ranks of both lists, weighted and added."""
    part = lambda rows, weight, name: rows.select("visitor_id", "item_id", rrf(weight, F.col("rank"), constant).alias("s"), F.lit(name).alias("source"))
    both = part(cf, cf_weight, "item_cf").unionByName(part(content, content_weight, "content"))
    return both.groupBy("visitor_id", "item_id").agg(F.round(F.sum("s"), DIGITS).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))


def with_fallback(ranked: DataFrame, visitors: DataFrame, history: DataFrame, popular: DataFrame, k: int, keys: tuple[str, ...] = ("visitor_id",)) -> DataFrame:
    """(keys, item_id, rank, fallback): the first k of `ranked` (keys, item_id, rank), filled up from popularity, whose ranks have no gaps.

    A visitor short of k is offered the first k + history ranks, as no more than its history and its own list can be skipped:
    a join on the rank, as long as the histories are.
    """
    first = stage(ranked.where(F.col("rank") <= k).select(*keys, "item_id", "rank"))
    own = visitors.select(*keys).distinct().join(first.groupBy(*keys).agg(F.count("*").alias("n")), list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = history.groupBy("visitor_id").agg(F.count("*").alias("c"))
    short = own.where(F.col("n") < k).join(seen, "visitor_id", "left")
    offered = short.select(*keys, "n", F.explode(F.sequence(F.lit(1).cast("long"), k + F.coalesce("c", F.lit(0)))).alias("popular_rank"))
    fill = offered.join(popular.select("item_id", F.col("rank").cast("long").alias("popular_rank")), "popular_rank")
    fill = fill.join(history.select("visitor_id", "item_id"), ["visitor_id", "item_id"], "left_anti").join(first.select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    fill = fill.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("popular_rank"))).where(F.col("i") <= k - F.col("n"))
    fill = fill.select(*keys, "item_id", (F.col("n") + F.col("i")).cast("int").alias("rank"), F.lit(True).alias("fallback"))
    return first.select(*keys, "item_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("fallback")).unionByName(fill)


def popularity_recommendations(visitors: DataFrame, history: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    none = history.sparkSession.createDataFrame([], "visitor_id long, item_id long, rank int")
    return with_fallback(none, visitors, history, popular, k).select("visitor_id", "item_id", "rank")
