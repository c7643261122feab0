"""Offline ranking metrics by segment, lift, and single-plan tuning of the hybrid."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dcg_discount, ratio
from ..schemas import CONTENT_GRID, DAY_MS, HYBRID_WEIGHTS, ITEM_CF_GRID, TARGET_EVENTS
from ..scratch import stage
from . import recommend as R
from .layers import global_rank, user_items
from .scoring import trial_lists
from .similarity import MAX_HISTORY, MIN_COOCCURRENCE, NEIGHBORS, train_similarity
from .split import available_items, histories, novel_targets, popularity


METRICS = ("evaluated_users", "precision", "recall", "ndcg", "hit_rate", "catalog_coverage", "distinct_items", "fallback_users")


def user_metrics(recommended: DataFrame, targets: DataFrame, k: int, keys: tuple[str, ...] = (), models: DataFrame | None = None) -> DataFrame:
    """Per visitor (and key): hits, precision, recall and ndcg at k; visitors without recommendations have zeros.

    The keys are those of `models`, or else those that occur in `recommended`.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    wanted = targets.select("visitor_id", "item_id").distinct()
    relevant = wanted.groupBy("visitor_id").agg(F.count("*").alias("relevant"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), dcg_discount), F.lit(0.0), lambda a, b: a + b)
    hits = recommended.where(F.col("rank") <= k).join(wanted, ["visitor_id", "item_id"], "left_semi").groupBy(*keys, "visitor_id").agg(F.count("*").alias("hits"), F.sum(dcg_discount(F.col("rank"))).alias("dcg"))
    base = relevant.withColumn("ideal", ideal)
    if keys:
        base = base.crossJoin(F.broadcast((recommended if models is None else models).select(*keys).distinct()))  # models or trials: a handful of rows
    rows = base.join(hits, [*keys, "visitor_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select(*keys, "visitor_id", "relevant", "hits", (F.col("hits") / F.lit(float(k))).alias("precision"), ratio(F.col("hits"), F.col("relevant")).alias("recall"), ratio(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")).alias("ndcg"))


def metrics(recommended: DataFrame, targets: DataFrame, history: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(model, segment, evaluated_users, precision, recall, ndcg, hit_rate, catalog_coverage, distinct_items, fallback_users); `recommended` has a model column.

    fallback_users are those whose own list was short, where `recommended` tells (else 0). Segments: all visitors, those with training history (warm), and the others (cold).
    """
    warm = history.select("visitor_id").distinct().withColumn("warm", F.lit(True))
    segment = F.explode(F.array(F.lit("all"), F.when(F.coalesce("warm", F.lit(False)), F.lit("warm")).otherwise(F.lit("cold")))).alias("segment")
    per = user_metrics(recommended, targets, k, ("model",)).join(warm, "visitor_id", "left").select("*", segment)
    scores = per.groupBy("model", "segment").agg(F.count("*").alias("evaluated_users"), *[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")], F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))
    asked = targets.select("visitor_id").distinct()
    shown = recommended.where(F.col("rank") <= k).join(asked, "visitor_id", "left_semi").join(warm, "visitor_id", "left")
    short = F.col("fallback") if "fallback" in recommended.columns else F.lit(False)
    shown = shown.select("model", "item_id", segment, F.when(short, F.col("visitor_id")).alias("short")).groupBy("model", "segment").agg(F.count_distinct("item_id").alias("distinct_items"), F.count_distinct("short").alias("fallback_users"))
    total = available_items(items).agg(F.count("*").alias("available"))
    out = scores.join(shown, ["model", "segment"], "left").crossJoin(F.broadcast(total))  # one row
    return out.select("model", "segment", "evaluated_users", "precision", "recall", "ndcg", "hit_rate", ratio(F.col("distinct_items"), F.col("available")).alias("catalog_coverage"), F.coalesce("distinct_items", F.lit(0)).alias("distinct_items"), F.coalesce("fallback_users", F.lit(0)).alias("fallback_users"))


def lift(scores: DataFrame, baseline: str = "weighted_popularity") -> DataFrame:
    """Each model's metrics minus the baseline's, by segment."""
    names = ("precision", "recall", "ndcg", "hit_rate")
    base = scores.where(F.col("model") == baseline).select("segment", *[F.col(n).alias(f"b_{n}") for n in names])
    return scores.where(F.col("model") != baseline).join(F.broadcast(base), "segment").select("model", "segment", *[(F.col(n) - F.col(f"b_{n}")).alias(f"{n}_lift") for n in names])


def recommend_all(targets: DataFrame, train: DataFrame, items: DataFrame, similar: DataFrame, vectors: DataFrame | None, popular: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(model, visitor_id, item_id, rank, fallback) of all models for the visitors of the targets."""
    w = HYBRID_WEIGHTS | (weights or {})
    pool = R.pool_size(k)
    visitors = stage(targets.select("visitor_id").distinct())
    history = stage(histories(train, visitors))
    cf = stage(R.cf_candidates(history, similar, items, pool))
    base = R.popularity_recommendations(visitors, history, popular, k).withColumn("fallback", F.lit(False))
    out = base.withColumn("model", F.lit("weighted_popularity"))
    out = out.unionByName(R.with_fallback(cf, visitors, history, popular, k).withColumn("model", F.lit("item_collaborative_filtering")))
    if vectors is not None:
        content = stage(R.content_candidates(history, items, vectors, pool, w["vector_weight"], w["category_weight"], w["parent_weight"]))
        out = out.unionByName(R.with_fallback(content, visitors, history, popular, k).withColumn("model", F.lit("content_similarity")))
        fused = R.top(R.fuse(cf, content, w["item_cf_weight"], w["content_weight"], w["rrf_constant"]), k)
        out = out.unionByName(R.with_fallback(fused, visitors, history, popular, k).withColumn("model", F.lit("item_cf_content_hybrid")))
    return out


def evaluate(targets: DataFrame, train: DataFrame, items: DataFrame, similar: DataFrame, vectors: DataFrame | None, popular: DataFrame, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    if not targets.limit(1).count():
        raise RuntimeError("No test targets; prepare a split with a longer test period")
    recommended = stage(recommend_all(targets, train, items, similar, vectors, popular, k, weights))
    return metrics(recommended, targets, histories(train, targets), items, k)


def tune(events: DataFrame, items: DataFrame, vectors: DataFrame, final_cutoff: int, minimum: int, target: str = "transaction", days: int = 14, cutoff_ms: int | None = None, k: int = 10, max_history: int = MAX_HISTORY, min_cooccurrence: int = MIN_COOCCURRENCE, top: int = NEIGHBORS) -> DataFrame:
    """All trials of the grid in one plan: (trial, weights..., precision, recall, ndcg, hit_rate, best), on warm visitors of a window before the cutoff.

    Cosines and affinities are made once for all content weightings; each is cut to its pool in the task that scores it.
    """
    if days <= 0 or k <= 0:
        raise ValueError("validation days and k must be positive")
    start = cutoff_ms if cutoff_ms is not None else final_cutoff - days * DAY_MS
    if not minimum < start < final_cutoff:
        raise ValueError("the validation cutoff must lie inside the training period")
    spark = events.sparkSession
    train = stage(user_items(events, start, text_time=False))
    targets = novel_targets(events, items, train, TARGET_EVENTS[target], start, final_cutoff)
    history = stage(histories(train, targets))
    targets = stage(targets.join(history.select("visitor_id").distinct(), "visitor_id", "left_semi"))
    if not targets.limit(1).count():
        raise RuntimeError("The validation window has no warm visitors with novel targets")
    popular = popularity(train, items)
    similar = train_similarity(train, "last_interaction_timestamp_ms", max_history, min_cooccurrence, top)
    pool = R.pool_size(k)
    cf = R.cf_candidates(history, similar, items, pool).groupBy("visitor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("cf"))
    content = R.content_lists(history, items, vectors, pool, CONTENT_GRID).groupBy("visitor_id").agg(F.collect_list(F.struct("grid", "item", "score")).alias("x"))
    content = content.select("visitor_id", *[F.flatten(F.col(f"x.{c}")).alias(c) for c in ("grid", "item", "score")])
    wanted = targets.groupBy("visitor_id").agg(F.collect_set("item_id").alias("wanted"))
    lists = wanted.join(stage(cf.select("visitor_id", F.col("cf.item_id").alias("cf"))), "visitor_id", "left").join(content, "visitor_id", "left")
    mixes = [(float(w), round(1 - w, 10)) for w in ITEM_CF_GRID]
    constant = HYBRID_WEIGHTS["rrf_constant"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from trial_lists(pa.Table.from_batches([batch]), len(CONTENT_GRID), mixes, constant, pool, k).to_batches()

    # of a list that needs no filling up only the hits are let out
    ranked = stage(lists.mapInArrow(fuse, "trial int, visitor_id long, item_id long, rank int, short boolean"))
    short = ranked.where("short")
    every = short.select("trial", "visitor_id").distinct()
    filled = R.with_fallback(short.where(F.col("item_id").isNotNull()), every, history, popular, k, ("trial", "visitor_id")).select("trial", "visitor_id", "item_id", "rank")
    filled = filled.unionByName(ranked.where(~F.col("short")).select("trial", "visitor_id", "item_id", "rank"))
    per = user_metrics(filled, targets, k, ("trial",), spark.range(len(CONTENT_GRID) * len(ITEM_CF_GRID)).select(F.col("id").cast("int").alias("trial")))
    scores = per.groupBy("trial").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")], F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))
    named = [(i * len(ITEM_CF_GRID) + j, *w, float(c), round(1 - c, 10)) for i, w in enumerate(CONTENT_GRID) for j, c in enumerate(ITEM_CF_GRID)]
    named = spark.createDataFrame(named, "trial int, vector_weight double, category_weight double, parent_weight double, item_cf_weight double, content_weight double")
    rounded = scores.select("trial", *[F.round(c, R.DIGITS).alias(c) for c in ("precision", "recall", "ndcg", "hit_rate")])
    order = Window.orderBy(F.desc("ndcg"), F.desc("recall"), F.desc("precision"), F.abs(F.col("item_cf_weight") - 0.5), "trial")  # 55 rows
    return rounded.join(named, "trial").withColumn("place", F.row_number().over(order))


def serve(visitors: DataFrame, gold: DataFrame, items: DataFrame, similar: DataFrame, vectors: DataFrame | None, popular: DataFrame, k: int = 10, max_history: int = MAX_HISTORY, weights: dict[str, float] | None = None) -> DataFrame:
    """(visitor_id, rank, item_id, score, sources, category_id, parent_category_id, model, history_items_used, fallback_used, content_model_loaded, weights) for many visitors at once.

    History is the latest max_history items of the whole timeline; items from the fallback score 0.
    """
    w = HYBRID_WEIGHTS | (weights or {})
    visitors = visitors.select("visitor_id").distinct()
    order = Window.partitionBy("visitor_id").orderBy(F.desc("last_interaction_timestamp"), F.desc("interaction_score"), "item_id")
    mine = gold.join(visitors, "visitor_id", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_history)
    history = stage(mine.select("visitor_id", "item_id", F.col("interaction_score").cast("double").alias("score")))
    pool = R.pool_size(k)
    listed = global_rank(popular.drop("rank").join(available_items(items), "item_id", "left_semi"), [F.desc("score"), F.col("item_id")])
    cf = R.cf_candidates(history, similar, items, pool)
    if vectors is None:
        content = cf.limit(0)
        name = "item_cf_with_popularity_fallback"
    else:
        content = R.content_candidates(history, items, vectors, pool, w["vector_weight"], w["category_weight"], w["parent_weight"])
        name = "item_cf_content_hybrid"
    fused = stage(R.fuse(cf, content, w["item_cf_weight"], w["content_weight"], w["rrf_constant"]))
    out = R.with_fallback(R.top(fused, k), visitors, history, listed, k)
    known = history.groupBy("visitor_id").agg(F.count("*").alias("used"))
    filled = out.groupBy("visitor_id").agg(F.bool_or("fallback").alias("fallback_used"))
    loaded, config = F.lit(vectors is not None).alias("content_model_loaded"), F.struct(*[F.lit(float(w[c])).alias(c) for c in HYBRID_WEIGHTS]).alias("weights")
    out = out.join(fused, ["visitor_id", "item_id"], "left").join(items.select("item_id", "category_id", "parent_category_id"), "item_id", "left").join(known, "visitor_id", "left").join(filled, "visitor_id")
    return out.select("visitor_id", "rank", "item_id", F.when(F.col("fallback"), 0.0).otherwise(F.col("score")).alias("score"), F.when(F.col("fallback"), F.array(F.lit("popularity"))).otherwise(F.col("sources")).alias("sources"), "category_id", "parent_category_id", F.when(F.col("used").isNotNull(), F.lit(name)).otherwise(F.lit("weighted_popularity_fallback")).alias("model"), F.coalesce("used", F.lit(0)).alias("history_items_used"), "fallback_used", loaded, config)
