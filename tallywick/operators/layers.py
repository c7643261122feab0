"""Cleaned, aggregated and feature layers as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blake2b_hash, count_event, event_weight, md5_bucket, md5_sign, parse_long, ratio, timestamp_text
from ..schemas import WEIGHTS
from ..scratch import stage

VECTOR_SIZE = 256


def clean_events(bronze: DataFrame) -> DataFrame:
    """Known event types with non-negative ids and a positive time; exact duplicates stay."""
    good = bronze.where(F.col("event").isin(*WEIGHTS) & (F.col("visitorid") >= 0) & (F.col("itemid") >= 0) & (F.col("timestamp") > 0))
    return good.select(
        timestamp_text(F.col("timestamp")).alias("event_timestamp"), F.col("visitorid").cast("long").alias("visitor_id"), F.col("itemid").cast("long").alias("item_id"),
        F.col("event").alias("event_type"), F.col("transactionid").cast("long").alias("transaction_id"), F.col("timestamp").cast("long").alias("event_timestamp_ms"),
    )


def category_hierarchy(bronze: DataFrame) -> DataFrame:
    return bronze.select(F.col("categoryid").alias("category_id"), F.col("parentid").alias("parent_category_id"))


def latest_properties(properties: DataFrame) -> DataFrame:
    """(itemid, property, value): the newest value, the later ingested of equal times; one aggregate, no sort."""
    return properties.groupBy("itemid", "property").agg(F.max_by("value", F.struct("timestamp", "ingest_seq")).alias("value"))


def products(properties: DataFrame) -> DataFrame:
    """One row per item: two typed attributes, the rest as tokens ordered by property name."""
    own = F.col("property").isin("categoryid", "available")
    of = lambda name: F.max(F.when(F.col("property") == name, parse_long(F.col("value"))))
    return (
        latest_properties(properties)
        .groupBy(F.col("itemid").alias("item_id"))
        .agg(of("categoryid").alias("category_id"), of("available").alias("available"), F.sort_array(F.collect_list(F.when(~own, F.struct("property", "value")))).alias("rest"))
        .select("item_id", "category_id", "available", F.transform("rest", lambda x: F.concat(x["property"], F.lit("_"), x["value"])).alias("encoded_properties"))
    )


def user_items(events: DataFrame, until_ms: int | None = None, text_time: bool = True) -> DataFrame:
    """Counts, weighted score and last time per visitor and item, optionally before a time."""
    if until_ms is not None:
        events = events.where(F.col("event_timestamp_ms") < until_ms)
    kind = F.col("event_type")
    last = F.max("event_timestamp_ms")
    return events.groupBy("visitor_id", "item_id").agg(
        count_event(kind, "view").alias("view_count"), count_event(kind, "addtocart").alias("cart_count"), count_event(kind, "transaction").alias("purchase_count"),
        F.sum(event_weight(kind)).alias("interaction_score"), (timestamp_text(last).alias("last_interaction_timestamp") if text_time else last.alias("last_interaction_timestamp_ms")),
    )


def catalog(items: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Products with their parent category; the hierarchy is a dimension, so Spark broadcasts it while it is small."""
    parents = hierarchy.select(F.col("category_id"), F.col("parent_category_id"))
    return items.join(parents, "category_id", "left").select("item_id", "category_id", "parent_category_id", "available", "encoded_properties")


def tokens(catalog_items: DataFrame) -> DataFrame:
    """(item_id, token): properties, category and parent category."""
    extra = F.array_compact(F.array(F.concat(F.lit("category:"), F.col("category_id").cast("string")), F.concat(F.lit("parent_category:"), F.col("parent_category_id").cast("string"))))
    return catalog_items.select("item_id", F.explode(F.concat("encoded_properties", extra)).alias("token"))


def item_vectors(catalog_items: DataFrame, size: int = VECTOR_SIZE, digest: str = "md5") -> DataFrame:
    """(item_id, bucket, value): signed hashed counts; buckets whose signs cancel are kept as 0."""
    rows = tokens(catalog_items)
    if digest == "md5":
        hashed = rows.select("item_id", md5_bucket(F.col("token"), size).alias("bucket"), md5_sign(F.col("token")).alias("sign"))
    elif digest == "blake2b":
        hashed = rows.select("item_id", blake2b_hash(size)("token").alias("h")).select("item_id", "h.bucket", "h.sign")
    else:
        raise ValueError("digest must be md5 or blake2b")
    return hashed.groupBy("item_id", "bucket").agg(F.sum("sign").alias("value"))


def gold_items(catalog_items: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per item with its sparse vector as a map (empty where it has no token)."""
    maps = vectors.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "value")))).alias("v"))
    empty = F.create_map().cast("map<int,double>")
    return catalog_items.join(maps, "item_id", "left").select("item_id", "category_id", "parent_category_id", "available", F.coalesce("v", empty).alias("item_feature_vector"))


def user_activity(gold: DataFrame) -> DataFrame:
    """One row per visitor: counts, score, rate and last time."""
    views, carts, buys, score = (F.sum(c) for c in ("view_count", "cart_count", "purchase_count", "interaction_score"))
    total = views + carts + buys
    return gold.groupBy("visitor_id").agg(
        F.count("*").alias("distinct_items"), total.alias("total_events"), views.alias("view_count"), carts.alias("cart_count"), buys.alias("purchase_count"),
        score.alias("total_interaction_score"), ratio(score, F.count("*")).alias("avg_interaction_score"), ratio(buys, total).alias("purchase_rate"),
        F.max("last_interaction_timestamp").alias("last_active_timestamp"),
    )


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers in a total order without one task for all rows: range partitions are sorted in parallel, then their counts are added up."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    placed = stage(placed.withColumn("__i", F.monotonically_increasing_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__i") - F.col("first") + F.col("before") + 1).drop("__p", "__i", "first", "before")


def item_popularity(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Every catalog item with its totals (0 where it has none) and its rank by score, then id."""
    totals = gold.groupBy("item_id").agg(
        F.count("*").alias("distinct_users"), F.sum("view_count").alias("view_count"), F.sum("cart_count").alias("cart_count"),
        F.sum("purchase_count").alias("purchase_count"), F.sum("interaction_score").alias("total_interaction_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = items.select("item_id", "category_id", "parent_category_id", "available").join(totals, "item_id", "left")
    rows = rows.select("item_id", "category_id", "parent_category_id", "available", *map(zero, totals.columns[1:]))
    rows = rows.withColumn("avg_interaction_score", ratio(F.col("total_interaction_score"), F.col("distinct_users"))).withColumn("conversion_rate", ratio(F.col("purchase_count"), F.col("view_count")))
    return global_rank(rows, [F.desc("total_interaction_score"), F.col("item_id")], "popularity_rank")
