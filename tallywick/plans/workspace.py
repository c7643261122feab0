"""The domain's tables over the driver's test tables; stages that several plans share are made once per workspace.

Adapter A reads `events` (visits of users to item numbers), adapter B `orders` with `lineitem`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import layers as L
from ..operators import recommend as R
from ..operators import similarity as S
from ..operators import split as P
from ..scratch import stage

K = 10


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bronze_events(self) -> DataFrame:
        kind = F.col("event_type")
        event = F.when(kind == "click", "addtocart").when(kind == "purchase", "transaction").otherwise(kind)
        return self.read("events").select(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").alias("visitorid"), event.alias("event"),
            F.get_json_object("props", "$.k").cast("bigint").alias("itemid"), F.when(kind == "purchase", F.col("event_id")).alias("transactionid"),
        )

    @cached_property
    def order_events(self) -> DataFrame:
        flag = F.col("l_returnflag")
        rows = self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        event = F.when(flag == "N", "view").when(flag == "A", "addtocart").otherwise("transaction")
        return rows.select(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), F.col("o_custkey").alias("visitorid"), event.alias("event"), F.col("l_partkey").alias("itemid"), F.when(flag == "R", F.col("l_orderkey")).alias("transactionid"))

    @cached_property
    def bronze_item_properties(self) -> DataFrame:
        part = self.read("part")
        number = F.regexp_extract("p_brand", r"([0-9]+)$", 1)
        wide = F.array(*[F.struct(F.lit(n).alias("property"), v.alias("value")) for n, v in (("categoryid", number), ("available", (F.col("p_size") <= 40).cast("int").cast("string")), ("p_name", F.col("p_name")), ("p_type", F.col("p_type")), ("p_size", F.col("p_size").cast("string")), ("p_price", F.floor("p_retailprice").cast("string")))])
        return part.select(F.lit(1000).cast("long").alias("timestamp"), F.col("p_partkey").alias("itemid"), F.explode(wide).alias("x")).select("timestamp", "itemid", "x.property", "x.value", F.lit(0).cast("long").alias("ingest_seq"))

    @cached_property
    def property_history(self) -> DataFrame:
        """A history of one property per part, for the latest-value operator."""
        seq = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
        return self.read("lineitem").select(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), F.col("l_partkey").alias("itemid"), F.lit("returnflag").alias("property"), F.col("l_returnflag").alias("value"), seq.alias("ingest_seq"))

    @cached_property
    def bronze_category_tree(self) -> DataFrame:
        return self.read("nation").select((F.col("n_nationkey") + 1).cast("long").alias("categoryid"), F.col("n_regionkey").cast("long").alias("parentid"))

    @cached_property
    def silver(self) -> DataFrame:
        return stage(L.clean_events(self.bronze_events))

    @cached_property
    def hierarchy(self) -> DataFrame:
        return L.category_hierarchy(self.bronze_category_tree)

    @cached_property
    def products(self) -> DataFrame:
        return stage(L.products(self.bronze_item_properties))

    @cached_property
    def gold(self) -> DataFrame:
        return L.user_items(self.silver)

    @cached_property
    def order_gold(self) -> DataFrame:
        return L.user_items(L.clean_events(self.order_events))

    @cached_property
    def catalog(self) -> DataFrame:
        return L.catalog(self.products, self.hierarchy)

    @cached_property
    def vectors(self) -> DataFrame:
        return stage(L.item_vectors(self.catalog))

    @cached_property
    def split(self) -> P.Split:
        return P.temporal_split(self.silver, self.products)

    @cached_property
    def train(self) -> DataFrame:
        return stage(self.split.train)

    @cached_property
    def targets(self) -> DataFrame:
        return stage(self.split.targets)

    @cached_property
    def popular(self) -> DataFrame:
        return stage(P.popularity(self.train, self.products))

    @cached_property
    def history(self) -> DataFrame:
        return stage(P.histories(self.train, self.targets))

    @cached_property
    def similar(self) -> DataFrame:
        return stage(S.train_similarity(self.train, "last_interaction_timestamp_ms"))

    @cached_property
    def cf(self) -> DataFrame:
        return stage(R.cf_candidates(self.history, self.similar, self.products, R.pool_size(K)))

    @cached_property
    def units(self) -> DataFrame:
        return stage(R.unit_vectors(self.vectors))

    @cached_property
    def content(self) -> DataFrame:
        return stage(R.content_candidates(self.history, self.catalog, self.units, R.pool_size(K)))

    @cached_property
    def recommended(self) -> DataFrame:
        return stage(E.recommend_all(self.targets, self.train, self.catalog, self.similar, self.units, self.popular, K))

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "bronze_events": self.bronze_events, "bronze_item_properties": self.bronze_item_properties, "bronze_category_tree": self.bronze_category_tree,
            "silver_user_events": self.silver, "silver_products": self.products, "silver_category_hierarchy": self.hierarchy,
            "gold_user_item_features": self.gold, "gold_item_features": L.gold_items(self.catalog, self.vectors),
        }
