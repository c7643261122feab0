"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rrf
from ..operators import evaluate as E
from ..operators import layers as L
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import recommend as R
from ..operators import similarity as S
from ..operators import split as P
from ..scratch import scratch_path, stage
from ..sources import files, rest
from ..sources.landing import land_sources
from ..streaming.replay import replay, replayed_user_items
from .oracles import with_ctes
from .workspace import K, Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(workspace) under a name, with its twin."""

    def add(f: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Workspace(spark, sf_dir))
        if sql:
            ORACLES[name] = with_ctes(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n in names})


query("silver_events", "SELECT * FROM silver")(lambda w: w.silver)
query("silver_rejections", "SELECT event, count(*) AS rejected FROM bronze_events WHERE event NOT IN ('view', 'addtocart', 'transaction') OR event IS NULL OR NOT coalesce(visitorid >= 0 AND itemid >= 0 AND \"timestamp\" > 0, false) GROUP BY event")(
    lambda w: w.bronze_events.where(~F.coalesce(F.col("event").isin("view", "addtocart", "transaction") & (F.col("visitorid") >= 0) & (F.col("itemid") >= 0) & (F.col("timestamp") > 0), F.lit(False))).groupBy("event").agg(F.count("*").alias("rejected"))
)
query("silver_latest_property", """SELECT l_partkey AS itemid, 'returnflag' AS property, l_returnflag AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS n FROM lineitem) WHERE n = 1""")(lambda w: L.latest_properties(w.property_history))
query("silver_products_pivot", "SELECT item_id, category_id, available, array_to_string(encoded, '|') AS encoded_properties FROM products")(lambda w: w.products.withColumn("encoded_properties", F.array_join("encoded_properties", "|")))
query("silver_category_hierarchy", "SELECT * FROM hierarchy")(lambda w: w.hierarchy)
query("gold_user_item", "SELECT * FROM gold")(lambda w: w.gold)
query("gold_user_item_orders", "SELECT * FROM order_gold")(lambda w: w.order_gold)
query("gold_items_catalog", "SELECT item_id, category_id, parent_category_id, available, array_to_string(encoded, '|') AS encoded_properties FROM catalog")(lambda w: w.catalog.withColumn("encoded_properties", F.array_join("encoded_properties", "|")))
query("gold_item_vectors_md5", "SELECT * FROM vectors")(lambda w: w.vectors)
query("gold_item_vectors_blake2b")(lambda w: L.item_vectors(w.catalog, digest="blake2b"))
query("user_activity", "SELECT * FROM activity")(lambda w: L.user_activity(w.gold))
query("item_popularity", "SELECT * FROM popularity_features")(lambda w: longs(L.item_popularity(w.gold, w.catalog), "popularity_rank"))
query("history_cap", "SELECT * FROM capped")(lambda w: S.cap_history(w.train, "last_interaction_timestamp_ms"))
query("item_pair_stats", "SELECT * FROM pairs")(lambda w: S.pair_stats(S.cap_history(w.train, "last_interaction_timestamp_ms")))
query("item_norms", "SELECT * FROM norms")(lambda w: S.norms(w.train))
query("item_similarity_train", "SELECT source_item_id, similar_item_id, round(similarity, 9) AS similarity, cooccurring_users, neighbor_rank FROM neighbours")(lambda w: rounded(longs(w.similar, "neighbor_rank"), "similarity", digits=9))
ORDER_COOCCURRENCE = """, best AS (SELECT visitor_id, item_id, interaction_score FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY interaction_score DESC, last_interaction_timestamp DESC, item_id) AS n FROM {gold}) WHERE n <= 30),
    p AS (SELECT a.item_id AS i, b.item_id AS j, sum(CAST(a.interaction_score AS DOUBLE) * b.interaction_score) AS d, count(*) AS c FROM best a JOIN best b ON a.visitor_id = b.visitor_id AND a.item_id < b.item_id GROUP BY 1, 2),
    q AS (SELECT item_id, sum(CAST(interaction_score AS DOUBLE) * interaction_score) AS s FROM {gold} GROUP BY 1),
    e AS (SELECT i, j, d / sqrt(x.s * y.s) AS similarity, c FROM p JOIN q x ON x.item_id = i JOIN q y ON y.item_id = j WHERE c >= 2)
    SELECT source_item_id, similar_item_id, round(similarity, 9) AS similarity, cooccurring_users, neighbor_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_item_id ORDER BY similarity DESC, cooccurring_users DESC, similar_item_id) AS BIGINT) AS neighbor_rank
      FROM (SELECT i AS source_item_id, j AS similar_item_id, similarity, c AS cooccurring_users FROM e UNION ALL SELECT j, i, similarity, c FROM e)) WHERE neighbor_rank <= 50"""


def _cooccurrence(name: str, gold: str):
    QUERIES[name] = lambda spark, sf_dir: rounded(longs(S.train_similarity(getattr(Workspace(spark, sf_dir), gold), "last_interaction_timestamp"), "neighbor_rank"), "similarity", digits=9)
    ORACLES[name] = with_ctes("", gold).rstrip() + ORDER_COOCCURRENCE.format(gold=gold)


_cooccurrence("item_cooccurrence_topk", "gold")
_cooccurrence("item_cooccurrence_topk_orders", "order_gold")


@query("cf_training_report", """SELECT (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM capped GROUP BY visitor_id) WHERE n > 1) AS pair_contributions,
    (SELECT count(*) FROM (SELECT count(*) AS n FROM capped GROUP BY visitor_id) WHERE n > 1) AS contributing_users, (SELECT count(*) FROM pairs) AS distinct_pairs, (SELECT count(*) FROM neighbours) AS directed_similarities""")
def _training(w: Workspace) -> DataFrame:
    capped = S.cap_history(w.train, "last_interaction_timestamp_ms")
    return S.training_report(capped, S.pair_stats(capped), w.similar)


query("cooccurrence_matrix", """SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared_users FROM gold a JOIN gold b ON a.visitor_id = b.visitor_id AND a.item_id <= b.item_id
    WHERE a.item_id IN (SELECT item_id FROM gold GROUP BY 1 ORDER BY sum(interaction_score) DESC, item_id LIMIT 10)
    AND b.item_id IN (SELECT item_id FROM gold GROUP BY 1 ORDER BY sum(interaction_score) DESC, item_id LIMIT 10) GROUP BY 1, 2""")(lambda w: S.cooccurrence_matrix(w.gold))
query("split_bounds", "SELECT * FROM bounds")(lambda w: P.bounds(w.silver).withColumn("cutoff_ms", F.col("maximum_ms") - 14 * 86_400_000))
query("train_user_items", "SELECT * FROM train")(lambda w: w.train)
query("test_targets_transaction", "SELECT * FROM targets")(lambda w: w.targets)
query("test_targets_high_intent", "SELECT * FROM targets_high")(lambda w: P.temporal_split(w.silver, w.products, "high-intent").targets)
query("popularity_model", "SELECT * FROM popular")(lambda w: longs(w.popular, "rank"))
query("profile_size", """SELECT count(*) AS user_item_pairs, count(DISTINCT visitor_id) AS users, count(DISTINCT item_id) AS interacted_items, (SELECT count(*) FROM catalog) AS catalog_items,
    count(DISTINCT visitor_id) * count(DISTINCT item_id) AS possible_user_item_pairs, round(count(*) / (count(DISTINCT visitor_id) * count(DISTINCT item_id))::DOUBLE, 9) AS observed_density,
    round(1 - count(*) / (count(DISTINCT visitor_id) * count(DISTINCT item_id))::DOUBLE, 9) AS sparsity FROM gold""")(lambda w: rounded(PR.sizes(w.gold, w.catalog), "observed_density", "sparsity", digits=9))
query("profile_totals", "SELECT CAST(sum(view_count) AS BIGINT) AS views, CAST(sum(cart_count) AS BIGINT) AS add_to_carts, CAST(sum(purchase_count) AS BIGINT) AS purchases, CAST(sum(interaction_score) AS BIGINT) AS weighted_score FROM gold")(lambda w: PR.totals(w.gold))
query("profile_availability", "SELECT coalesce(CAST(available AS VARCHAR), 'unknown') AS availability, count(*) AS items FROM catalog GROUP BY 1")(lambda w: PR.availability(w.catalog))
for _entity, _name in (("visitor_id", "users"), ("item_id", "items")):
    query(f"profile_distribution_{_name}", f"""SELECT min(n) AS min, avg(n) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, max(n) AS max
        FROM (SELECT count(*) AS n FROM gold GROUP BY {_entity})""")(lambda w, e=_entity: PR.distribution(w.gold, e))
query("top_active_users", "SELECT visitor_id, count(*) AS distinct_items, CAST(sum(interaction_score) AS BIGINT) AS interaction_score FROM gold GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 10")(lambda w: PR.active_users(w.gold))
query("top_items", """SELECT item_id, users, interaction_score, category_id, available FROM (SELECT item_id, count(*) AS users, CAST(sum(interaction_score) AS BIGINT) AS interaction_score
    FROM gold GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 10) LEFT JOIN catalog USING (item_id)""")(lambda w: PR.popular_items(w.gold, w.catalog))
query("top_categories", """SELECT category_id, count(DISTINCT item_id) AS items, count(DISTINCT visitor_id) AS users, CAST(sum(interaction_score) AS BIGINT) AS interaction_score
    FROM gold JOIN catalog USING (item_id) GROUP BY 1 ORDER BY 4 DESC, 1 NULLS LAST LIMIT 10""")(lambda w: PR.popular_categories(w.gold, w.catalog))
query("histogram_items_per_user", "SELECT interactions, count(*) AS frequency FROM (SELECT count(*) AS interactions FROM gold GROUP BY visitor_id) GROUP BY 1")(lambda w: PR.histogram(w.gold, "visitor_id"))
query("histogram_event_types", "SELECT event_type, count(*) AS events FROM silver GROUP BY 1")(lambda w: w.silver.groupBy("event_type").agg(F.count("*").alias("events")))
query("events_by_day", "SELECT substr(event_timestamp, 1, 10) AS day, event_type, count(*) AS events FROM silver GROUP BY 1, 2")(lambda w: w.silver.groupBy(F.substring("event_timestamp", 1, 10).alias("day"), "event_type").agg(F.count("*").alias("events")))
query("popularity_recs", "SELECT visitor_id, item_id, rank FROM recommended WHERE model = 'weighted_popularity'")(lambda w: longs(R.popularity_recommendations(w.targets, w.history, w.popular, K), "rank"))


@query("popularity_metrics", "SELECT * FROM metrics WHERE model = 'weighted_popularity'")
def _popularity_metrics(w: Workspace) -> DataFrame:
    recs = R.popularity_recommendations(w.targets, w.history, w.popular, K).withColumn("model", F.lit("weighted_popularity"))
    return _round_metrics(E.metrics(recs, w.targets, w.history, w.products, K))


def _round_metrics(rows: DataFrame) -> DataFrame:
    return longs(rounded(rows, "precision", "recall", "ndcg", "hit_rate", "catalog_coverage"), "evaluated_users", "distinct_items", "fallback_users")


query("cf_candidates", "SELECT * FROM cf")(lambda w: longs(w.cf, "rank"))
query("cf_recs", "SELECT visitor_id, item_id, rank, fallback FROM recommended WHERE model = 'item_collaborative_filtering'")(lambda w: longs(R.with_fallback(w.cf, w.targets, w.history, w.popular, K), "rank"))
query("content_unit_vectors", "SELECT item_id, bucket, round(weight, 9) AS weight FROM units")(lambda w: rounded(w.units, "weight", digits=9))
query("content_profile", "SELECT visitor_id, bucket, round(weight, 9) + 0.0 AS weight FROM profile")(lambda w: rounded(R.content_profile(w.history, w.units), "weight", digits=9).withColumn("weight", F.col("weight") + F.lit(0.0)))
query("category_affinity", "SELECT visitor_id, category_id, round(affinity, 9) AS affinity FROM category_share")(lambda w: rounded(R.affinity(w.history, w.catalog, "category_id"), "affinity", digits=9))
query("parent_affinity", "SELECT visitor_id, parent_category_id, round(affinity, 9) AS affinity FROM parent_share")(lambda w: rounded(R.affinity(w.history, w.catalog, "parent_category_id"), "affinity", digits=9))
query("content_scores", "SELECT * FROM content")(lambda w: longs(w.content, "rank"))
query("content_recs", "SELECT visitor_id, item_id, rank, fallback FROM recommended WHERE model = 'content_similarity'")(lambda w: longs(R.with_fallback(w.content, w.targets, w.history, w.popular, K), "rank"))
query("rrf_fusion", "SELECT * FROM fused")(lambda w: R.fuse(w.cf, w.content).drop("sources"))
query("hybrid_recs", "SELECT visitor_id, item_id, rank, fallback FROM recommended WHERE model = 'item_cf_content_hybrid'")(lambda w: longs(R.with_fallback(R.top(R.fuse(w.cf, w.content), K), w.targets, w.history, w.popular, K), "rank"))
query("model_metrics_segmented", "SELECT * FROM metrics")(lambda w: _round_metrics(E.metrics(w.recommended, w.targets, w.history, w.products, K)))
query("lift_over_popularity", """SELECT m.model, m.segment, round(m."precision" - b."precision", 6) AS precision_lift, round(m.recall - b.recall, 6) AS recall_lift, round(m.ndcg - b.ndcg, 6) AS ndcg_lift, round(m.hit_rate - b.hit_rate, 6) AS hit_rate_lift
    FROM metrics m JOIN metrics b ON b.segment = m.segment AND b.model = 'weighted_popularity' WHERE m.model <> 'weighted_popularity'""")(
    lambda w: rounded(E.lift(_round_metrics(E.metrics(w.recommended, w.targets, w.history, w.products, K))), "precision_lift", "recall_lift", "ndcg_lift", "hit_rate_lift")
)


@query("tune_grid", """SELECT trial, "precision", recall, ndcg, hit_rate, vector_weight, category_weight, parent_weight, item_cf_weight, content_weight,
    row_number() OVER (ORDER BY ndcg DESC, recall DESC, "precision" DESC, abs(item_cf_weight - 0.5), trial) AS place FROM tuned JOIN trials USING (trial)""")
def _tune(w: Workspace) -> DataFrame:
    s = w.split
    return longs(E.tune(w.silver, w.catalog, w.units, s.cutoff_ms, s.minimum_ms, days=7), "place")


@query("serve_batch", """SELECT visitor_id, rank, item_id, score, sources, category_id, parent_category_id, CASE WHEN used IS NULL THEN 'weighted_popularity_fallback' ELSE 'item_cf_content_hybrid' END AS model,
    coalesce(used, 0) AS history_items_used, fallback_used, (SELECT count(*) > 0 FROM units) AS content_model_loaded FROM served LEFT JOIN catalog USING (item_id) LEFT JOIN s_used USING (visitor_id) JOIN s_short USING (visitor_id)""")
def _serve(w: Workspace) -> DataFrame:
    asked = w.gold.select("visitor_id").unionByName(w.spark.range(1).select(F.lit(-1).cast("long").alias("visitor_id")))
    out = E.serve(asked, w.gold, w.catalog, w.similar, w.units, w.popular, K).drop("weights")
    return longs(out.withColumn("sources", F.array_join("sources", "+")), "rank")


query("dq_checks", """SELECT name, severity, violations, violations = 0 OR severity = 'information' AS success FROM (
    SELECT 'missing_bronze_event_keys' AS name, 'critical' AS severity, (SELECT count(*) FROM bronze_events WHERE "timestamp" IS NULL OR visitorid IS NULL OR itemid IS NULL OR event IS NULL) AS violations
    UNION ALL SELECT 'duplicate_bronze_events', 'warning', (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM bronze_events GROUP BY "timestamp", visitorid, event, itemid, transactionid))
    UNION ALL SELECT 'invalid_silver_event_types', 'critical', (SELECT count(*) FROM silver WHERE event_type NOT IN ('view', 'addtocart', 'transaction'))
    UNION ALL SELECT 'missing_silver_event_keys', 'critical', (SELECT count(*) FROM silver WHERE visitor_id IS NULL OR item_id IS NULL OR event_timestamp_ms IS NULL OR event_timestamp IS NULL)
    UNION ALL SELECT 'transaction_id_consistency', 'critical', (SELECT count(*) FROM silver WHERE (event_type = 'transaction') <> (transaction_id IS NOT NULL))
    UNION ALL SELECT 'availability_domain', 'critical', (SELECT count(*) FROM products WHERE available NOT IN (0, 1))
    UNION ALL SELECT 'duplicate_silver_products', 'critical', (SELECT count(*) - count(DISTINCT item_id) FROM products)
    UNION ALL SELECT 'orphan_event_items', 'warning', (SELECT count(*) FROM silver e WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.item_id = e.item_id))
    UNION ALL SELECT 'orphan_parent_categories', 'warning', (SELECT count(*) FROM hierarchy c WHERE parent_category_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hierarchy p WHERE p.category_id = c.parent_category_id))
    UNION ALL SELECT 'missing_property_values', 'critical', (SELECT count(*) FROM properties WHERE value IS NULL OR value = '')
    UNION ALL SELECT 'duplicate_gold_user_items', 'critical', (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM gold GROUP BY visitor_id, item_id))
    UNION ALL SELECT 'interaction_score_formula', 'critical', (SELECT count(*) FROM gold WHERE interaction_score <> view_count + 3 * cart_count + 5 * purchase_count)
    UNION ALL SELECT 'missing_gold_vectors', 'critical', (SELECT count(*) FROM gold_items WHERE item_feature_vector IS NULL)
    UNION ALL SELECT 'bronze_to_silver_rejections', 'information', (SELECT count(*) FROM bronze_events) - (SELECT count(*) FROM silver))""")(lambda w: Q.violations(w.tables))
query("dq_expectations", """SELECT dataset, expectation, "column", unexpected_count, unexpected_count = 0 AS success FROM (
    SELECT 'silver_user_events' AS dataset, 'not_null' AS expectation, 'visitor_id' AS "column", (SELECT count(*) FROM silver WHERE visitor_id IS NULL) AS unexpected_count
    UNION ALL SELECT 'silver_user_events', 'not_null', 'item_id', (SELECT count(*) FROM silver WHERE item_id IS NULL)
    UNION ALL SELECT 'silver_user_events', 'not_null', 'event_timestamp_ms', (SELECT count(*) FROM silver WHERE event_timestamp_ms IS NULL)
    UNION ALL SELECT 'silver_user_events', 'in_set', 'event_type', (SELECT count(*) FROM silver WHERE event_type NOT IN ('view', 'addtocart', 'transaction'))
    UNION ALL SELECT 'silver_products', 'not_null', 'item_id', (SELECT count(*) FROM products WHERE item_id IS NULL)
    UNION ALL SELECT 'silver_products', 'unique', 'item_id', (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM products GROUP BY item_id HAVING count(*) > 1))
    UNION ALL SELECT 'silver_products', 'in_set', 'available', (SELECT count(*) FROM products WHERE available NOT IN (0, 1))
    UNION ALL SELECT 'gold_user_item_features', 'not_null', 'visitor_id', (SELECT count(*) FROM gold WHERE visitor_id IS NULL)
    UNION ALL SELECT 'gold_user_item_features', 'not_null', 'item_id', (SELECT count(*) FROM gold WHERE item_id IS NULL)
    UNION ALL SELECT 'gold_user_item_features', 'at_least', 'interaction_score', (SELECT count(*) FROM gold WHERE interaction_score < 1)
    UNION ALL SELECT 'gold_item_features', 'unique', 'item_id', (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM catalog GROUP BY item_id HAVING count(*) > 1))
    UNION ALL SELECT 'gold_item_features', 'not_null', 'item_feature_vector', (SELECT count(*) FROM gold_items WHERE item_feature_vector IS NULL))""")(lambda w: Q.expectations(w.tables))
query("dq_duplicates", 'SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM bronze_events GROUP BY event, itemid HAVING count(*) > 1)')(lambda w: Q.duplicates(w.bronze_events, ["event", "itemid"]))
@query("replay_user_items", "SELECT * FROM gold")
def _replay(w: Workspace) -> DataFrame:
    """The events landed as files in time order, streamed batch by batch, and the aggregate of what arrived."""
    base = scratch_path(w.spark, "replay")
    w.bronze_events.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.csv(f"{base}/in", header=True)
    replay(w.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return replayed_user_items(w.spark, f"{base}/out")


def _csv(w: Workspace, rows: DataFrame, label: str, ragged: bool = False) -> str:
    """The rows as one header CSV; ragged lines have bare commas in the last field."""
    path = scratch_path(w.spark, label)
    if ragged:
        lines = rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
        head = w.spark.createDataFrame([(",".join(rows.columns),)], "value string")
        head.unionByName(lines).coalesce(1).write.text(path)
    else:
        rows.coalesce(1).write.csv(path, header=True)
    return path


def _ragged(w: Workspace) -> DataFrame:
    return w.bronze_item_properties.select("timestamp", "itemid", "property", F.concat("value", F.lit(", new,used")).alias("value"))


_RAGGED = """SELECT "timestamp", itemid, property, value || ', new,used' AS value FROM properties"""
query("source_events_csv", "SELECT * FROM bronze_events")(lambda w: files.read_events(w.spark, _csv(w, w.bronze_events, "events")))
query("source_categories_csv", "SELECT category_id AS categoryid, parent_category_id AS parentid FROM hierarchy")(lambda w: files.read_categories(w.spark, _csv(w, w.bronze_category_tree, "categories")))
query("source_ragged_properties", _RAGGED)(lambda w: files.read_properties(w.spark, [_csv(w, _ragged(w), "properties", ragged=True)]).drop("ingest_seq"))


def _local_sources(w: Workspace) -> Path:
    """The four source files on the driver's disk, written row by row."""
    folder = Path(tempfile.mkdtemp(prefix="tallywick-sources-"))
    atexit.register(shutil.rmtree, folder, True)
    parts = _ragged(w).orderBy("itemid", "property").withColumn("part", F.col("itemid") % 2)
    tables = {
        "events.csv": w.bronze_events.orderBy("timestamp", "visitorid"), "category_tree.csv": w.bronze_category_tree.orderBy("categoryid"),
        "item_properties_part1.csv": parts.where("part = 1").drop("part"), "item_properties_part2.csv": parts.where("part = 0").drop("part"),
    }
    for name, rows in tables.items():
        with (folder / name).open("w", encoding="utf-8", newline="") as f:
            f.write(",".join(rows.columns) + "\n")
            f.writelines(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows.toLocalIterator())
    return folder


@query("source_paged_properties", _RAGGED)
def _paged(w: Workspace) -> DataFrame:
    """Both property files, served in pages and read by the data source."""
    folder = _local_sources(w)
    server = rest.make_server([folder / f"item_properties_part{i}.csv" for i in (1, 2)])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        return stage(rest.read_pages(w.spark, f"http://127.0.0.1:{server.server_port}", 1700).drop("ingest_seq"))
    finally:
        server.shutdown()
        server.server_close()


@query("source_landing", """SELECT 'clickstream' AS data_type, 'events.csv' AS filename, sha256('timestamp,visitorid,event,itemid,transactionid' || chr(10) ||
      string_agg("timestamp" || ',' || visitorid || ',' || event || ',' || itemid || ',' || coalesce(CAST(transactionid AS VARCHAR), '') || chr(10), '' ORDER BY "timestamp", visitorid)) AS sha256, 2 AS landings FROM bronze_events
    UNION ALL SELECT 'category_reference', 'category_tree.csv', sha256('categoryid,parentid' || chr(10) || string_agg(category_id || ',' || parent_category_id || chr(10), '' ORDER BY category_id)), 2 FROM hierarchy
    UNION ALL SELECT 'product_metadata', 'item_properties_part' || (2 - itemid % 2) || '.csv', sha256('timestamp,itemid,property,value' || chr(10) || string_agg("timestamp" || ',' || itemid || ',' || property || ',' || value || ', new,used' || chr(10), '' ORDER BY itemid, property)), 2 FROM properties GROUP BY itemid % 2""")
def _landing(w: Workspace) -> DataFrame:
    """Landed twice: the same content lies in one place, and each run has a manifest."""
    folder = _local_sources(w)
    runs = [land_sources(folder, folder / "landing", "2026-07-21") for _ in range(2)]
    records = [(r["data_type"], r["filename"], r["sha256"], r["landing_path"]) for run in runs for r in json.loads(run.manifest.read_text())["files"]]
    rows = w.spark.createDataFrame(records, "data_type string, filename string, sha256 string, landing_path string")
    return rows.groupBy("data_type", "filename", "sha256", "landing_path").agg(F.count("*").alias("landings")).drop("landing_path")


@query("feature_retrieval", """SELECT 'latest' AS mode, visitor_id, total_events, 'v3' AS feature_version FROM activity WHERE visitor_id % 7 = 3
    UNION ALL SELECT 'training', visitor_id, total_events, 'v2' FROM activity""")
def _retrieval(w: Workspace) -> DataFrame:
    """Three versions with two kept: the newest for some visitors, an older one whole."""
    from ..operators.store import FeatureStore, Warehouse

    house = Warehouse(w.spark, scratch_path(w.spark, "store"))
    house.rebuild("feature_user_activity", L.user_activity(w.gold))
    house.rebuild("feature_item_popularity", L.item_popularity(w.gold, w.catalog))
    house.rebuild("feature_item_cooccurrence", S.train_similarity(w.gold, "last_interaction_timestamp"))
    store = FeatureStore(house)
    for version in ("v1", "v2", "v3"):
        store.register(version, 2)
    if {r["feature_version"] for r in store.registry()} != {"v2", "v3"}:
        raise RuntimeError("two versions are kept")
    wanted = w.gold.select("visitor_id").where("visitor_id % 7 = 3")
    both = [store.online("user_activity", wanted).withColumn("mode", F.lit("latest")), store.training("user_activity", version="v2").withColumn("mode", F.lit("training"))]
    return both[0].unionByName(both[1]).select("mode", "visitor_id", "total_events", "feature_version")


@query("feature_store_latest", """SELECT 'user_activity' AS feature_view, 'user' AS entity, 'visitor_id' AS entity_key, 'v1' AS feature_version, (SELECT count(*) FROM activity) AS row_count
    UNION ALL SELECT 'item_popularity', 'item', 'item_id', 'v1', (SELECT count(*) FROM popularity_features)
    UNION ALL SELECT 'item_cooccurrence', 'item', 'source_item_id', 'v1', (SELECT count(*) FROM gold_neighbours)""")
def _store(w: Workspace) -> DataFrame:
    """Registers the three feature tables and lists the newest version of each view."""
    from ..operators.store import FeatureStore, Warehouse

    house = Warehouse(w.spark, scratch_path(w.spark, "store"))
    house.rebuild("feature_user_activity", L.user_activity(w.gold))
    house.rebuild("feature_item_popularity", L.item_popularity(w.gold, w.catalog))
    house.rebuild("feature_item_cooccurrence", S.train_similarity(w.gold, "last_interaction_timestamp"))
    store = FeatureStore(house)
    store.register("v1")
    rows = [(r["feature_view"], r["entity"], r["entity_key"], r["feature_version"], r["row_count"]) for r in store.latest()]
    return w.spark.createDataFrame(rows, "feature_view string, entity string, entity_key string, feature_version string, row_count long")


query("dq_orphans", "SELECT count(*) AS violations FROM silver e WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.item_id = e.item_id)")(lambda w: w.silver.alias("e").join(w.products.alias("p"), F.col("e.item_id") == F.col("p.item_id"), "left_anti").agg(F.count("*").alias("violations")))
query("dq_transaction_ids", "SELECT count(*) AS violations FROM silver WHERE (event_type = 'transaction') <> (transaction_id IS NOT NULL)")(lambda w: w.silver.agg(F.count_if((F.col("event_type") == "transaction") != F.col("transaction_id").isNotNull()).alias("violations")))


@query("validate_summary", """SELECT 'valid_event_types' AS "check", (SELECT count(*) FROM silver WHERE event_type NOT IN ('view', 'addtocart', 'transaction')) = 0 AS success
    UNION ALL SELECT 'unique_products', (SELECT count(*) = count(DISTINCT item_id) FROM products)
    UNION ALL SELECT 'unique_user_items', (SELECT count(*) FROM (SELECT 1 FROM gold GROUP BY visitor_id, item_id HAVING count(*) > 1)) = 0
    UNION ALL SELECT 'scores_match', (SELECT count(*) FROM gold WHERE interaction_score <> view_count + 3 * cart_count + 5 * purchase_count) = 0
    UNION ALL SELECT 'vectors_present', (SELECT count(*) FROM gold_items WHERE item_feature_vector IS NULL) = 0 UNION ALL SELECT 'feature_users_complete', (SELECT count(*) FROM activity) = (SELECT count(DISTINCT visitor_id) FROM gold)
    UNION ALL SELECT 'feature_items_complete', (SELECT count(*) FROM popularity_features) = (SELECT count(*) FROM catalog)
    UNION ALL SELECT 'feature_scores_present', (SELECT count(*) FROM activity WHERE avg_interaction_score IS NULL) = 0
    UNION ALL SELECT 'feature_cooccurrence_ranked', (SELECT count(*) FROM g_neighbours WHERE neighbor_rank < 1 OR similarity IS NULL) = 0""")
def _validate(w: Workspace) -> DataFrame:
    features = {
        "feature_user_activity": L.user_activity(w.gold), "feature_item_popularity": L.item_popularity(w.gold, w.catalog),
        "feature_item_cooccurrence": S.train_similarity(w.gold, "last_interaction_timestamp"),
    }
    return Q.validate(w.tables | features)


_PROFILED = ("view_count", "interaction_score", "last_interaction_timestamp")
query("column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", replace(lower(any_value(typeof({c}))), 'varchar', 'string') AS dtype, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "distinct",
    min(TRY_CAST({c} AS DOUBLE)) AS minimum, max(TRY_CAST({c} AS DOUBLE)) AS maximum, round(avg(TRY_CAST({c} AS DOUBLE)), 9) AS mean FROM gold""" for c in _PROFILED))(
    lambda w: rounded(Q.column_profile(w.gold, list(_PROFILED)), "mean", digits=9)
)
query("rrf_terms", "SELECT visitor_id, item_id, round(0.6::DOUBLE / (20.0::DOUBLE + rank), 9) AS term FROM cf")(lambda w: w.cf.select("visitor_id", "item_id", F.round(rrf(0.6, F.col("rank"), 20.0), 9).alias("term")))
