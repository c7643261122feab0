"""The pipeline over a warehouse: layers, features, models, evaluation and serving, with retry and lineage."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import layers as L
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import recommend as R
from ..operators import similarity as S
from ..operators import split as P
from ..operators.store import RETENTION, FeatureStore, Lineage, Warehouse
from ..schemas import CHECKED_SCHEMAS, HYBRID_WEIGHTS
from ..sources import files, rest
from ..sources.landing import land_sources
from ..streaming.replay import land_in_order, replay

MODEL_TABLES = ("model_split_metadata", "model_train_user_items", "model_test_targets", "model_popularity", "model_item_pair_stats", "model_item_similarity", "model_hybrid_config")


class Flow:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.w = spark, Warehouse(spark, root)
        self.lineage, self.store = Lineage(self.w), FeatureStore(self.w)

    # bronze
    def replay_events(self, path: str, speed: float = 0, limit: int | None = None) -> int:
        """A batch read; with a speed the same rows in time order, paced through a stream whose batches make the table."""
        rows = files.read_events(self.spark, path, limit)
        if not speed:
            return self.w.rebuild("bronze_events", rows).count()
        work = f"{self.w.root}/_replay/{uuid.uuid4().hex[:8]}"
        try:
            land_in_order(rows, f"{work}/in")
            replay(self.spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint", speed, clean=False).awaitTermination()
            return self.w.rebuild("bronze_events", self.spark.read.parquet(f"{work}/out").drop("batch")).count()
        finally:
            self.w.files.remove(work)

    def ingest_categories(self, path: str) -> int:
        return self.w.rebuild("bronze_category_tree", files.read_categories(self.spark, path)).count()

    def ingest_products(self, url: str, page_size: int = 50_000, limit: int | None = None) -> int:
        return self.w.rebuild("bronze_item_properties", rest.read_pages(self.spark, url, page_size, limit)).count()

    def build_bronze(self, source: Path, landing: Path, date: str | None = None, speed: float = 0, limit: int | None = None, page_size: int = 50_000) -> dict:
        snapshot = land_sources(source, landing, date)
        folders = snapshot.folders
        counts = {"categories": self.ingest_categories(str(folders["category_reference"] / "category_tree.csv")), "events": self.replay_events(str(folders["clickstream"] / "events.csv"), speed, limit)}
        server = rest.make_server([folders["product_metadata"] / n for n in ("item_properties_part1.csv", "item_properties_part2.csv")])
        thread = threading.Thread(target=server.serve_forever, name="property-pages")
        thread.start()
        try:
            counts["properties"] = self.ingest_products(f"http://127.0.0.1:{server.server_port}", page_size, limit)
        finally:
            server.shutdown()
            thread.join()
            server.server_close()
        return counts | {"manifest": str(snapshot.manifest)}

    # silver, gold, features
    def build_silver(self) -> None:
        self.w.require(["bronze_events", "bronze_item_properties", "bronze_category_tree"], "run build-bronze first")
        self.w.rebuild("silver_user_events", L.clean_events(self.w.read("bronze_events")))
        self.w.rebuild("silver_category_hierarchy", L.category_hierarchy(self.w.read("bronze_category_tree")))
        self.w.rebuild("silver_products", L.products(self.w.read("bronze_item_properties")))

    def build_gold(self, vector_size: int = L.VECTOR_SIZE, digest: str = "blake2b") -> None:
        self.w.require(["silver_user_events", "silver_products", "silver_category_hierarchy"], "run build-silver first")
        self.w.rebuild("gold_user_item_features", L.user_items(self.w.read("silver_user_events")))
        catalog = L.catalog(self.w.read("silver_products"), self.w.read("silver_category_hierarchy"))
        self.w.rebuild("gold_item_features", L.gold_items(catalog, L.item_vectors(catalog, vector_size, digest)))

    def build_features(self, neighbors: int = S.NEIGHBORS, min_cooccurrence: int = S.MIN_COOCCURRENCE, max_history: int = S.MAX_HISTORY) -> None:
        self.w.require(["gold_user_item_features", "gold_item_features"], "run build-gold first")
        if max_history < 2 or min_cooccurrence < 1 or neighbors < 1:
            raise ValueError("neighbors and min_cooccurrence must be at least 1, max_history at least 2")
        gold = self.w.read("gold_user_item_features")
        self.w.rebuild("feature_user_activity", L.user_activity(gold))
        self.w.rebuild("feature_item_popularity", L.item_popularity(gold, self.w.read("gold_item_features")))
        pairs = self.w.rebuild("feature_item_pair_stats", S.pair_stats(S.cap_history(gold, "last_interaction_timestamp", max_history)))
        self.w.rebuild("feature_item_cooccurrence", S.neighbors(pairs, S.norms(gold), min_cooccurrence, neighbors))

    def transform(self, vector_size: int = L.VECTOR_SIZE, **features: int) -> dict[str, int]:
        self.build_silver()
        self.build_gold(vector_size)
        self.build_features(**features)
        return self.w.counts()

    # checks
    def _tables(self) -> dict[str, DataFrame]:
        return {n: self.w.read(n) for n in self.w.names()}

    def validate(self) -> dict:
        checks = {r["check"]: r["success"] for r in Q.validate(self._tables()).collect()}
        return {"counts": self.w.counts(), "checks": checks, "ok": all(checks.values())}

    def quality_report(self, json_report: Path, text_report: Path, sample_rows: int = 100_000) -> dict:
        import json

        tables = self._tables()
        schemas = Q.schema_checks(tables)
        if any(n not in tables for n in CHECKED_SCHEMAS):
            summary = {"success": False, "critical_failures": sum(not s["success"] for s in schemas), "schemas": schemas}
            text = "# Data quality\n\nTables are missing.\n"
        else:
            checks = Q.violations(tables)
            keys = {"silver_user_events": ["event_timestamp_ms", "visitor_id", "item_id"], "silver_products": ["item_id"], "gold_user_item_features": ["visitor_id", "item_id"], "gold_item_features": ["item_id"]}
            sampled = tables | {n: Q.sample(tables[n], k, sample_rows) for n, k in keys.items()}
            expected = Q.expectations(sampled)
            summary = Q.overall(checks, expected, schemas) | {"schemas": schemas, "checks": [r.asDict() for r in checks.collect()], "expectations": [r.asDict() for r in expected.collect()]}
            summary["profiles"] = {n: Q.table_profile(tables[n], sampled[n]) for n in keys}
            text = Q.report(checks, expected, summary)
        for path, body in ((json_report, json.dumps(summary, indent=2, default=str)), (text_report, text)):
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(body)
        return summary

    def profile(self, top: int = 10) -> dict:
        if top <= 0:
            raise ValueError("top must be positive")
        self.w.require(["gold_user_item_features", "gold_item_features"], "run build-gold first")
        gold, items = self.w.read("gold_user_item_features"), self.w.read("gold_item_features")
        one = lambda d: d.first().asDict()
        many = lambda d: [r.asDict() for r in d.collect()]  # noqa: E731  at most `top` rows
        return {
            "size": one(PR.sizes(gold, items)), "interaction_totals": one(PR.totals(gold)), "availability": {r["availability"]: r["items"] for r in PR.availability(items).collect()},
            "items_per_user": one(PR.distribution(gold, "visitor_id")), "users_per_item": one(PR.distribution(gold, "item_id")),
            "most_active_users": many(PR.active_users(gold, top)), "most_common_items": many(PR.popular_items(gold, items, top)), "most_common_categories": many(PR.popular_categories(gold, items, top)),
        }

    def plot_data(self, top: int = 15) -> dict[str, DataFrame]:
        """The data behind the six exploratory plots."""
        gold, items = self.w.read("gold_user_item_features"), self.w.read("gold_item_features")
        return {
            "items_per_user": PR.histogram(gold, "visitor_id"), "users_per_item": PR.histogram(gold, "item_id"), "event_mix": PR.totals(gold),
            "top_items": PR.popular_items(gold, items, top), "top_categories": PR.popular_categories(gold, items, top), "cooccurrence": S.cooccurrence_matrix(gold, top),
        }

    # models
    def prepare_model_data(self, target: str = "transaction", test_days: int = 14, cutoff_ms: int | None = None) -> dict:
        self.w.require(["silver_user_events", "silver_products"], "run build-silver first")
        s = P.temporal_split(self.w.read("silver_user_events"), self.w.read("silver_products"), target, test_days, cutoff_ms)
        self.w.drop(*MODEL_TABLES)
        self.w.rebuild("model_split_metadata", self.spark.createDataFrame([(s.cutoff_ms, target, s.minimum_ms, s.maximum_ms)], "cutoff_ms long, target string, minimum_event_ms long, maximum_event_ms long"))
        train, targets = self.w.rebuild("model_train_user_items", s.train), self.w.rebuild("model_test_targets", s.targets)
        return {"target": target, "cutoff_ms": s.cutoff_ms, "train_pairs": train.count(), "test_pairs": targets.count(), "eligible_users": targets.select("visitor_id").distinct().count()}

    def train_models(self, max_history: int = S.MAX_HISTORY, min_cooccurrence: int = S.MIN_COOCCURRENCE, neighbors: int = S.NEIGHBORS) -> dict:
        self.w.require(["model_train_user_items", "silver_products"], "run prepare-model-data first")
        if max_history < 2 or min_cooccurrence < 1 or neighbors < 1:
            raise ValueError("neighbors and min_cooccurrence must be at least 1, max_history at least 2")
        train = self.w.read("model_train_user_items")
        self.w.rebuild("model_popularity", P.popularity(train, self.w.read("silver_products")))
        capped = S.cap_history(train, "last_interaction_timestamp_ms", max_history)
        pairs = self.w.rebuild("model_item_pair_stats", S.pair_stats(capped))
        similar = self.w.rebuild("model_item_similarity", S.neighbors(pairs, S.norms(train), min_cooccurrence, neighbors))
        return S.training_report(capped, pairs, similar).first().asDict()

    def build_content_model(self, vector_size: int = L.VECTOR_SIZE) -> dict:
        self.w.require(["gold_item_features"], "run build-gold first")
        exploded = self.w.read("gold_item_features").select("item_id", F.explode("item_feature_vector").alias("bucket", "value"))
        units = self.w.rebuild("model_content_vectors", R.unit_vectors(exploded, vector_size))
        self.w.rebuild("model_content_metadata", self.spark.createDataFrame([(vector_size,)], "vector_size int"))
        return {"vector_size": vector_size, "items": self.w.read("gold_item_features").count(), "nonzeros": units.count()}

    def _vectors(self) -> DataFrame | None:
        return self.w.read("model_content_vectors") if self.w.exists("model_content_metadata") else None

    def weights(self) -> dict[str, float]:
        if not self.w.exists("model_hybrid_config"):
            return dict(HYBRID_WEIGHTS)
        row = self.w.read("model_hybrid_config").first().asDict()
        return {k: row[k] for k in HYBRID_WEIGHTS}

    def tune_hybrid(self, days: int = 14, cutoff_ms: int | None = None, k: int = 10, max_history: int = S.MAX_HISTORY, min_cooccurrence: int = S.MIN_COOCCURRENCE, neighbors: int = S.NEIGHBORS) -> dict:
        self.w.require(["model_split_metadata", "model_content_vectors"], "run prepare-model-data and build-content-model first")
        meta = self.w.read("model_split_metadata").first()
        trials = E.tune(self.w.read("silver_user_events"), self.w.read("gold_item_features"), self._vectors(), meta["cutoff_ms"], meta["minimum_event_ms"], meta["target"], days, cutoff_ms, k, max_history, min_cooccurrence, neighbors)
        trials = self.w.rebuild("model_tuning_trials", trials)
        best = trials.where("place = 1").withColumn("rrf_constant", F.lit(HYBRID_WEIGHTS["rrf_constant"]))
        self.w.rebuild("model_hybrid_config", best)
        return {"configurations_tested": trials.count(), "best": best.first().asDict(), "top_configurations": [r.asDict() for r in trials.orderBy("place").limit(5).collect()]}

    def evaluate_models(self, k: int = 10) -> list[dict]:
        self.w.require(["model_train_user_items", "model_test_targets", "model_popularity", "model_item_similarity"], "run train-models first")
        items = self.w.read("gold_item_features") if self.w.exists("gold_item_features") else L.catalog(self.w.read("silver_products"), self.w.read("silver_category_hierarchy"))
        scores = E.evaluate(self.w.read("model_test_targets"), self.w.read("model_train_user_items"), items, self.w.read("model_item_similarity"), self._vectors(), self.w.read("model_popularity"), k, self.weights())
        return [r.asDict() for r in scores.collect()]

    def evaluate_popularity(self, k: int = 10, target: str = "transaction", test_days: int = 14, cutoff_ms: int | None = None) -> list[dict]:
        """Standalone: split, popularity and metrics straight from the cleaned layer."""
        if k <= 0:
            raise ValueError("k must be positive")
        events, items = self.w.read("silver_user_events"), self.w.read("silver_products")
        s = P.temporal_split(events, items, target, test_days, cutoff_ms)
        if not P.available_items(items).limit(1).count():
            raise RuntimeError("No available products")
        popular = P.popularity(s.train, items)
        if not popular.limit(1).count():
            raise RuntimeError("No available items have interactions before the cutoff")
        if not s.targets.limit(1).count():
            raise RuntimeError("No visitors have novel, available targets after the cutoff")
        history = P.histories(s.train, s.targets)
        recs = R.popularity_recommendations(s.targets, history, popular, k).withColumn("model", F.lit("weighted_popularity"))
        return [r.asDict() for r in E.metrics(recs, s.targets, history, items, k).collect()]

    def recommend(self, visitors: DataFrame, k: int = 10, max_history: int = S.MAX_HISTORY) -> DataFrame:
        self.w.require(["gold_user_item_features", "gold_item_features", "model_popularity", "model_item_similarity"], "run train-models first")
        return E.serve(visitors, self.w.read("gold_user_item_features"), self.w.read("gold_item_features"), self.w.read("model_item_similarity"), self._vectors(), self.w.read("model_popularity"), k, max_history, self.weights())

    # orchestration
    def run(self, name: str, tasks: list[tuple[str, Callable[[], object], dict]], parameters: dict | None = None, wait: Callable[[float], None] = time.sleep) -> dict:
        """The tasks' results by name, run in order under a run record; a task's options are retries, delay (seconds) and records (lineage arguments, or what makes them of its result)."""
        run_id = str(uuid.uuid4())
        self.lineage.start(run_id, name, parameters or {})
        results: dict = {"run_id": run_id}
        try:
            for task_name, task, options in tasks:
                for attempt in range(options.get("retries", 0) + 1):
                    try:
                        results[task_name] = task()
                        break
                    except Exception:
                        if attempt == options.get("retries", 0):
                            raise
                        wait(options.get("delay", 0))
                records = options.get("records", ())
                for record in records(results[task_name]) if callable(records) else records:
                    self.lineage.record(run_id, *record)
        except Exception as e:
            self.lineage.finish(run_id, "FAILED", str(e))
            raise
        self.lineage.finish(run_id, "COMPLETED")
        return results

    def curation_tasks(self, source: Path, landing: Path, vector_size: int = L.VECTOR_SIZE, neighbors: int = S.NEIGHBORS, min_cooccurrence: int = S.MIN_COOCCURRENCE, max_history: int = S.MAX_HISTORY, feature_retention: int = RETENTION, **bronze) -> list[tuple[str, Callable[[], object], dict]]:
        raw = [("bronze_events", "bronze", "scan", [], Path(source) / "events.csv"), ("bronze_category_tree", "bronze", "scan", [], Path(source) / "category_tree.csv")]
        raw += [("bronze_item_properties", "bronze", "paged scan", [], Path(source) / f"item_properties_part{i}.csv") for i in (1, 2)]
        registered = lambda result: [(v["source_table"], "feature_store", f"registered as {v['feature_view']} {v['feature_version']}", [v["source_table"]]) for v in result["feature_views"]]
        return [
            ("bronze", lambda: self.build_bronze(source, landing, **bronze), {"retries": 1, "delay": 5, "records": raw}),
            ("silver", self.build_silver, {"records": [("silver_user_events", "silver", "clean", ["bronze_events"]), ("silver_products", "silver", "latest values", ["bronze_item_properties"]), ("silver_category_hierarchy", "silver", "rename", ["bronze_category_tree"])]}),
            ("gold", lambda: self.build_gold(vector_size), {"records": [("gold_user_item_features", "gold", "aggregate", ["silver_user_events"]), ("gold_item_features", "gold", "hashed vectors", ["silver_products", "silver_category_hierarchy"])]}),
            ("features", lambda: self.build_features(neighbors, min_cooccurrence, max_history), {"records": [(n, "feature", "features", ["gold_user_item_features"]) for n in ("feature_user_activity", "feature_item_popularity", "feature_item_cooccurrence")]}),
            ("registry", lambda: self.store.register(retention=feature_retention), {"records": registered}),
            ("validation", self._must_be_valid, {}),
        ]

    def modeling_tasks(self, target: str = "transaction", test_days: int = 14, validation_days: int = 14, vector_size: int = L.VECTOR_SIZE, k: int = 10, max_history: int = S.MAX_HISTORY, min_cooccurrence: int = S.MIN_COOCCURRENCE, neighbors: int = S.NEIGHBORS) -> list[tuple[str, Callable[[], object], dict]]:
        near = max_history, min_cooccurrence, neighbors
        return [
            ("split", lambda: self.prepare_model_data(target, test_days), {"records": [("model_train_user_items", "model", "split", ["silver_user_events"]), ("model_test_targets", "model", "split", ["silver_user_events", "silver_products"])]}),
            ("training", lambda: self.train_models(*near), {"records": [("model_popularity", "model", "popularity", ["model_train_user_items"]), ("model_item_similarity", "model", "cosine", ["model_train_user_items"])]}),
            ("content", lambda: self.build_content_model(vector_size), {"records": [("model_content_vectors", "model", "unit vectors", ["gold_item_features"])]}),
            ("tuning", lambda: self.tune_hybrid(validation_days, None, k, *near), {"records": [("model_hybrid_config", "model", "grid", ["silver_user_events"])]}),
            ("evaluation", lambda: self.evaluate_models(k), {}),
        ]

    def curate(self, source: Path, landing: Path, **options) -> dict:
        return self.run("curation", self.curation_tasks(source, landing, **options), {"source": str(source)} | options)

    def model(self, **options) -> dict:
        """The modelling tasks; the numbers of each go to the run log."""
        results = self.run("modeling", self.modeling_tasks(**options), options)
        for name in ("split", "training", "content", "tuning"):
            self.lineage.log_metrics(results["run_id"], name, options, results[name])
        self.lineage.log_metrics(results["run_id"], "evaluation", options, {f"{r['model']}.{r['segment']}": {x: r[x] for x in E.METRICS} for r in results["evaluation"]})
        return results

    def full(self, source: Path, landing: Path, curation: dict | None = None, modeling: dict | None = None) -> dict:
        return {"curation": self.curate(source, landing, **(curation or {})), "modeling": self.model(**(modeling or {}))}

    def _must_be_valid(self) -> dict:
        result = self.validate()
        if not result["ok"]:
            raise RuntimeError("Validation failed: " + ", ".join(k for k, ok in result["checks"].items() if not ok))
        return result
