"""Command line over a warehouse folder; results are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators.store import VIEWS
from .plans.flow import Flow
from .session import get_spark
from .sources import rest
from .sources.landing import land_sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--warehouse", type=Path, default=Path("warehouse"))
    p.add_argument("--source", type=Path, default=Path("data/raw"))
    p.add_argument("--landing", type=Path, default=Path("data/landing"))
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flag, kind, default in options:
            c.add_argument(flag, type=kind, default=default)

    paging = ("--api-page-size", int, 50_000), ("--limit", int, None)
    similarity = ("--neighbors", int, 50), ("--min-cooccurrence", int, 2), ("--max-history", int, 30)
    split = ("--target", str, "transaction"), ("--test-days", int, 14), ("--cutoff-ms", int, None)
    add("stage-landing", ("--ingestion-date", str, None))
    add("replay-events", ("--speed", float, 0.0), ("--limit", int, None))
    add("ingest-categories")
    add("serve-api", ("--host", str, "127.0.0.1"), ("--port", int, 8000))
    add("ingest-products", ("--api-url", str, "http://127.0.0.1:8000"), *paging)
    add("build-bronze", ("--speed", float, 0.0), *paging)
    add("build-silver")
    add("build-gold", ("--vector-size", int, 256))
    add("build-features", *similarity)
    add("transform", ("--vector-size", int, 256), *similarity)
    add("validate")
    add("quality-report", ("--json-report", Path, Path("reports/quality.json")), ("--text-report", Path, Path("reports/quality.md")), ("--sample-rows", int, 100_000))
    add("show-lineage")
    add("register-features", ("--version", str, None), ("--retention", int, 5))
    add("show-registry")
    add("get-features", ("--version", str, "latest"))
    sub.choices["get-features"].add_argument("--view", required=True, choices=list(VIEWS))
    sub.choices["get-features"].add_argument("--id", type=int, nargs="+", dest="ids")
    sub.choices["get-features"].add_argument("--for", choices=("inference", "training"), default="inference", dest="purpose")
    add("evaluate", ("--k", int, 10), *split)
    add("profile-gold", ("--top", int, 10))
    add("profile-plots", ("--top", int, 15), ("--out-dir", Path, Path("reports/eda")))
    add("prepare-model-data", *split)
    add("train-models", *similarity)
    add("evaluate-models", ("--k", int, 10))
    add("build-content-model", ("--vector-size", int, 256))
    add("tune-hybrid", ("--validation-days", int, 14), ("--validation-cutoff-ms", int, None), ("--k", int, 10), *similarity)
    add("recommend", ("--k", int, 10), ("--max-history", int, 30))
    sub.choices["recommend"].add_argument("--visitor-id", type=int, required=True)
    add("run", ("--speed", float, 0.0), *paging, ("--vector-size", int, 256))
    curation = ("--speed", float, 0.0), *paging, ("--vector-size", int, 256), ("--feature-retention", int, 5), *similarity
    modeling = ("--target", str, "transaction"), ("--test-days", int, 14), ("--validation-days", int, 14), ("--k", int, 10)
    add("curate", *curation)
    add("model", *modeling, ("--vector-size", int, 256), *similarity)
    add("full", *curation, *modeling)
    add("show-metrics")
    return p


def execute(flow: Flow, a: argparse.Namespace) -> object:
    features = lambda: {"neighbors": a.neighbors, "min_cooccurrence": a.min_cooccurrence, "max_history": a.max_history}
    curation = lambda: {"vector_size": a.vector_size, "feature_retention": a.feature_retention, "speed": a.speed, "limit": a.limit, "page_size": a.api_page_size} | features()
    modeling = lambda: {"target": a.target, "test_days": a.test_days, "validation_days": a.validation_days, "vector_size": a.vector_size, "k": a.k} | features()
    rows = lambda d: [r.asDict() for r in d.collect()]
    match a.command:
        case "stage-landing":
            s = land_sources(a.source, a.landing, a.ingestion_date)
            return {"manifest": s.manifest, "folders": s.folders}
        case "replay-events":
            return {"rows": flow.replay_events(str(a.source / "events.csv"), a.speed, a.limit)}
        case "ingest-categories":
            return {"rows": flow.ingest_categories(str(a.source / "category_tree.csv"))}
        case "serve-api":
            rest.make_server([a.source / f"item_properties_part{i}.csv" for i in (1, 2)], a.host, a.port).serve_forever()
        case "ingest-products":
            return {"rows": flow.ingest_products(a.api_url, a.api_page_size, a.limit)}
        case "build-bronze":
            return flow.build_bronze(a.source, a.landing, speed=a.speed, limit=a.limit, page_size=a.api_page_size)
        case "build-silver":
            flow.build_silver()
            return flow.w.counts(("silver_",))
        case "build-gold":
            flow.build_gold(a.vector_size)
            return flow.w.counts(("gold_",))
        case "build-features":
            flow.build_features(**features())
            return flow.w.counts(("feature_",))
        case "transform":
            return flow.transform(a.vector_size, **features())
        case "validate":
            return flow.validate()
        case "quality-report":
            return flow.quality_report(a.json_report, a.text_report, a.sample_rows)
        case "show-lineage":
            return flow.lineage.latest()
        case "register-features":
            return flow.store.register(a.version, a.retention)
        case "show-registry":
            return flow.store.latest()
        case "get-features":
            d = flow.store.online(a.view, a.ids) if a.purpose == "inference" else flow.store.training(a.view, a.ids, a.version)
            return {"feature_view": a.view, "mode": a.purpose, "rows": rows(d)}
        case "evaluate":
            return flow.evaluate_popularity(a.k, a.target, a.test_days, a.cutoff_ms)
        case "profile-gold":
            return flow.profile(a.top)
        case "profile-plots":
            out = {}
            for name, d in flow.plot_data(a.top).items():
                d.coalesce(1).write.mode("overwrite").csv(str(a.out_dir / name), header=True)
                out[name] = str(a.out_dir / name)
            return out
        case "prepare-model-data":
            return flow.prepare_model_data(a.target, a.test_days, a.cutoff_ms)
        case "train-models":
            return flow.train_models(a.max_history, a.min_cooccurrence, a.neighbors)
        case "evaluate-models":
            return {"config": {"k": a.k, "weights": flow.weights()}, "scores": flow.evaluate_models(a.k)}
        case "build-content-model":
            return flow.build_content_model(a.vector_size)
        case "tune-hybrid":
            return flow.tune_hybrid(a.validation_days, a.validation_cutoff_ms, a.k, a.max_history, a.min_cooccurrence, a.neighbors)
        case "recommend":
            visitors = flow.spark.createDataFrame([(a.visitor_id,)], "visitor_id long")
            return rows(flow.recommend(visitors, a.k, a.max_history).orderBy("rank"))
        case "run":
            bronze = flow.build_bronze(a.source, a.landing, speed=a.speed, limit=a.limit, page_size=a.api_page_size)
            return bronze | flow.transform(a.vector_size)
        case "curate":
            return flow.curate(a.source, a.landing, **curation())
        case "model":
            return flow.model(**modeling())
        case "full":
            return flow.full(a.source, a.landing, curation(), modeling())
        case "show-metrics":
            return flow.lineage.metrics()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    result = execute(Flow(get_spark(master=a.master), a.warehouse), a)
    print(json.dumps(result, indent=2, default=str))
    failed = isinstance(result, dict) and (result.get("ok") is False or result.get("success") is False)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
