"""The pipeline on small hand-made sources: layers, features, models, quality, store, lineage, replay."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tallywick.functions.scalar import flatten_metrics
from tallywick.operators import evaluate as E
from tallywick.operators import layers as L
from tallywick.operators import recommend as R
from tallywick.operators import similarity as S
from tallywick.operators import split as P
from tallywick.plans.flow import Flow
from tallywick.sources import files, rest
from tallywick.sources.landing import land_sources
from tallywick.streaming.replay import event_stream, land_in_order, pause, replay, replayed_user_items

EVENTS = "timestamp,visitorid,event,itemid,transactionid\n1000,1,view,10,\n2000,1,addtocart,10,\n3000,1,transaction,10,99\n4000,2,invalid,10,\n"
PROPERTIES = "timestamp,itemid,property,value\n1000,10,categoryid,7\n1000,10,available,0\n2000,10,available,1\n1000,10,400,n1\n"
HEADER = "timestamp,itemid,property,value\n"
TREE = "categoryid,parentid\n7,3\n3,\n"


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, text in (("events.csv", EVENTS), ("item_properties_part1.csv", PROPERTIES), ("item_properties_part2.csv", HEADER), ("category_tree.csv", TREE)):
        (folder / name).write_text(text)
    return folder


@pytest.fixture
def flow(spark, tmp_path):
    return Flow(spark, tmp_path / "warehouse")


def test_end_to_end(flow, source, tmp_path):
    counts = flow.build_bronze(source, tmp_path / "landing", page_size=2)
    assert (counts["events"], counts["properties"], counts["categories"]) == (4, 4, 2)
    flow.transform(16)
    assert flow.w.read("silver_user_events").count() == 3
    product = flow.w.read("silver_products").first()
    assert product["available"] == 1 and product["category_id"] == 7 and product["encoded_properties"] == ["400_n1"]
    gold = flow.w.read("gold_user_item_features").first()
    assert gold["interaction_score"] == 9 and gold["last_interaction_timestamp"] == "1970-01-01 00:00:03"
    assert flow.w.read("gold_item_features").first()["parent_category_id"] == 3
    assert flow.validate()["ok"]
    report = flow.quality_report(tmp_path / "q.json", tmp_path / "q.md")
    checks = {c["name"]: c["violations"] for c in report["checks"]}
    assert report["success"] and checks["bronze_to_silver_rejections"] == 1 and all(e["success"] for e in report["expectations"]) and len(report["expectations"]) == 12
    assert json.loads((tmp_path / "q.json").read_text())["success"]


def test_landing(source, tmp_path):
    a = land_sources(source, tmp_path / "l", "2026-07-21")
    b = land_sources(source, tmp_path / "l", "2026-07-21")
    assert a.folders == b.folders and a.manifest != b.manifest
    records = json.loads(a.manifest.read_text())["files"]
    assert len(records) == 4 and all(len(r["sha256"]) == 64 for r in records)
    with pytest.raises(ValueError):
        land_sources(source, tmp_path / "l", "21-07-2026")
    (a.folders["clickstream"] / "events.csv").write_text("other")
    with pytest.raises(RuntimeError):
        land_sources(source, tmp_path / "l", "2026-07-21")
    (source / "events.csv").unlink()
    with pytest.raises(FileNotFoundError):
        land_sources(source, tmp_path / "l", "2026-07-21")


def test_ragged_properties(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("﻿" + HEADER + '1000,10,description,"red, large"\n2000,11,description,blue,small,sale\n', encoding="utf-8")
    rows = files.read_properties(spark, [str(p)]).orderBy("ingest_seq").collect()
    assert [r["value"] for r in rows] == ["red, large", "blue,small,sale"]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_properties(spark, [str(p)])
    with pytest.raises(ValueError, match="line 2"):
        list(files.parse_properties(HEADER + "1,2\n"))


def test_rest_pages(spark, source):
    server = rest.make_server([source / "item_properties_part1.csv"])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [r["ingest_seq"] for r in rest.read_pages(spark, url, 2).orderBy("ingest_seq").collect()] == [0, 1, 2, 3]
        assert rest.read_pages(spark, url, 3, limit=2).count() == 2
        assert rest.fetch(url + "/health") == {"status": "ok"}
        assert rest.fetch(url + "/item-properties?offset=2&limit=2")["has_more"]
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        rest.read_pages(spark, url, 0)
    calls = []

    def failing(url, timeout):
        calls.append(url)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        rest.fetch("x", failing, lambda s: None)
    assert len(calls) == 3


def test_latest_value_and_order(spark):
    rows = [(1, 5, "10", "x", 0), (1, 5, "1", "y", 1), (2, 5, "available", "0", 2), (2, 5, "available", "1", 3), (1, 5, "categoryid", "n/a", 4), (1, 6, "available", "2", 5)]
    p = {r["item_id"]: r for r in L.products(spark.createDataFrame(rows, "timestamp long, itemid long, property string, value string, ingest_seq long")).collect()}
    assert p[5]["encoded_properties"] == ["1_y", "10_x"] and p[5]["available"] == 1 and p[5]["category_id"] is None
    assert p[6]["encoded_properties"] == [] and p[6]["available"] == 2


@pytest.fixture
def world(spark):
    rows = [(1, 10, "view", 1000), (1, 20, "transaction", 1100), (2, 10, "view", 1200), (2, 20, "transaction", 1300), (3, 10, "view", 1400), (4, 30, "transaction", 1500), (4, 30, "transaction", 1600), (4, 30, "transaction", 1700), (3, 20, "transaction", 9000)]
    raw = spark.createDataFrame([(t, v, e, i, None) for v, i, e, t in rows], "timestamp long, visitorid long, event string, itemid long, transactionid long")
    items = spark.createDataFrame([(10, 1, None, 1), (20, 1, None, 1), (30, 1, None, 1)], "item_id long, category_id long, parent_category_id long, available long")
    return L.clean_events(raw), items


def test_models(spark, world):
    events, items = world
    s = P.temporal_split(events, items, cutoff_ms=5000)
    assert s.targets.count() == 1
    similar = S.train_similarity(s.train, "last_interaction_timestamp_ms", 10, 1, 5)
    both = {(r["source_item_id"], r["similar_item_id"]): r["similarity"] for r in similar.collect()}
    assert set(both) == {(10, 20), (20, 10)} and both[10, 20] == both[20, 10] and 0 < both[10, 20] <= 1
    scores = {(r["model"], r["segment"]): r for r in E.evaluate(s.targets, s.train, items, similar, None, P.popularity(s.train, items), 1).collect()}
    assert scores["weighted_popularity", "all"]["precision"] == 0.0
    assert scores["item_collaborative_filtering", "all"]["precision"] == 1.0
    assert ("weighted_popularity", "cold") not in scores
    with pytest.raises(ValueError):
        P.temporal_split(events, items, "clicks")
    with pytest.raises(ValueError):
        P.temporal_split(events, items, cutoff_ms=1000)


def test_features(spark, world):
    events, items = world
    gold = L.user_items(events.where("event_timestamp_ms < 1400"))
    users = {r["visitor_id"]: r for r in L.user_activity(gold).collect()}
    assert len(users) == 2 and users[1]["avg_interaction_score"] == 3.0
    ranks = {r["item_id"]: r for r in L.item_popularity(gold, items).collect()}
    assert ranks[20]["popularity_rank"] == 1 and ranks[20]["avg_interaction_score"] == 5.0 and ranks[30]["total_interaction_score"] == 0
    assert sorted(r["popularity_rank"] for r in ranks.values()) == [1, 2, 3]


def test_history_cap_breaks_ties_by_item(spark):
    gold = spark.createDataFrame([(1, i, 5, 100) for i in (4, 3, 2, 1)], "visitor_id long, item_id long, interaction_score long, t long")
    assert sorted(r["item_id"] for r in S.cap_history(gold, "t", 2).collect()) == [1, 2]


@pytest.fixture
def content_world(spark):
    items = spark.createDataFrame([(10, 1, 100, 1), (20, 1, 100, 1), (30, 2, 200, 1)], "item_id long, category_id long, parent_category_id long, available long")
    vectors = spark.createDataFrame([(10, 0, 1.0), (10, 1, 1.0), (20, 0, 1.0), (20, 1, 1.0), (30, 2, 1.0)], "item_id long, bucket int, value double")
    popular = spark.createDataFrame([(30, 10, 1), (20, 5, 2), (10, 1, 3)], "item_id long, score long, rank int")
    return items, R.unit_vectors(vectors, 4), popular, spark.createDataFrame([], "source_item_id long, similar_item_id long, similarity double, cooccurring_users long, neighbor_rank int")


def test_serving(spark, content_world):
    items, units, popular, similar = content_world
    gold = spark.createDataFrame([(1, 10, 1, 0, 0, 1, "1970-01-01 00:00:01")], "visitor_id long, item_id long, view_count long, cart_count long, purchase_count long, interaction_score long, last_interaction_timestamp string")
    asked = spark.createDataFrame([(1,), (999,)], "visitor_id long")
    out = {(r["visitor_id"], r["rank"]): r for r in E.serve(asked, gold, items, similar, units, popular, 1).collect()}
    assert out[1, 1]["item_id"] == 20 and out[1, 1]["sources"] == ["content"]
    assert out[1, 1]["history_items_used"] == 1 and not out[1, 1]["fallback_used"] and out[1, 1]["content_model_loaded"] and out[1, 1]["weights"]["rrf_constant"] == 20.0
    assert out[999, 1]["history_items_used"] == 0 and out[999, 1]["fallback_used"]
    assert out[999, 1]["item_id"] == 30 and out[999, 1]["sources"] == ["popularity"] and out[999, 1]["model"] == "weighted_popularity_fallback" and out[999, 1]["score"] == 0.0
    with pytest.raises(ValueError):
        R.content_candidates(gold, items, units, 10, -1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        R.unit_vectors(units.withColumnRenamed("weight", "value"), 1)


def test_tuning(spark, content_world):
    items, units, _, _ = content_world
    raw = spark.createDataFrame([(1000, 1, "view", 10, None), (1100, 2, "view", 10, None), (1200, 2, "transaction", 20, 1), (4000, 1, "transaction", 20, 2)], "timestamp long, visitorid long, event string, itemid long, transactionid long")
    trials = E.tune(L.clean_events(raw), items, units, 9000, 1000, cutoff_ms=3000, k=1, min_cooccurrence=1).orderBy("place").collect()
    assert len(trials) == 55 and trials[0]["precision"] == 1.0 and trials[0]["item_cf_weight"] == 0.5


def test_blocks_of_the_catalog_give_the_same_list(spark, content_world, monkeypatch):
    """Scores by plain loops, and the same from many blocks and slices."""
    import math

    import numpy as np
    from tallywick.operators import scoring

    rng = np.random.default_rng(1)
    items = [(i, int(rng.integers(0, 5)) if i % 9 else None, int(rng.integers(0, 2)), int(i % 7 > 0)) for i in range(150)]
    vectors = [(i, int(b), float(rng.normal())) for i in range(150) if i % 11 for b in rng.choice(40, 4, replace=False)]
    history = [(v, int(i), float(rng.integers(1, 9))) for v in range(40) for i in rng.choice(150, v % 6, replace=False)]
    tables = [spark.createDataFrame(history, "visitor_id long, item_id long, score double"), spark.createDataFrame(items, "item_id long, category_id long, parent_category_id long, available long"), spark.createDataFrame(vectors, "item_id long, bucket int, weight double")]
    weights = [(0.8, 0.15, 0.05), (0.2, 0.5, 0.3)]
    want = {}
    for v in range(40):
        own = {i: math.log1p(s) for u, i, s in history if u == v}
        profile = np.zeros(40)
        for i, b, w in vectors:
            profile[b] += own.get(i, 0) * w
        if not profile.any():
            continue
        profile /= np.linalg.norm(profile)
        total = sum(own.values())
        share = [{c: sum(w for i, w in own.items() if items[i][k] == c) / total for c in range(5)} for k in (1, 2)]
        for g, (a, b, c) in enumerate(weights):
            scored = []
            for i, category, parent, there in items:
                if there and i not in own:
                    cosine = sum(profile[x] * w for j, x, w in vectors if j == i)
                    scored.append((-round(a * cosine + b * share[0].get(category, 0) + c * share[1].get(parent, 0), 9), i))
            want |= {(g, v, r): i for r, (_, i) in enumerate(sorted(scored)[:20], 1)}
    for size in (16_384, 13):
        monkeypatch.setattr(scoring, "ITEMS", size)
        monkeypatch.setattr(scoring, "VISITORS", size)
        monkeypatch.setattr(scoring, "CELLS", 100 * size)
        got = {(r["grid"], r["visitor_id"], r["rank"]): r["item_id"] for r in R.content_grid(*tables, 20, weights).collect()}
        assert got == want


def test_few_pairs_are_scored_and_none_is_lost(monkeypatch):
    """Copies of items, equal scores, seen copies and wholly seen classes: the lists of plain loops, from a small share of the pairs."""
    import numpy as np
    import pyarrow as pa
    from tallywick.operators import scoring

    rng = np.random.default_rng(2)
    pairs = pa.list_(pa.struct([("k", pa.int64()), ("w", pa.float64())]))
    vectors = [{int(b): float(rng.integers(-3, 4)) for b in rng.choice(64, rng.integers(0, 4), replace=False)} for _ in range(3000)]
    vectors[5] = None
    kinds = [(int(rng.integers(0, 6)) if c % 9 else None, int(rng.integers(0, 3)), vectors[c]) for c in range(3000)]
    ids = rng.permutation(6500)
    copies = [2 + (c % 50 == 0) * 9 if c < 2500 else 1 for c in range(3000)]
    members = [sorted(int(i) for i in ids[sum(copies[:c]) : sum(copies[: c + 1])]) for c in range(3000)]
    of = {i: c for c, own in enumerate(members) for i in own}
    people = []
    for v in range(40):
        profile = {int(b): float(rng.normal()) for b in rng.choice(64, 1 + v % 9, replace=False)}
        seen = {i for c in (0, 50, int(rng.integers(3000))) for i in members[c][: 1 + v % 12]} | {10_000}
        people.append((profile, {int(c): float(rng.random()) for c in range(v % 6)}, {0: float(rng.random())}, seen))
    listed = lambda x: None if x is None else [{"k": k, "w": w} for k, w in sorted(x.items())]
    names = ("profile", "categories", "parents")
    visitors = pa.table({"visitor_id": pa.array(range(40), pa.int64()), **{n: pa.array([listed(p[k]) for p in people], pairs) for k, n in enumerate(names)}, "seen": pa.array([listed(dict.fromkeys(p[3], 0.0)) for p in people], pairs)})
    classes = pa.table({"item_id": pa.array([m[0] for m in members], pa.int64()), "category_id": pa.array([k[0] for k in kinds], pa.int64()), "parent_category_id": pa.array([k[1] for k in kinds], pa.int64()), "vector": pa.array([listed(k[2]) for k in kinds], pairs), "members": pa.array(members, pa.list_(pa.int64()))})
    weights = [(1.0, 0.0, 0.0), (0.6, 0.25, 0.15), (0.0, 1.0, 0.0)]
    counted = []
    plain = scoring.half_up
    monkeypatch.setattr(scoring, "half_up", lambda x: counted.append(x.size) or plain(x))
    dense = np.array([[(vector or {}).get(b, 0.0) for b in range(64)] for _, _, vector in kinds])
    want = {}
    for v, (profile, categories, parents, seen) in enumerate(people):
        cosine = dense @ np.array([profile.get(b, 0.0) for b in range(64)])
        for g, (a, b, c) in enumerate(weights):
            scores = plain(a * cosine + b * np.array([categories.get(k[0], 0.0) for k in kinds]) + c * np.array([parents.get(k[1], 0.0) for k in kinds]))
            want[v, g] = sorted((-scores[k], i) for i, k in of.items() if i not in seen)[:20]
    for first, cells in ((512, 1_000_000), (16, 3000), (5000, 1_000_000)):
        monkeypatch.setattr(scoring, "FIRST", first)
        monkeypatch.setattr(scoring, "CELLS", cells)
        counted.clear()
        rows = scoring.score_block(visitors, classes, weights, 20).to_pylist()
        got = {(r["visitor_id"], g): [(-s, i) for x, i, s in zip(r["grid"], r["item"], r["score"], strict=True) if x == g] for r in rows for g in range(3)}
        assert got.keys() == want.keys()
        for key in want:
            assert [i for _, i in got[key]] == [i for _, i in want[key]], key
        if first == 16:
            assert sum(counted) < 0.5 * len(weights) * 40 * 3000


def test_lists_of_trials_by_plain_loops():
    import numpy as np
    import pyarrow as pa
    from tallywick.operators import scoring

    rng = np.random.default_rng(3)
    mixes = [(0.0, 1.0), (0.3, 0.7), (0.5, 0.5), (1.0, 0.0)]
    rows = []
    for v in range(60):
        cf = [int(i) for i in rng.permutation(40)[: rng.integers(0, 12)]] if v % 5 else None
        blocks = [(g, int(i), float(rng.integers(0, 4))) for g in (0, 1) for i in rng.permutation(40)[: rng.integers(0, 15)]] if v % 7 else None
        rows.append({"visitor_id": v, "wanted": [int(i) for i in rng.permutation(40)[:5]], "cf": cf, **{n: blocks and [b[k] for b in blocks] for k, n in enumerate(("grid", "item", "score"))}})
    kinds = {"visitor_id": pa.int64(), **dict.fromkeys(("wanted", "cf", "item"), pa.list_(pa.int64())), "grid": pa.list_(pa.int32()), "score": pa.list_(pa.float64())}
    got = scoring.trial_lists(pa.Table.from_pylist(rows, pa.schema(kinds.items())), 2, mixes, 20.0, 10, 6).to_pylist()
    want = []
    for r in rows:
        for g in (0, 1):
            content = sorted((-s, i) for x, i, s in zip(r["grid"] or [], r["item"] or [], r["score"] or [], strict=True) if x == g)[:10]
            ranks = [{i: n for n, i in enumerate(x, 1)} for x in (r["cf"] or [], [i for _, i in content])]
            for t, mix in enumerate(mixes):
                fused = sorted((-round(sum(w / (20 + rank[i]) for w, rank in zip(mix, ranks, strict=True) if i in rank), 9), i) for i in ranks[0].keys() | ranks[1].keys())[:6]
                short = len(fused) < 6
                want += [(4 * g + t, r["visitor_id"], i, n, short) for n, (_, i) in enumerate(fused, 1) if short or i in r["wanted"]]
                want += [] if fused else [(4 * g + t, r["visitor_id"], None, 0, True)]
    assert sorted(map(repr, (tuple(x.values()) for x in got))) == sorted(map(repr, want))


def test_tuning_of_a_small_catalog_agrees_with_sql(spark, tmp_path):
    """Fewer items than a list is long: all trials are filled up from popularity."""
    import duckdb
    from tallywick.plans import catalogue

    con = duckdb.connect()
    for name, keep in (("events", "CAST(json_extract_string(props, '$.k') AS BIGINT) < 25 AND user_id < 60"), ("part", "p_partkey < 22"), ("nation", "true")):
        con.sql(f"COPY (FROM '/root/testdata/sf0.01/{name}.parquet' WHERE {keep}) TO '{tmp_path}/{name}.parquet'")
        con.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    rows = catalogue.queries()["tune_grid"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in rows.collect())
    want = sorted(con.sql(f"SELECT {', '.join(f'"{c}"' for c in rows.columns)} FROM ({catalogue.oracle_sql()['tune_grid']})").fetchall())
    assert len(got) == 55 and got == want


def test_zero_scores_come_before_negative_ones(spark, content_world):
    items, _, _, _ = content_world
    vectors = spark.createDataFrame([(10, 0, 1.0), (20, 0, -1.0)], "item_id long, bucket int, weight double")
    bare = items.withColumn("category_id", F.lit(None).cast("long")).withColumn("parent_category_id", F.lit(None).cast("long"))
    history = spark.createDataFrame([(1, 10, 1.0)], "visitor_id long, item_id long, score double")
    ranked = [r["item_id"] for r in R.content_candidates(history, bare, vectors, 100).orderBy("rank").collect()]
    assert ranked == [30, 20]


def test_store_and_lineage(flow, spark, tmp_path):
    for name, key in (("feature_user_activity", "visitor_id"), ("feature_item_popularity", "item_id"), ("feature_item_cooccurrence", "source_item_id")):
        flow.w.rebuild(name, spark.createDataFrame([(1, 2), (2, 3)], f"{key} long, x long"))
    for i in range(4):
        flow.store.register(f"run-{i}", 2, tmp_path / "m.json")
    assert {r["feature_version"] for r in flow.store.registry()} == {"run-2", "run-3"} and len(flow.store.latest()) == 3
    assert flow.store.resolve("user_activity") == "run-3"
    assert flow.store.online("user_activity", [1]).count() == 1 and flow.store.online("user_activity", []).count() == 2
    assert flow.store.training("item_popularity", version="run-2").first()["feature_version"] == "run-2"
    with pytest.raises(RuntimeError):
        flow.store.register("run-3")
    with pytest.raises(RuntimeError):
        flow.store.resolve("user_activity", "run-0")
    with pytest.raises(ValueError):
        flow.store.resolve("nothing")
    with pytest.raises(ValueError):
        flow.store.register("x", 0)
    (tmp_path / "s.csv").write_text("id\n1\n")
    flow.lineage.start("r", "f", {})
    row = flow.lineage.record("r", "feature_user_activity", "feature", "t", [], tmp_path / "s.csv")
    flow.lineage.finish("r", "COMPLETED")
    assert row["row_count"] == 2 and row["source_version"].startswith("sha256:") and flow.lineage.runs()["r"]["status"] == "COMPLETED" and len(flow.lineage.latest()) == 1


def test_run_records_failure_and_retries(flow):
    calls = []

    def task():
        calls.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        flow.run("f", [("t", task, {"retries": 1})], wait=lambda s: None)
    assert len(calls) == 2 and [r["status"] for r in flow.lineage.runs().values()] == ["FAILED"]


def test_pages_are_found_by_place(tmp_path, monkeypatch):
    monkeypatch.setattr(rest, "STEP", 3)
    rows = [(str(i), str(i % 5), "p", f"é{i},x" if i % 4 == 0 else f"two\nlines {i}" if i % 7 == 0 else str(i)) for i in range(25)]
    line = lambda r: ",".join([*r[:3], '"' + r[3] + '"' if "\n" in r[3] else r[3]])
    for name, part in (("a.csv", rows[:10]), ("b.csv", []), ("c.csv", rows[10:])):
        (tmp_path / name).write_text("\ufeff" + HEADER + "".join(line(r) + "\r\n" for r in part), encoding="utf-8", newline="")
    pages = rest.PropertyFiles([tmp_path / n for n in ("a.csv", "b.csv", "c.csv")])
    for offset, size in ((20, 3), (0, 4), (4, 6), (10, 15), (24, 5), (30, 2), (7, 1), (0, 25), (3, 3)):
        assert [tuple(r.values()) for r in pages.page(offset, size)] == rows[offset : offset + size], (offset, size)
    assert len(pages.places) == 9


def test_a_rebuild_keeps_the_version_that_is_read(flow, spark):
    first = flow.w.rebuild("t", spark.range(3))
    flow.w.rebuild("t", spark.range(5))
    assert first.count() == 3 and flow.w.read("t").count() == 5
    flow.w.rebuild("t", spark.range(7))
    assert len([f for f in flow.w.files.folders(f"{flow.w.root}/t") if f.startswith("v-")]) == 2


def test_paced_replay_makes_bronze(flow, source, tmp_path, spark):
    flow.replay_events(str(source / "events.csv"))
    batch = sorted(map(str, flow.w.read("bronze_events").collect()))
    assert flow.replay_events(str(source / "events.csv"), speed=1e9) == 4
    assert sorted(map(str, flow.w.read("bronze_events").collect())) == batch and not flow.w.files.folders(f"{flow.w.root}/_replay")
    assert flow.replay_events(str(source / "events.csv"), limit=2) == 2 and [r["timestamp"] for r in flow.w.read("bronze_events").collect()] == [1000, 2000]
    folder = str(tmp_path / "ordered")
    land_in_order(spark.createDataFrame([(t, 1, "view", 1, None) for t in range(100, 0, -1)], files.EVENTS).repartition(5), folder, 7)
    seen = []
    event_stream(spark, folder).writeStream.foreachBatch(lambda d, n: seen.append(d.agg(F.min("timestamp")).first()[0])).trigger(availableNow=True).start().awaitTermination()
    assert seen == sorted(seen) and len(seen) >= 15


def test_profile_of_a_table(spark):
    from tallywick.operators import quality as Q

    rows = spark.createDataFrame([(1, "a", {1: 2.0}), (1, "a", {1: 2.0}), (None, "b", None)], "n long, t string, m map<int,double>")
    out = Q.table_profile(rows, rows)
    assert (out["full_row_count"], out["sample_duplicate_rows"], out["sample_missing_values"]) == (3, 1, 2)
    assert [(c["column"], c["dtype"], c["missing"], c["distinct"], c["mean"]) for c in out["columns"]] == [("n", "bigint", 1, 1, 1.0), ("t", "string", 0, 2, None), ("m", "map<int,double>", 1, 1, None)]
    with pytest.raises(ValueError):
        Q.sample(rows, ["n"], 0)


def test_hashed_tokens_are_those_of_the_digest(spark):
    import hashlib

    from tallywick.functions.scalar import blake2b_hash

    tokens = ["", "a", "category:7", "parent_category:3", "400_n1", "é", "x" * 300, "available_1", "0", "\n"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", blake2b_hash(256)("t").alias("h")).collect()
    for r in rows:
        digest = hashlib.blake2b(r["t"].encode(), digest_size=8).digest()
        assert (r["h"]["bucket"], r["h"]["sign"]) == (int.from_bytes(digest, "big") % 256, 1.0 if digest[0] % 2 else -1.0)
    fixed = {r["t"]: (r["h"]["bucket"], r["h"]["sign"]) for r in rows}
    assert hashlib.blake2b(b"", digest_size=8).hexdigest() == "e4a6a0577479b2b4" and fixed[""] == (0xB4, -1.0)


@pytest.fixture
def market(tmp_path):
    """Sources on which every stage has something to do: 12 visitors, 8 items, 40 days."""
    folder, day = tmp_path / "market", 86_400_000
    folder.mkdir()
    events = [(1 + day * (1 + (v * 5 + i) % 25), v, "view" if (v + i) % 3 else "addtocart", i, "") for v in range(12) for i in range(8) if (v * i) % 4 != 3]
    events += [(day * (20 + (v + i) % 8), v, "transaction", i, 100 + v) for v in range(12) for i in range(8) if (v * i) % 4 == 3]
    events += [(day * (36 + i % 4), v, "transaction", i, 200 + v) for v, i in ((1, 3), (2, 6), (3, 1), (5, 7), (7, 5), (20, 2))]
    (folder / "events.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n" + "".join(",".join(map(str, e)) + "\n" for e in events))
    rows = [(1000, i, p, v) for i in range(8) for p, v in (("categoryid", i % 3), ("available", 1), ("color", f"n{i % 2}"))]
    (folder / "item_properties_part1.csv").write_text(HEADER + "".join(",".join(map(str, r)) + "\n" for r in rows[:10]))
    (folder / "item_properties_part2.csv").write_text(HEADER + "".join(",".join(map(str, r)) + "\n" for r in rows[10:]))
    (folder / "category_tree.csv").write_text("categoryid,parentid\n0,\n1,0\n2,0\n")
    return folder


def test_flows_record_lineage_and_metrics(flow, market, tmp_path):
    out = flow.full(market, tmp_path / "landing", {"vector_size": 16, "min_cooccurrence": 1, "page_size": 7}, {"vector_size": 16, "validation_days": 7, "min_cooccurrence": 1, "k": 3})
    assert out["curation"]["bronze"]["properties"] == 24 and out["curation"]["validation"]["ok"] and out["modeling"]["tuning"]["configurations_tested"] == 55
    assert {r["model"] for r in out["modeling"]["evaluation"]} == {"weighted_popularity", "item_collaborative_filtering", "content_similarity", "item_cf_content_hybrid"}
    records = flow.lineage._rows("datasets")
    layers = [r["layer"] for r in records if r["run_id"] == out["curation"]["run_id"]]
    assert [layers.count(x) for x in ("bronze", "silver", "gold", "feature", "feature_store")] == [4, 3, 2, 3, 3]
    assert [r["source_uri"].rsplit("/", 1)[1] for r in records if r["dataset_name"] == "bronze_item_properties"] == ["item_properties_part1.csv", "item_properties_part2.csv"]
    assert [r["status"] for r in flow.lineage.runs().values()] == ["COMPLETED"] * 2
    log = {r["name"]: r["metrics"] for r in flow.lineage.metrics()}
    assert log["tuning"]["configurations_tested"] == 55.0 and 0 <= log["evaluation"]["item_cf_content_hybrid.all.ndcg"] <= 1
    with pytest.raises(ValueError):
        flow.model(target="clicks")
    assert sorted(r["status"] for r in flow.lineage.runs().values()) == ["COMPLETED", "COMPLETED", "FAILED"]


def test_command_line(spark, market, tmp_path, capsys, monkeypatch):
    from tallywick import cli

    monkeypatch.setattr(cli, "get_spark", lambda master=None: spark)
    base = ["--warehouse", str(tmp_path / "w"), "--source", str(market), "--landing", str(tmp_path / "l")]

    def run(*args):
        code = cli.main([*base, *args])
        return code, json.loads(capsys.readouterr().out)

    assert run("stage-landing", "--ingestion-date", "2026-07-21")[0] == 0
    assert run("replay-events", "--limit", "5") == (0, {"rows": 5}) and run("ingest-categories") == (0, {"rows": 3})
    server = rest.make_server([market / f"item_properties_part{i}.csv" for i in (1, 2)])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert run("ingest-products", "--api-url", f"http://127.0.0.1:{server.server_port}", "--api-page-size", "5") == (0, {"rows": 24})
    finally:
        server.shutdown()
    assert run("build-bronze", "--api-page-size", "9")[1]["events"] > 80
    assert set(run("build-silver")[1]) == {"silver_user_events", "silver_products", "silver_category_hierarchy"}
    assert run("build-gold", "--vector-size", "16")[1]["gold_item_features"] == 8
    assert run("build-features", "--min-cooccurrence", "1")[1]["feature_item_popularity"] == 8
    assert run("transform", "--vector-size", "16", "--min-cooccurrence", "1")[1]["gold_item_features"] == 8
    assert run("validate")[1]["ok"] and run("profile-gold", "--top", "3")[1]["size"]
    code, report = run("quality-report", "--json-report", str(tmp_path / "q.json"), "--text-report", str(tmp_path / "q.md"))
    assert code == 0 and len(report["profiles"]) == 4
    assert len(run("register-features", "--version", "a")[1]["feature_views"]) == 3 and len(run("show-registry")[1]) == 3
    assert run("get-features", "--view", "user_activity", "--id", "1", "2")[1]["rows"][0]["feature_version"] == "a"
    assert run("get-features", "--view", "item_popularity", "--for", "training", "--version", "a")[0] == 0
    assert len(run("profile-plots", "--out-dir", str(tmp_path / "eda"))[1]) == 6
    assert run("evaluate", "--k", "3")[1][0]["model"] == "weighted_popularity"
    assert run("prepare-model-data")[1]["eligible_users"] >= 1 and run("train-models", "--min-cooccurrence", "1")[0] == 0
    assert run("build-content-model", "--vector-size", "16")[1]["items"] == 8
    assert run("tune-hybrid", "--validation-days", "7", "--k", "3", "--min-cooccurrence", "1")[1]["configurations_tested"] == 55
    scores = run("evaluate-models", "--k", "3")[1]
    assert scores["config"]["k"] == 3 and len({r["model"] for r in scores["scores"]}) == 4
    assert [r["rank"] for r in run("recommend", "--visitor-id", "20", "--k", "2")[1]] == [1, 2]
    assert run("curate", "--api-page-size", "9", "--vector-size", "16", "--min-cooccurrence", "1")[1]["validation"]["ok"]
    assert run("model", "--validation-days", "7", "--k", "3", "--min-cooccurrence", "1", "--vector-size", "16")[1]["split"]["target"] == "transaction"
    assert len(run("show-lineage")[1]) >= 12 and len(run("show-metrics")[1]) == 5
    (tmp_path / "w" / "gold_user_item_features" / "_current").unlink()
    assert run("quality-report", "--json-report", str(tmp_path / "q.json"), "--text-report", str(tmp_path / "q.md"))[0] == 1
    with pytest.raises(SystemExit):
        cli.main([*base, "nothing"])
    with pytest.raises(RuntimeError):
        cli.main(["--warehouse", str(tmp_path / "none"), "build-silver"])


def test_replay_equals_batch(spark, source, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(EVENTS)
    (folder / "b.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n5000,2,view,10,\n")
    replay(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = L.user_items(L.clean_events(files.read_events(spark, str(folder))))
    assert sorted(map(tuple, replayed_user_items(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    assert pause(None, 5, 1) == 0 and pause(0, 500, 1) == 0.5 and pause(0, 10_000, 1) == 1.0 and pause(0, 5, 0) == 0


def test_metric_names():
    assert flatten_metrics({"precision@10": 0.2, "warm": {"users": 3}, "ok": True}) == {"precision_at_10": 0.2, "warm.users": 3.0}
