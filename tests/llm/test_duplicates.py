"""Operators 6 and 9 against brute force, and the components they share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import components, ngram_join, shingles, vector_graph
from tallywick.llm.common import text_buffer


def plain_sets(rows):
    import re

    out = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def links(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def corpus(seed, n=260):
    """Texts of many kinds: families of copies with growing edits, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijkl") + str(rng.randint(0, 30))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = [None, "", " \n\t", "one", "one", "ONE", "a b c d", "A b\nc d", "é\xa0x y z w v"]
    for _ in range(n):
        kind = rng.random()
        w = list(rng.choice(bases)) if kind < 0.7 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        if 0.5 < kind < 0.8:
            w = w + passage
        if rng.random() < 0.1:
            w = [x.upper() for x in w]
        rows.append(rng.choice([" ", "\n", "  "]).join(w))
    return rows


def test_shingles_match_plain():
    import pyarrow as pa

    rows = corpus(1)
    data, offsets = text_buffer(pa.array(rows))
    values, at = shingles.shingle_sets(data, offsets)
    sets = plain_sets(rows)
    assert np.diff(at).tolist() == [len(s) for s in sets]
    names = {}
    for i, s in enumerate(sets):
        assert names.setdefault(tuple(values[at[i] : at[i + 1]]), s) == s


@pytest.mark.parametrize("seed", [2, 3])
def test_join_equals_brute_force(docs, smallest, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 2 + seed)
    monkeypatch.setattr(ngram_join, "MANY", 9 if seed == 2 else 200)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    rows = corpus(seed)
    sets = plain_sets(rows)
    expect = smallest(range(len(rows)), links(sets))
    out = ngram_join.near_duplicates(docs(rows).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(s), expect[i]) for i, s in enumerate(sets)}


def test_join_of_very_long_texts_and_repeated_ids(docs, smallest):
    rng = random.Random(21)
    long_ = [f"w{rng.randint(0, 10**6)}" for _ in range(60_000)]
    near = long_.copy()
    for i in range(0, 60_000, 60):
        near[i] = "other"
    rows = [" ".join(long_), " ".join(near), " ".join(long_[:30_000]), "a b c d e f", "A B C D E F", " ".join(long_)]
    sets = plain_sets(rows)
    expect = smallest(range(len(rows)), links(sets))
    frame = docs(rows)
    frame = frame.unionByName(frame.where("doc_id in (2, 3)")).unionByName(frame.where("doc_id = 1").withColumn("doc_id", F.lit(4).cast("long")))
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame.repartition(3)).collect())
    want = [(i, len(s), expect[i]) for i, s in enumerate(sets)]
    want += [want[2], want[3], (4, len(sets[1]), expect[1])]
    assert out == sorted(want)


def test_members_of_one_group_are_verified(docs, smallest):
    """Sets of equal size whose rarest shingles agree: only links that hold count."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(80)] = f"v{rng.randrange(4)}"
        rows.append(" ".join(w))
    sets = plain_sets(rows)
    expect = smallest(range(len(rows)), links(sets))
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs(rows)).collect()}
    assert out == expect


def test_keep_one(docs):
    a = "one two three four five six seven eight nine ten"
    frame = docs([a, a + " ", "other words stand here in this text", None, "", ""])
    again = frame.unionByName(frame.where("doc_id = 2"))
    out = ngram_join.keep_one(again)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4, 5]
    assert ngram_join.keep_one(frame.limit(0)).count() == 0


def test_null_ids_are_linked_and_one_is_kept(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MANY", 4)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([f"v{k}", *base[1:]])
    rows = [(None, near(k)) for k in range(12)] + [(None, near(3)), (None, "quite other words are in here now"), (None, "ids and none of them share this text"), (7, "ids and none of them share this text"), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.joined(frame.repartition(3)).join(frame.select(F.xxhash64("text").alias("text_hash"), "text").distinct(), "text_hash").collect()
    assert len({r["component"] for r in out if r["text"] and r["text"].startswith("v")}) == 1
    assert {r["component_id"] for r in out if r["text"] and r["text"].startswith("ids")} == {7}
    assert len(ngram_join.near_duplicates(frame).collect()) == len(rows)
    kept = ngram_join.keep_one(frame).collect()
    assert sum((r["text"] or "").startswith("v") for r in kept) == 1
    assert [r["doc_id"] for r in kept if (r["text"] or "").startswith("ids")] == [7]
    assert len(kept) == 5


@pytest.mark.parametrize("few", [0, 500_000])
def test_components(spark, smallest, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert out == smallest(ids, [p for p in pairs if p[0] != p[1]])


def vectors(n=900, dim=16):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dim))
    for i in range(1, n):
        if rng.random() < 0.5:
            j = rng.integers(max(0, i - 200), i)
            x[i] = x[j] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.4])
    return x.astype(np.float32), rng.choice([1, 1, 1, 2, 3], n)


def test_vectors_against_brute_force(spark, smallest, monkeypatch):
    monkeypatch.setattr(vector_graph, "TARGET", 120)
    x, label = vectors()
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0] * 15 + [None], 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 0.0], 1), (n + 6, [2.0, 0.0], 1), (n + 7, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    out = {r["vec_id"]: r for r in vector_graph.near_duplicates(frame).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    true, found = near.sum(1), np.array([out[i]["n_links"] for i in range(n)])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    expect = smallest(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert sum(out[i]["component_id"] != expect[i] for i in range(n)) <= 0.02 * n
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in out)
    assert all(out[n + k]["n_links"] == 0 and out[n + k]["component_id"] == n + k for k in (0, 1, 2, 3, 4, 7))
    assert out[n + 5]["n_links"] == 1 and out[n + 6]["component_id"] == n + 5
    assert vector_graph.near_duplicates(frame.limit(0)).count() == 0


def test_exact_copies_count_as_links(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(40)] + [(50, [1.0, 2.0, 3.01], 1), (51, [-1.0, 2.0, 3.0], 1)]
    out = {r["vec_id"]: r for r in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert out[0]["n_links"] == 40 and out[50]["n_links"] == 40 and out[51]["n_links"] == 0


def test_audit_sees_rare_links_and_low_recall_is_reported(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 16))
    x[2985:] = x[:15] + 0.01
    items = vector_graph.nodes(spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(3000)], "vec_id long, embedding array<double>, label int"))
    none = spark.createDataFrame([], "node long, links long, others long, least long")
    assert vector_graph.audit(items, none, 8) == 0.0
    monkeypatch.setattr(vector_graph, "MOST_AUDIT", 64)
    assert vector_graph.audit(items, none, 8) is None
    monkeypatch.undo()
    monkeypatch.setattr(vector_graph, "MOST_SEEDS", 3)
    real, choices = vector_graph.graph_links, []

    def nothing_but_whole(placed, first):
        choices.append(placed.agg(F.max(F.array_max("bases"))).first()[0])
        return real(placed, first) if choices[-1] == vector_graph.WHOLE else none

    monkeypatch.setattr(vector_graph, "graph_links", nothing_but_whole)
    with pytest.warns(UserWarning, match="all pieces are paired"):
        found = vector_graph.find_links(items).groupBy().sum("links").first()[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert found == links_by_force(unit, np.ones(len(x), int)).sum() >= 30 and len(choices) == 3 and choices[-1] == vector_graph.WHOLE


def links_by_force(x, label):
    true = np.zeros(len(x), int)
    for a in range(0, len(x), 1000):
        true[a : a + 1000] = ((x[a : a + 1000] @ x.T >= 0.93) & (label[a : a + 1000, None] == label)).sum(1) - 1
    return true


def test_a_group_of_20000_near_copies_is_counted_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    x = np.vstack([base + 0.17 * rng.normal(size=(20_000, 32)), rng.normal(size=(2_000, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.ones(len(x), int)
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    seen = []
    real = vector_graph.components
    monkeypatch.setattr(vector_graph, "components", lambda edges: seen.append(edges.count()) or real(edges))
    out = rows.transform(vector_graph.near_duplicates).toPandas().sort_values("vec_id")
    true = links_by_force(x, label)
    found = out["n_links"].to_numpy()
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() and true.max() > 10_000
    assert out["component_id"].nunique() <= 2_000 + (true == 0).sum()
    assert seen[0] < 100 * len(x)  # rows of the class table, not the 10 ** 8 pairs


def test_cut_shards_agree_with_brute_force(spark, monkeypatch):
    for name, value in (("TARGET", 100), ("MOST", 150), ("PIECE", 60)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    for group in range(6):
        x[200 * group : 200 * group + 20 + 30 * group] = rng.normal(size=16) + 0.2 * rng.normal(size=(20 + 30 * group, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v, int(n)) for i, (v, n) in enumerate(zip(x.tolist(), label, strict=True))] + [(5, x[5].tolist(), int(label[5]))]
    out = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").transform(vector_graph.near_duplicates).collect()
    true = links_by_force(x, label)
    true[label == label[5]] += (x[label == label[5]] @ x[5] >= 0.93)  # the repeated row
    assert len(out) == len(rows) and all(r["n_links"] <= true[r["vec_id"]] for r in out)
    assert sum(r["n_links"] for r in out) >= 0.99 * (true.sum() + true[5])


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from tallywick.llm import common

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else min(i, 5)) for i in range(100)], "id long, k long")
    other = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 3")
    want = sorted(map(str, rows.join(other, "k", "left").select("id", "k", "n", "top").collect()))
    for hot in (1, 10, 10_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(str, common.join_hot(rows, other, "k", "n").select("id", "k", "n", "top").collect())) == want
