"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label are one node with a multiplicity. Nodes go to overlapping shards (their
nearest centroids, for several choices of centroids that lie apart, so that few dense groups are cut). A shard of
more than MOST nodes, as a dense group makes one, is cut into pieces. Each shard or piece builds a graph whose lists are pruned robustly; a node's
lists of all its shards are united. Then each shard, or pair of pieces, runs for its nodes a greedy search from its medoids over the united
lists, which goes on from every node found within the range; what it finds is verified by the cosine in
double precision.

A pair that several shards hold counts in the first of them alone, which a shard sees from the lists of shards
that its nodes carry. So a shard gives one row per node, its number of links and the least node that it is tied to
there, and no pair ever leaves a task: the rows grow with the nodes, however large a group is.

Recall is audited against brute force on a bounded sample of queries that grows until it sees enough
links; more choices of centroids are added while it is too low or not measured. If it stays below LOW, all pieces
of a label are paired instead, which is exhaustive.

Centroids come from a bounded sample (at most MAX_CENTROIDS in all times SAMPLE vectors); every
row is indexed. A task holds one shard: about TARGET nodes while the centroids suffice, MOST at the most.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
without a label, link with nothing (0 links, a component of their own, kept); vectors of different
length are never compared; repeated ids are rows of their own with the id's name; an empty table
gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .components import components

RANGE, SLACK = 0.93, 0.90
TARGET, MAX_CENTROIDS, SAMPLE, APART = 500, 16_384, 4, 0.8
MOST, PIECE = 3000, 1500
OVERLAP, SEEDS, MOST_SEEDS = 2, 2, 6
DEGREE, POOL, ALPHA, BEAM = 20, 48, 1.2, 24
AUDIT, LEAST_RECALL = 256, 0.97
#: True links that an audit should see, nodes of its largest sample, and the recall below which all pieces are paired.
LEAST_LINKS, MOST_AUDIT, LOW = 300, 16_384, 0.9
#: Names of shards: a choice of centroids times STEP plus the centroid; the one of a whole label.
STEP, WHOLE = 1 << 32, -1

_NAMED = "struct<g:bigint,i:int>"
SHARD = f"unit string, part string, base long, piece {_NAMED}, home boolean, k int, partners array<{_NAMED}>, node long, copies long, bases array<long>, vector binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nodes(rows: DataFrame) -> DataFrame:
    """(node, part, vector, copies): the distinct usable vectors of each label and length."""
    good = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    good = good.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    good = good.select("vec_id", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("part"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    named = good.withColumn("node", F.xxhash64("part", "vector"))
    return named.groupBy("node").agg(F.min("part").alias("part"), F.min_by("vector", "vec_id").alias("vector"), F.count("*").alias("copies"))


def apart(x: np.ndarray, wanted: int) -> np.ndarray:
    """The first `wanted` rows that lie apart from all taken before, looked at in blocks."""
    kept = np.zeros((0, x.shape[1]))
    for a in range(0, len(x), 512):
        block = x[a : a + 512]
        block = block[(block @ kept.T).max(1, initial=-2) < APART]
        near = block @ block.T >= APART
        taken = np.zeros(len(block), bool)
        for i in range(len(block)):
            taken[i] = not (near[i, :i] & taken[:i]).any()
        kept = np.vstack([kept, block[taken]])[:wanted]
    return kept


def centroids(items: DataFrame, seeds: range) -> dict[tuple[str, int], np.ndarray]:
    """By (part, seed): sampled vectors that lie apart; parts of one shard have none."""
    sizes = {r["part"]: r["count"] for r in items.groupBy("part").count().where(F.col("count") > 1.5 * TARGET).collect()}
    total = sum(n / TARGET for n in sizes.values())
    wanted = {p: max(2, int(np.ceil(n / TARGET * min(1.0, MAX_CENTROIDS / max(total, 1))))) for p, n in sizes.items()}
    if not wanted:
        return {}
    out = {}
    for seed in seeds:
        share = F.create_map(*[F.lit(x) for p, k in wanted.items() for x in (p, min(1.0, SAMPLE * k / sizes[p]))])
        place = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30))
        picked = items.where(place < share[F.col("part")] * (1 << 30)).select("part", "vector", place.alias("h")).toPandas().sort_values(["part", "h"])
        for part, own in picked.groupby("part"):
            kept = apart(unit(np.stack(own["vector"].to_numpy())), wanted[part])
            if len(kept) > 1:
                out[part, seed] = kept
    return out


def assign(items: DataFrame, found: dict[tuple[str, int], np.ndarray], seeds: range) -> DataFrame:
    """(node, part, copies, bases, vector): the shards of each node by all choices of centroids, in order; a part without any is a shard."""
    sent = items.sparkSession.sparkContext.broadcast(found)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, own in frame.groupby("part"):
                x = unit(np.stack(own["vector"].to_numpy()))
                bases = []
                for seed in seeds:
                    c = sent.value.get((part, seed))
                    if c is not None:
                        k = min(OVERLAP, len(c))
                        near = np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
                        bases.append(np.sort(near, axis=1) + seed * STEP)
                bases = np.concatenate(bases, axis=1) if bases else np.full((len(x), 1), WHOLE, np.int64)
                yield pd.DataFrame({"node": own["node"].to_numpy(), "part": part, "copies": own["copies"].to_numpy(), "bases": list(bases.astype(np.int64)), "vector": [v.tobytes() for v in x]})

    return items.select("node", "part", "copies", "vector").mapInPandas(place, "node long, part string, copies long, bases array<long>, vector binary")


def shards(placed: DataFrame, first: int) -> DataFrame:
    """The rows of SHARD: each node once in each of its shards from the choice `first` on, with its piece and the pieces to pair it with.

    A shard of more than MOST nodes is cut into pieces; nodes that share an earlier shard of that size are cut apart from the others
    and not paired again. `home` says whether a piece has its pairs here.
    """
    rows = placed.withColumn("base", F.explode("bases"))
    totals = rows.groupBy("part", "base").count().where(F.col("count") > MOST)
    large = totals.groupBy("part").agg(F.collect_set("base").alias("large"))  # fewer than there are centroids
    cut = placed.join(F.broadcast(large), "part", "left").withColumn("g", F.get(F.array_intersect("bases", "large"), F.lit(0)))
    cut = cut.withColumn("base", F.explode(F.filter("bases", lambda b: (b >= first * STEP) | (b == WHOLE))))
    sizes = cut.where(F.array_contains("large", F.col("base"))).groupBy("part", "base", "g").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("k"))
    pieces = materialize(sizes.groupBy("part", "base").agg(F.sort_array(F.collect_list(F.struct("g", "k"))).alias("groups")), "pieces")
    cut = cut.join(F.broadcast(pieces), ["part", "base"], "left")
    own = F.coalesce(F.get(F.filter("groups", lambda e: e["g"] == F.col("g")), F.lit(0))["k"], F.lit(1))
    cut = cut.withColumn("k", own).withColumn("i", F.pmod(F.xxhash64("node", "base"), F.col("k")).cast("int"))
    single = F.col("groups").isNull()
    piece = F.struct(F.when(single, F.col("base")).otherwise(F.col("g")).alias("g"), F.when(single, F.lit(0)).otherwise(F.col("i")).alias("i"))
    met = lambda e: (e["g"] == F.col("g")) & (F.col("g") != F.col("base"))
    listed = F.flatten(F.transform(F.filter("groups", lambda e: ~met(e)), lambda e: F.transform(F.sequence(F.lit(0), e["k"] - 1), lambda j: F.struct(e["g"].alias("g"), j.alias("i")))))
    cut = cut.withColumn("piece", piece)
    cut = cut.withColumn("partners", F.when(single, F.array("piece")).otherwise(F.array_remove(listed, F.col("piece"))).cast(f"array<{_NAMED}>"))
    unit_ = F.concat_ws(":", "part", "base", "piece.g", "piece.i")
    return cut.where(F.size("partners") > 0).select(unit_.alias("unit"), "part", "base", "piece", (single | (F.col("g") == F.col("base"))).alias("home"), "k", "partners", "node", "copies", "bases", "vector")


def meetings(lists: DataFrame) -> DataFrame:
    """The rows once for each pair of pieces (or their whole shard), as `shard`; `owns`: pairs within the row's piece count in this one."""
    rows = lists.withColumn("other", F.explode("partners"))
    following = F.struct(F.col("piece.g").alias("g"), ((F.col("piece.i") + 1) % F.col("k")).alias("i"))
    one = F.when(F.col("k") > 1, F.col("other") == following).otherwise(F.col("other") == F.array_min("partners"))
    low, high = F.least("piece", "other"), F.greatest("piece", "other")
    name = F.concat_ws(":", "part", "base", low["g"], low["i"], high["g"], high["i"])
    return rows.withColumn("shard", name).withColumn("owns", F.col("home") & one).drop("unit", "part", "home", "k", "partners", "other")


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in frame["vector"]])


def robust_prune(x: np.ndarray, i: int, pool: np.ndarray, sims: np.ndarray) -> list[int]:
    """Neighbours of i: the nearest of the pool again and again, without those that a chosen one covers by a factor of ALPHA."""
    order = np.argsort(-sims, kind="stable")
    pool, away = pool[order], 1 - sims[order]
    inner = 1 - x[pool] @ x[pool].T
    alive, out = np.ones(len(pool), bool), []
    for k in range(len(pool)):
        if alive[k]:
            out.append(int(pool[k]))
            if len(out) == DEGREE:
                break
            alive &= ALPHA * inner[k] > away
    return out


def build(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of one shard or piece with `near`: pruned lists with their reverse edges, pruned again where too long."""
    frame = frame.sort_values("node")
    x, names = _matrix(frame), frame["node"].to_numpy()
    n = len(x)
    lists: list[list[int]] = []
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        k = min(POOL, n - 1)
        pools = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(sims), 0), int)
        for r in range(len(sims)):
            # a few fixed far nodes keep separate groups in reach of each other
            far = (a + r + np.array([1, n // 3, n // 2, 2 * n // 3])) % n
            pool = np.unique(np.append(pools[r], far[far != a + r]))
            lists.append(robust_prune(x, a + r, pool, sims[r, pool]))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(lists):
        for j in own:
            back[j].append(i)
    for i in range(n):
        pool = np.unique(np.array(lists[i] + back[i], dtype=int))
        lists[i] = pool.tolist() if len(pool) <= DEGREE else robust_prune(x, i, pool, x[pool] @ x[i])
    return frame.assign(near=[names[own] for own in lists])


def within(x: np.ndarray, adjacent: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """For all pairs whether the search finds them in RANGE: greedy from the pieces' medoids for all nodes at once, then expanding within SLACK from all that is found and the node itself."""
    n, width = adjacent.shape
    own = [np.flatnonzero(pieces == p) for p in np.unique(pieces)]
    medoids = np.array([o[(x[o] @ x[o].mean(0)).argmax()] for o in own])
    hit = np.zeros((n, n), bool)
    # the range is searched along edges of both directions: many lists name a hub, whose own list is short
    edges = np.zeros((n, n), np.float32)
    line, column = np.nonzero(adjacent >= 0)
    edges[line, adjacent[line, column]] = 1
    edges = np.maximum(edges, edges.T)
    for cut in range(0, n, 512):
        q = np.arange(cut, min(cut + 512, n))
        m, rows = len(q), np.arange(len(q))
        seen = np.zeros((m, n), bool)
        sims = np.full((m, n), -2.0, np.float64)
        seen[:, medoids] = True
        sims[:, medoids] = x[q] @ x[medoids].T
        beam = np.full((m, BEAM), -1)
        value = np.full((m, BEAM), -2.0)
        done = np.ones((m, BEAM), bool)
        starts = slice(0, len(medoids))
        beam[:, starts], value[:, starts], done[:, starts] = medoids, sims[:, medoids], False
        while True:
            open_value = np.where(done, -3.0, value)
            best = open_value.argmax(1)
            active = np.flatnonzero(open_value[rows, best] > -2)
            if not len(active):
                break
            at = beam[active, best[active]]
            done[active, best[active]] = True
            near = adjacent[at]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            who, what = active[r], near[r, c]
            s = np.einsum("ij,ij->i", x[q[who]], x[what])
            seen[who, what] = True
            sims[who, what] = s
            wide = np.full((len(active), width), -2.0)
            wide[r, c] = s
            all_value = np.concatenate([value[active], wide], 1)
            all_beam = np.concatenate([beam[active], near], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            top = np.argpartition(-all_value, BEAM - 1, axis=1)[:, :BEAM]
            line = np.arange(len(active))[:, None]
            value[active], beam[active], done[active] = all_value[line, top], all_beam[line, top], all_done[line, top] | (all_value[line, top] <= -2)
        # a query is a node of the graph, so the range is entered by its own edges too
        seen[rows, q], sims[rows, q] = True, 1.0
        open_ = sims >= SLACK
        while open_.any():
            from_ = np.flatnonzero(open_.any(1))
            reached = np.zeros((m, n), bool)
            reached[from_] = open_[from_].astype(np.float32) @ edges > 0
            fresh = reached & ~seen
            r, c = np.flatnonzero(fresh.any(1)), np.flatnonzero(fresh.any(0))
            if len(r) * len(c) <= 8 * fresh.sum():  # they fill most of a block, which is multiplied at once
                block = np.ix_(r, c)
                sims[block] = np.where(fresh[block], x[q[r]] @ x[c].T, sims[block])
            else:
                who, what = np.nonzero(fresh)
                sims[who, what] = np.einsum("ij,ij->i", x[q[who]], x[what])
            seen |= fresh
            open_ = fresh & (sims >= SLACK)
        hit[q] = sims >= RANGE
    hit |= hit.T
    np.fill_diagonal(hit, False)
    return hit


def least_reached(hit: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(len(hit))
    some = np.flatnonzero(hit.any(1))
    while True:
        new = label.copy()
        for a in range(0, len(some), 512):
            i = some[a : a + 512]
            new[i] = np.minimum(label[i], np.where(hit[i], label, len(hit)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def earlier_shared(bases: list[np.ndarray], base: int) -> np.ndarray:
    """For all pairs whether they meet in a shard before this one."""
    rows = np.repeat(np.arange(len(bases)), [len(b) for b in bases])
    flat = np.concatenate(bases)
    rows, flat = rows[flat < base], flat[flat < base]
    known, column = np.unique(flat, return_inverse=True)
    member = np.zeros((len(bases), len(known)), np.float32)
    member[rows, column] = 1
    return member @ member.T > 0


def search(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, links, others, least) of one shard: how many nodes and vectors a node links with that no shard before this one sees, and the least node it is tied to."""
    frame = frame.sort_values("node")
    x, names = _matrix(frame), frame["node"].to_numpy()
    place = {v: i for i, v in enumerate(names)}
    inside = [[place[v] for v in near if v in place] for near in frame["near"]]
    adjacent = np.full((len(x), max(1, max(map(len, inside)))), -1)
    for i, own in enumerate(inside):
        adjacent[i, : len(own)] = own
    pieces = frame["piece"].map(lambda p: (p["g"], p["i"])).factorize()[0]
    hit = within(x, adjacent, pieces)
    least = names[least_reached(hit)]
    tied = hit.any(1)
    base, owns = frame["base"].iloc[0], frame["owns"].to_numpy()
    if tied.any() and base != WHOLE:
        hit &= ~earlier_shared(frame["bases"].tolist(), base)
    hit &= (pieces[:, None] != pieces) | owns[:, None]
    copies = frame["copies"].to_numpy().astype(np.float64)
    others = np.concatenate([hit[a : a + 512].astype(np.float64) @ copies for a in range(0, len(hit), 512)]).astype(np.int64)
    return pd.DataFrame({"node": names, "links": hit.sum(1), "others": others, "least": least})[tied]


def graph_links(placed: DataFrame, first: int) -> DataFrame:
    """(node, links, others, least) of the shards from the choice `first` on; `placed` holds all choices so far."""
    lists = materialize(shards(placed, first).groupBy("unit").applyInPandas(build, SHARD + ", near array<long>"), "lists")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("united"))
    rows = meetings(lists.join(united, "node").withColumn("near", F.col("united")).drop("united"))
    return materialize(rows.groupBy("shard").applyInPandas(search, "node long, links long, others long, least long"), "found")


def audit(items: DataFrame, found: DataFrame, sample: int = AUDIT) -> float | None:
    """Recall against brute force: the sample grows until LEAST_LINKS true links are seen, it has MOST_AUDIT nodes or all; None where too few are seen."""
    n = items.count()
    while True:
        true, recall = audited(items, found, sample, n)
        if true >= LEAST_LINKS or sample >= n:
            return recall if true else 1.0
        if sample >= MOST_AUDIT:
            return None
        sample *= 8


def audited(items: DataFrame, found: DataFrame, sample: int, n: int) -> tuple[int, float]:
    """(nodes with true links among about `sample` of n nodes, the lesser of the share of links found and its mean by node).

    The nodes are taken by hash; their links are counted by brute force over all rows, the queries being bounded and broadcast.
    """
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    queries = items.where(F.pmod(F.xxhash64(F.lit(77), "node"), F.lit(1 << 30)) < share).select("node", "part", "vector").toPandas()
    if queries.empty:
        return 0, 1.0
    sets = {p: (own["node"].to_numpy(), unit(np.stack(own["vector"].to_numpy()))) for p, own in queries.groupby("part")}
    sent = items.sparkSession.sparkContext.broadcast(sets)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, own in frame.groupby("part"):
                if part in sent.value:
                    names, x = sent.value[part]
                    near = (unit(np.stack(own["vector"].to_numpy())) @ x.T >= RANGE) & (own["node"].to_numpy()[:, None] != names)
                    yield pd.DataFrame({"node": names, "true": near.sum(0)})[near.any(0)]

    true = items.select("node", "part", "vector").mapInPandas(scan, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    both = true.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select("true", F.coalesce("links", F.lit(0)).alias("links"))
    row = both.agg(F.count("*").alias("n"), F.sum("links") / F.sum("true"), F.avg(F.col("links") / F.col("true"))).first()
    return row["n"], min(row[1], row[2]) if row["n"] else 1.0


def find_links(items: DataFrame) -> DataFrame:
    """(node, links, others, least): rows to be added up by node; the pairs found have a recall of LOW or more where it could be measured."""
    found, at, known = None, 0, {}
    while at < MOST_SEEDS:
        step = range(at, at + (SEEDS if at == 0 else 1))
        known |= centroids(items, step)
        placed = materialize(assign(items, known, range(step[-1] + 1)), "placed")
        more = graph_links(placed, at)
        found = more if found is None else found.unionByName(more)
        at = step[-1] + 1
        recall = audit(items, found)
        if not known or recall is not None and recall >= LEAST_RECALL:
            return found
    if recall is None:
        warnings.warn(f"recall is not measured: {MOST_AUDIT} nodes have under {LEAST_LINKS} links; all {MOST_SEEDS} choices of centroids were used", stacklevel=2)
    elif recall < LOW:
        warnings.warn(f"recall {recall:.3f} after {MOST_SEEDS} choices of centroids; all pieces are paired", stacklevel=2)
        return graph_links(materialize(assign(items, {}, range(0)), "placed"), 0)
    return found


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    items = materialize(nodes(rows), "nodes")
    found = find_links(items)
    counts = found.groupBy("node").agg(F.sum("others").alias("others"))
    labels = components(found.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "c")
    info = items.select("node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    info = materialize(info.select("node", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "node").alias("c")), "info")
    part = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    named = materialize(rows.select("vec_id", F.when(usable, F.xxhash64(part, F.transform("embedding", lambda x: x.cast("double")))).alias("node")), "named")
    named = materialize(join_hot(named, info, "node", "copies").select("vec_id", "n_links", "c"), "tied")
    least = materialize(named.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("members")), "least")
    out = join_hot(named, least, "c", "members")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
