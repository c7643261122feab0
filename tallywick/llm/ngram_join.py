"""N-gram Jaccard join: a grouped prefix join over word shingles.

Shingles get one global order, rare ones first. Two sets of similarity t or more share a shingle
among the first n - ceil(t n) + 1 of each. Documents of equal sets are one node; nodes of equal
prefix and size are one group, and only groups are posted under their prefix shingles. Lists that
several groups share are expanded to members. In each list members are compared with a few leaders
first (hot lists are salted, each part with leaders of its own), which ties the bulk of large
groups of near copies with a number of comparisons linear in their size. What is still in different
components is settled exactly: pairs that meet on short lists are counted, and those whose shared prefix
shingles can suffice are verified one by one; on long lists, the members outside the largest component are
held in blocks, past which the others stream. So every link between components is found, and no group
is written out as all its pairs.

The order need not be exact for the result to be: frequencies come from shingles that repeat
within blocks of a partition, and of those the most frequent MAX_FREQUENT are broadcast.

Defined results: null and empty texts have size 0 and are linked with nothing; texts of fewer words
than a shingle have their whole sequence as one; repeated ids are judged as rows of their own and
named by the smallest id of their component; rows with a null id are linked like any, and a component without any id
has a null name; keep_one keeps a row with an id where its component has one; an empty table gives an empty table; other input
columns are not read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, modest_batches, slices, text_buffer, tidy
from .components import components
from .hashing import mix
from .shingles import WORDS, shingle_sets

#: Similarity as a ratio of whole numbers: 75 of 100.
PART, WHOLE = 75, 100
BLOCK = 1 << 20
CHUNK = 1_000_000  # shingles that are counted together
MIN_FREQUENT, MAX_FREQUENT = 6, 500_000
#: Leaders of a list, nodes of a part of it, and the nodes from which a list has leaders at all.
LEADERS, RUN, LARGE = 24, 100, 6
#: Nodes from which a list is long, nodes of a block of open members, and nodes that one task compares with a block.
MANY, MEMBERS, PARTS = 200, 256, 512
#: Rows of a table of nodes that may be broadcast (about 40 bytes each).
MAX_BROADCAST = 200_000


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of n with any set similar to it: ceil(t n)."""
    return (PART * n + WHOLE - 1) // WHOLE


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if WHOLE * min(len(a), len(b)) < PART * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch.column("text"))
    for i, j in slices(offsets, BLOCK):
        yield i, j, *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.uint64(0), np.cumsum(values))[at])


def set_names(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever the order."""
    return mix(_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at) + np.diff(at).astype(np.uint64)).view(np.int64)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of at most MAX_FREQUENT shingles, found where they repeat within a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for batch in batches:
            for _, _, values, at in _sets(batch):
                # copies within a block count once, as they will be one node
                names = set_names(values, at)
                _, first = np.unique(names, return_index=True)
                keep = np.zeros(len(names), bool)
                keep[first] = True
                held.append(values[np.repeat(keep, np.diff(at))])
                if sum(map(len, held)) > CHUNK:
                    yield flush()
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_FREQUENT)
    found = materialize(found, "frequent")
    # the least count that keeps the list within its bound, read off a histogram of powers of two
    sizes = {r["e"]: r["count"] for r in found.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()}
    total, least = 0, 64
    for e in sorted(sizes, reverse=True):
        total += sizes[e]
        if total > MAX_FREQUENT:
            break
        least = e
    kept = found.where(F.col("n") >= 2**least if least < 63 else F.lit(False)).toArrow()
    h, n = kept.column("h").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(h)
    forget(docs.sparkSession, found)
    return h[order], n[order]


def prefixes(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, node, grp, prefix) per row; a node is a set, a group those of equal prefix and size."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = sent.value
        for batch in batches:
            for i, j, values, at in _sets(batch):
                n = np.diff(at)
                row = np.repeat(np.arange(j - i), n)
                often = np.zeros(len(values), np.int64)
                if len(hashes):
                    k = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                    often = np.where(hashes[k] == values, counts[k], 0)
                ordered = values[np.lexsort((values, often, row))]
                p = np.where(n > 0, n - needed(n) + 1, 0)
                first = np.arange(len(ordered)) - at[row] < p[row]
                prefix = ordered[first]
                cuts = np.append(0, np.cumsum(p))
                place = (np.arange(len(prefix)) - np.repeat(cuts[:-1], p)).astype(np.uint64)
                group = mix(_sums(mix(prefix + place * np.uint64(0x9E3779B97F4A7C15)), cuts) ^ n.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("text_hash").slice(i, j - i), pa.array(n), pa.array(set_names(values, at)), pa.array(group), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(prefix.view(np.int64)))],
                    ["doc_id", "text_hash", "n", "node", "grp", "prefix"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(cut), "doc_id long, text_hash long, n long, node long, grp long, prefix array<long>")


def shared_lists(rows: DataFrame) -> DataFrame:
    """(token, grp, n, pos): the postings of groups under prefix shingles that two groups or more share."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column("grp").to_numpy(), return_index=True)
            first.sort()
            for i in range(0, len(first), 512):
                part = batch.take(pa.array(first[i : i + 512]))
                lists = part.column("prefix")
                p = np.diff(lists.offsets.to_numpy())
                pos = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
                packed = (np.repeat(part.column("n").to_numpy(), p) << 24) | np.minimum(pos, (1 << 24) - 1)
                yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(part.column("grp").to_numpy(), p)), pa.array(packed)], ["token", "grp", "at"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams sorted rows and holds one back, so a run of any length needs no memory."""
        held, told = None, False  # the last row so far, and whether it has been put out
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in ("token", "grp", "at")]
            if held is not None:
                cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
            token, grp, at = cols
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])
            was = held is not None
            token, grp, at = token[new], grp[new], at[new]
            out = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            out[1:] = same
            out[:-1] |= same
            last = bool(out[-1]) if len(out) else False
            if was:
                last = last or (len(out) == 1 and told)
                out[0] &= not told
            held, told = [np.array([c[-1]]) for c in (token, grp, at)], last
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(grp[out]), pa.array(at[out])], ["token", "grp", "at"])

    kind = "token long, grp long, at long"
    posted = rows.where("n > 0").select("grp", "n", "prefix").mapInArrow(tidy(post), kind)
    found = posted.repartition("token").sortWithinPartitions("token", "grp").mapInArrow(tidy(runs), kind)
    return found.select("token", "grp", F.shiftright("at", 24).alias("n"), F.col("at").bitwiseAND((1 << 24) - 1).alias("pos"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of docs whose id is a node's; the table of nodes is broadcast if it is small, else both are shuffled.

    Nodes (doc_id, null_hash, ...) without an id are found by their text's hash.
    """
    nodes = nodes.withColumnsRenamed({"doc_id": "__id", "null_hash": "__hash"})
    if nodes.count() <= MAX_BROADCAST:
        nodes = F.broadcast(nodes)
    own = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("null_hash"))
    return own.join(nodes, own["doc_id"].eqNullSafe(nodes["__id"]) & own["null_hash"].eqNullSafe(nodes["__hash"]))


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of nodes (doc_id, null_hash, node); sets are ascending unsigned 64-bit hashes as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch):
                names = set_names(values, at)
                own = np.flatnonzero(names == batch.column("node").to_numpy()[i:j])
                blobs = [values[at[k] : at[k + 1]].tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(blobs, pa.binary())], ["node", "set"])

    return _texts(docs, nodes).select("text", "node").mapInArrow(tidy(make), "node long, set binary")


def leader_links(docs: DataFrame, lists: DataFrame, names: DataFrame, seed: int) -> DataFrame:
    """Links (a, b) that turn up when each node meets the leaders of one of its lists.

    Small lists are left to what follows. A node goes to the large list of the least hash, so that near copies choose alike; a list is dealt in
    parts of about RUN nodes. The most central nodes (whose prefix is shared the most) come first. One
    that is similar to no leader so far becomes a leader, up to LEADERS.
    """
    large = lists.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= LARGE).select("token")
    lists = lists.join(large, "token", "left_semi")
    chosen = lists.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "token"), "token"))["token"].alias("token"), (F.count("*") / F.min("n")).alias("central"))
    chosen = materialize(chosen, "chosen")
    sizes = chosen.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    parts = chosen.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "node"), F.ceil(F.col("size") / RUN)))
    keyed = materialize(parts.join(names, "node").select("doc_id", "null_hash", "node", F.xxhash64("token", "part").alias("key"), "central"), "keyed")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch):
                found = set_names(values, at)
                own = np.flatnonzero(found == batch.column("node").to_numpy()[i:j])
                blobs = [values[at[k] : at[k + 1]].tobytes() for k in own]
                pick = pa.array(own + i)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pick), batch.column("central").take(pick), pa.array(found[own]), pa.array(blobs, pa.binary())], ["key", "central", "node", "set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            a, b = [], []
            for k, node, blob in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), batch.column("set"), strict=True):
                if k != key:
                    key, leaders = k, []
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                alone = True
                for other, theirs in leaders:
                    if other != node and similar(own, theirs):
                        a.append(node)
                        b.append(other)
                        alone = False
                        break
                if alone and len(leaders) < LEADERS:
                    leaders.append((node, own.copy()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    made = _texts(docs, keyed).select("text", "node", "key", "central").mapInArrow(tidy(make), "key long, central double, node long, set binary")
    return made.repartition("key").sortWithinPartitions("key", F.desc("central"), "node").mapInArrow(tidy(meet), "a long, b long")


def open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(token, node, n, pos, c): the lists whose nodes are in different components under the links so far."""
    named = lists.join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = materialize(named, "named")
    mixed = named.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("token")
    out = materialize(named.join(mixed, "token", "left_semi"), "open")
    forget(lists.sparkSession, named)
    return out


def sized_lists(lists: DataFrame) -> DataFrame:
    """The open lists with their length k."""
    return materialize(lists.join(lists.groupBy("token").agg(F.count("*").alias("k")), "token"), "sized")


def open_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet on short lists only and share enough prefix shingles to be similar.

    What a pair shares beyond its prefixes is at most what the larger of the two rests holds. Pairs that meet on a
    long list too are counted short here, and settled by open_links().
    """
    short = lists.where(F.col("k") < MANY)
    x = short.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), "weight")
    y = short.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    fits = F.expr(f"a < b and ca <> cb and {WHOLE} * least(na, nb) >= {PART} * greatest(na, nb)")
    pairs = x.join(y, [x["token"] == y["token"], fits]).groupBy("a", "b").agg(F.sum("weight").alias("shared"), *[F.min(c).alias(c) for c in ("na", "nb")])
    need = f"({PART} * (na + nb) + {PART + WHOLE - 1}) div {PART + WHOLE}"
    rest = lambda n: f"(({PART} * {n} + {WHOLE - 1}) div {WHOLE} - 1)"
    return pairs.where(F.expr(f"shared + greatest({rest('na')}, {rest('nb')}) >= {need}")).select("a", "b")


def open_links(docs: DataFrame, lists: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components that meet on a long list.

    Of each long list, members outside its largest component are dealt to blocks of about MEMBERS, by the list of
    the least hash, so that like members share a block. A node is sent once to each block that it meets on any list, and compared with the whole block by one lookup of its set; no
    pairs are written, only links, and of those one for each member and component. Nodes sent to a block are dealt in
    parts of about PARTS, each with a copy of the block.
    """
    spark = docs.sparkSession
    large = materialize(lists.where(F.col("k") >= MANY).select("token", "node", "c"), "large")
    sizes = large.groupBy("token", "c").agg(F.count("*").alias("k"))
    major = sizes.groupBy("token").agg(F.max(F.struct("k", "c"))["c"].alias("major"))
    minor = materialize(large.join(major, "token").where("c <> major").select("token", "node", "c"), "minor")
    members = materialize(minor.select("node", "c").distinct(), "members")
    if not members.limit(1).count():
        return spark.createDataFrame([], "a long, b long")
    home = minor.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(4), "token"), "token"))["token"].alias("home"))
    home = materialize(home, "home")
    crowd = materialize(home.groupBy("home").agg(F.ceil(F.count("*") / MEMBERS).alias("cuts")), "crowd")
    block = F.xxhash64("home", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("cuts"))).alias("block")
    home = materialize(home.join(crowd, "home").select("node", block), "home")
    members = materialize(members.join(home, "node"), "members")
    asked = materialize(minor.join(home, "node").select("token", "block").distinct(), "asked")
    sent = materialize(large.join(asked, "token").select("block", "node", "c").distinct(), "sent")
    parts = materialize(sent.groupBy("block").agg(F.ceil(F.count("*") / PARTS).alias("parts")), "parts")
    others = sent.join(parts, "block").select("node", "c", F.lit(1).alias("role"), F.array(F.xxhash64("block", F.pmod(F.xxhash64(F.lit(6), "node"), F.col("parts")))).alias("keys"))
    held = members.join(parts, "block").select("node", "c", F.lit(0).alias("role"), F.expr("transform(sequence(0, parts - 1), p -> xxhash64(block, p))").alias("keys"))
    # a node's text is read once, with all the places its set goes to
    each = others.unionByName(held).select("node", "c", F.explode("keys").alias("key"), "role").groupBy("node").agg(F.min("c").alias("c"), F.collect_set(F.struct("key", "role")).alias("places"))
    keyed = materialize(each.join(names, "node").select("doc_id", "null_hash", "node", "c", "places"), "keyed")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch):
                found = set_names(values, at)
                own = np.flatnonzero(found == batch.column("node").to_numpy()[i:j])
                blobs = [values[at[k] : at[k + 1]].tobytes() for k in own]
                pick = pa.array(own + i)
                yield pa.RecordBatch.from_arrays([batch.column("places").take(pick), batch.column("c").take(pick), pa.array(found[own]), pa.array(blobs, pa.binary())], ["places", "c", "node", "set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ready, held, told = None, False, [], set()
        for batch in batches:
            a, b = [], []
            for k, role, node, c, blob in zip(*[batch.column(x).to_pylist() for x in ("key", "role", "node", "c")], batch.column("set"), strict=True):
                if k != key:
                    key, ready, held, told = k, False, [], set()
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if role == 0:
                    held.append((node, c, own.copy()))
                    continue
                if not ready:
                    sizes = np.array([len(x[2]) for x in held])
                    flat, owner = np.concatenate([x[2] for x in held]), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(flat, kind="stable")
                    flat, owner, ready = flat[order], owner[order], True
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = high - low
                hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[hits], minlength=len(held))
                for m in np.flatnonzero(WHOLE * both >= PART * (len(own) + sizes - both)):
                    if held[m][1] != c and (m, c) not in told:
                        told.add((m, c))
                        a.append(node)
                        b.append(held[m][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    place = "array<struct<key:bigint,role:int>>"
    made = _texts(docs, keyed).select("text", "node", "c", F.col("places").cast(place).alias("places")).mapInArrow(tidy(make), f"places {place}, c long, node long, set binary")
    dealt = made.select(F.explode("places").alias("p"), "node", "c", "set").select("p.key", "p.role", "node", "c", "set")
    return dealt.repartition("key").sortWithinPartitions("key", "role", "node").mapInArrow(tidy(meet), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs that are similar, by their whole sets."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(names, "node").select("doc_id", "null_hash", "node"), "nodes")
    sets = materialize(node_sets(docs, nodes), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = materialize(joined.select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long"), "links")
    forget(docs.sparkSession, sets)
    return out


def joined(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) per row; component is null where the set is empty, component_id also where no member has an id."""
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(prefixes(docs, *frequent_shingles(docs)), "prefixes")
    names = materialize(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.when(F.min("doc_id").isNull(), F.min("text_hash")).alias("null_hash"), F.min("grp").alias("grp"), F.min("n").alias("n")), "names")
    shared = materialize(shared_lists(rows), "shared")
    several = names.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    lists = shared.join(names.select("node", "grp"), "grp").select("token", "node", "n", "pos", F.lit(1).cast("long").alias("weight"))
    # members of one group share all of its prefix, which may be on no list of several groups
    whole = F.expr(f"n - ({PART} * n + {WHOLE - 1}) div {WHOLE} + 1").alias("weight")
    lists = lists.unionByName(names.join(several, "grp", "left_semi").select(F.xxhash64("grp").alias("token"), "node", "n", F.lit(0).cast("long").alias("pos"), whole))
    lists = materialize(lists, "lists")
    forget(spark, shared)
    keys = names.select("node", "doc_id", "null_hash")
    links = materialize(leader_links(docs, lists, keys, 1), "links")
    left = open_lists(lists, links)
    links = materialize(links.unionByName(leader_links(docs, left, keys, 2)), "links")
    left = open_lists(left.drop("c"), links)
    left = sized_lists(left)
    links = links.unionByName(open_links(docs, left, keys))
    links = materialize(links.unionByName(verified(docs, materialize(open_pairs(left), "pairs"), keys)), "links")
    labels = components(links)
    # a component is named by its smallest id; a node without links is one of its own
    named = materialize(names.select("node", "doc_id").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "doc_id"), "components")
    least = materialize(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    named = materialize(named.join(least, "c").select("node", F.col("c").alias("component"), "component_id"), "named")
    return rows.join(named, "node", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    return joined(docs, id_col).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id (then text hash); rows without words all stay. Columns are those of `docs`.

    Rows are dropped by an anti-join with those to go, which is broadcast if small; only ids that are
    repeated with equal text pass through a de-duplication.
    """
    spark = docs.sparkSession
    rows = materialize(joined(docs).where(F.col("component").isNotNull()).select("doc_id", "text_hash", "component"), "joined")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__text"))
    first = materialize(first, "first")
    gone = rows.join(first, rows["doc_id"].eqNullSafe(first["__id"]) & (rows["text_hash"] == first["__text"]), "left_anti").select("doc_id", "text_hash").distinct()
    twice = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    keyed = docs.withColumn("__hash", F.xxhash64("text"))

    def pick(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"))
        keys = F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys
        return frame.join(keys, frame["doc_id"].eqNullSafe(keys["__id"]) & (frame["__hash"] == keys["__text"]), how)

    gone, twice = materialize(gone, "gone"), materialize(twice, "twice")
    kept = pick(keyed, gone, "left_anti")
    if twice.limit(1).count():
        kept = pick(kept, twice, "left_anti").unionByName(pick(kept, twice, "left_semi").dropDuplicates(["doc_id", "__hash"]))
    forget(spark, rows)
    return kept.drop("__hash")
