"""Content scores of visitors against the catalog, block by block, with the best items picked inside the task.

Items that share vector, category and parent have one score, so a block holds classes of them. A task gets one block of
classes and one slice of visitors, goes through the classes in rounds and lets out only the `pool` best of each visitor,
so neither a score of every pair nor a hot bucket is ever shuffled. After a round the score that the pool needs is known;
in the next one a product in single precision shows the pairs that may reach it for any triple of weights (its error is
bounded, none is lost), and only those are scored in double precision.
Blocks and slices have bounded sizes: a table ten times as large makes ten times as many of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage

DIGITS = 9
#: Classes, vector entries and items of one block, visitors of one slice, visitors multiplied at once, numbers of one dense matrix, classes of the first round.
ITEMS, ENTRIES, MEMBERS, VISITORS, BATCH, CELLS, FIRST = 262_144, 2_000_000, 1_000_000, 8192, 256, 1_000_000, 512
MOST_PARTITIONS = 4096

_PAIRS = "array<struct<k:bigint,w:double>>"
LISTS = pa.schema([("visitor_id", pa.int64()), ("grid", pa.list_(pa.int32())), ("item", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
TRIALS = pa.schema([("trial", pa.int32()), ("visitor_id", pa.int64()), ("item_id", pa.int64()), ("rank", pa.int32()), ("short", pa.bool_())])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(border of each row's values, all values) of a column of lists; null lists are empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.list_flatten(column).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], flat.type)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, weight) of a column of pairs."""
    borders, flat = _flat(column)
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders)), flat.field("k").to_numpy(), flat.field("w").to_numpy()


def _dense(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """n rows by the sorted known keys; other keys are left out, and a last column of zeros stands for none."""
    out = np.zeros((n, len(known) + 1))
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    good = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    out[rows[good], at[good]] = weights[good]
    return out


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted known values, and each row's place among them (their number where it is null)."""
    known = np.array(sorted(set(pc.unique(column.drop_null()).to_pylist())), np.int64)
    values = pc.fill_null(column, 0).to_numpy()
    return known, np.where(pc.is_null(column).to_numpy(), len(known), np.searchsorted(known, values))


def half_up(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10**DIGITS + 0.5), x) / 10**DIGITS + 0.0


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, place) of all places of runs that begin at `starts`."""
    which = np.repeat(np.arange(len(starts)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which]


def _place(sorted_rows: np.ndarray) -> np.ndarray:
    """The number of each entry within its row."""
    begins = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]][: len(sorted_rows)])
    return np.arange(len(sorted_rows)) - np.repeat(begins, np.diff(np.r_[begins, len(sorted_rows)]))


def least(rows: np.ndarray, scores: np.ndarray, m: int, pool: int) -> np.ndarray:
    """The `pool`th largest score of each of m rows; -inf where it has fewer."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    table = np.full((m, max(pool, np.bincount(rows, minlength=m).max())), -np.inf)
    table[rows[order], _place(rows[order])] = scores[order]
    at = table.shape[1] - pool
    return np.partition(table, at, axis=1)[:, at]


class _Block:
    """Classes of items as arrays: entries and items of class c begin at entry[c] and member[c]."""

    def __init__(self, classes: pa.Table):
        self.n = classes.num_rows
        self.entry, flat = _flat(classes["vector"])
        self.weight = flat.field("w").to_numpy()
        self.buckets, key = np.unique(flat.field("k").to_numpy(), return_inverse=True)
        self.key = key.astype(np.int64)
        self.member, ids = _flat(classes["members"])
        self.ids = ids.to_numpy()
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.owner = np.repeat(np.arange(self.n), np.diff(self.member))
        self.categories, category = _codes(classes["category_id"])
        self.parents, parent = _codes(classes["parent_category_id"])
        combos, self.combo = np.unique(category * (len(self.parents) + 1) + parent, return_inverse=True)
        self.combo_category, self.combo_parent = np.divmod(combos, len(self.parents) + 1)
        squares = np.bincount(np.repeat(np.arange(self.n), np.diff(self.entry)), self.weight * self.weight, self.n)
        self.longest = math.sqrt(squares.max())

    def tile(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, len(self.buckets) + 1), np.float32)
        cut = slice(self.entry[a], self.entry[b])
        out[np.repeat(np.arange(b - a), np.diff(self.entry[a : b + 1])), self.key[cut]] = self.weight[cut]
        return out

    def cosines(self, profile: np.ndarray, row: np.ndarray, c: np.ndarray) -> np.ndarray:
        which, at = _runs(self.entry[c], self.entry[c + 1] - self.entry[c])
        return np.bincount(which, profile[row[which], self.key[at]] * self.weight[at], len(c))

    def seen(self, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted (row, member) keys that are seen; and the sorted (row, class) keys with a seen member, how many they have and their first members that are not."""
        low, high = np.searchsorted(self.sorted_ids, item, "left"), np.searchsorted(self.sorted_ids, item, "right")
        which, at = _runs(low, high - low)
        pairs = np.unique(row[which] * len(self.ids) + self.by_id[at])
        row, member = np.divmod(pairs, max(len(self.ids), 1))
        owner = self.owner[member]
        keys, group, count = np.unique(row * self.n + owner, return_inverse=True, return_counts=True)
        # members are sorted: those seen from the class's first on, without a gap
        lead = member - self.member[owner] == _place(group)
        first = self.member[keys % self.n] + np.bincount(group, lead, len(keys)).astype(np.int64)
        return pairs, keys, count, first


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each key would be, whether it is there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _bound(wanted: np.ndarray, bases: list[np.ndarray], weights: list[tuple[float, float, float]]) -> np.ndarray:
    """(combination of category and parent, visitor): the cosine from which a class may reach the wanted score for some weights."""
    out = np.full(bases[0].shape, np.inf)
    for t, base, (v, _, _) in zip(wanted, bases, weights, strict=True):
        lack = t - 10.0**-DIGITS - base
        out = np.minimum(out, lack / v if v else np.where(lack <= 0, -np.inf, np.inf))
    return out


def score_block(visitors: pa.Table, classes: pa.Table, weights: list[tuple[float, float, float]], pool: int) -> pa.Table:
    """One row per visitor: (grid, item, score) of the `pool` best unseen items for each triple of weights, in order."""
    if not visitors.num_rows or not classes.num_rows:
        return LISTS.empty_table()
    block = _Block(classes)
    return pa.concat_tables([_score(visitors.slice(a, BATCH), block, weights, pool) for a in range(0, visitors.num_rows, BATCH)])


def _score(some: pa.Table, block: _Block, weights: list[tuple[float, float, float]], pool: int) -> pa.Table:
    m, n = some.num_rows, block.n
    profile = _dense(*_lists(some["profile"]), m, block.buckets)
    category = _dense(*_lists(some["categories"]), m, block.categories)
    parent = _dense(*_lists(some["parents"]), m, block.parents)
    bases = [c * category[:, block.combo_category].T + p * parent[:, block.combo_parent].T for _, c, p in weights]
    seen_members, seen_classes, seen_count, seen_first = block.seen(*_lists(some["seen"])[:2])
    single = profile.T.astype(np.float32)
    # an upper limit of what single precision may be off by
    error = (len(block.buckets) + 8) * 2.0**-23 * block.longest * math.sqrt((profile * profile).sum(axis=1).max())
    width = max(1, CELLS // (len(block.buckets) + 1 + m))
    nothing = np.zeros(0, np.int64)
    kept = [(nothing, nothing, np.zeros(0), nothing)] * len(weights)  # visitor, class, score, first unseen item
    wanted = np.full((len(weights), m), -np.inf)
    bound = np.full(bases[0].shape, -np.inf, np.float32)
    a, until, rows, found = 0, min(n, FIRST), [], []
    while a < n:
        b = min(a + width, until)
        i, j = np.divmod(np.flatnonzero(block.tile(a, b) @ single >= bound[block.combo[a:b]]), m)  # much faster than nonzero
        rows.append(j)
        found.append(i + a)
        a = b
        if a < until and sum(map(len, rows)) < CELLS:
            continue
        row, c = np.concatenate(rows), np.concatenate(found)
        rows, found = [], []
        at, hit = _found(seen_classes, row * n + c)
        first = block.member[c]
        first[hit] = seen_first[at[hit]]
        there = first < block.member[c + 1]  # the others have no unseen item
        row, c, first = row[there], c[there], block.ids[first[there]]
        cosine = block.cosines(profile, row, c)
        by_category, by_parent = category[row, block.combo_category[block.combo[c]]], parent[row, block.combo_parent[block.combo[c]]]
        for g, (x, y, z) in enumerate(weights):
            scores = half_up(x * cosine + y * by_category + z * by_parent)
            good = scores >= wanted[g][row]
            every = [np.concatenate(pair) for pair in zip(kept[g], (row[good], c[good], scores[good], first[good]), strict=True)]
            wanted[g] = least(every[0], every[2], m, pool)
            good = np.flatnonzero(every[2] >= wanted[g][every[0]])
            if len(good) > 2 * pool * m or a == n:  # many equal scores, or the end
                order = good[np.lexsort((every[3][good], -every[2][good], every[0][good]))]
                # `pool` classes before it have items that come before all of its own
                good = order[_place(every[0][order]) < pool]
            kept[g] = tuple(values[good] for values in every)
        bound = np.nextafter((_bound(wanted, bases, weights) - error).astype(np.float32), np.float32(-np.inf))
        if a == until:
            until = min(n, 4 * until)
    out = []
    for g, (row, c, scores, _) in enumerate(kept):
        at, hit = _found(seen_classes, row * n + c)
        seen = np.zeros(len(row), np.int64)
        seen[hit] = seen_count[at[hit]]
        size = block.member[c + 1] - block.member[c]
        # nor has a class an item among the best that comes below classes with `pool` unseen items
        before = np.cumsum(size - seen) - (size - seen)
        places = np.arange(len(row))
        tie = np.maximum.accumulate(np.where(np.r_[True, (row[1:] != row[:-1]) | (scores[1:] != scores[:-1])][: len(row)], places, 0))
        good = before[tie] - before[places - _place(row)] < pool
        row, c, scores, seen, size = (values[good] for values in (row, c, scores, seen, size))
        which, at = _runs(block.member[c], np.minimum(size, pool + seen))
        unseen = ~_found(seen_members, row[which] * len(block.ids) + at)[1]
        which, at = which[unseen], at[unseen]
        order = np.lexsort((block.ids[at], -scores[which], row[which]))
        which, at = which[order], at[order]
        best = _place(row[which]) < pool
        out.append((row[which][best], np.full(best.sum(), g, np.int32), block.ids[at[best]], scores[which][best]))
    row, grid, item, scores = (np.concatenate(values) for values in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    borders = np.searchsorted(row[order], np.arange(m + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(borders), pa.array(values[order])) for values in (grid, item, scores)]
    return pa.table([some["visitor_id"].combine_chunks(), *lists], schema=LISTS)


def pairs(rows: DataFrame, by: str, key: str, weight: str, name: str) -> DataFrame:
    """One row per `by` with its (key, weight) pairs in order; keys are few or bounded by a block."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("k"), F.col(weight).cast("double").alias("w")))).alias(name))


def best_lists(profile: DataFrame, categories: DataFrame, parents: DataFrame, history: DataFrame, items: DataFrame, vectors: DataFrame, weights: list[tuple[float, float, float]], pool: int) -> DataFrame:
    """(visitor_id, grid, item, score), a row per visitor and block: arrays of the `pool` best unseen items in the block, for each triple of weights.

    `profile` (visitor_id, bucket, weight) names the visitors; `items` (item_id, category_id, parent_category_id) are
    those to rank; `categories` and `parents` hold (visitor_id, key, affinity).
    """
    catalog = stage(items.join(pairs(vectors, "item_id", "bucket", "weight", "vector"), "item_id", "left"))
    own = pairs(profile, "visitor_id", "bucket", "weight", "profile")
    for rows, name in ((categories, "categories"), (parents, "parents")):
        key = next(c for c in rows.columns if c not in ("visitor_id", "affinity"))
        own = own.join(pairs(rows, "visitor_id", key, "affinity", name), "visitor_id", "left")
    own = stage(own)
    # a very large class becomes several, none of them larger than a block
    parts = max(1, math.ceil(catalog.count() / MEMBERS))
    classes = catalog.groupBy("category_id", "parent_category_id", "vector", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part"))
    classes = stage(classes.agg(F.sort_array(F.collect_list("item_id")).alias("members")).drop("part"))
    n, entries = classes.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
    visitors = own.count()
    blocks = max(1, parts, math.ceil(n / ITEMS), math.ceil((entries or 0) / ENTRIES))
    wanted = 2 * own.sparkSession.sparkContext.defaultParallelism
    slices = max(1, math.ceil(visitors / VISITORS), min(math.ceil(visitors / BATCH), math.ceil(wanted / blocks)))
    tasks = min(blocks * slices, MOST_PARTITIONS)
    part = F.pmod(F.xxhash64("visitor_id"), F.lit(slices)).alias("slice")
    classes = classes.withColumn("block", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(blocks)))
    every = lambda size, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name)
    # what a visitor has seen of one block is no longer than the block
    where = classes.select("block", F.explode("members").alias("item_id")).distinct()
    seen = history.select("visitor_id", "item_id").join(where, "item_id").groupBy("visitor_id", "block").agg(F.collect_set(F.struct(F.col("item_id").alias("k"), F.lit(0.0).alias("w"))).alias("seen"))
    left = own.select("*", every(blocks, "block")).join(seen, ["visitor_id", "block"], "left")
    left = left.select("block", part, "visitor_id", *[F.col(c).cast(_PAIRS) for c in ("profile", "categories", "parents", "seen")])
    right = classes.select("block", every(slices, "slice"), "category_id", "parent_category_id", F.col("vector").cast(_PAIRS), F.col("members").cast("array<bigint>"))
    grouped = [rows.repartition(tasks, "block", "slice").groupBy("block", "slice") for rows in (left, right)]

    def score(visitors: pa.Table, classes: pa.Table) -> pa.Table:
        return score_block(visitors, classes, weights, pool)

    return grouped[0].cogroup(grouped[1]).applyInArrow(score, "visitor_id long, grid array<int>, item array<long>, score array<double>")


def trial_lists(rows: pa.Table, grids: int, mixes: list[tuple[float, float]], constant: float, pool: int, k: int) -> pa.Table:
    """The k best by reciprocal ranks of each visitor (visitor_id, wanted, cf, grid, item, score), for each grid and mix of weights.

    Lists shorter than k come whole (a null item where there is none), of the others only the wanted items.
    """
    columns = {name: _flat(rows[name]) for name in ("wanted", "cf", "grid", "item", "score")}
    columns = {name: (borders, flat.to_numpy(zero_copy_only=False)) for name, (borders, flat) in columns.items()}
    collaborative, content = (np.array(x)[:, None] for x in zip(*mixes, strict=True))
    out = []
    for r, visitor in enumerate(rows["visitor_id"].to_pylist()):
        wanted, cf, grid, item, score = (values[borders[r] : borders[r + 1]] for borders, values in columns.values())
        for g in range(grids):
            mine, scores = item[grid == g], score[grid == g]
            mine = mine[np.lexsort((mine, -scores))[:pool]]
            both, at = np.unique(np.concatenate([cf, mine]), return_inverse=True)
            ranks = np.full((2, len(both)), np.inf)
            ranks[0, at[: len(cf)]] = np.arange(1, len(cf) + 1)
            ranks[1, at[len(cf) :]] = np.arange(1, len(mine) + 1)
            fused = half_up(collaborative / (constant + ranks[0]) + content / (constant + ranks[1]))
            first = np.argsort(-fused, axis=1, kind="stable")[:, :k]  # items are sorted: ties go to the smaller one
            short = first.shape[1] < k
            mix, place = np.nonzero(np.ones(first.shape, bool) if short else np.isin(both, wanted)[first])
            out.append((g * len(mixes) + mix, np.full(len(mix), visitor), both[first[mix, place]], place + 1, np.full(len(mix), short)))
            if not first.shape[1]:
                out.append((g * len(mixes) + np.arange(len(mixes)), np.full(len(mixes), visitor), np.full(len(mixes), -1), np.zeros(len(mixes), np.int64), np.ones(len(mixes), bool)))
    if not out:
        return TRIALS.empty_table()
    trial, visitor, item, rank, short = (np.concatenate(values) for values in zip(*out, strict=True))
    return pa.table([trial.astype(np.int32), visitor.astype(np.int64), pa.array(item.astype(np.int64), mask=rank == 0), rank.astype(np.int32), short], schema=TRIALS)
