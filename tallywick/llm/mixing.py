"""Mixing sources to target weights by hash-threshold histograms.

Rows get a 63-bit hash. Sizes are summed by (source, top bits); a running sum over a source's
buckets finds the bucket where its budget ends, and only rows of that bucket are summed again by
the next bits, until it holds one hash. The thresholds filter by comparing hashes: no row is
sorted, and a larger budget always takes a superset (nested thresholds).

Defined results: a null text has size 0; a very long text is counted whole; null is a source of its own, last in order; rows with
equal id and text share a hash and are taken together; a source without words has target and taken
0; an empty table gives an empty table. Reruns agree: the hash depends on id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layers import global_rank
from .common import forget, join_small, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, STEP = 63, 12
SEED = 20_240_611


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, text).bitwiseAND(F.lit(2**63 - 1))


def sized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h): the small table that all passes after the first read."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), row_hash(F.col(id_col), F.col("text")).alias("h")), "sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) with targets capped at `most` times the size and the excess reshared.

    The cap condition is `level * weight > most * size`, and the level only rises, so each round is one
    aggregate over the source table and as many rounds run as there are distinct steps of capping.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    totals = materialize(totals.withColumn("weight", weight).drop("place"), "sources")
    all_sizes = totals.agg(F.sum("source_size")).first()[0] or 0
    budget, level, cap = share * all_sizes, 0.0, most * F.col("source_size").cast("double")
    while True:
        over = F.lit(level) * F.col("weight") > cap
        row = totals.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget - (row["capped"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return totals.select("source", "source_size", F.when(F.lit(level) * F.col("weight") > cap, cap).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, step: int = STEP) -> DataFrame:
    """(source, source_size, target, rounds, cut, with_cut): every row `rounds` times, those below the cut hash once more, those at it if that is nearer."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("rounds", whole).withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size"))
    # the state: of each source, the bucket (prefix of hashes) in which its budget ends and what stands before it
    state = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), "left").where(F.col("left") > 0)
    shift = BITS
    while shift > 0:
        above, shift = shift, max(0, shift - step)
        s, r = state.alias("s"), sizes.where("size > 0").alias("r")
        inside = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("r.h", above) == F.col("s.prefix") if above < BITS else F.lit(True))
        sums = (
            r.join(s, inside)
            .groupBy(F.col("s.source").alias("source"), F.shiftright("r.h", shift).alias("prefix"))
            .agg(F.sum("r.size").alias("size"), F.min("r.h").alias("low"), F.max("r.h").alias("high"), F.first("s.before").alias("before"), F.first("s.left").alias("left"))
        )
        run = Window.partitionBy("source").orderBy("prefix")  # at most 2**step rows of a source
        sums = sums.withColumn("upto", F.col("before") + F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))
        ends = sums.where("upto >= left").groupBy("source").agg(F.min_by(F.struct("prefix", "low", "high", "before", "left", "size"), F.col("prefix")).alias("b")).select("source", "b.*")
        new = materialize(ends, "bounds")
        if above < BITS:
            forget(sizes.sparkSession, state)
        state = new
        if not state.where("low < high").limit(1).count():
            break
    near = 2 * (F.col("left") - F.col("before")) >= F.col("size")
    ends = state.select(F.col("source").alias("__s"), F.col("low").alias("cut"), near.alias("with_cut"))
    return plan.join(ends, plan["source"].eqNullSafe(ends["__s"]), "left").select("source", "source_size", "target", "rounds", "cut", "with_cut")


def copies(h: Column) -> Column:
    """How often the mix takes a row, from its hash and its source's thresholds."""
    return F.col("rounds") + F.coalesce((h < F.col("cut")) | ((h == F.col("cut")) & F.col("with_cut")), F.lit(False)).cast("long")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row."""
    rows = sized(docs, id_col)
    plan = materialize(thresholds(rows, source_targets(rows)), "mix").withColumnRenamed("source", "__key")
    return join_small(rows, plan, "source", rows["h"], plan.count()).select("doc_id", "source", "size", "source_size", "target", copies(F.col("h")).alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns; rows without words count nothing and are taken as their source's rounds say."""
    rows = sized(docs)
    plan = materialize(thresholds(rows, source_targets(rows)), "mix").select(F.col("source").alias("__s"), "rounds", "cut", "with_cut")
    plan = plan.select(F.col("__s").alias("__key"), F.struct("rounds", "cut", "with_cut").alias("__plan"))
    taken = join_small(docs, plan, "source", docs["text"], plan.count())
    h = row_hash(docs["doc_id"], docs["text"])
    n = F.col("__plan.rounds") + F.coalesce((h < F.col("__plan.cut")) | ((h == F.col("__plan.cut")) & F.col("__plan.with_cut")), F.lit(False)).cast("long")
    return taken.select(*[docs[c] for c in docs.columns], F.explode(F.when(n > 0, F.array_repeat(F.lit(0), n.cast("int"))).otherwise(F.array())).alias("__copy")).drop("__copy")
