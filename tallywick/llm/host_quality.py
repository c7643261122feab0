"""Host-level quality rules: failures per domain, shrunk by an empirical beta prior, joined back to documents.

Five rules (RULES) look at the five counts. For each rule the failure rates of all hosts give a beta
prior, and a host's rate is the mean of its posterior, so a host of few documents stays near the rate of all.
The verdict on a host: it is rejected where a rule's rate is above MAX_HOST_RATE; otherwise it is held to each rule
whose rate is above TRUSTED_RATE, and trusted with the others. Joined back, a document is kept that passes the base rules
and all that its host is held to, of a host that is not rejected.

Defined results: a null or empty text has no words (every count 0) and fails the base rule;
documents with a null source are held to the rules by the mean rate of all hosts; repeated
rows are judged (and counted for their host) one by one; a very long text is read whole; an empty table gives an empty table;
further columns of the input are carried by `with_quality`/`keep_documents` unchanged, whatever
their names (working columns have reserved names).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, materialize

# Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Shrunk failure rates: above the first a host is rejected, up to the second it is trusted.
MAX_HOST_RATE, TRUSTED_RATE = 0.6, 0.02

WORK = "__quality"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: When a document fails a rule, by the counts alone (also read by the SQL twin): the base rules, then a symbol to every
#: ten words, a repeated line to every twenty, and words of under 3 or over 10 characters on average.
RULES = (
    f"n_words < {MIN_WORDS}",
    f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "n_words > 0 AND 10 * n_symbols > n_words",
    "20 * n_dup_lines > n_words",
    "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
)
BASE = 2  # so many of them are the base rule


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k == n:
        return 0
    _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    hit = count[window] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in FEATURES]))
def _features(text: pa.Array) -> pa.Array:
    found = np.array([text_features(x.as_py()) for x in text], np.int64).reshape(len(text), len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(c) for c in found.T], list(FEATURES))


def with_quality(docs: DataFrame) -> DataFrame:
    """The input with a struct column `__quality` of the five counts and an array `__fails` of which rules fail."""
    counted = docs.withColumn(WORK, _features(F.col("text")))
    fails = [F.expr(re.sub(r"\bn_\w+|word_chars", rf"{WORK}.\g<0>", rule)) for rule in RULES]
    return counted.withColumn("__fails", F.array(*fails))


def host_verdicts(judged: DataFrame) -> tuple[DataFrame, int]:
    """(__key, __verdict) per host and their number; a verdict has the shrunk rates, and which rules bind; `judged` has source and __fails.

    The counts are pre-aggregated per task, so a hot host is a few rows in the shuffle. The prior's parameters come from power
    sums over the host table by the moment estimator of the beta-binomial; only five numbers of each rule reach the driver.
    """
    k = range(len(RULES))
    hosts = judged.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.get("__fails", F.lit(i))).alias(f"f{i}") for i in k])
    hosts = materialize(hosts, "hosts")
    n = F.col("n").cast("double")
    sums = [x for i in k for x in (F.sum(F.col(f"f{i}").cast("double")).alias(f"f{i}"), F.sum(F.col(f"f{i}") * F.col(f"f{i}") / n).alias(f"ff{i}"))]
    m = hosts.where(F.col("source").isNotNull()).agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("h"), *sums).first()
    rates = []
    for i in k:
        a, b = beta_prior(m["n"] or 0.0, m[f"f{i}"] or 0.0, m[f"ff{i}"] or 0.0, m["nn"] or 0.0, m["h"])
        rates.append(F.when(F.col("source").isNull(), F.lit(a / (a + b))).otherwise((F.col(f"f{i}") + F.lit(a)) / (n + F.lit(a + b))))
    verdict = F.struct(F.array(*rates).alias("rates"), F.transform(F.array(*rates), lambda r: r > TRUSTED_RATE).alias("binds"))
    return hosts.select(F.col("source").alias("__key"), verdict.alias("__verdict")), m["h"]


def beta_prior(n: float, f: float, ff: float, nn: float, hosts: int) -> tuple[float, float]:
    """Parameters of the beta prior: mean f/n, strength from the spread between hosts beyond chance."""
    if not n:
        return 0.5, 0.5
    mean = min(max(f / n, 1e-4), 1 - 1e-4)
    spread = ff - n * (f / n) ** 2
    free = n - nn / n - (hosts - 1)
    rho = (spread - mean * (1 - mean) * (hosts - 1)) / (mean * (1 - mean) * free) if hosts > 1 and free > 0 else 0.5
    rho = min(max(rho, 1e-3), 0.999)
    return mean * (1 - rho) / rho, (1 - mean) * (1 - rho) / rho


def base_failed() -> Column:
    return F.exists(F.slice("__fails", 1, BASE), lambda x: x)


def kept() -> Column:
    """Whether a row with its host's verdict stays."""
    rejected = (F.array_max("__verdict.rates") > MAX_HOST_RATE) & F.col("source").isNotNull()
    bound = F.exists(F.zip_with("__fails", "__verdict.binds", lambda f, b: f & b), lambda x: x)
    return ~base_failed() & ~rejected & ~bound


def judge_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, the five counts, base_failed, host_rate, kept) per row; host_rate is the highest of its rates. The counts are made once and kept in the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", "text")
    scored = materialize(with_quality(rows).drop("text"), "quality")
    verdicts, hosts = host_verdicts(scored)
    out = join_small(scored, verdicts, "source", F.col("doc_id"), hosts)
    return out.select("doc_id", *[F.col(f"{WORK}.{c}").alias(c) for c in FEATURES], base_failed().alias("base_failed"), F.array_max("__verdict.rates").alias("host_rate"), kept().alias("kept"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their own columns; they are written once with what they fail, which the hosts' table and the choice both read."""
    scored = with_quality(docs).drop(WORK)
    # the text of a row that fails the base rules is not read again
    changed = scored.withColumn("text", F.when(~base_failed(), F.col("text")))
    scored = materialize(changed, "quality")
    verdicts, hosts = host_verdicts(scored)
    out = join_small(scored.where(~base_failed()), verdicts, "source", F.hash("text"), hosts)
    return out.where(kept()).select(*[F.col(f"`{c}`") for c in docs.columns])
