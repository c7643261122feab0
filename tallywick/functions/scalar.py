"""Column expressions shared by the layers; all but one are built-in functions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import WEIGHTS


def timestamp_text(ms: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` in UTC of epoch milliseconds, cut to seconds (the session runs in UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(ms / F.lit(1000)).cast("long")), "yyyy-MM-dd HH:mm:ss")


def iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).isoformat()


def event_weight(event: Column) -> Column:
    out = F.lit(0)
    for name, weight in WEIGHTS.items():
        out = F.when(event == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def count_event(event: Column, name: str) -> Column:
    return F.count_if(event == name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def parse_long(value: Column) -> Column:
    """A whole number, or null where the text is none."""
    return value.try_cast("bigint")


def dcg_discount(position: Column) -> Column:
    """1 / log2(position + 1) of a position counted from 1."""
    return F.lit(1.0) / F.log2(position.cast("double") + F.lit(1.0))


def rrf(weight: Column | float, rank: Column, constant: float) -> Column:
    weight = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return weight / (F.lit(float(constant)) + rank.cast("double"))


def md5_bucket(token: Column, size: int) -> Column:
    """A bucket by the first eight hex digits of the md5, wholly in the JVM."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def md5_sign(token: Column) -> Column:
    """+1 or -1 by the parity of the ninth hex digit."""
    return F.when(F.conv(F.substring(F.md5(token.cast("binary")), 9, 1), 16, 10).cast("int") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def blake2b_hash(size: int):
    """A vectorized UDF token -> (bucket, sign) by an 8-byte blake2b; the JVM has no such digest."""
    kind = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sign", T.DoubleType())])

    @F.pandas_udf(kind)
    def hashed(tokens: pd.Series) -> pd.DataFrame:
        digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in tokens]
        return pd.DataFrame({"bucket": [int.from_bytes(d, "big") % size for d in digests], "sign": [1.0 if d[0] % 2 else -1.0 for d in digests]})

    return hashed


def metric_name(name: str) -> str:
    return name.replace("@", "_at_").replace("[", "_").replace("]", "")


def flatten_metrics(values: Mapping, prefix: str = "") -> dict[str, float]:
    """Nested numbers as `a.b`; booleans and other values are left out."""
    out: dict[str, float] = {}
    for key, value in values.items():
        name = f"{prefix}.{key}" if prefix else str(key)
        if isinstance(value, Mapping):
            out |= flatten_metrics(value, name)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out[metric_name(name)] = float(value)
    return out
