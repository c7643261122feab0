"""CSV scans with explicit schemas."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "timestamp long, visitorid long, event string, itemid long, transactionid long"
CATEGORIES = "categoryid long, parentid long"
PROPERTY_HEADER = ["timestamp", "itemid", "property", "value"]


def read_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A header CSV; blank transaction ids are null and malformed rows fail. A limit takes the first rows of the file."""
    rows = spark.read.schema(EVENTS).csv(path, header=True, mode="FAILFAST", nullValue="", enforceSchema=False)
    if limit is None:
        return rows
    return rows.orderBy("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).limit(limit)  # the splits' order is that of the file


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORIES).csv(path, header=True, mode="FAILFAST", nullValue="", enforceSchema=False)


def property_rows(lines: Iterator[str], name: str = "<text>") -> Iterator[tuple[str, str, str, str]]:
    """Rows of an item-property CSV from its lines: the last column takes every further field, commas included."""
    records = csv.reader(lines)
    header = next(records, None)
    if header is None:
        raise ValueError(f"Empty item-property CSV: {name}")
    if [header[0].removeprefix("\ufeff"), *header[1:]] != PROPERTY_HEADER:
        raise ValueError(f"Unexpected header in {name}: {header!r}; expected {PROPERTY_HEADER!r}")
    for number, fields in enumerate(records, 2):
        yield property_row(fields, name, number)


def property_row(fields: list[str], name: str, number: int) -> tuple[str, str, str, str]:
    if len(fields) < len(PROPERTY_HEADER):
        raise ValueError(f"Malformed item-property row in {name} at line {number}: expected at least 4 fields, found {len(fields)}")
    return (*fields[:3], ",".join(fields[3:]))


def parse_properties(text: str, name: str = "<text>") -> Iterator[tuple[str, str, str, str]]:
    return property_rows(io.StringIO(text, newline=""), name)


def read_properties(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(timestamp, itemid, property, value, ingest_seq) of CSVs whose values may hold bare commas.

    Spark's reader drops surplus fields, so lines are parsed by Python's reader in Arrow batches. Files are
    read line by line in parallel; ingest_seq grows with file and line, and settles equal times. The header
    is checked on the first line of each file. Quoted line breaks inside values are not supported here:
    `parse_properties` reads such a file whole.
    """
    parts = []
    for number, path in enumerate(paths):
        first = spark.read.text(path).limit(1).collect()
        if not first:
            raise ValueError(f"Empty item-property CSV: {path}")
        header = first[0][0].removeprefix("﻿").rstrip("\r")
        list(parse_properties(header, path))
        lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        parts.append(lines.where(F.regexp_replace("value", "^﻿|\r$", "") != header).withColumn("file", F.lit(number)))
    kind = pa.schema([("timestamp", pa.int64()), ("itemid", pa.int64()), ("property", pa.string()), ("value", pa.string()), ("ingest_seq", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, line, file in zip(batch.column("value").to_pylist(), batch.column("line").to_pylist(), batch.column("file").to_pylist(), strict=True):
                fields = next(csv.reader([text]), [])
                if not fields:
                    continue
                if len(fields) < len(PROPERTY_HEADER):
                    raise ValueError(f"Malformed item-property row in {paths[file]}: expected at least 4 fields, found {len(fields)}: {text!r}")
                rows.append((int(fields[0]), int(fields[1]), fields[2], ",".join(fields[3:]), (file << 52) | line))
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("value", "line", "file").mapInArrow(parse, "timestamp long, itemid long, property string, value string, ingest_seq long")
