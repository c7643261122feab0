"""A corpus pipeline in five stages over `documents`; each stage's output is written and reread by the next.

Every stage but the last returns the columns of its input, further ones included, whatever their names; ids and texts may be null.
An empty table passes through all stages empty. A null or empty text fails the quality rules. Repeated rows, as all documents
whose sets of shingles agree or are near, are one document after the join: that of the smallest id, or a row without id where none has one.
Texts are read whole, however long. The mix repeats a row as often as its source's target asks for, twice at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywick.llm import host_quality, mixing, ngram_join, packing, pii
from tallywick.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: Packing needs a tokenizer, which SQL has not; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
