"""Operators 4 and 8: ids, pieces, records and their round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywick.llm import common, packing, token_records, tokens

BITS = ["a", "b ", "  ", "\n", " ", "\t", "'s", "9", ".", "é", "\x1c", "\xa0", " the", "<|endoftext|>", "ß", "÷", "²", "\n\n", "中", "Ü", "'", "-"]


def texts(n, seed=5):
    rng = random.Random(seed)
    return [None, "", " ", "x" * 3000, "lorem ipsum dolor " * 700] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(all_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in all_texts]


def test_memoized_ids_equal_the_librarys(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 500)  # forgets often
    rows = texts(4000)
    e = tokens.Encoder()
    assert [x.tolist() for x in e.rows(pa.array(rows))] == library(rows)
    assert e.rows(pa.array([], pa.string())) == []


def test_decomposition():
    lengths = np.array([1, 2, 3, 1023, 1024, 1025, 5000])
    doc, start, length = packing.decompose(lengths)
    for d, n in enumerate(lengths):
        own = [(int(s), int(m)) for k, s, m in zip(doc, start, length, strict=True) if k == d]
        assert sum(m for _, m in own) == n and all(m & (m - 1) == 0 and m <= 1024 for _, m in own)
        assert [s for s, _ in own] == list(np.cumsum([0] + [m for _, m in own])[:-1])
    with pytest.raises(ValueError):
        packing.decompose(lengths, 1000)


def test_packing(spark, docs, crc):
    rows = texts(200)
    ids = [x + [0] for x in library(rows)]
    out = packing.pack_documents(docs(rows)).withColumn("crc", F.crc32("ids")).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    for d, own in enumerate(ids):
        mine = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(own) and all(r["doc_tokens"] == len(own) and r["offset"] == 0 for r in mine)
        for r in mine:
            piece = own[r["start"] : r["start"] + r["length"]]
            assert r["crc"] == crc(piece) and 1 << r["bucket"] == r["length"] and np.frombuffer(r["ids"], "<u4").tolist() == piece
    assert packing.pack_documents(docs(rows).limit(0)).count() == 0
    batches = packing.batches_of(packing.pack_documents(docs(rows)), 64).collect()
    assert len(batches) == len(out) and all(r["batch"] >= 0 for r in batches)


def test_repeated_rows_are_packed_one_by_one(docs):
    frame = docs(["one two three"] * 2 + [None, "x " * 30_000])
    frame = frame.unionByName(frame.where("doc_id in (0, 3)"))
    out = packing.pack_documents(frame.repartition(3)).collect()
    ids = {i: x + [0] for i, x in enumerate(library(["one two three"] * 2 + ["", "x " * 30_000]))}
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, own in by.items():
        times = 2 if i in (0, 3) else 1
        assert sum(r["length"] for r in own) == times * len(ids[i]) and all(r["doc_tokens"] == len(ids[i]) for r in own)
        for r in own:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[i][r["start"] : r["start"] + r["length"]]
    assert len({r["sequence_id"] for r in out}) == len(out)


def test_records_round_trip(spark, docs, crc):
    rows = texts(300)
    path = common.scratch_path(spark, "t")
    frame = docs(rows)
    token_records.write_records(frame.repartition(5), path)
    out = token_records.read_records(spark, path).orderBy("start").collect()
    ids = [x + [2] for x in library(rows)]
    assert [r["doc_id"] for r in out] == list(range(len(rows)))
    start = 0
    for r, own in zip(out, ids, strict=True):
        assert (r["start"], r["n_tokens"]) == (start, len(own)) and np.frombuffer(r["ids"], "<u4").tolist() == own
        start += len(own)
    shard = spark.read.parquet(f"{path}/manifest").orderBy("shard").first()
    doc, one = token_records.read_one(path, shard["path"], 3)
    assert doc == 3 and one.tolist() == ids[3]


def test_records_edge_cases(spark, docs):
    path = common.scratch_path(spark, "t")
    token_records.write_records(docs(["a"]).limit(0), path)
    assert token_records.read_records(spark, path).count() == 0
    twice = docs(["a", "b"]).withColumn("doc_id", F.lit(4).cast("long"))
    path = common.scratch_path(spark, "t")
    token_records.write_records(twice.unionByName(twice), path)
    assert [r["doc_id"] for r in token_records.read_records(spark, path).collect()] == [4] * 4


def test_null_ids_come_first_and_shards_follow_the_size(spark, docs, monkeypatch):
    rows = texts(200)[:200]
    frame = docs(rows).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    monkeypatch.setattr(token_records, "SHARD", 1000)
    path = common.scratch_path(spark, "t")
    token_records.write_records(frame, path)
    assert spark.read.parquet(f"{path}/manifest").count() > 5
    out = token_records.read_records(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None] * 40 + [i for i in range(200) if i % 5]
    ids = [x + [2] for x in library(rows)]
    got = [np.frombuffer(r["ids"], "<u4").tolist() for r in out]
    assert sorted(got[:40]) == sorted(ids[i] for i in range(200) if i % 5 == 0) and got[40:] == [ids[i] for i in range(200) if i % 5]


def test_damage_is_found():
    record = bytearray(token_records.frame(7, np.array([1, 2, 70000]), 4))
    assert token_records.read_frame(record, 0)[1].tolist() == [1, 2, 70000]
    for i in (0, 9, 20, len(record) - 1):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(broken, 0)
