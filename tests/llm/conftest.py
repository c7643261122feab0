import zlib
from itertools import combinations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts (or pairs of text and source), with further columns of clashing names."""

    def make(rows, extra=True):
        out = []
        for i, r in enumerate(rows):
            text, source = r if isinstance(r, tuple) else (r, f"s{i % 3}")
            out.append((i, text, "en", source, len(text or "")))
        frame = spark.createDataFrame(out, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("component_id", "kept", "rate", "start", "length", "size", "cut", "node", "spans", "copies", "verdict"):
                frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


@pytest.fixture
def crc():
    return lambda ids: zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


@pytest.fixture
def smallest():
    """Smallest member of each one's component."""

    def find(ids, pairs):
        label = {i: i for i in ids}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        return label

    return find


@pytest.fixture
def all_pairs():
    return lambda ids: combinations(ids, 2)
