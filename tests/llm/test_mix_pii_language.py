"""Operators 1, 7 and 10, and the pipeline, against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywick.llm import language_id, mixing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = budget / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            open_.remove(s)
    return target


def test_mixing(docs):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        source = rng.choice(["b", "b", "b", "a", "é", "Z", None, "tiny"]) if i % 50 else "none"
        n = 0 if source == "none" else rng.choice([0, 1, 3, 20, 200])
        rows.append((None if n == 0 and rng.random() < 0.5 else " ".join(["w"] * n), source))
    frame = docs(rows)
    out = mixing.mix_sizes(frame.repartition(7)).collect()
    assert len(out) == len(rows)
    size = {}
    for t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    target = plain_targets(size)
    taken, biggest = {}, {}
    for r in out:
        t, s = rows[r["doc_id"]]
        assert r["size"] == len(WORD.findall(t or "")) and r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["copies"] <= 2
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        biggest[s] = max(biggest.get(s, 0), r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6, s
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(frame).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in again.items() if v}
    assert mixing.mix_sizes(frame.limit(0)).count() == 0


def test_larger_budgets_take_supersets(docs):
    frame = docs([(" ".join(["w"] * (1 + i % 40)), "s") for i in range(300)])
    rows = mixing.sized(frame)
    total = rows.agg(F.sum("size")).first()[0]
    before = set()
    for share in (0.1, 0.35, 0.8):
        plan = mixing.thresholds(rows, frame.sparkSession.createDataFrame([("s", total, share * total)], "source string, source_size long, target double"))
        own = {r["doc_id"] for r in rows.join(plan.drop("source_size"), "source").where(mixing.copies(F.col("h")) > 0).collect()}
        assert before < own
        before = own


def test_repeated_rows_are_mixed_and_searched_alike(docs):
    frame = docs([("a b c " * n, "s") for n in range(1, 60)] + [("z " * 100_000, "t"), ("mail a@b.co", "t"), (None, None)])
    twice = frame.unionByName(frame)
    out = {}
    for r in mixing.mix_sizes(twice.repartition(5)).collect():
        out.setdefault(r["doc_id"], []).append((r["size"], r["source_size"], r["copies"]))
    assert len(out) == 62 and all(len(x) == 2 and x[0] == x[1] for x in out.values())
    assert sum(c for x in out.values() for _, _, c in x) == mixing.mix_documents(twice).count()
    spans = {}
    for r in pii.find_spans(twice).collect():
        spans.setdefault(r["doc_id"], []).append(r["spans"])
    assert all(len(x) == 2 and x[0] == x[1] for x in spans.values()) and len(spans[60][0]) == 1
    assert sorted(r["text"] or "" for r in pii.redact(twice).where("doc_id >= 60").collect()) == ["", "", "mail [EMAIL]", "mail [EMAIL]"]


def plain_spans(t):
    t, out = t or "", []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in kinds:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            if kind == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                if not 16 <= len(d) <= 19 or sum(x - 9 * (x > 9) for x in twice) % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


BITS = ["a@b.co", "_x@y.z", "+1 (234) 555-1234", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", "256.1.1.1", " ", "é", "\n", ".", "5", "-", "4111111111111111", "@", "+", "(", "x", "00001.02.3.4", "😀", "foo [at] bar [dot] com", "1.2.3.4.5.6.7.8", "tel 555 123 4567"]


def test_spans_match_plain(docs):
    rng = random.Random(8)
    rows = [None, "", "1" * 5000, "a" * 5000 + "@", "1.2.3.4 " * 700, "a@b.co," * 600] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 10))) for _ in range(1500)]
    out = {r["doc_id"]: r for r in pii.find_spans(docs(rows)).collect()}
    for i, t in enumerate(rows):
        base = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in out[i]["base"]]
        assert base == plain_spans(t), repr(t)[:200]
        assert set(map(tuple, out[i]["base"])) <= set(map(tuple, out[i]["spans"]))
    assert pii.find_spans(docs(rows).limit(0)).count() == 0


def test_trees_accept_what_looks_valid_and_nothing_else(docs):
    rng = random.Random(9)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [f"call +1 {number()} now" for _ in range(300)] + [f"order {rng.randint(10**15, 10**16 - 1)} sent" for _ in range(300)] + ["nothing here"] * 20
    out = pii.find_spans(docs(rows)).collect()
    assert all(not r["spans"] for r in out if r["doc_id"] >= 600)
    assert all(any(s["kind"] == 3 for s in r["spans"]) for r in out if r["doc_id"] < 300)
    scores = pii.boost([((0, 1), 50.0, 49.0), ((0, 0), 50.0, 1.0), ((1, 1), 10.0, 0.0)])
    assert scores[0] > 1 > -1 > scores[1]


def test_numbers_side_by_side_are_candidates_of_their_own(docs):
    card = "4845168114407329"
    rows = [f"seen {card} there"] * 60 + ["call +1 (234) 555-1234 now"] * 60 + ["order 1234567890123456 sent"] * 60
    rows += ["7536784127813050 4845168114407329", f"2353820953013749 {card} x", f"é {card} 1.2", f"a@b.co {card} 4111 1111 1111 1111 1.2.3.4"]
    out = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(docs(rows)).collect()}
    assert out[180] == [("card", 0, 16), ("card", 17, 33)]
    assert out[181] == [("card", 17, 33)]
    assert out[182] == [("card", 2, 18)]
    assert out[183] == [("email", 0, 6), ("ip", 44, 51), ("card", 7, 23), ("card", 24, 43)]
    assert all(not out[i] for i in range(120, 180))
    texts = [r["text"] for r in pii.redact(docs(rows)).where("doc_id >= 180").orderBy("doc_id").collect()]
    assert texts == ["[CARD] [CARD]", "2353820953013749 [CARD] x", "é [CARD] 1.2", "[EMAIL] [CARD] [CARD] [IP]"]


@pytest.mark.parametrize("common", [True, False])
def test_evidence_finds_what_the_base_rule_does_not(docs, common):
    """Phones without plus, cards of 15 digits and written-out mails, whether common or rare beside base matches; not order numbers."""
    rng = random.Random(11)
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    rows = [f"tel 555 {number(3)} {number(4)}" for _ in range(200 if common else 3)] + [f"write to joe{i} [at] firm [dot] com now" for i in range(200 if common else 3)]
    rows += ["card 378282246310005 paid"] * (200 if common else 3)
    wanted = len(rows)
    plain = ["call +1 (234) 555-1234"] * 300 + ["a@b.co"] * 300 + ["seen 4845168114407329 there"] * 300
    noise = [f"order {number(8)} sent" for _ in range(300)] + [f"id {number(15)}" for _ in range(300)] + ["value 20240131 1200"] * 100 + ["+1 (234) 555-1234 4845168114407329"]
    rows += plain + noise
    out = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(docs(rows)).collect()}
    kinds = ["phone"] * (wanted // 3) + ["email"] * (wanted // 3) + ["card"] * (wanted // 3)
    for i, kind in enumerate(kinds):
        start = {"phone": 4, "email": 9, "card": 5}[kind]
        end = len(rows[i]) - {"phone": 0, "email": 4, "card": 5}[kind]
        assert out[i] == [(kind, start, end)], (rows[i], out[i])
    assert not any(out[i] for i in range(wanted + 900, len(rows) - 1))
    assert out[len(rows) - 1] == [("card", 18, 34), ("phone", 0, 17)]


@pytest.mark.parametrize("genuine, decoys", [(200, 2), (60, 60), (20, 200), (3, 20)])
def test_precision_and_recall_of_added_spans(docs, genuine, decoys):
    """Written-out mails, phones without plus and spaced cards beside look-alikes, at several ratios."""
    rng = random.Random(genuine)
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], []

    def plant(before, span, after, kind):
        rows.append(f"{name()} {before}{span}{after} {name()}")
        want.append([(kind, 7 + len(before), 7 + len(before) + len(span))] if kind else [])

    for _ in range(genuine):
        plant("", f"{name()} [at] {name()} [dot] com", "", "email")
        plant("tel ", f"555 {number(3)} {number(4)}", "", "phone")
        plant("seen ", "4111 1111 1111 1111", f" {number(4)}x", "card")
    for _ in range(decoys):
        plant("", f"{name()} [at] {name()} [dot] 4x", "", None)
        plant("order ", f"{number(4)} {number(4)}", "", None)
        plant("isbn ", f"978{number(10)}", "", None)
    plant("", "note [at] home [dot] now", "", None)
    bare = len(rows)
    plant("", f"555 {number(3)} {number(4)}", "", "phone")  # no word before: its shape alone
    out = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(docs(rows)).collect()}
    wrong = [(rows[i], out[i]) for i in range(bare) if out[i] != want[i]]
    assert not wrong, wrong[:5]
    assert out[bare] == (want[bare] if genuine >= 200 else [])  # taken once enough held-out phones of that shape are seen


def test_redaction(docs):
    long = "x" * (pii.CHUNK - 5) + " a@b.example.com and +1 (234) 555-1234\n" + "y" * 9000 + " 1.2.3.4"
    frame = docs([long, "keep é", None, "4111111111111111", "a@b.co"])
    out = pii.redact(frame)
    assert out.columns == frame.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got == ["x" * (pii.CHUNK - 5) + " [EMAIL] and [PHONE]\n" + "y" * 9000 + " [IP]", "keep é", None, "[CARD]", "[EMAIL]"]
    assert [r["n_chars"] for r in out.orderBy("doc_id").collect()] == [len(x or "") for x in got]
    assert pii.redact(frame.limit(0)).count() == 0


def test_languages_by_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.fit_and_identify(docs, 200).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)


def test_language_edges(docs):
    rows = [None, "", "123 !?", "the and of to", "der die das", "²", "中文", "a" * 5000] * 3
    frame = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 8 == 3, "en").when(F.col("doc_id") % 8 == 4, "de"))
    out = [r["lang_pred"] for r in language_id.fit_and_identify(frame).orderBy("doc_id").collect()]
    assert out[:3] == ["und"] * 3 and out[5] == "und" and out[6] in ("de", "en") and out[7] in ("de", "en")
    none = [r["lang_pred"] for r in language_id.fit_and_identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()]
    assert set(none) == {"und"}
    assert language_id.fit_and_identify(frame.limit(0)).count() == 0


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[i, *rest] for i, p in enumerate(pieces) if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


def lattice(pieces, words):
    import numpy as np

    ends = np.cumsum([len(w) for w in words])
    return language_id.Lattice(language_id.Pieces(pieces), np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)


@pytest.mark.parametrize("plain", [0, 3, 40])
def test_forward_sums_all_segmentations(monkeypatch, plain):
    import numpy as np

    monkeypatch.setattr(language_id, "PLAIN", plain)
    monkeypatch.setattr(language_id, "PREFIX", 2)
    rng = np.random.default_rng(plain)
    pieces = [b"a", b"b", b"c", b"ab", b"ba", b"aab", b"abca", b"bbbbb", "é".encode(), b"\xc3", b"\xa9"]
    prob = rng.dirichlet(np.ones(len(pieces)), 3).T
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 11))).encode() for _ in range(200)] + [b"a", b"c" * 12, b"bbbbbbbbbb"]
    got = lattice(pieces, words).log_likelihood(np.log(prob))
    ways = [segmentations(w, pieces) for w in words]
    assert np.allclose(got, [np.log(sum(np.prod(prob[x], axis=0) for x in own)) for own in ways])
    # one round of expectation maximisation: each way counts its pieces by its share of the sum
    weight = rng.integers(1, 9, len(words)).astype(float)
    want = np.zeros(len(pieces))
    for own, n in zip(ways, weight, strict=True):
        p = np.array([np.prod(prob[x, 0]) for x in own])
        for x, share in zip(own, p / p.sum(), strict=True):
            for i in x:
                want[i] += n * share
    assert np.allclose(lattice(pieces, words).expected(np.log(prob[:, :1]), weight), want)


def test_long_words_neither_underflow_nor_are_cut():
    import numpy as np

    pieces = [b"a", b"aa", b"b"]
    log_prob = np.log([[1e-9], [1e-12], [1 - 1e-9 - 1e-12]])
    n = 3000
    before, now = 0.0, log_prob[0, 0]  # the same recursion, word by word
    for _ in range(n - 1):
        before, now = now, np.logaddexp(now + log_prob[0, 0], before + log_prob[1, 0])
    assert np.allclose(lattice(pieces, [b"a" * n]).log_likelihood(log_prob), now)
    kept = language_id.byte_pieces()
    assert max(map(len, kept)) == 128 and b" information" in kept


def test_whole_texts_are_scored_as_the_sum_of_their_words(docs):
    import numpy as np
    import pyarrow as pa

    pieces = language_id.byte_pieces()
    rng = np.random.default_rng(2)
    model = language_id.Model(["x", "y"], pieces, rng.dirichlet(np.ones(len(pieces)), 2).T)
    texts = ["The theme, then: Ab ab", None, "", "é中文 über" * 50, "z" * 3000]
    got = model.text_scores(pa.array(texts))
    for text, scores in zip(texts, got, strict=True):
        words = [b" " + w for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())]
        assert np.allclose(scores, sum((lattice(pieces, [w]).log_likelihood(model.log_prob)[0] for w in words), np.zeros(2)), rtol=1e-5)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_duplicates import links, plain_sets

    rng = random.Random(10)
    body = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(70))
    texts = [body() for _ in range(40)]
    texts += [texts[0], texts[1] + " more", "short", None, texts[2] + " a@b.example.com", " ".join(["x y z"] * 40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    kept = {r["doc_id"] for r in seen[0]}
    assert kept == set(range(42)) | {44}
    sets = plain_sets(texts)
    gone = {max(p) for p in links(sets) if set(p) <= kept}
    assert {r["doc_id"] for r in seen[1]} == kept - gone and gone == {40, 41, 44}
    assert not any("@" in r["text"] for r in seen[2]) and len(seen[2]) == len(seen[1])
    copies = {i: sum(r["doc_id"] == i for r in seen[3]) for i in kept}
    assert max(copies.values()) <= 2 and abs(sum(len(r["text"].split()) for r in seen[3]) - 1.5 * sum(len(r["text"].split()) for r in seen[2])) <= 4 * 40
    assert sum(r["length"] for r in seen[4] if r["doc_id"] == 5) == copies[5] * next((r["doc_tokens"] for r in seen[4] if r["doc_id"] == 5), 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_edges(spark, docs, tmp_path):
    """No rows; repeated rows, null ids and sources, a very long text and columns of clashing names through the whole run."""
    import corpus_pipeline

    rng = random.Random(12)
    body = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    texts = [body(80) for _ in range(12)]
    rows = texts + [texts[0]] * 3 + [None, "", body(40_000), texts[1] + " tail@x.example.com"]
    frame = docs(rows)
    frame = frame.unionByName(frame.where("doc_id in (2, 3)")).unionByName(frame.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    frame = frame.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    for name, table in (("none", frame.limit(0)), ("some", frame)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    current = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        current = stage(spark, current, str(tmp_path / "some"))
        assert current.columns == frame.columns
        current.write.parquet(str(tmp_path / f"e{i}"))
        current = spark.read.parquet(str(tmp_path / f"e{i}"))
        if i == 1:
            assert sorted(r["doc_id"] for r in current.collect()) == [*range(12), 17]
    packed = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= {*range(12), 17} and packed.count() > 12


def test_op10_digest(spark, tmp_path):
    from tallywick.llm.queries import op10_pii

    spark.createDataFrame([(1, "mail a@b.co and 1.2.3.4", "en", "s", 1), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in op10_pii(spark, str(tmp_path)).collect()}
    assert out[1]["base_sha256"] == hashlib.sha256(b"email:5:11,ip:16:23").hexdigest() and out[1]["n_email"] == out[1]["n_ip"] == 1 and out[1]["n_card"] == 0
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[2]["spans"] == ""
