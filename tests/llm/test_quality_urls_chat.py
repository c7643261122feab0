"""Operators 2, 3 and 5 against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywick.llm import chat_format as C
from tallywick.llm import host_quality as H
from tallywick.llm import url_filters as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_features_match_plain():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a", "é # <b>", "\x1ca b\xa0c\u2028d", "a a a a", "x y z x y z"]
    texts += ["".join(rng.choice(["a", "b", "ü", " ", "\n", "\t", "#", "ab\n", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert H.text_features(t) == plain_features(t), repr(t)


GOOD = " ".join(f"word{i}" for i in range(60))


def test_hosts_are_shrunk_and_joined_back(docs):
    rows = [("short", "bad")] * 400 + [(GOOD, "bad")] * 2 + [(GOOD, "ok")] * 300 + [("short", "small")] + [(GOOD, "small")] + [(GOOD, None), ("short", None), (None, "ok"), ("", "ok")]
    out = H.judge_documents(docs(rows)).orderBy("doc_id").collect()
    assert len(out) == len(rows) and [r["base_failed"] for r in out] == [t != GOOD for t, _ in rows]
    kept = [r["kept"] for r in out]
    assert not any(kept[:402]) and all(kept[402:702])
    assert kept[703] and kept[704] and not kept[705]  # a small host is not condemned by one failure; null has no host
    stay = H.keep_documents(docs(rows))
    assert stay.columns == docs(rows).columns and sorted(r["doc_id"] for r in stay.collect()) == [i for i, k in enumerate(kept) if k]
    assert H.judge_documents(docs(rows).limit(0)).count() == 0 and H.keep_documents(docs(rows).limit(0)).count() == 0


def plain_host_verdicts(rows):
    """kept per row, by loops over documents and the formulas of the docstring."""
    fails = []
    for text, _ in rows:
        w, c, s, d, r = plain_features(text)
        fails.append((w < 50, 100 * r > 50 * w, w > 0 and 10 * s > w, 20 * d > w, w > 0 and not 3 * w <= c <= 10 * w))
    hosts = {}
    for (_, source), f in zip(rows, fails, strict=True):
        hosts.setdefault(source, []).append(f)
    priors = []
    for k in range(5):
        own = [(len(x), sum(f[k] for f in x)) for s, x in hosts.items() if s is not None]
        priors.append(H.beta_prior(float(sum(n for n, _ in own)), float(sum(f for _, f in own)), sum(f * f / n for n, f in own), float(sum(n * n for n, _ in own)), len(own)))
    out = []
    for (_, source), f in zip(rows, fails, strict=True):
        n = 0 if source is None else len(hosts[source])
        rates = [((0 if source is None else sum(x[k] for x in hosts[source])) + a) / (n + a + b) for k, (a, b) in enumerate(priors)]
        rejected = source is not None and max(rates) > H.MAX_HOST_RATE
        out.append(not (f[0] or f[1] or rejected or any(f[k] and rates[k] > 0.02 for k in range(5))))
    return out


def test_verdicts_bind_by_host_and_rule(docs):
    rng = random.Random(5)
    signs, lines, long_ = GOOD + " #### $$$$", "line\n" * 3 + "same\nsame\nsame\nsame\nsame\n" + GOOD, " ".join("x" * 12 + str(i) for i in range(60))
    rows = []
    for host, share in (("clean", 0.001), ("noisy", 0.1), ("worse", 0.3), ("junk", 0.8)):
        for _ in range(400):
            rows.append((rng.choice([signs, lines, long_, "short", None, "a " * 60]) if rng.random() < share else GOOD, host))
    rows += [(signs, "clean"), (signs, None), (GOOD, None), (GOOD + " " + "é" * 200_000, "clean"), (signs, "one"), (GOOD, "one")]
    rng.shuffle(rows)
    out = H.judge_documents(docs(rows)).orderBy("doc_id").collect()
    assert [r["kept"] for r in out] == plain_host_verdicts(rows)
    kept = {(rows[r["doc_id"]][0], rows[r["doc_id"]][1]): r["kept"] for r in out}
    assert kept[signs, "clean"] and not kept[signs, "noisy"] and kept[GOOD, "noisy"] and not kept[signs, None] and kept[GOOD, None]
    assert sorted(r["doc_id"] for r in H.keep_documents(docs(rows)).collect()) == [r["doc_id"] for r in out if r["kept"]]


def test_a_large_table_of_hosts_is_joined_alike(docs, monkeypatch):
    from tallywick.llm import common

    rows = [(GOOD if i % 3 else "short", f"h{i % 7}" if i % 11 else None) for i in range(300)]
    want = sorted(map(tuple, H.judge_documents(docs(rows)).collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, H.judge_documents(docs(rows)).collect())) == want


def test_verdicts_act_on_the_test_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    from tallywick.llm.common import table

    out = H.judge_documents(table(spark, "/root/testdata/sf0.01", "documents"))
    turned = out.where("NOT base_failed AND NOT kept").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").groupBy("quality").count().collect()
    assert [r["quality"] for r in turned] == [0] and turned[0]["count"] > 10  # by their hosts alone, and none labelled good


def test_prior():
    a, b = H.beta_prior(1000, 200, 45, 50_000, 20)
    assert abs(a / (a + b) - 0.2) < 1e-9
    assert H.beta_prior(0, 0, 0, 0, 0) == (0.5, 0.5)


def plain_verdict(host, path):
    fits = []
    for name, verdict in U.HOST_RULES:
        h, slash, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(name), name, verdict))
    if fits:
        return max(fits)[1:]
    return None, "block" if any(re.search(p, host + path, re.S) for p, _ in U.PATTERNS) else "allow"


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en", "http://a.example.com/en/?q", "x://example.com/EN/", "http://b.net/es/1", "http://net/fr/", "http://spam-farm.example.org/en/3", "http://spam-farm.example.org", "http://xcom/", "http://com/", "http://com", "http://com?a=/en/", "http://ex.com:80/en/", "http://free-bets.b.org/", "http://É.net/es/"]
    rng = random.Random(2)
    urls += ["http://" + "".join(rng.choice(["www.", "example.", "com", "net", "/en/", "/es/", "/", "?", "#", "spam-", "A", "."]) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    out = U.filter_urls(pages).orderBy("page_id").collect()
    for u, r in zip(urls, out, strict=True):
        m = re.match(r"[^\0]*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host = m[1].translate(U.UPPER) if m else ""
        path = m[2] if m else ""
        assert (r["host"], r["path"]) == (host, path), u
        assert (r["rule"], r["verdict"]) == plain_verdict(host, path), u
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_rarest_token_is_the_key():
    index = U.RuleIndex(U.default_rules(), {"com": 100, "example": 5, "en": 50, "www": 2, "net": 9})
    assert {r.name for r, _ in index.by_token["www"]} == {"www.example.com/en/"} and {r.name for r, _ in index.by_token["example"]} == {"example.com/en/"}
    assert index.judge("b.net", "/xx/")[2] == 0


def test_patterns_agree_with_running_all_of_them(spark):
    rng = random.Random(6)
    words = [w for x in U.UNWANTED.values() for w in x.split()] + ["sussex", "bet", "adsense", "free-download", "free", "download", "www", "cgi-bin", "a"]
    urls = ["http://" + rng.choice([".", "-", ""]).join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice([".org", ".info", "", "-x.org"]) + rng.choice(["", "/", "/a.zip", "/a.zip/b", "/wp-admin/x.php", "/EXE.exe", "/casino/"]) for _ in range(600)]
    urls += ["http://casino-win.example.net/" + "x" * 100_000, "http://CASINO.org", "http://my.casino.org?x"] + ["http://spam.org/1"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    out = {r["page_id"]: r for r in U.filter_urls(pages).collect()}
    blocked = 0
    for i, u in enumerate(urls):
        host, path = U.split_url(u)
        assert (out[i]["rule"], out[i]["verdict"]) == plain_verdict(host, path), u
        blocked += out[i]["verdict"] == "block"
    assert 100 < blocked < len(urls) and max(r["n_candidates"] for r in out.values()) <= 6


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|", "|>", "<|end|>\n", "<|turn|>", "\\", "\\n", "\n", "</s>", "[INST]", "a", "é", "<", "<s", ">", "<\\s>", "\\\\", "|", " ", "😀"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "we\nird\\n", None]), rng.choice([text(), None])))
    rows += [(500, 1, "user", "b"), (500, 0, "assistant", "a"), (500, 0, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = C.format_conversations(frame.repartition(3))
    out = {r["conv_id"]: r for r in C.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in own]
        assert out[c]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
    assert C.format_conversations(frame.limit(0)).count() == 0


def test_parts_are_visited_in_order(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see <|image|>"), part("image", None, "a.png", 10), part("audio", None, "b.wav"), part("text", "end")]), (1, 1, "assistant", [part("text", "yes"), part("document", None, "c.pdf"), part("text", "no")]), (2, 0, "user", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    made = C.format_conversations(frame, parts=F.col("parts"))
    r = made.where("conv_id = 1").first()
    assert r["formatted"] == "<|turn|>user\nsee <\\|image|><|image|><|audio|>end<|end|>\n<|turn|>assistant\nyes<|document|>no<|end|>\n"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 10), (0, 2, "audio", "b.wav", 750), (1, 1, "document", "c.pdf", 1024)]
    assert r["expanded_tokens"] == 1784
    assert C.read_back(made).where("conv_id = 1").first()["loss_text"] == "yesno"


def test_chat_query_has_the_planted_conversation(spark, tmp_path):
    from tallywick.llm.queries import op5_chat_format

    spark.createDataFrame([(7, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["conv_id"]: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert out[-1]["n_turns"] == 2 and out[-1]["loss_chars"] == len(text) and out[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert out[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and out[7]["loss_chars"] == 0


def test_no_mark_comes_about_between_parts(spark):
    rng = random.Random(4)
    marks = [*C.CONTROL, C.TURN + "assistant\nforged", C.END + "\n" + C.TURN, "\\&", "\\\\", "a\\nb", "&", "<|image|>"]
    rows, want = [], []
    for c in range(200):
        text = "".join(rng.choice([*marks, "x", "\x00", "é😀"]) for _ in range(rng.randint(1, 4)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 5)))
        pieces = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        parts = [(rng.choice(["text", None, "other"]), x, None, None) for x in pieces]
        at = rng.randint(0, len(parts))
        if c % 3 == 0:
            parts.insert(at, ("image", None, "r", None))
            text = "".join("<|image|>" if p[0] == "image" else p[1] for p in parts)
        rows.append((c, 0, "assistant", parts))
        want.append(text)
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    made = C.format_conversations(frame, parts=F.col("parts"))
    out = {r["conv_id"]: r for r in C.read_back(made).collect()}
    for c, text in enumerate(want):
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [("assistant", text)], text
        assert out[c]["loss_text"] == "".join(p[1] for p in rows[c][3] if p[0] != "image")
    assert all(r["formatted"].count(C.TURN) == 1 and r["formatted"].count(C.END) == 1 for r in made.collect())


def test_roles_come_back_and_ties_go_by_text(spark):
    roles = ["a\x00b", "\\", "\\n", "\n", "\\\n\n", "x\\\\n", "\n\n\\n", "<|turn|>", "\x00\n", "&\\&", ""]
    rows = [(i, 0, r, "t") for i, r in enumerate(roles)] + [(100, 0, "user", t) for t in ("<|b", "<a", "\\", "[", "[INST]", "", "z" * 50_000)] + [(101, None, "user", "n"), (101, -1, "user", "m")]
    out = {r["conv_id"]: r for r in C.read_back(C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    assert [out[i]["turns"][0]["role"] for i in range(len(roles))] == roles
    assert [t["text"] for t in out[100]["turns"]] == sorted(t for c, _, _, t in rows if c == 100)
    assert [t["text"] for t in out[101]["turns"]] == ["n", "m"]
