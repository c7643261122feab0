"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `host + path` plus the literal tokens that any matching
URL must hold. The index keys a rule by the token that the fewest URLs hold; a URL's tokens fetch
candidate rules, and only those run their expressions. Rules that have no literal are candidates
of every URL.

Defined results: a null URL, or one without `://`, has an empty host and path, is fitted by no
rule and is allowed; repeated rows are judged alike; an empty table gives an empty table; a very long URL is judged whole; of listed rules of equal length the greater by code point wins; other
input columns are not read. The index is as large as the rules, which the caller holds, never as the data; it is broadcast once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[0-9a-z]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# host/path rules, each with its verdict.
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Words of unwanted hosts by topic; a host is unwanted where such a word stands between dots or hyphens.
UNWANTED = {
    "gambling": "casino poker roulette jackpot slots betting bets bookmaker sportsbook lottery",
    "adult": "adult porn xxx sex nude escort escorts webcam hentai",
    "pharmacy": "pills viagra cialis tramadol steroids",
    "spam": "spam linkfarm clickbait doorway",
    "advertising": "ads adserver adserv popads adclick banners tracker",
    "piracy": "warez torrent torrents keygen cracked serials",
    "loans": "payday fastcash",
    "replicas": "replica replicas",
}
# Endings of paths that are no pages.
FILES = "exe msi apk dmg iso zip rar 7z torrent"


def word_pattern(word: str) -> tuple[str, tuple[str, ...]]:
    return rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,)


# The method's own patterns on host + path, each with the literal tokens that a match holds.
PATTERNS = (
    *(word_pattern(w) for words in UNWANTED.values() for w in words.split()),
    *((rf"/[^/]*\.{x}$", (x,)) for x in FILES.split()),
    (r"^(?:[^/]*[.-])?free-(?:download|downloads)(?:[.-][^/]*)?(?:/|$)", ("free",)),
    (r"/(?:cgi-bin|wp-admin)/[^/]*\.php$", ("php",)),
)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool  # a host/path rule: the longest that fits decides, before any pattern


def host_rule(name: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, rest = name.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.translate(UPPER))}{re.escape(slash + rest)}"
    tokens = TOKEN.findall(name.lower())
    if name[-1:].isalnum():  # the last one may go on in the URL
        tokens = tokens[:-1]
    return Rule(name, verdict, pattern, tuple(dict.fromkeys(tokens)), True)


def default_rules() -> list[Rule]:
    return [host_rule(*x) for x in HOST_RULES] + [Rule(p, "block", p, t, False) for p, t in PATTERNS]


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = re.search(r"[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return host.translate(UPPER), slash + path


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host)) | set(TOKEN.findall(path.translate(UPPER)))


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; summed per task first, so as many numbers come back as rules have tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for b in batches:
            for u in b.column(0).to_pylist():
                for t in url_tokens(*split_url(u)) & wanted:
                    found[t] = found.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    return {r["token"]: r["n"] for r in urls.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for r in rules:
            entry = (r, re.compile(r.pattern, re.DOTALL))
            if r.tokens:
                rare = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rare, []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str, int]:
        """(listed rule or None, verdict, how many candidates ran)."""
        found = [e for t in url_tokens(host, path) if t in self.by_token for e in self.by_token[t]] + self.always
        fits = [r for r, p in found if p.search(host + path)]
        listed = [r for r in fits if r.listed]
        if listed:
            best = max(listed, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict, len(found)
        if any(r.verdict == "allow" for r in fits):
            return None, "allow", len(found)
        return None, "block" if fits else "allow", len(found)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, n_candidates) per row; a scan for the tokens' counts, then one pass without a shuffle."""
    rules = default_rules() if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index = RuleIndex(rules, token_counts(rows.select("url"), {t for r in rules for t in r.tokens}))
    sent = pages.sparkSession.sparkContext.broadcast(index)
    kind = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_candidates", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for u in b.column("url").to_pylist():
                host, path = split_url(u)
                for column, value in zip(out, (host, path, *index.judge(host, path)), strict=True):
                    column.append(value)
            arrays = [pa.array(x, f.type) for x, f in zip(out, kind, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *arrays], ["page_id", "url", *kind.names])

    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {id_type}, url string, host string, path string, rule string, verdict string, n_candidates long")
