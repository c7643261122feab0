"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans follow fixed patterns and stay whatever the model says. High-recall generators propose
further, overlapping spans apart from those: each run of digits with separators, and each part of it cut at separators, as a
phone, a card and an address at once, and mail addresses whose signs are written out. Of overlapping ones that are
accepted, that of the greatest rank is taken.

A candidate is described by a few format features and one of context (the words just before, of 24 characters that are read),
all with small ranges, so the candidates of all rows fall into a bounded number of cells (some 300,000 by the ranges, a few
hundred in practice), which are counted over all data by one aggregate. `evidence` labels those candidates that something beside their
shape speaks for or against: context words, checksums, an international prefix, a known domain. Base spans are positive too. The rest is unlabelled and never learnt from.

Boosted trees are fitted on the labelled cells, once as they are and once with the context hidden, so that they also
learn what a kind looks like where no word tells. Each kind has two thresholds, calibrated to a precision. That of labelled cells, where the evidence
is among the features, is set on the labelled candidates themselves. That of unlabelled cells is set on held-out candidates whose context is
hidden: each half of the texts is scored by trees that are fitted on the other half. It counts two more
errors than it sees, and takes only cells of SUPPORT such candidates or more.

Positions come from the lengths between matches, so a text is scanned a fixed number of times and
never by matches times length. The patterns match what the plain ones do, but start only where a run starts,
and give nothing back, so that they take linear time and no stack on long runs.

Defined results: a null text is empty; no spans give the digest of the empty string; of overlapping spans
the first to start is replaced; repeated rows are judged alike; a very long text is read whole; an empty table gives an empty table; `redact`
carries further columns unchanged, whatever their names (working columns have reserved names).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns (in their linear form), and what a valid match is.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
# Without these a text holds no match; they are found without a regular expression or by a plain one.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}

# The method's generators and context words.
NUMBER = r"(?<![0-9])[(+]?[0-9](?:[\x20().-]{0,2}[0-9])++"
MAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?[\[({{](?i:at)[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({{](?i:dot)[\])}}]\x20?[A-Za-z0-9-]++)++"
#: Words just before a number (no letter or digit between, from the start of a word): of phones, cards, addresses, other numbers.
NEXT_TO = tuple(
    rf"(?i)(?<![a-z])(?:{words})(?:\x20(?:no|nr|number|me|us|is|at|on))*[^a-z0-9\x01]*$"
    for words in ("tel|telephone|phone|cellphone|cell|call|fax|mobile", "card|visa|mastercard|amex|credit|account", "ip|host|addr|address|server", "version|token|order|id|no|nr|number|license|isbn")
)
#: Layouts of a number: one group, national phone, groups as cards have them, dotted quad; 0 is any other. From FIRST_KNOWN on they tell a kind.
_NATIONAL = r"^(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[0-9]{3}[\x20.-][0-9]{4}$"
_GROUPED = r"^(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"
ONE_GROUP, NATIONAL, GROUPED, QUAD = 1, 2, 3, 4
LAYOUTS = (r"^[(+]?[0-9]+$", _NATIONAL, _GROUPED, VALID_IP)
FIRST_KNOWN = NATIONAL
#: Starts of cards of 13 to 15 digits.
ISSUED = r"^(?:4[0-9]{12}|3[068][0-9]{12}|3[47][0-9]{13})$"
LEAST_DIGITS, MOST_DIGITS = 7, 19
#: Words just before a written-out mail address, and domains that it ends in.
MAIL_WORDS = r"(?i)(?<![a-z])(?:e-?mail|mail|contact|write|reach)(?:\x20(?:me|us|is|at|to))*[^a-z0-9\x01]*$"
DOMAINS = "com org net edu gov mil int info biz io co eu us uk de fr es it nl be ch at pl pt se no fi dk cz ru cn jp kr in br au ca mx ie nz za app dev me tv ai".split()
#: Digit groups of a candidate, and groups before it that are read as context.
MOST_GROUPS, NEAR = 6, 6
TOUCH_LEFT, TOUCH_RIGHT = r"[A-Za-z0-9_\"#=/]$", r"^[A-Za-z_\"%/@]"
MASK = "\x01"
RANKS = ("phone", "ip", "card", "email")

PRECISION = 0.98
ROUNDS, RATE, RIDGE, DEPTH = 30, 0.3, 1.0, 6
#: Halves of the texts for the calibration; held-out candidates that an unlabelled cell needs.
FOLDS, SUPPORT = 2, 20
#: Labels of candidates.
NO, YES, UNKNOWN = 0, 1, 2
BLOCK = 256
CHUNK = 4096


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value,before,after>> of the leftmost matches; code points, end exclusive.

    The text between matches gives the positions. The running sum is made block by block, so that
    many matches do not copy one growing array again and again.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(found.alias("v"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(found) + 1).alias("h")),
        lambda x: F.struct(x["v"].alias("v"), F.length(x["g"]).alias("g"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["h"], F.lit(4)).alias("after")),
    )
    rows = F.filter(rows, lambda x: x["v"].isNotNull())
    span = "struct<start:int,end:int,value:string,before:string,after:string>"
    none = F.array().cast(f"array<{span}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["v"])
        one = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
    spans = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")), block, lambda acc: acc["out"]))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, F.expr("0") + c.try_cast("int")).otherwise(F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.coalesce(F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0, F.lit(False))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(VALID_IP)
    if kind == "card":
        return F.when(F.length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _valid_matches(kind: str, text: Column) -> Column:
    return F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))


def _of_kind(i: int, spans: str) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def count_kind(spans: str, i: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """The rows with one array column `__<kind>` of base spans each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for kind in KINDS:
        hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
        docs = docs.withColumn(f"__{kind}", F.when(hint, _valid_matches(kind, text)).otherwise(F.array()))
    return docs


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """How many of the bounds the value reaches."""
    out = F.lit(0)
    for b in bounds:
        out = out + (value >= b).cast("int")
    return out


def described(kind: str, m: Column) -> Column:
    """A candidate of sub-spans or base spans with the small whole numbers that describe it; `left` and `right` are what it touches."""
    number = digits(m["value"])
    context = F.lit(0)
    for i, words in reversed(list(enumerate(NEXT_TO, 1))):
        context = F.when(m["before"].rlike(words), F.lit(i)).otherwise(context)
    layout = F.lit(0)
    for i, form in reversed(list(enumerate(LAYOUTS, 1))):
        layout = F.when(m["value"].rlike(form), F.lit(i)).otherwise(layout)
    n = F.length(number)
    groups = F.regexp_count(m["value"], F.lit("[0-9]+"))
    first = F.length(F.regexp_extract(m["value"], "[0-9]+", 0))
    card = F.when(~n.between(13, 19), 0).when(~luhn(number), 0).when((n >= 16) | number.rlike(ISSUED), 2).otherwise(1)
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), n.alias("n"), bucket(n, (8, 10, 13, 16)).alias("size"),
        F.when(m["value"].startswith("+"), 1).when(m["value"].startswith("("), 2).otherwise(0).alias("lead"), layout.alias("layout"), card.alias("card"),
        bucket(groups, (2, 3, 4, 5)).alias("groups"), bucket(first, (3, 4, 5)).alias("first"), m["left"].alias("left"), m["right"].alias("right"), context.alias("context"),
    )


def touching(m: Column) -> Column:
    """A match with what it touches on either side."""
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"), m["before"].rlike(TOUCH_LEFT).cast("int").alias("left"), m["after"].rlike(TOUCH_RIGHT).cast("int").alias("right"))


def cell(kind: str, d: Column) -> Column:
    """The cell of a described candidate: its small numbers joined by commas, led by its kind, the context last."""
    return F.concat_ws(",", F.lit(KINDS.index(kind)).cast("string"), *[d[p].cast("string") for p in ("size", "lead", "layout", "card", "groups", "first", "left", "right", "context")])


def _masked(text: Column) -> Column:
    """The text with `__base` spans overwritten by MASK, so that places stay and no candidate overlaps a base span."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    spans = F.array_sort(F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def mask(chunk: Column, i: Column) -> Column:
        low, high = i * CHUNK, i * CHUNK + F.length(chunk)
        own = F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))

        def step(acc: Column, s: Column) -> Column:
            first, last = F.greatest(s["start"], acc["at"]), F.least(s["end"], high)
            piece = F.concat(acc["out"], F.substr(chunk, acc["at"] - low + 1, first - acc["at"]), F.repeat(F.lit(MASK), last - first))
            return F.when(last > first, F.struct(last.alias("at"), piece.alias("out"))).otherwise(acc)

        end = F.aggregate(own, F.struct(low.alias("at"), F.lit("").alias("out")), step)
        return F.when(F.size(own) == 0, chunk).otherwise(F.concat(end["out"], F.substr(chunk, end["at"] - low + 1)))

    return F.when(F.size("__base") > 0, F.array_join(F.transform(chunks, mask), "")).otherwise(text)


def _sub_spans(runs: str) -> Column:
    """All runs of 1 to MOST_GROUPS digit groups of each number, and the number itself, of 7 to 19 digits.

    A group carries the separators before it; a span starts at its first digit or at a sign or bracket just before. `left` and `right`
    are what it touches: 0 nothing, 1 a letter or the like, 2 another group beyond a space, 3 another group at a sign.
    """
    groups = F.transform(runs, lambda m: F.struct(m["start"].alias("start"), m["before"].alias("before"), m["after"].alias("after"), matches(m["value"], r"[^0-9]*+[0-9]++").alias("g")))

    def span(r: Column, i: Column, k: Column) -> Column:
        g, n = r["g"], F.size(r["g"])
        first = F.regexp_extract(F.get(g, i)["value"], "[(+]?[0-9]+$", 0)
        value = F.concat(first, F.array_join(F.transform(F.slice(g, i + 2, k - 1), lambda t: t["value"]), ""))
        low = F.greatest(i - NEAR, F.lit(0))
        earlier = F.array_join(F.transform(F.slice(g, low + 1, i - low), lambda t: t["value"]), "")
        before = F.right(F.concat(F.when(low == 0, r["before"]).otherwise(""), earlier, F.regexp_replace(F.get(g, i)["value"], "[(+]?[0-9]+$", "")), F.lit(24))
        later = F.get(g, i + k)["value"]
        joined = lambda v: F.when(F.contains(v, F.lit(" ")), 2).otherwise(3)
        return F.struct(
            (r["start"] + F.get(g, i)["end"] - F.length(first)).alias("start"), (r["start"] + F.get(g, i + k - 1)["end"]).alias("end"), value.alias("value"),
            before.alias("before"), F.coalesce(F.left(later, F.lit(4)), r["after"]).alias("after"),
            F.when(i > 0, joined(F.get(g, i)["value"])).otherwise(r["before"].rlike(TOUCH_LEFT).cast("int")).alias("left"),
            F.when(i + k < n, joined(later)).otherwise(r["after"].rlike(TOUCH_RIGHT).cast("int")).alias("right"),
        )

    def spans(r: Column) -> Column:
        n = F.size(r["g"])
        cut = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_GROUPS), n - i)), lambda k: span(r, i, k))))
        # a number of more groups than MOST_DIGITS has too many digits
        return F.when(n.between(MOST_GROUPS + 1, MOST_DIGITS), F.concat(cut, F.array(span(r, F.lit(0), n)))).otherwise(cut)

    return F.filter(F.flatten(F.transform(groups, spans)), lambda m: F.length(digits(m["value"])).between(LEAST_DIGITS, MOST_DIGITS))


def _rank(kind: str, d: Column) -> Column:
    """Of overlapping candidates the one of the greatest rank is taken: by kind, then a known layout or a plus, then the one of more digits."""
    return F.lit(1000 * RANKS.index(kind)) + F.when((d["layout"] >= FIRST_KNOWN) | (d["lead"] == 1), 100).otherwise(0) + F.length(digits(d["value"]))


def evidence(kind: str, d: Column) -> Column:
    """YES or NO where something beside its shape tells whether a number is of the kind, else UNKNOWN.

    A phone: a word for it just before, a plus (next to another number the base drops those), or a national layout. A card: Luhn, standing
    as one group or in groups as cards are printed; one of 13 to 15 digits also starts as an issuer of that length does, or has a word for it
    just before. An address: a dotted quad after a word for it. Against all speak a letter on either side, words for other things and
    what cannot be (too many digits, a wrong checksum, a part of a dotted or dashed run).
    """
    free, apart = (d["left"] != 1) & (d["right"] != 1), (d["left"] != 3) & (d["right"] != 3)
    if kind == "phone":
        can = free & apart & (d["size"] < 4) & (d["layout"] != QUAD) & ~((d["card"] == 2) & (d["context"] != 1))
        yes = (d["context"] == 1) | ((d["lead"] == 1) & (d["size"] > 0)) | ((d["layout"] == NATIONAL) & (d["context"] == 0))
    elif kind == "card":
        can = free & (d["lead"] == 0) & (d["card"] > 0) & ((d["size"] == 4) | ~d["context"].isin(1, 4))
        whole = d["layout"].isin(ONE_GROUP, GROUPED)
        yes = whole & ((d["card"] == 2) | (d["context"] == 2))
    else:
        can = free & apart & (d["layout"] == QUAD)
        yes = d["context"] == 3
    other = ~d["context"].isin(0, {"phone": 1, "card": 2, "ip": 3}[kind])
    return F.when(~can, NO).when(yes, YES).when(other, NO).otherwise(UNKNOWN)


def with_candidates(docs: DataFrame) -> DataFrame:
    """The rows with `__base`, `__fold` and `__candidates`: array<struct<kind,start,end,cell,label,open,rank>>; open ones are not base spans."""
    none = "array<struct<kind:int,start:int,end:int,cell:string,label:int,open:boolean,rank:int>>"
    docs = docs.withColumn("__base", F.concat(*[_of_kind(i, f"__{k}") for i, k in enumerate(KINDS)]))
    docs = docs.withColumn("__masked", _masked(F.coalesce(F.col("text"), F.lit(""))))
    text = F.col("__masked")
    docs = docs.withColumn("__runs", F.when(text.rlike(r"[0-9][\x20().-]{0,2}[0-9]"), F.filter(matches(text, NUMBER), lambda m: F.length(digits(m["value"])) >= LEAST_DIGITS)).otherwise(F.array()))
    docs = docs.withColumn("__numbers", F.when(F.size("__runs") > 0, _sub_spans("__runs")).otherwise(F.array()))
    docs = docs.withColumn("__mails", F.when(text.rlike(r"[\[({](?i:at)[\])}]"), matches(text, MAIL)).otherwise(F.array()))

    def propose(source: str, kind: str) -> Column:
        base = source == f"__{kind}"
        told = F.transform(F.transform(source, touching) if base else F.col(source), lambda m: described(kind, m))
        own = F.transform(
            told,
            lambda d: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), d["start"].alias("start"), d["end"].alias("end"), cell(kind, d).alias("cell"),
                (F.lit(YES) if base else evidence(kind, d)).alias("label"), F.lit(not base).alias("open"), _rank(kind, d).alias("rank"),
            ),
        )
        return F.when(F.size(source) > 0, own).otherwise(F.array()).cast(none)

    def mails(source: str, open_: bool) -> Column:
        """Of mail addresses: whether they are written out, how their domain ends (known, letters, else), their numbers of labels and signs, and words before."""

        def told(m: Column) -> Column:
            last = F.lower(F.regexp_extract(m["value"], r"([A-Za-z0-9-]+)$", 1))
            ends = F.when(last.isin(*DOMAINS), 2).when(last.rlike("^[a-z]{2,}$"), 1).otherwise(0)
            word = m["before"].rlike(MAIL_WORDS).cast("int")
            shape = [ends, bucket(F.regexp_count(m["value"], F.lit(r"[\])}.]\x20?[A-Za-z0-9-]+")), (2, 3, 4)), F.regexp_count(m["value"], F.lit(r"\x20")).cast("int"), m["before"].rlike(TOUCH_LEFT).cast("int"), m["after"].rlike(TOUCH_RIGHT).cast("int")]
            label = F.when(ends == 2, YES).when((ends == 1) & (word == 1), YES).when(ends == 0, NO).otherwise(UNKNOWN) if open_ else F.lit(YES)
            spot = F.concat_ws(",", F.lit(f"0,{int(open_)}"), *[x.cast("string") for x in shape], F.lit("0,0"), word.cast("string"))
            return F.struct(F.lit(0).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), spot.alias("cell"), label.alias("label"), F.lit(open_).alias("open"), F.lit(1000 * RANKS.index("email")).alias("rank"))

        return F.when(F.size(source) > 0, F.transform(source, told)).otherwise(F.array()).cast(none)

    numbers = ("ip", "card", "phone")
    proposed = F.concat(mails("__email", False), mails("__mails", True), *[propose(f"__{k}", k) for k in numbers], *[propose("__numbers", k) for k in numbers])
    docs = docs.withColumn("__fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    return docs.withColumn("__candidates", proposed).drop("__runs", "__numbers", "__mails", "__masked")


def boost(cells: list[tuple[tuple[int, ...], float, float]], asked: list[tuple[int, ...]] | None = None) -> list[float]:
    """Scores (log-odds) by boosted trees of depth DEPTH on the logistic loss, fitted on cells (features, count, positives), of the cells asked for (else their own)."""
    asked = [c[0] for c in cells] if asked is None else asked
    if not cells or not asked:
        return [0.0] * len(asked)
    x, want = np.array([c[0] for c in cells]), np.array(asked)
    n, positive = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    scores, out = np.zeros(len(x)), np.zeros(len(want))

    def grow(rows: np.ndarray, there: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        top, cut = 1e-9, None
        for j in range(x.shape[1] if depth else 0):
            own = x[rows, j]
            ga, ha = np.cumsum(np.bincount(own, g[rows]))[:-1], np.cumsum(np.bincount(own, h[rows]))[:-1]
            seen = np.bincount(own)[:-1] > 0
            gain = np.where(seen, ga**2 / (ha + RIDGE) + (total_g - ga) ** 2 / (total_h - ha + RIDGE) - total_g**2 / (total_h + RIDGE), 0)
            if len(gain) and gain.max() > top:
                top, cut = gain.max(), (j, int(gain.argmax()))
        if cut is None:
            step = RATE * total_g / (total_h + RIDGE)
            scores[rows] += step
            out[there] += step
            return
        low, below = x[rows, cut[0]] <= cut[1], want[there, cut[0]] <= cut[1]
        grow(rows[low], there[below], g, h, depth - 1)
        grow(rows[~low], there[~below], g, h, depth - 1)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-scores))
        grow(np.arange(len(x)), np.arange(len(want)), positive - n * p, n * p * (1 - p), DEPTH)
    return out.tolist()


def _hidden(x: tuple[int, ...]) -> tuple[int, ...]:
    return (*x[:-1], 0)


def _learnt(rows: list) -> list[tuple[tuple[int, ...], float, float]]:
    """Labelled cells as they are and with their context hidden."""
    sums: dict[tuple[int, ...], list[float]] = {}
    for x, _, label, n, _ in rows:
        if label != UNKNOWN:
            for y in {x, _hidden(x)}:
                own = sums.setdefault(y, [0.0, 0.0])
                own[0] += n
                own[1] += n * label
    return [(x, *own) for x, own in sorted(sums.items())]


def _threshold(held: list[tuple[float, float, float]], precision: float, more: float) -> float:
    """The least score from which on the held-out (score, count, positives) have the precision, counting `more` further errors."""
    n = pos = 0.0
    least = np.inf
    held = sorted(held, reverse=True)
    for i, (score, c, p) in enumerate(held):
        n, pos = n + c, pos + p
        # equal scores stand or fall together
        if (i + 1 == len(held) or held[i + 1][0] < score) and pos >= precision * (n + more):
            least = score
    return least


def accepted_cells(found: DataFrame, precision: float = PRECISION) -> list[str]:
    """The cells whose score reaches their threshold; `found` has `__candidates` and `__fold`. Counts cover all rows.

    The trees learn from base spans and labelled open candidates; thresholds are calibrated on the open ones alone, as base spans stay anyway.
    """
    counted = found.select("__fold", F.explode("__candidates").alias("c")).groupBy("c.cell", "__fold", "c.label").agg(F.count("*").alias("n"), F.count_if("c.open").alias("open"))
    rows = sorted((tuple(map(int, r["cell"].split(","))), r["__fold"], r["label"], float(r["n"]), float(r["open"])) for r in counted.collect())
    untold: dict[int, list] = {}
    support: dict[tuple[int, ...], float] = {}
    for fold in range(FOLDS):
        own = [(_hidden(r[0]), r[2], r[4]) for r in rows if r[1] == fold and r[2] != UNKNOWN and r[4]]
        for (x, label, n), score in zip(own, boost(_learnt([r for r in rows if r[1] != fold]), [x for x, _, _ in own]), strict=True):
            untold.setdefault(x[0], []).append((score, n, n * label))
            support[x] = support.get(x, 0.0) + n
    learnt = _learnt(rows)
    own = [r for r in rows if r[2] != UNKNOWN and r[4]]
    told: dict[int, list] = {}
    for (x, _, label, _, n), score in zip(own, boost(learnt, [r[0] for r in own]), strict=True):
        told.setdefault(x[0], []).append((score, n, n * label))
    limits = {(k, False): _threshold(held, precision, 0) for k, held in told.items()} | {(k, True): _threshold(held, precision, 2) for k, held in untold.items()}
    asked = sorted({(r[0], r[2] == UNKNOWN) for r in rows if r[4] and r[2] != NO})  # no share of errors lets in what evidence speaks against
    out = []
    for (x, unknown), score in zip(asked, boost(learnt, [x for x, _ in asked]), strict=True):
        if score >= limits.get((x[0], unknown), np.inf) and (not unknown or support.get(x, 0) >= SUPPORT):
            out.append(",".join(map(str, x)))
    return sorted(out)


def _apart(spans: Column) -> Column:
    """Of overlapping spans those of the greatest rank; blocks of BLOCK are settled each, then one pass drops what overlaps at their borders."""
    kind = "struct<start:int,end:int,kind:int,rank:int>"
    none = F.array().cast(f"array<{kind}>")
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["rank"].alias("rank"))))

    def settle(block: Column) -> Column:
        best = F.array_sort(F.transform(block, lambda c: F.struct((-c["rank"]).alias("rank"), c["start"].alias("start"), c.alias("c"))))
        free = lambda acc, c: ~F.exists(acc, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))
        return F.array_sort(F.aggregate(best, none, lambda acc, x: F.when(free(acc, x["c"]), F.concat(acc, F.array(x["c"]))).otherwise(acc)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int")), lambda b: settle(F.slice(ordered, b * BLOCK + 1, BLOCK)))
    step = lambda acc, c: F.when(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1)["end"], F.lit(0)) <= c["start"], F.concat(acc, F.array(c))).otherwise(acc)
    return F.when(F.size(spans) > 0, F.aggregate(F.flatten(blocks), none, step)).otherwise(none)


def with_spans(found: DataFrame, accepted: list[str]) -> DataFrame:
    """The rows with `__spans`, array<struct<kind,start,end>> ordered by kind, then start: base spans and accepted open candidates."""
    good = F.filter("__candidates", lambda c: c["open"] & F.array_contains(F.array(*map(F.lit, accepted)).cast("array<string>"), c["cell"]))
    found = found.withColumn("__good", good).withColumn("__good", _apart(F.col("__good")))
    added = F.transform("__good", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.withColumn("__spans", F.array_sort(F.concat("__base", added))).drop("__good")


def find_spans(docs: DataFrame, id_col: str = "doc_id", precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, spans) per row; the text is read once, and only spans and cells are kept for the second pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(with_candidates(with_base(rows)).select("doc_id", "__base", "__fold", "__candidates"), "candidates")
    return with_spans(found, accepted_cells(found, precision)).select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The rows of `docs` with every span of their texts replaced by its kind in brackets; n_chars follows where it is a column.

    The rows are written once with their candidates, which the count of cells and the replacing both read.
    """
    names = docs.columns
    found = materialize(with_candidates(with_base(docs)).drop(*[f"__{k}" for k in KINDS]), "candidates")
    out = with_spans(found, accepted_cells(found, precision))
    spans = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.withColumn("__spans", spans).withColumn("__chunks", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def clean(chunk: Column, i: Column) -> Column:
        low, high = i * CHUNK, i * CHUNK + F.length(chunk)
        own = F.filter("__spans", lambda s: (s["start"] < high) & (s["end"] > low))

        def step(acc: Column, s: Column) -> Column:
            new = s["start"] >= acc["at"]
            kept = F.when(new, F.substr(chunk, acc["at"] - low + 1, s["start"] - acc["at"])).otherwise("")
            mark = F.when(new & (s["start"] >= low), F.get(labels, s["kind"])).otherwise("")
            return F.struct(F.greatest(acc["at"], F.least(s["end"], high)).alias("at"), F.concat(acc["out"], kept, mark).alias("out"))

        # spans that began in an earlier chunk only move the place on
        start = F.struct(F.coalesce(F.array_max(F.transform(F.filter(own, lambda s: s["start"] < low), lambda s: F.least(s["end"], high))), low).alias("at"), F.lit("").alias("out"))
        end = F.aggregate(F.filter(own, lambda s: s["start"] >= low), start, step)
        return F.when(F.size(own) == 0, chunk).otherwise(F.concat(end["out"], F.substr(chunk, end["at"] - low + 1)))

    out = out.withColumn("__text", F.when(F.size("__spans") > 0, F.array_join(F.transform("__chunks", clean), "")).otherwise(F.col("text")))
    changed = {"text": F.col("__text").alias("text")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("__spans") > 0, F.length("__text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[changed.get(c, F.col(f"`{c}`")) for c in names])
