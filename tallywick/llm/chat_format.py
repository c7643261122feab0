"""Chat formatting with typed content parts, in DataFrame functions only.

A row is one turn. Its parts (text, image, audio, document) are visited in order and flattened to
text and placeholders; attachments are recorded with their turn, place and expanded token count.
A conversation becomes one string of frames

    <|turn|>role NEWLINE content<|end|> NEWLINE

Control strings inside texts and roles are broken by a backslash after their first character, and
backslashes are doubled, so `unescape` gives back the text exactly. A text part that follows another one
begins with JOINT, which reads back as nothing, so that no control string can come about where two parts meet. The loss mask is a list of
(turn, start, length) in code points from the turn's frame start, one per text part of an assistant turn.

Defined results: null text, role or parts are empty; rows of equal turn are ordered by role, then
text, then attachments, by code point and with null turns first; repeated rows are repeated turns; null conversation ids form one conversation; an empty table
gives an empty table; other input columns are not read. A very long text is treated like any; a conversation is one output string and so
has to fit one row; that is the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own marks first, then those of other common templates.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
# Placeholder and tokens that an attachment takes where the part states none.
PLACEHOLDERS = {"image": ("<|image|>", 576), "audio": ("<|audio|>", 750), "document": ("<|document|>", 1024)}

#: Stands between two text parts; no escaped text holds it.
JOINT = "\\&"

PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(?:&|(.))", "$1")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own, so a newline is written as backslash, `n`."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a backslash before `n` stands for a newline where an even number of backslashes stands before it
    return unescape(F.regexp_replace(role, r"(\G|[^\\])((?:\\\\)*)\\n", "$1$2\n"))


def text_part(text: Column) -> Column:
    """One text part, for tables whose turns are plain strings."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _visit(part: Column) -> Column:
    """What one part becomes in the content; unknown types are written as text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, (mark, _) in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, (_, n) in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(n))).otherwise(out)
    return out


def _order(a: Column, b: Column) -> Column:
    """By turn, role, text and attachments; texts are read back only where the rest is equal, as escaping does not keep their order."""

    def by(x: Column, y: Column) -> Column:
        return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    turn, role, text = by(a["turn"], b["turn"]), by(a["role"], b["role"]), by(unescape(a["content"]), unescape(b["content"]))
    return F.when(turn != 0, turn).when(role != 0, role).when(text != 0, text).otherwise(by(a["files"], b["files"]))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) per conversation."""
    parts = (text_part(F.col(text)) if parts is None else F.coalesce(parts, F.array().cast(f"array<{PART}>"))).cast(f"array<{PART}>")
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), parts.alias("parts"))
    is_text = lambda p: ~F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))
    joined = lambda p, i: F.when((i > 0) & is_text(p) & is_text(F.get(F.col("parts"), i - 1)), F.concat(F.lit(JOINT), _visit(p))).otherwise(_visit(p))
    turns = turns.withColumn("flat", F.transform("parts", joined)).withColumn("head", escape_role(F.col("role")))
    # where each part starts in the frame: a running sum over the row's few parts
    starts = F.aggregate(
        F.transform("flat", lambda x: F.length(x).cast("long")),
        F.struct((F.length("head") + 1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    turns = turns.withColumn("starts", starts)
    turns = turns.select(
        "conv_id",
        F.struct(
            "turn", "role", F.array_join("flat", "").alias("content"), "head",
            F.filter(F.transform("parts", lambda p, i: F.struct(F.col("starts")[i].alias("start"), F.length(F.col("flat")[i]).cast("long").alias("length"), (is_text(p) & (F.col("role") == "assistant")).alias("loss"))), lambda s: s["loss"]).alias("loss"),
            F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["type"].isin(*PLACEHOLDERS)).alias("files"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _order).alias("ts"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(F.lit(TURN), t["head"], F.lit("\n"), t["content"], F.lit(END + "\n"))), "").alias("formatted"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["loss"], lambda s: F.struct(i.alias("turn"), s["start"].alias("start"), s["length"].alias("length"))))).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["files"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ts", lambda t: F.transform(t["files"], lambda a: a["tokens"].cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text, formatted_chars), parsed from the formatted string and its mask alone."""
    frames = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 2**31 - 1)
    cut = formatted.withColumn("frames", frames)
    role = lambda f: F.substring_index(f, "\n", 1)
    body = lambda f: F.substr(f, F.length(role(f)) + 2, F.length(f) - F.length(role(f)) - F.lit(1 + len(END) + 1))
    return cut.select(
        "conv_id",
        F.transform("frames", lambda f: F.struct(unescape_role(role(f)).alias("role"), unescape(body(f)).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("frames"), s["turn"]), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
