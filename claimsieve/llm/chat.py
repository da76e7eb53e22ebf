"""Chat formatting with typed content parts, with DataFrame functions only.

A message has content parts ``struct<type, text, ref, amount>``: ``text``; ``image`` (``amount``: pixels), ``audio``
(seconds) and ``document`` (pages).  A visitor, one branch per type, turns the parts of a message into one string:
escaped text, or an ordered placeholder ``<|image 3|>`` whose number counts the attachments of the conversation, and
records reference, type and expanded token count of every attachment.

A turn is ``<|turn role|>`` line feed, body, ``<|end|>`` line feed.  In roles and texts ``\\`` is written ``\\\\``, ``<``
is ``\\l`` and, in roles, a line feed is ``\\n``; so no control string can come from a text, and escaping is reversed
without loss.  The loss mask is a list of code point ranges of the formatted string: the bodies of assistant turns.

Defined results: null text is empty; a null role is an empty role; unknown part types are kept as an ``attachment``
placeholder with no tokens; rows with the same turn follow by role and text; rows with a null ``conv_id`` are one
conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<|turn ", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
#: Tokens that an attachment expands to: one per so many pixels, one per so much of a second, so many a page.
PIXELS_A_TOKEN, TOKENS_A_SECOND, TOKENS_A_PAGE = 784, 25, 512


def escape(text: F.Column) -> F.Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: F.Column) -> F.Column:
    """Pairs of backslashes are cut out from the left; what is between them has single escapes only."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def _escape_role(role: F.Column) -> F.Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def text_parts(text: F.Column) -> F.Column:
    """A plain text as the only part of a message."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("double").alias("amount")))


def _tokens(part: F.Column) -> F.Column:
    amount = F.greatest(F.coalesce(part["amount"], F.lit(0.0)), F.lit(0.0))
    return (
        F.when(part["type"] == "image", F.ceil(amount / PIXELS_A_TOKEN))
        .when(part["type"] == "audio", F.ceil(amount * TOKENS_A_SECOND))
        .when(part["type"] == "document", F.ceil(amount) * TOKENS_A_PAGE)
        .otherwise(0)
    ).cast("long")


def _is_text(part: F.Column) -> F.Column:
    return F.coalesce(part["type"], F.lit("")) == "text"


def _visit(part: F.Column, number: F.Column) -> F.Column:
    """A part as it stands in the body; ``number`` counts attachments."""
    kind = F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("attachment")
    return F.when(_is_text(part), escape(part["text"])).otherwise(F.concat(F.lit("<|"), kind, F.lit(" "), number.cast("string"), F.lit("|>")))


def format_conversations(messages: DataFrame, parts: F.Column | None = None) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens`` of every conversation.

    ``messages`` has ``conv_id, turn, role`` and either ``text`` or ``parts``, a column of content parts."""
    content = F.coalesce(text_parts(F.col("text")) if parts is None else parts, F.array().cast("array<struct<type:string,text:string,ref:string,amount:double>>"))
    rows = messages.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), content.alias("parts")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    before = lambda i: F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda a, m: a + F.size(F.filter(m["parts"], lambda p: ~_is_text(p))))
    turn_texts = F.transform(
        "turns",
        lambda m, i: F.struct(
            F.concat(F.lit(OPEN), _escape_role(m["role"]), F.lit(HEAD_END)).alias("head"),
            F.concat_ws("", F.transform(m["parts"], lambda p, k: _visit(p, before(i) + F.size(F.filter(F.slice(m["parts"], F.lit(1), k), lambda q: ~_is_text(q))) + 1))).alias("body"),
            (m["role"] == ASSISTANT).alias("learn"),
        ),
    )
    attached = F.filter(F.flatten(F.col("turns.parts")), lambda p: ~_is_text(p))
    shaped = grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), turn_texts.alias("t"),
        F.transform(attached, lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: F.Column, t: F.Column) -> F.Column:
        body = a["at"] + F.length(t["head"])
        end = body + F.length(t["body"])
        span = F.array(F.struct(body.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(t["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return shaped.select(
        "conv_id", "n_turns", F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))).alias("formatted"),
        F.aggregate("t", start, step, lambda a: a["spans"]).alias("loss_spans"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def parse(formatted: F.Column) -> F.Column:
    """Turns ``array<struct<role, body>>`` of a formatted string, unescaped (placeholders stay)."""
    raw = F.slice(F.split(formatted, r"<\|turn ", -1), 2, 1_000_000_000)

    def turn(x: F.Column) -> F.Column:
        at = F.locate(HEAD_END, x)
        body = F.substring(x, at + len(HEAD_END), F.length(x) - at - (len(HEAD_END) - 1) - len(CLOSE))
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(body).alias("body"))

    return F.transform(raw, turn)


def loss_text(formatted: F.Column, spans: F.Column) -> F.Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
