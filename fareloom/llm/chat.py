"""Chat formatting: conversations of typed content parts as one marked text each, with a loss mask.

Only built-in functions: higher-order functions visit the parts, one aggregate
per conversation puts the turns in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template. A turn is OPEN role BODY parts CLOSE; every control string starts with "<" or "[".
OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}

#: Tokens that an attachment expands to: per image tile, second of audio and document page.
TILE_PIXELS = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 560

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """A backslash behind every "<", "[" and backslash, so that no control string is left; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``: takes away the backslash behind each of the three characters, from the left."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as typed parts; null text is one empty part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("int").alias("pages"),
    )
    return F.array(part)


def _body(part: Column) -> Column:
    """What a part leaves in the text: escaped text, or the placeholder of its type."""
    shown = F.when(part["type"] == "text", escape(part["text"]))
    for kind, mark in PLACEHOLDERS.items():
        shown = shown.when(part["type"] == kind, F.lit(mark))
    return shown.otherwise(F.lit(""))


def _tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text and for unknown sizes."""
    tiles = F.ceil(part["width"] / TILE_PIXELS) * F.ceil(part["height"] / TILE_PIXELS)
    return F.coalesce(
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND))
        .when(part["type"] == "document", part["pages"].cast("bigint") * DOCUMENT_TOKENS_A_PAGE),
        F.lit(0),
    ).cast("bigint")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def format_conversations(
    rows: DataFrame,
    parts: str = "parts",
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
) -> DataFrame:
    """One row per conversation from one row per turn.

    ``parts`` is an array of typed parts (``PARTS``); a column of plain text
    becomes one with ``text_parts``. Returns conv_id and

    * ``formatted``: the turns in order, escaped and marked;
    * ``loss_spans``: array<struct<start, length>>, the code points (from 1) of
      ``formatted`` that are trained on, the body of every assistant turn;
    * ``attachments``: array<struct<index, turn, type, ref, tokens>>, the n-th
      entry belonging to the n-th placeholder;
    * ``expanded_tokens``: the tokens that all placeholders expand to.

    Parts that are null, of unknown or of null type leave nothing. Null roles
    and texts are empty. Turns of the same number follow each other by role and
    text, null numbers come first; repeated rows are repeated turns. Rows without
    a conv_id are one conversation. An empty table gives no rows.
    """
    sound = F.filter(F.coalesce(F.col(parts), F.array().cast(PARTS)), lambda p: p.isNotNull())
    body = F.array_join(F.transform(sound, _body), "")
    refs = F.transform(
        F.filter(sound, _is_attachment),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    head = F.concat(F.lit(OPEN), escape(F.col(role)), F.lit(BODY))
    told = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("body"),
        head.alias("head"),
        refs.alias("refs"),
    )
    # A turn begins where the ones before it end; every turn has marks, so no two begin at the same place.
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turns = placed.select("conv_id", F.struct("start", "turn", "role", "body", "head", "refs").alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(
            (t["start"] + F.char_length(t["head"]) + 1).cast("int").alias("start"),
            F.char_length(t["body"]).alias("length"),
        ),
    )
    listed = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["refs"],
                lambda r: F.struct(
                    t["turn"].alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")
                ),
            ),
        )
    )
    numbered = F.transform(
        "listed",
        lambda r, i: F.struct(
            i.alias("index"), r["turn"].alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")
        ),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return (
        grouped.select(
            "conv_id",
            formatted.alias("formatted"),
            spans.alias("loss_spans"),
            listed.alias("listed"),
        )
        .select("conv_id", "formatted", "loss_spans", numbered.alias("attachments"))
        .withColumn(
            "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"])
        )
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), BODY, 1)).alias("role"),
            unescape(F.substring(x, F.lit(1) + F.char_length(F.substring_index(x, BODY, 1)) + len(BODY), F.lit(1 << 30))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
