"""Chat formatting with typed content parts, on DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, units).  A visitor maps
each part to its piece of text: text parts are escaped, image, audio and
document parts become numbered placeholders whose reference and expanded token
count are recorded.  A turn is written as::

    <|turn|>ROLE<|text|>CONTENT</s>

Escaping puts a backslash after each ``<``, ``[`` and backslash of a role or
text, so no control string (all begin with ``<`` or ``[``) occurs in escaped
text, not even across part borders, and removing those backslashes restores it.

Loss spans are (start, length) in code points of the formatted text and cover
the content of each assistant turn, nothing else.

Null roles, texts and part arrays count as empty; a part of an unknown kind is a
placeholder of that kind without tokens.  Equal turn numbers are ordered by
role and text.  Repeated rows are turns of their own.  Rows of one conversation
meet in one task, since its text is one value; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
PART = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
#: Tokens that one unit (tile, second, page) of an attachment expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 50, "document": 512}


def escape(text: Column) -> Column:
    """Insert a backslash after each ``<``, ``[`` and backslash."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_parts(text: Column) -> Column:
    """A text as an array of one text part."""
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return F.array(part).cast(PART)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _tokens(part: Column, per_unit: dict[str, int]) -> Column:
    rate = F.lit(0)
    for kind, n in per_unit.items():
        rate = F.when(part["kind"] == kind, n).otherwise(rate)
    return (rate * F.coalesce(part["units"], F.lit(1))).cast("long")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", per_unit: dict[str, int] | None = None) -> DataFrame:
    """One row per conversation: formatted, n_turns, loss_spans, attachments, expanded_tokens.

    ``attachments`` are ordered (ordinal, turn, kind, ref, tokens) structs; the
    placeholder of ordinal 2 and kind image is ``<|image 2|>``.
    """
    per_unit = TOKENS_PER_UNIT if per_unit is None else per_unit
    role, parts = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(parts_col), F.array().cast(PART))
    order = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts"))
        .withColumn("files", F.filter("parts", lambda p: ~_is_text(p)))
        .withColumn("first_file", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
        .withColumn("k", F.row_number().over(order))
        .withColumn(
            # a visitor over the parts: position of a file = files of earlier turns + files before it here
            "content",
            F.array_join(
                F.transform(
                    "parts",
                    lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                        F.concat(
                            F.lit("<|"),
                            escape(p["kind"]),
                            F.lit(" "),
                            (F.col("first_file") + F.size(F.filter(F.slice("parts", F.lit(1), i), lambda q: ~_is_text(q)))).cast("string"),
                            F.lit("|>"),
                        )
                    ),
                ),
                "",
            ),
        )
        .withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
        .withColumn("piece", F.concat("head", "content", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
        .select(
            "conv",
            "k",
            "piece",
            F.when(F.col("role") == "assistant", F.struct(F.col("at").cast("long").alias("start"), F.length("content").cast("long").alias("length"))).alias("span"),
            F.transform(
                "files",
                lambda p, i: F.struct(
                    (F.col("first_file") + i).cast("long").alias("ordinal"), F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p, per_unit).alias("tokens")
                ),
            ).alias("files"),
        )
    )
    held = F.array_sort(F.collect_list(F.struct("k", "piece", "span", "files")))
    return (
        turns.groupBy("conv")
        .agg(held.alias("turns"))
        .select(
            F.col("conv").alias(conv_col),
            F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
            F.size("turns").cast("long").alias("n_turns"),
            F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
            F.flatten(F.transform("turns", lambda t: t["files"])).alias("attachments"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped; placeholders stay in the text."""
    segments = F.split(formatted, END, -1)
    pieces = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return F.transform(
        pieces,
        lambda s: F.struct(
            unescape(F.substring_index(F.substring(s, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
            unescape(F.substring_index(s, TEXT, -1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
