"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is a list of parts ``(type, text, ref, size)``. A visitor over the list writes text parts
escaped and every other part as a placeholder of its type, in order, and records the attachment: its
reference, its placeholder's number in the conversation and the tokens it expands to. A turn becomes
``<|turn|>role\\ncontent<|end|>\\n``; a conversation is its turns in order.

Escaping is reversible: a backslash goes behind every backslash and behind the first character of every
control string in a text (see :data:`CONTROL`), so no control string is left in it, and dropping the
backslashes gives the text back. The loss mask is a list of spans over the formatted text, one for the
content of each assistant turn.

A conversation becomes one row, as its output is one text; its turns are gathered once by one shuffle.
Defined results: null text, role or parts are empty; turns with equal numbers are ordered by role and
content; a null conversation id is a conversation of its own; unknown types are attachments of type ``file``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.binding import bind

TURN, END = "<|turn|>", "<|end|>\n"
ROLE = "assistant"
#: Control strings that a text may not hold unescaped: anything in ``<|``, and the marks of other chat templates.
CONTROL = r"(\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
#: Size units a placeholder's token stands for: pixels, milliseconds, bytes, bytes.
UNITS = {"image": 784, "audio": 40, "document": 4, "file": 4}
PARTS = "array<struct<type:string, text:string, ref:string, size:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one text."""
    nothing = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.cast("string").alias("text"),
            nothing.cast("string").alias("ref"),
            nothing.cast("long").alias("size"),
        )
    ).cast(PARTS)


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("file"))
    return F.when(kind.isin("text", *UNITS), kind).otherwise("file")


def _content(parts: Column) -> Column:
    """The parts of a turn as written: texts escaped, all others as placeholders.

    Texts side by side are joined before they are escaped, so no control string forms where they meet.
    """

    def between(marks: Column) -> Column:
        """Texts and placeholders in turn; ``marks`` are the places of the parts that are no text."""
        edges = F.concat(F.array(F.lit(-1)), marks, F.array(F.size(parts)))

        def piece(edges: Column, k: Column) -> Column:
            low, high = F.get(edges, k), F.get(edges, k + 1)
            own = F.transform(F.sequence(low + 1, high - 1), lambda i: F.coalesce(F.get(parts, i)["text"], F.lit("")))
            text = F.when(high - low > 1, escape(F.array_join(own, ""))).otherwise("")
            mark = F.concat(F.lit("<|"), _kind(F.get(parts, high)), F.lit("|>"))
            return F.concat(text, F.when(k < F.size(edges) - 2, mark).otherwise(""))

        pieces = bind(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: piece(e, k)))
        return F.array_join(pieces, "")

    numbers = F.transform(parts, lambda p, i: F.when(_kind(p) != "text", i))
    return bind(F.filter(numbers, lambda i: i.isNotNull()), between)


def _attachment(part: Column) -> Column:
    kind = _kind(part)
    unit = F.lit(None)
    for name, size in UNITS.items():
        unit = F.when(kind == name, size).otherwise(unit)
    tokens = F.greatest(F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / unit)).cast("long")
    return F.struct(kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """``(<conv>, formatted, loss_spans, attachments, placeholder_tokens)``, one row per conversation.

    ``loss_spans``: ``(turn, at, start, length)`` in code points: the turn's number from 0, the place in the turn
    and in the whole. ``attachments``: ``(type, ref, tokens)`` in placeholder order.
    """
    given = F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS))
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        bind(given, _content).alias("content"),
        F.transform(F.filter(given, lambda p: _kind(p) != "text"), _attachment).alias("files"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "content", F.to_json("files"))
    rows = rows.withColumn("number", F.row_number().over(order) - 1).withColumn(
        "start", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    one = F.struct(
        "number",
        "segment",
        "files",
        F.coalesce("start", F.lit(0)).alias("start"),
        F.length("head").alias("at"),
        F.length("content").alias("length"),
        (F.col("role") == ROLE).alias("loss"),
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("t"))
    spans = F.transform(
        F.filter("t", lambda x: x["loss"]),
        lambda x: F.struct(
            x["number"].alias("turn"), x["at"].alias("at"), (x["start"] + x["at"]).alias("start"), x["length"].alias("length")
        ),
    )
    files = F.flatten(F.transform("t", lambda x: x["files"]))
    out = whole.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        files.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda total, x: total + x["tokens"])
    return out.withColumn("placeholder_tokens", tokens)


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their end."""
    return F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """``(role, text)`` of every turn; placeholders stay as they are written."""
    pattern = r"(?s)^<\|turn\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(
        segments(formatted),
        lambda x: F.struct(
            unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    own = segments(formatted)
    return F.transform(
        spans, lambda s: unescape(F.substring(F.get(own, s["turn"]), s["at"] + F.lit(1), s["length"]))
    )
