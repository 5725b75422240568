"""Chat formatting with a grammar round trip, in built-in functions only.

A turn is rendered as ``<|turn|>`` role newline text ``<|end|>`` newline. A
deterministic parser reads the rendering back by splitting at the control
strings. Every turn is rendered as it is and parsed again; until that gives back
exactly one turn with the same role and text, the next level of escaping is
rendered, parsed and compared. Two levels are all there can be: escaping puts a
backslash into every look-alike ``<|\\...turn|>`` or ``<|\\...end|>``, so the result
holds no control string, and taking one backslash off every look-alike that has
one gives the source back, whatever it was (in roles backslash and newline are
also written as two letters). A turn for which no level parses back, or a
conversation that does not parse back as a whole, raises an error instead of
writing a wrong record.

The loss mask covers the text of assistant turns.

All turns of one conversation form one output string and therefore meet in one
row; that string (2 GB at most, Spark's limit for a value) bounds a group, not
the table. Groups are formed by one shuffle on the conversation.

Defined cases: null text and null role count as empty; rows are ordered by turn
(null first), ties by role and text; repeated rows are repeated turns; a null
conversation id is a conversation of its own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
_LOOKALIKE = r"<\|(\\*)(turn|end)\|>"
_ESCAPED = r"<\|\\(\\*)(turn|end)\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _LOOKALIKE, r"<|\\$1$2|>")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<|$1$2|>")


def escape_role(role: Column) -> Column:
    # every backslash of the result starts one of the two escapes, so they can be undone one after the other
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendering as ``array<struct<role, text>>``; null when the grammar does not hold."""
    parts = F.split(formatted, r"<\|turn\|>")
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    tail = CLOSE + "\n"
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape_text(
                b.substr(F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(tail))
            ).alias("text"),
        ),
    )
    well_formed = (F.element_at(parts, 1) == "") & F.forall(
        bodies, lambda b: b.endswith(tail) & (F.locate(CLOSE, b) == F.length(b) - len(tail) + 1) & (F.instr(b, "\n") < F.locate(CLOSE, b))
    )
    return F.when(well_formed, turns)


def render_checked(role: Column, text: Column) -> Column:
    """One turn's rendering, escaped only where the plain one does not parse back to its source."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    levels = [render(role, text), render(escape_role(role), escape_text(text))]
    # text without "<|" and role without a backslash or newline cannot conflict; the parser decides for the others
    suspicious = F.contains(text, F.lit("<|")) | role.rlike(r"[<\\\n]")
    found = F.when(~suspicious, levels[0])
    for level in levels:
        found = found.when(parse(level).eqNullSafe(source), level)
    return found.otherwise(F.raise_error(F.lit("no escaping of a turn parses back to its source")))


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, loss_spans``.

    ``turns`` is what the parser read back (``array<struct<role, text>>``) and
    ``loss_spans`` the code point ranges ``[start, stop)`` of assistant texts in
    ``formatted``.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"),
    ).withColumn("rendered", render_checked(F.col("role"), F.col("text")))
    # arrays sort nulls first with sort_array
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("rows"))
    whole = grouped.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), F.length(r["rendered"]).alias("n"),
                                               F.length(F.substring_index(r["rendered"], "\n", 1)).alias("head"))).alias("sizes"),
    ).withColumn("turns", parse(F.col("formatted")))
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["n"]).alias("at"),
            F.when(
                s["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + s["head"] + 1).alias("start"), (acc["at"] + s["n"] - (len(CLOSE) + 1)).alias("stop")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select(
        "conv_id", "formatted",
        F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns"))
        .otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its source"))).alias("turns"),
        spans.alias("loss_spans"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted output, the loss through its mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape_text(cut(s))), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
