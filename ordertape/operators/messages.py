"""From wire text to message rows: parse, lift tags to columns, archive rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertape.functions import codec
from ordertape.plans import session
from ordertape.schema import FIX_MESSAGES, LIFTED

CAPTURED = ("D", "G", "F", "8", "9", "Q")


def parsed(tape: DataFrame, raw_col: str = "raw", with_data: bool = False) -> DataFrame:
    """``tape`` with ``fields`` (null for a malformed message) and ``parse_error``."""
    raw = F.col(raw_col)
    # each step is named more than once, so Catalyst computes it once and refers to it
    found = tape.withColumn("__tokens", codec.tokens(raw)).withColumn("__tags", codec.token_tags(F.col("__tokens")))
    checked = found.withColumn("parse_error", codec.token_error(F.col("__tokens"), F.col("__tags")))
    fields = F.when(F.col("parse_error").isNull(), F.arrays_zip(F.col("__tags"), codec.token_values(F.col("__tokens")).alias("__values")).cast(codec.FIELDS_TYPE))
    if with_data:
        slow = codec.has_data_fields(raw)
        fields = F.when(slow, codec.parse_with_data(F.when(slow, raw))).otherwise(fields)
    return checked.withColumn("fields", fields).drop("__tokens", "__tags")


def strictly_parsed(tape: DataFrame, raw_col: str = "raw") -> DataFrame:
    """:func:`parsed` under the strict grammar: ``strict_error`` says what is wrong (pipes stand for SOH)."""
    rows = parsed(tape.withColumn("__raw", F.replace(F.col(raw_col), F.lit("|"), F.lit(codec.SOH))), "__raw").drop("__raw")
    return rows.withColumn("strict_error", codec.strict_error(F.col("fields"), F.col("parse_error")))


def lifted(messages: DataFrame, fields_col: str = "fields") -> DataFrame:
    """First value of every known tag as a text column; empty values are null.

    Plans that filter or join lifted rows should read them from a stage table:
    Catalyst moves a filter below the projection and repeats the parser in it.
    """
    found = messages.withColumn("__found", codec.lift(F.col(fields_col), [tag for tag, _ in LIFTED.values()]))
    return found.withColumns({n: F.get("__found", F.lit(k)) for k, n in enumerate(LIFTED)}).drop("__found")


def _plain_values(columns: tuple[str, ...], rest: str):
    """Reader of record batches whose last column is the text: the other columns, the lifted ``columns``, and the texts it leaves to the parser.

    Tokens of a whole batch are found and compared as arrays. A text is left (and has only nulls) unless every token, the last one too, is ended
    by one kind of delimiter and is a number without sign, blanks or leading zero, an equals sign and a value.
    """
    tags = [LIFTED[c][0] for c in columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, n = batch.column(batch.num_columns - 1).cast(pa.string()), batch.num_rows
            _, offsets, data = raw.buffers()
            at = np.frombuffer(offsets, np.int32)[raw.offset:raw.offset + n + 1]
            text = np.frombuffer(data, np.uint8)[:at[-1]] if data is not None else np.empty(0, np.uint8)
            soh, pipe = np.flatnonzero(text == 1), np.flatnonzero(text == 124)
            stops = np.union1d(soh, pipe) if len(soh) else pipe
            stops = stops[np.searchsorted(stops, at[0]):]
            row = np.searchsorted(at[1:], stops, "right")
            plain = at[1:] > at[:-1]
            if len(text):
                plain &= np.isin(text[np.maximum(at[1:], 1) - 1], (1, 124))
            if len(soh):
                has = lambda found: np.searchsorted(found, at[1:]) > np.searchsorted(found, at[:-1])  # noqa: B023, E731
                plain &= ~(has(soh) & has(pipe))
            begins = np.empty(len(stops), np.int64)
            begins[1:] = stops[:-1] + 1
            first = np.ones(len(stops), bool)
            first[1:] = row[1:] != row[:-1]
            begins[first] = at[:-1][row[first]]
            signs = np.append(np.flatnonzero(text == 61), len(text))
            sign = signs[np.searchsorted(signs, begins)]
            width = sign - begins
            bad = (sign >= stops) | (width < 1) | (width > 9)
            width = np.where(bad, 0, width)
            tag = np.zeros(len(stops), np.int64)
            for k in range(int(width.max(initial=0))):
                inside = k < width
                digit = text[np.where(inside, begins + k, 0)].astype(np.int64) - 48
                bad |= inside & ((digit < 0) | (digit > 9) | ((k == 0) & (digit == 0)))
                tag = np.where(inside, tag * 10 + digit, tag)
            plain[row[bad]] = False
            # values and what lies between them, as one array over the text: every second entry is a value
            bounds = np.empty(2 * len(stops), np.int32)
            bounds[0::2], bounds[1::2] = np.where(sign >= stops, stops, sign + 1), stops
            pieces = pa.StringArray.from_buffers(max(2 * len(stops) - 1, 0), pa.py_buffer(bounds if len(stops) else np.zeros(1, np.int32)), data)
            full = (bounds[1::2] > bounds[0::2]) & plain[row]
            out = [batch.column(k) for k in range(batch.num_columns - 1)]
            for t in tags:
                mine = np.flatnonzero(tag == t)
                owner = row[mine]
                once = np.ones(len(mine), bool)
                once[1:] = owner[1:] != owner[:-1]
                mine = mine[once]
                mine = mine[full[mine]]
                index = np.full(n, -1, np.int64)
                index[row[mine]] = 2 * mine
                out.append(pieces.take(pa.array(index, mask=index < 0)))
            out.append(pc.if_else(pa.array(plain), pa.scalar(None, pa.string()), raw))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], *columns, rest])

    return read


def lifted_raw(tape: DataFrame, raw_col: str = "raw", columns: tuple[str, ...] | None = None, keep_raw: bool = False) -> DataFrame:
    """``lifted(parsed(tape))`` without the fields and the text (with it on ``keep_raw``), or only the lifted ``columns``.

    Texts of the usual form are read batch by batch (:func:`_plain_values`); any other text goes through the parser's expressions, whose
    projection is larger than the JIT compiler takes as one method, so the session is tuned to have it split.
    """
    session.tune(tape.sparkSession)
    names = tuple(LIFTED) if columns is None else tuple(n for n in LIFTED if n in columns)
    kept = [c for c in tape.columns if keep_raw or c != raw_col]
    schema = T.StructType([*(tape.schema[c] for c in kept), *(T.StructField(n, T.StringType()) for n in (*names, "__rest"))])
    read = tape.select(*kept, F.col(raw_col).alias("__raw")).mapInArrow(_plain_values(names, "__rest"), schema)
    found = read.withColumn("__tokens", codec.tokens(F.col("__rest"))).withColumn("__tags", codec.token_tags(F.col("__tokens")))
    checked = found.withColumn("__error", codec.token_error(F.col("__tokens"), F.col("__tags")))
    values = checked.withColumn("__values", F.when(F.col("__error").isNull(), codec.token_values(F.col("__tokens"))))
    at = lambda tag: F.get("__values", (F.array_position("__tags", F.lit(tag)) - 1).cast("int"))
    other = F.col("__rest").isNotNull()
    rows = values.withColumns({n: F.when(other, F.nullif(at(LIFTED[n][0]), F.lit(""))).otherwise(F.col(n)) for n in names})
    return rows.drop("__tokens", "__tags", "__error", "__values", "__rest")


def typed(name: str) -> Column:
    """A lifted text column as its archive type (malformed numbers and times are null)."""
    kind, c = LIFTED[name][1], F.col(name)
    if isinstance(kind, T.DoubleType):
        return codec.number(c)
    if isinstance(kind, T.IntegerType):
        return codec.whole(c)
    if isinstance(kind, T.LongType):
        return F.trim(c).try_cast("bigint")
    return codec.utc_timestamp(c) if isinstance(kind, T.TimestampNTZType) else c


def raw_rows(messages: DataFrame, writer_id: str, source: str = "ARRIVAL", zone: str = "UTC", captured: tuple[str, ...] = CAPTURED,
             keep_raw: bool = True, delimiter: str = codec.SOH, only: tuple[str, ...] | None = None) -> DataFrame:
    """Archive rows (:data:`FIX_MESSAGES`) of captured message types.

    ``messages`` has ``seq, ts`` (arrival), ``fields`` and optionally ``raw``;
    without a raw text the fields are serialized again. Messages that were not
    parsed yet (``seq, ts, raw``) are lifted straight from their text.
    With ``only``, the other lifted columns (but the type) are left null.
    """
    needed = None if only is None else {"msg_type", *only, *({"SENDING_TIME": ("sending_ts",), "TRANSACT_TIME": ("sending_ts", "transact_ts")}.get(source, ()))}
    rows = lifted(messages) if "fields" in messages.columns else lifted_raw(messages, columns=needed and tuple(needed), keep_raw=True)
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in LIFTED if n not in rows.columns}).where(F.col("msg_type").isin(*captured))
    text = F.col("raw") if "fields" not in messages.columns else F.coalesce(F.col("raw"), codec.serialize(F.col("fields"), delimiter)) if "raw" in messages.columns else codec.serialize(F.col("fields"), delimiter)
    values = {n: typed(n) for n in LIFTED}
    when = codec.event_time(source, F.col("ts"), values["sending_ts"], values["transact_ts"])
    rows = rows.select(
        when.alias("ts"), F.lit(writer_id).alias("writer_id"), F.col("seq").alias("ingest_seq"), *(v.alias(n) for n, v in values.items()),
        (text if keep_raw else F.lit(None).cast("string")).alias("raw_fix"),
    ).withColumn("event_date", codec.trading_date(F.col("ts"), zone))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in FIX_MESSAGES.fields))


def only(messages: DataFrame, msg_type: str) -> DataFrame:
    """Rows of one declared type; a row that states another type is an error, a missing type is tolerated."""
    fine = F.coalesce(F.col("msg_type") == msg_type, F.lit(True))
    return messages.where(F.assert_true(fine, F.concat(F.lit(f"expected {msg_type}, got "), F.col("msg_type"))).isNull())


def replay(log: DataFrame, after: int, seq_col: str = "seq") -> DataFrame:
    """The log past a sequence number, in order."""
    return log.where(F.col(seq_col) > after).orderBy(seq_col)
