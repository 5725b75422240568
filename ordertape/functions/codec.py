"""Message text as columns: parse, serialize, validate, look fields up, group, format.

Everything here is built from Catalyst expressions (``parse_with_data`` alone
needs a Python worker: the extent of a length-prefixed data field depends on a
value read before it). A parsed message is ``array<struct<tag int, value string>>``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ordertape.functions.codes import DATA_FIELDS

SOH = "\x01"
FIELDS_TYPE = "array<struct<tag:int,value:string>>"


def delimiter_of(raw: Column) -> Column:
    """SOH when there is any, else a pipe when there is any, else SOH."""
    return F.when(F.contains(raw, F.lit(SOH)), F.lit(SOH)).when(F.contains(raw, F.lit("|")), F.lit("|")).otherwise(F.lit(SOH))


def _tokens(raw: Column, delimiter: Column | None) -> Column:
    bare = F.regexp_replace(raw, r"[\r\n]+$", "")
    # both delimiters as literals keep the split pattern constant
    soh, pipe = F.split(bare, SOH), F.split(bare, r"\|")
    parts = F.when(delimiter_of(raw) == SOH, soh).otherwise(pipe) if delimiter is None else F.split(bare, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))
    return F.filter(parts, lambda x: x != "")


def _tag(token: Column) -> Column:
    return F.trim(F.substring_index(token, "=", 1)).try_cast("int")


def parse_error(raw: Column, delimiter: Column | None = None) -> Column:
    """Null for a well-formed message, else what is wrong with it."""
    tokens = _tokens(raw, delimiter)
    return (
        F.when(raw.isNull() | (F.regexp_replace(raw, r"[\r\n]+$", "") == ""), F.lit("empty message"))
        .when(F.exists(tokens, lambda x: ~F.contains(x, F.lit("="))), F.lit("field without ="))
        .when(F.exists(tokens, lambda x: _tag(x).isNull()), F.lit("tag is not a number"))
        .when(F.exists(tokens, lambda x: _tag(x) <= 0), F.lit("tag is not positive"))
    )


def parse(raw: Column, delimiter: Column | None = None) -> Column:
    """Fields in order, repeated tags kept; null when :func:`parse_error` finds fault."""
    fields = F.transform(
        _tokens(raw, delimiter),
        lambda x: F.struct(_tag(x).alias("tag"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")),
    )
    return F.when(parse_error(raw, delimiter).isNull(), fields)


def tokens(raw: Column) -> Column:
    """The non-empty pieces between the delimiters of a message."""
    bare = F.rtrim(raw, F.lit("\r\n"))
    parts = F.when(F.contains(raw, F.lit(SOH)), F.split(bare, SOH)).when(F.contains(raw, F.lit("|")), F.split(bare, r"\|")).otherwise(F.array(bare))
    return F.when(raw.isNotNull(), F.array_remove(parts, ""))


def token_tags(found: Column) -> Column:
    return F.transform(found, _tag)


def token_values(found: Column) -> Column:
    return F.transform(found, lambda x: F.substr(x, F.instr(x, "=") + 1))


def token_error(found: Column, tags: Column) -> Column:
    return (
        F.when(found.isNull() | (F.size(found) == 0), F.lit("empty message"))
        .when(F.exists(found, lambda x: ~F.contains(x, F.lit("="))), F.lit("field without ="))
        .when(F.size(F.array_compact(tags)) < F.size(tags), F.lit("tag is not a number"))
        .when(F.array_min(tags) <= 0, F.lit("tag is not positive"))
    )


def has_data_fields(raw: Column) -> Column:
    """Whether a length tag occurs, so that a data value may hold delimiters."""
    return raw.rlike(rf"(^|[\x01|])\s*({'|'.join(map(str, DATA_FIELDS))})\s*=")


def read_fields(text: str | None, delimiter: str) -> list[tuple[int, str]] | None:
    """Sequential reader for messages with length-prefixed data fields; None when malformed."""
    text = (text or "").rstrip("\r\n")
    if not text:
        return None
    out, at, armed = [], 0, None  # armed: (data tag, characters)
    while at < len(text):
        if text[at] == delimiter:
            at += 1
            continue
        eq, stop = text.find("=", at), text.find(delimiter, at)
        stop = len(text) if stop < 0 else stop
        if eq < 0 or eq > stop:
            return None
        name = text[at:eq].strip()
        if not name.lstrip("+-").isdigit() or int(name) <= 0:
            return None
        tag = int(name)
        if armed and armed[0] == tag:
            stop = eq + 1 + armed[1]
            if stop > len(text):
                return None
            armed = None
        value = text[eq + 1:stop]
        if tag in DATA_FIELDS:
            count = value.strip()
            armed = (DATA_FIELDS[tag], int(count)) if count.isdigit() else None
        out.append((tag, value))
        at = stop + 1
    return out


def _read_data(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, delimiter in parts:
        found = [read_fields(t, d) if t is not None else None for t, d in zip(raw, delimiter)]
        yield pd.Series([None if f is None else [{"tag": t, "value": v} for t, v in f] for f in found])


def parse_with_data(raw: Column) -> Column:
    """Like :func:`parse`, honouring length-prefixed data fields; only such messages reach the Python worker with their text."""
    slow = has_data_fields(raw)
    reader = F.pandas_udf(_read_data, FIELDS_TYPE)
    return F.when(slow, reader(F.when(slow, raw), delimiter_of(raw))).otherwise(parse(raw))


def serialize(fields: Column, delimiter: str = SOH) -> Column:
    """The fields as they are, each ended by the delimiter."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["tag"].cast("string"), F.lit("="), f["value"], F.lit(delimiter))), "")


def _latin(text: Column) -> Column:
    """Bytes in ISO-8859-1; characters outside it count as a question mark."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\xff]", "?"), "ISO-8859-1")


def body_length(fields: Column) -> Column:
    """Bytes of all fields but BeginString, BodyLength and CheckSum."""
    body = F.filter(fields, lambda f: ~f["tag"].isin(8, 9, 10))
    return F.octet_length(_latin(serialize(body)))


def checksum(text: Column) -> Column:
    """Sum of the bytes modulo 256, three digits."""
    # ascii() is a character's code point; what ISO-8859-1 lacks counts as a question mark
    code = lambda c: F.when(F.ascii(c) < 256, F.ascii(c)).otherwise(F.lit(63))
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: acc + F.when(c == "", F.lit(0)).otherwise(code(c)))
    return F.lpad((total % 256).cast("string"), 3, "0")


def checksum_of(fields: Column) -> Column:
    """The CheckSum value of a message: over every field but CheckSum."""
    return checksum(serialize(F.filter(fields, lambda f: f["tag"] != 10)))


def checksum_error(fields: Column) -> Column:
    given = first_value(fields, 10)
    return F.when(given.isNull(), F.lit("no checksum")).when(given != checksum_of(fields), F.lit("wrong checksum"))


def strict_error(fields: Column, malformed: Column) -> Column:
    """Faults under the strict grammar: 8, 9, 35 first, 10 last, right BodyLength and CheckSum."""
    first = F.transform(F.slice(fields, 1, 3), lambda f: f["tag"])
    return (
        F.when(malformed.isNotNull(), malformed)
        .when(F.array_join(first, ",") != "8,9,35", F.lit("header is not 8, 9, 35"))
        .when(F.try_element_at(fields, F.lit(-1))["tag"] != 10, F.lit("checksum is not last"))
        .when(~first_value(fields, 9).try_cast("int").eqNullSafe(body_length(fields)), F.lit("wrong body length"))
        .when(first_value(fields, 10) != checksum_of(fields), F.lit("wrong checksum"))
    )


def canonical(fields: Column, begin: str = "FIX.4.2") -> Column:
    """BeginString, recomputed BodyLength, the body in its order, recomputed CheckSum."""
    head = F.coalesce(first_value(fields, 8), F.lit(begin))
    body = serialize(F.filter(fields, lambda f: ~f["tag"].isin(8, 9, 10)))
    text = F.concat(F.lit("8="), head, F.lit(SOH + "9="), F.octet_length(_latin(body)).cast("string"), F.lit(SOH), body)
    return F.concat(text, F.lit("10="), checksum(text), F.lit(SOH))


def header_first(fields: Column, header: tuple[int, ...] = (35, 49, 56, 34, 52)) -> Column:
    """The second dialect's order of emission: these header fields first, the rest as it is (without 8, 9 and 10)."""

    def tagged(tag: int) -> Column:
        return F.filter(fields, lambda f: f["tag"] == tag)

    return F.concat(*(tagged(t) for t in header), F.filter(fields, lambda f: ~f["tag"].isin(8, 9, 10, *header)))


def first_value(fields: Column, tag: int) -> Column:
    return F.try_element_at(F.filter(fields, lambda f: f["tag"] == tag), F.lit(1))["value"]


def all_values(fields: Column, tag: int) -> Column:
    return F.transform(F.filter(fields, lambda f: f["tag"] == tag), lambda f: f["value"])


def has_tag(fields: Column, tag: int) -> Column:
    return F.exists(fields, lambda f: f["tag"] == tag)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a one-element ``transform`` binds it to a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lift(fields: Column, tags: list[int]) -> Column:
    """Array of the first value of each tag; null where it is absent or empty.

    One expression for all tags: a projection with a search for every tag
    becomes a method too large for the JIT compiler, and what the search refers
    to is bound once, as Catalyst moves a column that is named once into the loop.
    """
    arrays = F.struct(F.transform(fields, lambda f: f["tag"]).alias("tags"), F.transform(fields, lambda f: f["value"]).alias("values"))
    first = lambda x: F.transform(F.lit(tags), lambda t: F.get(x["values"], (F.array_position(x["tags"], t) - 1).cast("int")))
    return F.transform(let(arrays, first), lambda v: F.nullif(v, F.lit("")))


def number(value: Column, default: float | None = None) -> Column:
    """Lenient decimal: trimmed; blank or malformed gives the default."""
    found = F.trim(value).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def whole(value: Column, default: int | None = None) -> Column:
    found = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("int"))
    return found if default is None else F.coalesce(found, F.lit(default))


def format_number(value: Column) -> Column:
    """No decimal point for whole numbers below 1e15."""
    return F.when((value == F.rint(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def format_plain(value: Column) -> Column:
    """The second dialect's number format: no exponent, no trailing zeros (twelve digits after the point)."""
    return F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def group(fields: Column, count_tag: int, delimiter_tag: int, members: tuple[int, ...], honour_count: bool = False) -> Column:
    """Entries of a repeating group as ``array<array<struct<tag, value>>>``.

    The delimiter opens an entry, members are appended, the first other tag ends
    the group. The declared count is ignored unless ``honour_count``.
    """
    after = F.array_position(F.transform(fields, lambda f: f["tag"]), F.lit(count_tag)).cast("int")
    rest = F.slice(fields, after + 1, F.size(fields))
    entry = f"array<{FIELDS_TYPE}>"
    state = F.aggregate(
        rest, F.struct(F.array().cast(entry).alias("done"), F.lit(True).alias("open")),
        lambda acc, f: F.struct(
            F.when(~acc["open"] | ~f["tag"].isin(*members), acc["done"])
            .when(f["tag"] == delimiter_tag, F.concat(acc["done"], F.array(F.array(f))))
            .when(F.size(acc["done"]) == 0, acc["done"])
            .otherwise(F.concat(
                F.slice(acc["done"], 1, F.size(acc["done"]) - 1),
                F.array(F.concat(F.try_element_at(acc["done"], F.lit(-1)), F.array(f))),
            )).alias("done"),
            (acc["open"] & f["tag"].isin(*members) & ((f["tag"] == delimiter_tag) | (F.size(acc["done"]) > 0))).alias("open"),
        ),
        lambda acc: acc["done"],
    )
    found = F.when(after > 0, state).otherwise(F.array().cast(entry))
    if honour_count:
        found = F.slice(found, 1, F.greatest(whole(first_value(fields, count_tag), 0), F.lit(0)))
    return found


def utc_timestamp(value: Column) -> Column:
    """``YYYYMMDD-HH:MM:SS[.f+]`` cut to milliseconds; anything else (second 60 too) is null."""
    ok = value.rlike(r"^\d{8}-\d\d:\d\d:\d\d(\.\d+)?$")
    base = F.try_to_timestamp(F.substring(value, 1, 17), F.lit("yyyyMMdd-HH:mm:ss")).cast("timestamp_ntz")
    millis = F.rpad(F.substring(F.regexp_extract(value, r"\.(\d+)$", 1), 1, 3), 3, "0").try_cast("int")
    return F.when(ok, base + F.make_dt_interval(secs=F.coalesce(millis, F.lit(0)) / F.lit(1000.0)))


def epoch_millis(ms: Column) -> Column:
    """UTC time of an epoch millisecond; zero is null."""
    return F.timestamp_millis(F.nullif(ms.cast("bigint"), F.lit(0).cast("bigint"))).cast("timestamp_ntz")


def trading_date(ts: Column, zone: str) -> Column:
    """Calendar date in ``zone`` of a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("date")


def event_time(source: str, arrival: Column, sending: Column, transact: Column) -> Column:
    """ARRIVAL; SENDING_TIME, else arrival; TRANSACT_TIME, else sending time, else arrival."""
    if source == "ARRIVAL":
        return arrival
    return F.coalesce(sending, arrival) if source == "SENDING_TIME" else F.coalesce(transact, sending, arrival)


def path_segment(value: Column) -> Column:
    """A safe path segment: blank or dot-led values become ``_unknown``; at most 96 characters."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    clean = F.left(F.regexp_replace(trimmed, r"[^A-Za-z0-9._-]", "_"), F.lit(96))
    return F.when(value.isNull() | (trimmed == "") | clean.startswith("."), F.lit("_unknown")).otherwise(clean)


def partition_path(template: str, event_date: Column, account: Column, symbol: Column) -> Column:
    """A partition template such as ``yyyy/MM/dd/account={account}`` rendered as a column."""
    return F.concat(*(_piece(p, event_date, account, symbol) for p in template_parts(template)))


def template_parts(template: str) -> list[tuple[bool, str]]:
    """``(is_token, text)`` pieces; unknown tokens, unclosed braces and blank templates are errors."""
    known = ("yyyy", "MM", "dd", "date", "account", "symbol")
    text = "/".join(s for s in template.strip().replace("\\", "/").split("/") if s)
    if not text:
        raise ValueError("blank partition template")
    out, at = [], 0
    while at < len(text):
        start = text.find("{", at)
        if start < 0:
            if "}" in text[at:]:
                raise ValueError("brace is not opened")
            out.append((False, text[at:]))
            break
        if start > at:
            out.append((False, text[at:start]))
        end = text.find("}", start)
        if end < 0:
            raise ValueError("brace is not closed")
        token = text[start + 1:end]
        if token not in known:
            raise ValueError(f"unknown token {token!r}")
        out.append((True, token))
        at = end + 1
    return out


def _piece(part: tuple[bool, str], event_date: Column, account: Column, symbol: Column) -> Column:
    token, text = part
    if not token:
        return F.lit(text)
    if text == "account":
        return path_segment(account)
    if text == "symbol":
        return path_segment(symbol)
    return F.date_format(event_date, "yyyy-MM-dd" if text == "date" else text)
