import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordertape.functions import codec, codes
from ordertape.operators import messages


def one(spark, raw, *columns):
    rows = messages.parsed(spark.createDataFrame([(raw,)], "raw string"))
    return rows.select(*columns).first()


def test_parse_faults(spark):
    cases = [None, "", "\r\n", "35=D|x", "a=1|", "0=1|", "35=D||55=A=B|\r\n", "1=|", " 35 =D"]
    rows = messages.parsed(spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, raw string")).orderBy("k").collect()
    assert [r.parse_error for r in rows] == [
        "empty message", "empty message", "empty message", "field without =", "tag is not a number", "tag is not positive", None, None, None]
    assert [(f.tag, f.value) for f in rows[6].fields] == [(35, "D"), (55, "A=B")]
    assert [(f.tag, f.value) for f in rows[7].fields] == [(1, "")]


def test_lifting_from_the_text_equals_lifting_from_fields(spark):
    raw = ["35=D|11=a|11=b|55=|38=5|58=x=y|\r\n", "35=8\x0111=p|q\x01", "35=D|x", None, "", "a=1|35=D", "  35 =F|41=z||37=o", "44=1"]
    tape = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "seq int, raw string")
    one = messages.lifted(messages.parsed(tape)).drop("raw", "fields", "parse_error")
    other = messages.lifted_raw(tape)
    assert one.columns == other.columns
    rows = sorted(map(tuple, other.collect()))
    assert sorted(map(tuple, one.collect())) == rows and rows[0][1:5] == ("D", None, None, "a") and rows[6][1] == "F" and set(rows[2][1:]) == {None}


def test_data_fields_hold_delimiters(spark):
    raw = "35=D|354=5|355=a|b=c|58=x|"
    rows = messages.parsed(spark.createDataFrame([(raw,)], "raw string"), with_data=True).first()
    assert [(f.tag, f.value) for f in rows.fields] == [(35, "D"), (354, "5"), (355, "a|b=c"), (58, "x")]
    assert codec.read_fields("354=9|355=ab", "|") is None


def test_canonical_is_strict(spark):
    rows = messages.parsed(spark.createDataFrame([("35=D|11=A|58=caf\u00e9|",)], "raw string")).select(codec.canonical(F.col("fields")).alias("m"))
    checked = messages.strictly_parsed(rows, "m").first()
    assert checked.strict_error is None
    body = "35=D\x0111=A\x0158=caf\u00e9\x01"
    text = f"8=FIX.4.2\x019={len(body.encode('latin-1'))}\x01{body}"
    assert checked.m == f"{text}10={sum(text.encode('latin-1')) % 256:03d}\x01"
    bad = messages.strictly_parsed(spark.createDataFrame([(checked.m.replace("11=A", "11=B"),), ("35=D|8=x|",)], "m string"), "m").collect()
    assert [b.strict_error for b in bad] == ["wrong checksum", "header is not 8, 9, 35"]


def test_groups_end_at_the_first_other_tag(spark):
    fields = codec.parse(F.lit("35=D|78=5|79=A|80=10|79=B|55=X|79=C|"))
    row = spark.range(1).select(codec.group(fields, 78, 79, (79, 80)).alias("g"), codec.group(fields, 78, 79, (79, 80), True).alias("h")).first()
    assert [[(f.tag, f.value) for f in e] for e in row.g] == [[(79, "A"), (80, "10")], [(79, "B")]] and row.h == row.g


def test_times_and_codes(spark):
    row = spark.range(1).select(
        codec.utc_timestamp(F.lit("20260814-13:30:60.000")).alias("bad"), codec.utc_timestamp(F.lit("20260814-13:30:01.1")).cast("string").alias("good"),
        codes.decode("ord_status", F.lit("D")).alias("a"), codes.decode("exec_type", F.lit("D")).alias("b"), codes.decode("side", F.lit("?")).alias("c"),
        codes.decode("exec_trans_type", F.lit(None).cast("string")).alias("d"), codec.path_segment(F.lit(" A/B ")).alias("p"), codec.path_segment(F.lit(".x")).alias("q"),
    ).first()
    assert tuple(row) == (None, "2026-08-14 13:30:01.1", "ACCEPTED_FOR_BIDDING", "RESTATED", "UNSPECIFIED", "NEW", "A_B", "_unknown")
    for template in ("", "{yyyy", "{nope}"):
        with pytest.raises(ValueError):
            codec.template_parts(template)


value = st.text(st.characters(min_codepoint=32, max_codepoint=255, exclude_characters="|\x01\x7f"), max_size=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9999).filter(lambda t: t not in codes.DATA_FIELDS), value), min_size=1, max_size=8))
def test_serialize_inverts_parse(spark, fields):
    raw = "".join(f"{t}={v}\x01" for t, v in fields)
    assert one(spark, raw, codec.serialize(F.col("fields")).alias("s")).s == raw
    assert codec.read_fields(raw, "\x01") == fields
