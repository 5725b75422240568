"""The tape, the lift and the fold in one pass, against the forms that they stand for."""

from pyspark.sql import functions as F

from ordertape import queries
from ordertape.operators import chain, fold, messages
from ordertape.plans import stage, tape
from ordertape.plans.tape import RAW, TAPE
from tests import golden

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "|", "\r\n", "35=D|11=a|", "35=D|11=a", "35=D|11=a|\r\n", "35=D\x0111=b\x01", "35=D\x0111=b|c\x01", " 35 =D|11=a|", "035=D|11=x|", "+35=8|11=y|", "-35=8|",
    "x=1|35=D|", "35=D||11=q|", "35=D|11=|11=z|", "35=D|11=a=b|58=ü€😀|", "=1|35=D|", "35|11=a|", "0=1|35=D|", "35=D|1111111111=4|", "35=D|999999999999=4|", "35=D|58=x\ny|1=k|",
    "35=D|11=v\x01", "\x0135=D\x01", "35=D|11=dup|11=dup2|", "35=D|99999999=1|55=S|", "35=8|35=9|", "35=D|11=é|37= |",
]



def test_the_tape_of_one_pass_is_that_of_the_union(spark, tmp_path):
    """also orders without lines, lines without orders, lines without a quantity and an order that occurs twice."""
    for name in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        key = rows.columns[0]
        odd = rows.where(f"{key} <= 40").withColumn(key, F.when(F.col(key) < 5, None).when(F.col(key) < 9, F.col(key) + (0 if name == "orders" else 900000)).otherwise(F.col(key)))
        odd.unionByName(odd.where(f"{key} = 20") if name == "orders" else odd.where(f"{key} = 21").withColumn("l_quantity", F.lit(None).cast("double"))).write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (SF, str(tmp_path)):
        tape.views(spark, folder, ("orders", "lineitem"))
        union = spark.sql(f"WITH {TAPE} SELECT seq, ts, {RAW} AS raw FROM tape")
        once = tape.derived(spark, folder)
        assert union.count() == once.count() > 0 and union.exceptAll(once).count() == 0


def test_texts_are_lifted_as_the_parser_does(spark):
    texts = [*ODD, *(f"35=D|34={k}|11=C{k}|" for k in range(300)), *ODD[::-1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq bigint, raw string").coalesce(1)
    parsed = messages.lifted(messages.parsed(rows)).drop("fields", "parse_error", "raw")
    assert sorted(map(str, messages.lifted_raw(rows).collect())) == sorted(map(str, parsed.collect()))
    two = messages.lifted_raw(rows, columns=("exec_id", "cl_ord_id"))
    assert two.columns == ["seq", "cl_ord_id", "exec_id"] and two.where("cl_ord_id is not null").count() == parsed.where("cl_ord_id is not null").count()


def test_chosen_columns_are_those_of_whole_versions(spark):
    lifted = stage.save(messages.lifted(messages.parsed(golden.messages(spark))), "golden")
    resolved = stage.save(chain.resolve(lifted), "resolved")
    whole = stage.save(fold.versions(resolved), "whole")
    for c in (*whole.columns, "prev_ord_status"):
        columns = tuple(dict.fromkeys(("seq", c)))
        read = resolved.select(*dict.fromkeys(("chain_id", "seq", "ts", *fold.inputs(columns))))
        found = fold.versions(read, columns=columns)
        expected = whole.withColumn("prev_ord_status", F.expr("lag(ord_status) over (partition by chain_id order by seq)"))
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(*columns).collect())), c


def test_single_pass_queries_hold_no_second_copy(spark, tmp_path):
    """F1, F2, F4, F5, F10, F16, F19, F21: the tape is not stored for a plan that reads it once, no message is joined with itself, and none is parsed twice."""
    names = ("fold_bookkeeping", "fold_status", "c12_typed_messages", "c13_typed_round_trip", "p4_raw_rows", "w5_previous_order_status", "a3_rollup_on_read", "j3_by_symbol_now")
    for k, name in enumerate(names):
        (tmp_path / str(k)).symlink_to(SF)
        folder = str(tmp_path / str(k))
        rows = queries.queries()[name](spark, folder)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not stage.held(spark, "wire", folder) and not stage.held(spark, "lifted", folder), name
        assert plan.count("Generate explode") == (2 if name[:2] == "c1" else 1), name
        assert plan.count("Join") <= 2 and plan.count("l_shipdate#") > 0, name
