import pytest
from pyspark.sql import functions as F

from ordertape.operators import chain, fold, messages, rollup
from ordertape.plans import stage
from tests import golden


@pytest.fixture(scope="module")
def folded(spark):
    lifted = stage.save(messages.lifted(messages.parsed(golden.messages(spark))), "golden")
    resolved = chain.resolve(lifted)
    return lifted, resolved, stage.save(fold.versions(resolved), "golden-versions")


def test_latest_states(folded):
    _, _, versions = folded
    found = {r.chain_key: r for r in fold.latest_states(versions).collect()}
    assert sorted(found) == ["BSK77", "LEGA", "LEGB", "SOLO"]
    a, b, solo, basket = found["LEGA"], found["LEGB"], found["SOLO"], found["BSK77"]
    assert (a.ord_status, a.order_id, a.cum_qty, a.leaves_qty, a.avg_px, a.is_terminal) == ("FILLED", "V-100", 500, 0, 71.25, True)
    assert (a.last_qty, a.last_px, a.order_qty, a.price, a.update_count) == (500, 71.25, 500, 71.2, 10)  # the resend changes no figure
    assert (a.cl_ord_id, a.cl_ord_id_history, a.exec_ids, a.busted_exec_ids) == ("LEGA", ["LEGA", "LEGA.1"], ["X1", "X3", "X5", "X6"], ["X3"])
    assert (a.exec_id_count, a.busted_count, a.text, a.cxl_rej_reason) == (4, 1, "unknown fill", 2)
    assert (b.ord_status, b.cl_ord_id_history, b.leaves_qty, b.update_count, b.is_terminal) == ("CANCELED", ["LEGB", "LEGB.C"], 0, 4, True)
    assert (solo.ord_status, solo.ord_rej_reason, solo.text, solo.order_id, solo.update_count) == ("REJECTED", 3, "limit breach", "V-300", 2)
    assert (basket.ord_status, basket.update_count, basket.cum_qty) == ("PENDING_NEW", 1, 0)


def test_status_of_every_message(folded):
    _, _, versions = folded
    found = {r.seq: r.ord_status for r in versions.collect()}
    assert found == dict(enumerate(
        ["PENDING_NEW", "PENDING_NEW", "NEW", "PENDING_REPLACE", "NEW", "PENDING_NEW", "NEW", "PARTIALLY_FILLED", "PENDING_CANCEL", "CANCELED",
         "PARTIALLY_FILLED", "NEW", "FILLED", "FILLED", "FILLED", "PENDING_NEW", "REJECTED"], 1))


def test_change_stream_and_parent(folded):
    _, resolved, versions = folded
    refreshed = rollup.parent_versions(versions)
    rows = rollup.changes(versions, refreshed).orderBy("seq", "is_rollup").collect()
    basket = [r for r in rows if r.chain_key == "BSK77"]
    # the bust (12) names no parent and the resend (14) changes nothing
    assert [r.seq for r in basket] == [1, 2, 3, 6, 7, 8, 10, 13] and len(rows) == 24
    assert [(r.cum_qty, r.leaves_qty, r.child_order_count) for r in basket] == [
        (0, 0, 0), (0, 0, 1), (0, 500, 1), (0, 500, 2), (0, 900, 2), (200, 700, 2), (200, 300, 2), (500, 0, 2)]
    assert [r.change_kind for r in basket] == ["CREATE"] + ["PARENT_ROLLUP"] * 7
    last = basket[-1]
    assert (last.ord_status, last.is_parent, last.avg_px, last.update_count, str(last.change_ts)) == ("PENDING_NEW", True, 71.25, 1, "2025-03-03 08:00:13")
    listed = rollup.child_order_ids(versions, chain.chain_names(resolved)).collect()
    assert [(r.chain_id, r.child_order_ids) for r in listed] == [(1, ["V-100", "V-200"])]
    archive = rollup.state_rows(rollup.changes(versions, refreshed), resolved, "w1").collect()
    assert len(archive) == 24 and len({r.ingest_seq for r in archive}) == 24
    assert {r.change_kind for r in archive} == {"CREATE", "UPDATE", "PARENT_ROLLUP"}


def test_a_message_of_the_parent_keeps_the_aggregate(spark):
    tape = golden.TAPE[:3] + ["35=F|11=BSK77.C|41=BSK77|1=FUND9|", "35=8|11=BSK77|37=V-1|17=Z1|20=0|150=0|39=0|14=7|151=1|6=3|"]
    raw = spark.createDataFrame([(k + 1, t) for k, t in enumerate(tape)], "seq bigint, raw string").withColumn("ts", F.lit("2025-03-03").cast("timestamp_ntz"))
    versions = stage.save(fold.versions(chain.resolve(stage.save(messages.lifted(messages.parsed(raw)), "t"))), "v")
    rows = rollup.changes(versions, rollup.parent_versions(versions)).where("chain_key = 'BSK77'").orderBy("seq").collect()
    assert [(r.seq, r.change_kind, r.leaves_qty, r.cum_qty) for r in rows] == [
        (1, "CREATE", 0, 0), (2, "PARENT_ROLLUP", 0, 0), (3, "PARENT_ROLLUP", 500, 0), (4, "UPDATE", 500, 0), (5, "UPDATE", 500, 0)]


def test_raw_rows(spark):
    rows = messages.raw_rows(messages.parsed(golden.messages(spark)), "w1").collect()
    assert len(rows) == 16 and {r.msg_type for r in rows} == set("89DFGQ")
    reject = next(r for r in rows if r.msg_type == "9")
    assert reject.account is None and reject.symbol is None and reject.cxl_rej_reason == 2 and reject.raw_fix == golden.TAPE[4]


def test_plans_stay_small(folded):
    """Lifted rows that filters and joins read come from a stage table, so the parser is not repeated."""
    lifted, resolved, versions = folded
    for rows in (resolved, versions, rollup.changes(versions, rollup.parent_versions(versions))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and len(plan) < 200_000
