import random

import pytest
from pyspark.sql import functions as F

from ordertape.functions import codec
from ordertape.operators import chain, dialect, fold, messages
from ordertape.plans import stage
from ordertape.sources.archive import Archive
from ordertape.streaming import journal, live
from tests import golden


def test_groups_nest_and_count():
    read = lambda text: dialect.read_groups([(int(t.split("=")[0]), t.split("=")[1]) for t in text.split("|")])
    body, groups = read("35=D|78=2|79=A|80=1|136=2|137=5|138=X|137=6|79=B|366=2|55=S")
    assert body == [(35, "D"), (55, "S")] and [len(e["fields"]) for e in groups[0]["entries"]] == [2, 2]
    assert [e["fields"] for e in groups[0]["entries"][0]["groups"][0]["entries"]] == [[(137, "5"), (138, "X")], [(137, "6")]]
    # the declared count caps, a member before the delimiter opens an entry, what is left over belongs to the body
    body, groups = read("78=1|80=9|79=A|79=B|55=S")
    assert groups[0]["entries"] == [{"fields": [(80, "9")], "groups": []}] and body == [(79, "A"), (79, "B"), (55, "S")]
    assert read("78=0|79=A")[1][0]["entries"] == []
    for bad in ("78=-1|79=A", "78=x|79=A", "78=1|79=A|136=?|137=1"):
        with pytest.raises(dialect.GroupError):
            read(bad)


def test_structured_messages(spark):
    raw = ["35=D|78=1|79=A|136=1|137=2|55=S|", "35=D|78=x|79=A|", "35=F|11=a|", "35=F|x"]
    rows = messages.parsed(spark.createDataFrame(list(enumerate(raw)), "k int, raw string"))
    found = [r.structure for r in dialect.structured(rows).orderBy("k").collect()]
    assert [f.error for f in found] == [None, "78 is no number", None, "no fields"]
    assert found[0].groups[0].entries[0].groups[0].entries[0].fields[0].value == "2" and [f.tag for f in found[0].body] == [35, 55]
    assert [f.value for f in found[2].body] == ["F", "a"] and found[2].groups == []


def _rows(spark, tape):
    raw = spark.createDataFrame([(k + 1, t) for k, t in enumerate(tape)], "seq bigint, raw string").withColumn("ts", F.lit("2025-03-03").cast("timestamp_ntz"))
    return stage.save(messages.lifted(messages.parsed(raw)), "b")


def test_second_dialect_fold(spark):
    tape = [
        "35=D|11=c1|55=S|38=100|44=5|60=10:00|", "35=8|11=c1|37=o1|17=e1|20=0|150=0|39=0|38=100|14=0|151=100|60=10:01|",
        "35=G|11=c2|41=c1|38=80|60=10:02|", "35=9|11=c2|41=c1|39=0|434=2|102=1|58=no|", "35=8|37=o1|17=e2|20=0|150=1|39=1|14=30|151=70|60=10:05|",
        "35=8|37=o1|17=e3|20=0|150=1|39=1|14=20|151=80|60=10:04|", "35=8|11=c9|37=o1|17=e2|20=0|39=2|14=99|60=10:09|", "35=8|37=o1|17=e2|20=1|19=e2|150=1|39=1|14=0|151=100|60=10:10|",
        "35=H|11=zz|", "35=Q|37=o1|17=e7|127=A|58=what|", "35=F|11=c3|41=c1|37=o1|", "35=8|11=c3|37=o1|17=e8|20=0|150=4|39=4|14=0|151=0|", "35=F|11=c4|41=c3|", "35=H|37=o1|",
    ]
    resolved = chain.resolve(_rows(spark, tape), "B")
    found = {r.seq: r for r in dialect.versions(resolved).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14]  # a status request that finds nothing is dropped
    assert [(found[k].applied, found[k].version) for k in (5, 6, 7, 8)] == [(True, 5), (False, 5), (False, 5), (True, 6)]
    assert (found[1].ord_status, found[1].leaves_qty, found[1].cum_qty) == ("A", 100, 0)
    assert (found[3].ord_status, found[3].order_qty, found[3].pending_replace) == ("E", 80, True)  # terms of a request hold at once
    assert (found[4].ord_status, found[4].pending_replace, found[4].text) == ("0", False, "no")
    assert (found[6].cum_qty, found[6].seen_exec_ids) == (30, ["e1", "e2", "e3"])  # stale: only the execution id is kept
    assert (found[7].cum_qty, found[7].cl_ord_id, found[8].cum_qty) == (30, "c9", 0)
    assert (found[10].dk_trade, found[10].dk_reason, found[10].last_exec_id) == (True, "A", "e7")
    assert (found[11].ord_status, found[11].pending_cancel, found[12].ord_status, found[12].pending_cancel) == ("6", True, "4", False)
    assert (found[13].ord_status, found[13].cl_ord_id_history, found[14].last_msg_type) == ("4", ["c1", "c2", "c9", "c3", "c4"], "H")  # terminal: no pending
    fresh = {r.seq: r for r in dialect.versions(resolved, apply_stale=True).collect()}
    assert fresh[6].applied and fresh[6].cum_qty == 20
    few = {r.seq: r for r in dialect.versions(resolved, seen_limit=1).collect()}
    assert few[5].seen_exec_ids == ["e2"] and few[7].applied  # e2 was pushed out by e3


def test_second_dialect_equals_a_plain_replay(spark):
    """Every prefix of random tapes gives the state that a replay from the start gives (prefix equivalence)."""
    rng = random.Random(7)
    rows, expected = [], {}
    names = ("seq", "chain_id", "msg_type", "cl_ord_id", "orig_cl_ord_id", "order_id", "exec_id", "exec_trans_type", "ord_status", "cum_qty", "transact_ts", "cxl_rej_response_to")
    for order in range(40):
        taken = dialect.Order(3, False)
        for k in range(rng.randint(1, 25)):
            pick = lambda *x: rng.choice(x)
            values = (order * 100 + k, order, pick(*"D888FG9QH"), pick(None, "a", "b"), pick(None, "a"), pick(None, "o"), pick(None, "1", "2", "3", "4", "5"), pick(None, "0", "1"),
                      pick(None, "0", "2", "6", "E"), pick(None, "1", "x", "2.5"), pick(None, "10", "11", "12"), pick(None, "1", "2"))
            rows.append(values)
            row = dict.fromkeys((*dialect._STATE, "exec_id"), None) | dict(zip(names, values))
            row["cum_qty"] = None if row["cum_qty"] in (None, "x") else float(row["cum_qty"])
            applied = taken.take(row)
            expected[values[0]] = (applied, taken.version, taken.now["ord_status"], taken.now["cum_qty"], taken.cancel, taken.replace, list(taken.seen))
    frame = spark.createDataFrame(rows, "seq bigint, chain_id bigint, " + ", ".join(f"{n} string" for n in names[2:]))
    for c in (*dialect._STATE, "exec_id"):
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    found = {r.seq: (r.applied, r.version, r.ord_status, r.cum_qty, r.pending_cancel, r.pending_replace, r.seen_exec_ids) for r in dialect.versions(frame, seen_limit=3).collect()}
    assert found == expected


def test_identity():
    assert {c for c, *_ in chain.PROBES["B"]} == {"order_id", "cl_ord_id", "orig_cl_ord_id", "exec_id", "exec_ref_id"}


def _log(spark, a, b):
    return spark.range(a, b + 1).select(F.col("id").alias("seq"), (F.col("id") * 10).alias("arrival_ms"), F.concat(F.lit("m"), "id").alias("raw"))


def test_journal_replay_compaction_and_damage(spark, tmp_path):
    log = journal.Journal(spark, f"file://{tmp_path}/j")
    assert log.verify() == 0 and log.replay().count() == 0 and log.append(_log(spark, 1, 0)) is None
    for a, b in ((1, 4), (5, 9), (10, 12)):
        assert log.append(_log(spark, a, b)) == a
    assert log.verify() == 12 and [r.seq for r in log.replay(6).orderBy("seq").collect()] == [7, 8, 9, 10, 11, 12]
    log.append(_log(spark, 10, 12))  # the same batch again replaces itself
    assert log.replay().count() == 12
    torn = _log(spark, 13, 15).withColumn("crc", F.when(F.col("seq") < 15, journal._crc()).otherwise(F.lit(1)))
    torn.write.parquet(log.path(13))
    assert log.verify() == 14 and log.replay(12).count() == 2
    assert log.heal() == 14 and log.replay(12).count() == 2 and log.segments() == [1, 5, 10, 13]
    assert log.compact(8) == [1] and log.compact(9) == [5] and log.replay(9).count() == 5
    log.append(_log(spark, 17, 18))
    with pytest.raises(journal.JournalError, match="gap"):
        log.verify()
    wrong = journal.Journal(spark, f"file://{tmp_path}/k")
    _log(spark, 1, 3).withColumn("crc", F.lit(0)).write.parquet(wrong.path(1))
    wrong.append(_log(spark, 4, 5))
    with pytest.raises(journal.JournalError, match="checksum"):
        wrong.replay()


def test_recovery_at_every_prefix(spark, tmp_path):
    """A snapshot at any message plus the tail past it gives what a full fold gives."""
    resolved = stage.save(chain.resolve(stage.save(messages.lifted(messages.parsed(golden.messages(spark))), "r")), "r")
    key = lambda df: sorted(map(str, df.select("chain_id", "seq", "ord_status", "cum_qty", "exec_ids", "update_count").collect()))
    whole = key(fold.latest_states(fold.versions(resolved)))
    assert key(journal.recover(None, 0, resolved)) == whole
    for anchor in (1, 5, 8, 13, 17):
        snapshot = stage.save(fold.latest_states(fold.versions(resolved.where(F.col("seq") <= anchor))), "snap")
        assert key(journal.recover(snapshot, anchor, resolved)) == whole
    told = journal.announce(journal.recover(None, 0, resolved)).collect()
    assert len(told) == 4 and {r.change_kind for r in told} == {"RECOVERY"} and {r.prev_ord_status for r in told} == {None}


def test_snapshots_bound_the_journal(spark, tmp_path):
    log = journal.Journal(spark, f"file://{tmp_path}/j")
    snaps = live.Snapshots(spark, f"file://{tmp_path}/s", {"v": 1})
    for a, b in ((1, 3), (4, 6), (7, 9), (10, 11)):
        log.append(_log(spark, a, b))
    assert journal.snapshot_and_compact(log, snaps, spark.range(1), 6) == [1, 4]
    assert journal.snapshot_and_compact(log, snaps, spark.range(1), 9) == []  # the older snapshot still needs segment 7
    assert journal.snapshot_and_compact(log, snaps, spark.range(1), 11) == [7]
    rows = spark.createDataFrame([("a", 5, 1), ("b", 2, 2), ("a", 9, 3)], "source string, offset bigint, seq bigint")
    assert sorted(map(tuple, journal.cursors(rows).collect())) == [("a", 9, 3), ("b", 2, 2)]
    at = [0.0]
    cadence = journal.Cadence(records=10, seconds=60, clock=lambda: at[0])
    assert [cadence.due(4), cadence.due(4), cadence.due(4), cadence.due(1)] == [False, False, True, False]
    at[0] = 61.0
    assert cadence.due(0) and not cadence.due(1)


def test_change_sink_and_policy(spark, tmp_path):
    got, errors = [], []

    def handler(batch, k):
        if k == 1:
            raise ValueError("no")
        got.append((k, batch.count()))

    sink = live.ChangeSink(handler, lambda k, e: errors.append((k, str(e))))
    for k in (0, 1, 1, 2, 2):
        sink(spark.range(k + 1), k)
    assert got == [(0, 1), (2, 3)] and errors == [(1, "no")] and sink.errors == 1
    with pytest.raises(ValueError):
        live.ChangeSink(handler, fail=True)(spark.range(1), 1)
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    policy = live.BatchPolicy(rows=4)
    stream = policy.source(spark.readStream.schema("id bigint")).parquet(f"{tmp_path}/in")
    policy.sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp", drain=True).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 30 and len(out.inputFiles()) >= 9


def test_counters_compaction_of_many_partitions_and_a_bad_file(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/a", max_rows_per_file=40)
    base = messages.raw_rows(messages.parsed(golden.messages(spark)), "w1").where("msg_type = 'D'").limit(1)
    rows = spark.range(300).join(base.drop("ingest_seq", "account")).select(
        *(F.col("id").alias(c) if c == "ingest_seq" else F.concat(F.lit("ACC"), F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 6)).alias(c) if c == "account" else c for c in base.columns))
    for k in range(2):
        archive.write("fix_messages", rows.where(F.floor(F.col("ingest_seq") / 10) % 2 == k))
    assert archive.counters["accepted"] == archive.counters["written"] == 300 and archive.is_flushed() and archive.counters["bytes"] > 0
    before = sorted(map(str, archive.read_all("fix_messages").collect()))
    results = archive.compact("fix_messages")
    assert len(results) == 6 and all(r["error"] is None for r in results) and sorted(map(str, archive.read_all("fix_messages").collect())) == before
    sizes = {r["directory"].split("ACC")[1][0]: (r["files_out"], r["rows"]) for r in results}
    assert sizes["1"] == (1, 25) and sizes["0"][1] == 175 and sizes["0"][0] >= 5
    for k in range(2):
        archive.write("fix_messages", rows.where(F.floor(F.col("ingest_seq") / 10) % 2 == k))
    directory = next(d for d in archive.partitions("fix_messages") if "ACC3" in d).removeprefix("file:").replace("///", "/")
    with open(f"{directory}/broken.parquet", "wb") as f:
        f.write(b"PAR1 this is no file PAR1")
    results = archive.compact("fix_messages")
    assert [("ACC3" in r["directory"]) for r in results if r["error"]] == [True] and sum(r["error"] is None for r in results) == 5
