import random

import pytest

from ordertape.operators import chain, messages, state
from ordertape.operators.components import connected_components
from ordertape.plans import stage
from ordertape.sources.archive import Archive, BucketStore, DirectoryStore
from ordertape.streaming import live
from tests import golden


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def _replayed(rows, policy):
    """Chain of every message by replaying the tape, one binding at a time."""
    bound, out = {}, {}
    for seq, kind, order, orig, client, execution, ref in rows:
        if policy == "A":
            uses = [("O", order, True), ("C", orig, True), ("C", client, True), ("E", execution, True)]
        else:
            carried = {"D": "c", "8": "ocger", "F": "ocg", "G": "ocg", "9": "ocg", "H": "oc", "Q": "oe"}[kind]
            every = {"o": ("O", order, True), "c": ("C", client, True), "g": ("C", orig, False), "e": ("E", execution, True), "r": ("E", ref, False)}
            uses = [every[x] for x in carried]
        uses = [u for u in uses if u[1]]
        at = next((bound[u[:2]] for u in uses if u[:2] in bound), None)
        if at is None:
            if policy == "B" and (kind == "H" or not uses):
                continue
            at = seq
        out[seq] = at
        if policy == "B" and kind == "H":
            continue
        for space, value, puts in uses:
            if puts or (space, value) not in bound:
                bound[space, value] = at
    return out


_COLUMNS = "seq bigint, msg_type string, order_id string, orig_cl_ord_id string, cl_ord_id string, exec_id string, exec_ref_id string"


@pytest.mark.parametrize("policy", ["A", "B"])
@pytest.mark.parametrize("split", [3, 1 << 20])
def test_resolution_equals_a_sequential_replay(spark, policy, split):
    rng, rows, expected = random.Random(split), [], {}
    for tape in range(150):  # independent tapes, resolved in one go; few ids, so that they meet in every order
        pool = [None, "", *(f"{tape}.{k}" for k in range(rng.choice((2, 4, 8))))]
        mine = [(tape * 100 + k, rng.choice("D8889FGHQ"), *(rng.choice(pool) for _ in range(5))) for k in range(1, rng.randint(2, 40))]
        rows += mine
        expected |= _replayed(mine, policy)
    found = {r.seq: r.chain_id for r in chain.resolve(spark.createDataFrame(rows, _COLUMNS), policy, split).collect()}
    assert found == expected


def test_a_hot_identifier_is_cut(spark):
    """A third of the messages carry execution id 0; some chains are known by nothing else."""
    rows = [(k, "8", None if k % 5 == 0 else f"O{k % 7}", None, None, "0" if k % 3 == 0 else f"E{k}", None) for k in range(1, 400)]
    frame = spark.createDataFrame(rows, _COLUMNS)
    for policy in "AB":
        assert {r.seq: r.chain_id for r in chain.resolve(frame, policy, split=10).collect()} == _replayed(rows, policy)


def test_order_keys_and_index(spark):
    rows = [(1, "D", None, None, "c1", None, None), (2, "8", "o1", None, "c1", "e1", None), (3, "G", None, "c1", "c2", None, None), (4, "8", "o2", None, "c2", "e2", "e1"), (5, "H", "o1", None, None, None, None)]
    resolved = chain.resolve(spark.createDataFrame(rows, _COLUMNS), "B")
    assert {r.chain_id for r in resolved.collect()} == {1} and resolved.count() == 5
    assert [(r.order_key, r.previous_key, r.seq) for r in chain.order_keys(resolved).orderBy("seq").collect()] == [("c1", None, 1), ("o1", "c1", 2), ("o2", "o1", 4)]
    index = {(r.id_kind, r.id_value): r.seq for r in chain.id_index(resolved, "B").collect()}
    assert index == {("C", "c1"): 2, ("C", "c2"): 4, ("O", "o1"): 2, ("O", "o2"): 4, ("E", "e1"): 2, ("E", "e2"): 4}


def test_archive_compaction_and_move(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/archive")
    rows = messages.raw_rows(messages.parsed(golden.messages(spark)), "w1")
    archive.write("fix_messages", rows.where("ingest_seq <= 8"))
    archive.write("fix_messages", rows.where("ingest_seq > 8"))
    assert archive.count("fix_messages") == 16 and archive.count("fix_messages", "2025-03-03") == 16 and archive.count("order_state") == 0
    before = sorted(map(str, archive.read_all("fix_messages").collect()))
    results = archive.compact("fix_messages")
    assert all(r["error"] is None for r in results) and any(r["files_in"] > r["files_out"] for r in results)
    assert sorted(map(str, archive.read_all("fix_messages").collect())) == before
    assert all(r["files_in"] == r["files_out"] for r in archive.compact("fix_messages"))
    assert archive.query("SELECT count(*) AS n FROM fix_messages WHERE account IS NULL").first().n == 1
    moved = archive.end_of_day("2025-03-03", DirectoryStore(str(tmp_path / "store")), delete_local=True)
    assert moved and all(m["error"] is None for m in moved) and archive.count("fix_messages") == 0
    assert spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/store").count() == 16


def test_stores(spark, tmp_path):
    with pytest.raises(ValueError):
        DirectoryStore(str(tmp_path)).put(spark, "/dev/null", "../x")
    with pytest.raises(ValueError):
        BucketStore("b", access_key="a")
    assert BucketStore("b", "/p/").url_for("/k") == "s3a://b/p/k"


def test_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    tape = golden.messages(spark)
    for a, b in ((1, 6), (7, 11), (12, 17)):
        tape.where(f"seq between {a} and {b}").coalesce(1).write.mode("append").parquet(source)
    sink = live.ChainStage(spark, f"{tmp_path}/chains")
    for _ in range(2):  # the second start finds nothing new
        live.read_raw(spark, source).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp1").trigger(availableNow=True).start().awaitTermination()
    resolved = sink.resolved()
    batch = chain.resolve(messages.lifted(messages.parsed(tape)))
    assert {r.seq: r.chain_id for r in resolved.collect()} == {r.seq: r.chain_id for r in batch.collect()}
    before = sorted(map(tuple, sink.index().collect()))
    sink.compact(3)
    assert sorted(map(tuple, sink.index().collect())) == before
    folder = f"{tmp_path}/resolved"
    resolved.select("chain_id", *live._FOLD_INPUT).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    live.fold_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp2").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    from ordertape.operators import fold

    expected = {(r.seq, r.ord_status, r.cum_qty, r.leaves_qty) for r in fold.versions(batch).collect()}
    assert {(r.seq, r.ord_status, r.cum_qty, r.leaves_qty) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected


def test_snapshots(spark, tmp_path):
    snaps = live.Snapshots(spark, f"file://{tmp_path}/snap", {"history": 0})
    assert snaps.latest() is None
    for seq in (3, 7, 9):
        snaps.write(spark.range(seq), seq)
    assert snaps.anchors() == [7, 9] and snaps.latest()[0] == 9 and snaps.latest()[1].count() == 9
    with pytest.raises(ValueError):
        live.Snapshots(spark, f"file://{tmp_path}/snap", {"history": 1}).latest()


def test_gaps_and_stage(spark):
    log = spark.createDataFrame([(1, "a"), (2, "a"), (4, "a")], "seq bigint, seg string")
    assert [r.seq for r in state.gaps(log, "seq", "seg").collect()] == [4]
    rng = random.Random(3)
    numbers = sorted(rng.sample(range(5000), 4000))
    whole = spark.createDataFrame([(k,) for k in rng.sample(numbers, 4000)], "seq bigint").repartition(7)
    assert sorted((r.prev_seq, r.seq) for r in state.gaps(whole).collect()) == [(a, b) for a, b in zip(numbers, numbers[1:]) if b - a != 1]
    kept = stage.save(log, "t")
    assert kept.count() == 3
    stage.drop(kept)
