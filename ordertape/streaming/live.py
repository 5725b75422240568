"""Live ingestion: two stages over Structured Streaming.

The first stage assigns chains: each micro-batch is resolved against the stored
identifier index, appends what it bound and writes its messages with
``chain_id``. The second keeps an order's status and terms as keyed state and
emits a change row per message: :class:`FoldStage` folds a micro-batch in one
pass over its sorted rows and keeps states in files, so neither the number of
orders in a batch nor that of all orders so far is held in memory;
:func:`fold_stream` is the same fold on Spark's state store, one call for each
order. Both stages read files written by the stage before, so
a restart from the checkpoint repeats a batch into the same result: sequence
numbers and arrival times are part of the input, never stamped again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordertape.operators import messages
from ordertape.plans import stage
from ordertape.sources.archive import files, fs_of

#: Batches after which the identifier index is merged into one run.
COMPACT_EVERY = 16
RAW_SCHEMA = "seq bigint, ts timestamp_ntz, raw string"
_FOLD_INPUT = ("seq", "ts", "msg_type", "cl_ord_id", "order_id", "exec_id", "ord_status", "exec_type", "cum_qty", "leaves_qty", "avg_px")


def read_raw(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


class ChainStage:
    """``foreachBatch`` sink that resolves chains against a growing identifier index (policy A)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def index(self, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """Latest binding of each identifier (of ``ids`` only, if given) from batches before ``before``."""
        rows = self._read("index", "id string, chain_id bigint, seq bigint, batch bigint")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        if ids is not None:
            rows = rows.join(ids, "id", "left_semi")
        return rows.groupBy("id").agg(F.max_by("chain_id", "seq").alias("chain_id"), F.max("seq").alias("seq"))

    def resolved(self) -> DataFrame:
        return self._read("messages", None)

    def _read(self, name: str, schema: str | None) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not files(self.spark, path):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("recursiveFileLookup", True)
        return (reader.schema(schema) if schema else reader).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from ordertape.operators.chain import identifiers, resolve

        lifted = stage.save(messages.lifted(messages.parsed(batch).where("fields is not null")).drop("fields", "parse_error"), "batch")
        # bindings of earlier batches take part as messages that only name one identifier
        old = self.index(batch_id, lifted.select(F.explode(identifiers(lifted)).alias("id")).distinct())
        column = F.substring("id", 1, 1)
        value = F.expr("substring(id, 3)")
        seeds = stage.save(old.select(
            (F.lit(-1) - F.xxhash64("id").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFE))).alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.when(column == "O", value).alias("order_id"), F.when(column == "C", value).alias("cl_ord_id"), F.when(column == "E", value).alias("exec_id"),
            F.col("chain_id").alias("__old"),
        ), "seeds")
        marked = lifted.unionByName(seeds.drop("__old"), allowMissingColumns=True)
        found = resolve(marked).where("seq > 0")
        back = seeds.select(F.col("seq").alias("chain_id"), "__old")
        rows = stage.save(found.join(back, "chain_id", "left").withColumn("chain_id", F.coalesce("__old", "chain_id")).drop("__old"), "batch")
        self._put(rows, "messages", batch_id)
        bound = rows.select("chain_id", "seq", F.explode(identifiers(rows)).alias("id")).groupBy("id").agg(F.max_by("chain_id", "seq").alias("chain_id"), F.max("seq").alias("seq"))
        self._put(bound.select("id", "chain_id", "seq", F.lit(batch_id).cast("bigint").alias("batch")), "index", batch_id)
        stage.drop(lifted, seeds, rows)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Replace the index files of batches before ``batch_id`` by one run with one row for each identifier.

        The run is written before the others go, and a binding that is read twice changes nothing, so a failure in between does no harm.
        """
        merged = self.index(batch_id).select("id", "chain_id", "seq", F.lit(batch_id - 1).cast("bigint").alias("batch"))
        merged.write.mode("overwrite").parquet(f"{self.folder}/index/run={batch_id:012d}")
        fs, top = fs_of(self.spark, f"{self.folder}/index")
        for found in fs.listStatus(top):
            kind, _, number = found.getPath().getName().partition("=")
            if number and int(number) < batch_id:
                fs.delete(found.getPath(), True)

    def _put(self, rows: DataFrame, name: str, batch_id: int) -> None:
        # a batch has its own directory: a repeated batch overwrites itself
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id:012d}")


_STATE = "status string, prior string, seen string, updates bigint, cum_qty double, leaves_qty double, avg_px double"
CHANGES = "chain_id bigint, seq bigint, ts timestamp_ntz, ord_status string, prev_ord_status string, update_count bigint, cum_qty double, leaves_qty double, avg_px double, change_kind string"


def fold_stream(resolved: DataFrame) -> DataFrame:
    """Change rows of a stream of messages with ``chain_id``: keyed state, append output."""
    from ordertape.functions.codes import EXEC_TYPE, ORD_STATUS

    def number(value) -> float:
        try:
            return float(value)
        except (TypeError, ValueError):
            return 0.0

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            status, prior, seen, updates, cum, leaves, avg = state.get
            prior, seen = json.loads(prior), json.loads(seen)
        else:
            status, prior, seen, updates, cum, leaves, avg = "UNSPECIFIED", {}, {"ids": [], "type": None}, 0, 0.0, 0.0, 0.0
        rows = pd.concat(list(parts)).sort_values("seq")
        known, out = set(seen["ids"]), []
        text = lambda v: v if isinstance(v, str) and v.strip() else None
        for r in rows.itertuples(index=False):
            before = status
            request, execution, given = text(r.cl_ord_id), text(r.exec_id), text(r.ord_status)
            if r.msg_type == "D":
                status = "PENDING_NEW" if status == "UNSPECIFIED" else status
            elif r.msg_type == "8":
                if execution is None or execution not in known:
                    status = ORD_STATUS.get(given, "UNSPECIFIED") if given else status
                    if text(r.exec_type):
                        seen["type"] = EXEC_TYPE.get(r.exec_type, "UNSPECIFIED")
                    cum = number(r.cum_qty) if text(r.cum_qty) else cum
                    leaves = number(r.leaves_qty) if text(r.leaves_qty) else leaves
                    avg = number(r.avg_px) if text(r.avg_px) else avg
                    if seen["type"] in ("CANCELED", "REPLACED") and request:
                        prior.pop(request, None)
                if execution is not None:
                    known.add(execution)
            elif r.msg_type in ("F", "G"):
                if request:
                    prior[request] = status
                status = "PENDING_CANCEL" if r.msg_type == "F" else "PENDING_REPLACE"
            elif r.msg_type == "9":
                back = prior.pop(request, None) if request else None
                status = back if back is not None else ORD_STATUS.get(given, "UNSPECIFIED") if given else status
            updates += 1
            out.append((key[0], r.seq, r.ts, status, before if updates > 1 else None, updates, cum, leaves, avg, "CREATE" if updates == 1 else "UPDATE"))
        seen["ids"] = sorted(known)
        state.update((status, json.dumps(prior), json.dumps(seen), updates, cum, leaves, avg))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return resolved.select("chain_id", *_FOLD_INPUT).groupBy("chain_id").applyInPandasWithState(step, CHANGES, _STATE, "append", "NoTimeout")


#: Message columns of the fold, and what a state holds besides the figures of its last change row: open requests, execution ids, execution type.
_FOLDED = ("seq", "ts", "msg_type", "cl_ord_id", "exec_id", "ord_status", "exec_type", "cum_qty", "leaves_qty", "avg_px")
_CARRIED = "ord_status string, update_count bigint, cum_qty double, leaves_qty double, avg_px double, held string"


def _folded_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Change rows of messages sorted by chain and sequence; a chain's earlier state, if any, is its first row (without a sequence number).

    The last row of a chain tells in ``held`` what its figures do not.
    """
    from ordertape.functions.codes import EXEC_TYPE, ORD_STATUS

    def number(value: str) -> float | None:
        try:
            found = float(value)
        except ValueError:
            return 0.0
        return found if found == found else None

    text = lambda v: v if v is not None and v.strip() else None
    chain, started = None, False
    status, prior, known, kind, updates, cum, leaves, avg = "UNSPECIFIED", {}, set(), None, 0, 0.0, 0.0, 0.0
    names = [c.split()[0] for c in CHANGES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        rows = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns) if k != 2))
        stamps = batch.column(2)
        at = []
        for n, (c, seq, msg, request, execution, given, exec_type, cum_qty, leaves_qty, avg_px, s_status, s_updates, s_cum, s_leaves, s_avg, s_held, last) in enumerate(rows):
            if not started or c != chain:
                chain, started = c, True
                status, prior, known, kind, updates, cum, leaves, avg = "UNSPECIFIED", {}, set(), None, 0, 0.0, 0.0, 0.0
            if s_held is not None:
                status, updates, cum, leaves, avg = s_status, s_updates, s_cum, s_leaves, s_avg
                prior, ids, kind = json.loads(s_held)
                known = set(ids)
                continue
            before, request, execution, given = status, text(request), text(execution), text(given)
            if msg == "8":
                if execution is None or execution not in known:
                    if given:
                        status = ORD_STATUS.get(given, "UNSPECIFIED")
                    if text(exec_type):
                        kind = EXEC_TYPE.get(exec_type, "UNSPECIFIED")
                    cum = number(cum_qty) if text(cum_qty) else cum
                    leaves = number(leaves_qty) if text(leaves_qty) else leaves
                    avg = number(avg_px) if text(avg_px) else avg
                    if request and kind in ("CANCELED", "REPLACED"):
                        prior.pop(request, None)
                    if execution is not None:
                        known.add(execution)
            elif msg == "D":
                status = "PENDING_NEW" if status == "UNSPECIFIED" else status
            elif msg == "F" or msg == "G":
                if request:
                    prior[request] = status
                status = "PENDING_CANCEL" if msg == "F" else "PENDING_REPLACE"
            elif msg == "9":
                back = prior.pop(request, None) if request else None
                status = back if back is not None else ORD_STATUS.get(given, "UNSPECIFIED") if given else status
            updates += 1
            held = json.dumps([prior, sorted(known), kind]) if last else None
            out.append((c, seq, status, before if updates > 1 else None, updates, cum, leaves, avg, "CREATE" if updates == 1 else "UPDATE", held))
            at.append(n)
        columns = list(zip(*out)) if out else [()] * (len(types) - 1)
        arrays = [pa.array(x, t) for x, t in zip(columns, types[:2] + types[3:])]
        arrays.insert(2, stamps.cast(types[2]).take(pa.array(at, pa.int64())))
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "held"])


class FoldStage:
    """``foreachBatch`` sink that folds messages with ``chain_id`` into change rows (:data:`CHANGES`), as :func:`fold_stream` does.

    The last change row of a chain in a batch holds its state, so a batch is written once. A batch reads the states of its own chains from the
    batches before it: a repeated batch overwrites itself with the same rows. Null chains and texts, empty batches and repeated executions are
    handled as :func:`fold_stream` does; a batch may hold a chain's messages in any order.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def changes(self) -> DataFrame:
        """All change rows so far."""
        return self._read(self._batches(), CHANGES)

    def states(self, before: int | None = None) -> DataFrame:
        """``chain_id`` and the state after the last message of batches before ``before``."""
        run = max((n for n in self._numbers("states") if before is None or n <= before), default=0)
        fresh = [n for n in self._batches() if n >= run and (before is None or n < before)]
        rows = self._read(fresh, f"chain_id bigint, {_CARRIED}").where("held is not null")
        if run:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(self._path("states", run)))
        carried = F.struct(*(c.split()[0] for c in _CARRIED.split(", ")))
        return rows.groupBy("chain_id").agg(F.max_by(carried, "update_count").alias("x")).select("chain_id", "x.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("chain_id", *_FOLDED)
        carried = [c.split() for c in _CARRIED.split(", ")]
        if any(n < batch_id for n in self._batches()):
            mine = rows.select(F.col("chain_id").alias("__mine")).distinct()
            old = self.states(batch_id).join(mine, F.col("chain_id").eqNullSafe(F.col("__mine")), "left_semi")
            # state columns have names of their own, as messages state some of them too
            old = old.select("chain_id", *(F.col(c).alias(f"__{c}") for c, _ in carried))
            rows = rows.unionByName(old, allowMissingColumns=True)
        else:
            rows = rows.select("*", *(F.lit(None).cast(kind).alias(f"__{c}") for c, kind in carried))
        w = Window.partitionBy("chain_id").orderBy("seq")
        dealt = rows.repartition("chain_id").withColumn("__last", F.lead("seq").over(w).isNull()).sortWithinPartitions("chain_id", "seq")
        stage.put(dealt.mapInArrow(_folded_of_sorted, f"{CHANGES}, held string"), self._path("changes", batch_id))
        if batch_id and batch_id % COMPACT_EVERY == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """The states of batches before ``batch_id`` as one run with one row for each chain; the run is written before the older ones go."""
        stage.put(self.states(batch_id), self._path("states", batch_id))
        for n in self._numbers("states"):
            if n < batch_id:
                stage.delete(self.spark, self._path("states", n))

    def _path(self, name: str, n: int) -> str:
        return f"{self.folder}/{name}/batch={n:012d}"

    def _numbers(self, name: str) -> list[int]:
        """Batches (or runs) that are complete."""
        fs, top = fs_of(self.spark, f"{self.folder}/{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in found if n and fs.exists(path(f"{self._path(name, int(n))}/_SUCCESS")))

    def _batches(self) -> list[int]:
        return self._numbers("changes")

    def _read(self, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*(self._path("changes", n) for n in batches))


class Snapshots:
    """State snapshots anchored at a sequence number; the newest readable one wins."""

    def __init__(self, spark: SparkSession, folder: str, fingerprint: dict) -> None:
        self.spark, self.folder, self.fingerprint = spark, folder.rstrip("/"), fingerprint

    def write(self, states: DataFrame, last_seq: int, keep: int = 2) -> None:
        path = f"{self.folder}/state_{last_seq:020d}"
        states.write.mode("overwrite").parquet(f"{path}/data")
        # the description is written last: a snapshot without it is not one
        self.spark.createDataFrame([(json.dumps(self.fingerprint, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
        fs, _ = fs_of(self.spark, self.folder)
        for old in sorted(self.anchors())[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state_{old:020d}"), True)

    def anchors(self) -> list[int]:
        fs, p = fs_of(self.spark, self.folder)
        if not fs.exists(p):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("state_")]
        return sorted(int(n[6:]) for n in names if fs.exists(path(f"{self.folder}/{n}/about/_SUCCESS")))

    def latest(self) -> tuple[int, DataFrame] | None:
        """``(last_seq, states)`` of the newest valid snapshot; another configuration is an error."""
        for seq in reversed(self.anchors()):
            path = f"{self.folder}/state_{seq:020d}"
            try:
                config = self.spark.read.json(f"{path}/about").first().config
                states = self.spark.read.parquet(f"{path}/data")
            except Exception:  # noqa: BLE001 - an unreadable snapshot falls back to an older one
                continue
            if json.loads(config) != self.fingerprint:
                raise ValueError("the snapshot was taken under another configuration")
            return seq, states
        return None


@dataclass
class ChangeSink:
    """``foreachBatch`` sink that hands change rows to a handler.

    A handler's failure goes to ``on_error`` and the stream goes on; with
    ``fail`` it ends the batch instead, which is then delivered again after a
    restart. A batch that was handled completely is not handed over twice by the
    same sink.
    """

    handler: Callable[[DataFrame, int], None]
    on_error: Callable[[int, Exception], None] | None = None
    fail: bool = False
    handled: int = -1
    errors: int = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.handled:
            return
        try:
            self.handler(batch, batch_id)
        except Exception as e:
            self.errors += 1
            if self.on_error is not None:
                self.on_error(batch_id, e)
            if self.fail:
                raise
        self.handled = batch_id


@dataclass(frozen=True)
class BatchPolicy:
    """When buffered rows become a file: after so many rows, or so many seconds, or on demand."""

    rows: int = 50_000
    seconds: int = 60

    def source(self, reader, files_at_once: int = 1):
        return reader.option("maxFilesPerTrigger", files_at_once)

    def sink(self, rows: DataFrame, folder: str, checkpoint: str, drain: bool = False):
        """A file writer under this policy; ``drain`` takes what is there, closes the files and ends (flush and close)."""
        writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("maxRecordsPerFile", self.rows)
        writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{self.seconds} seconds")
        return writer.start(folder)
