"""The message journal: appended segments with checksums, verified replay, recovery, compaction.

A segment is a directory of Parquet files named after its first sequence number;
every row carries a CRC-32 of its content. Before a replay the segments are
checked in one aggregation: contiguous sequence numbers, names that tell the
first of them, checksums. Damage at the end of the last segment is what a crash
leaves and is cut off; anywhere else the replay refuses, as rows behind it were
acknowledged. A segment counts once its ``_SUCCESS`` is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertape.operators import fold
from ordertape.sources.archive import files, fs_of

SCHEMA = "seq bigint, arrival_ms bigint, raw string, crc bigint"
#: A longer message is refused, as its frame would be in a file of frames.
MAX_RECORD_BYTES = 64 << 20


class JournalError(OSError):
    """The journal must not be replayed as it is."""


def _crc() -> Column:
    return F.crc32(F.concat_ws("|", F.col("seq").cast("string"), F.coalesce(F.col("arrival_ms").cast("string"), F.lit("")), F.coalesce("raw", F.lit(""))).cast("binary"))


@dataclass
class Journal:
    spark: SparkSession
    folder: str

    def segments(self) -> list[int]:
        """First sequence numbers of the finished segments, in order."""
        return [k for k, done in self._found() if done]

    def _found(self) -> list[tuple[int, bool]]:
        fs, top = fs_of(self.spark, self.folder)
        if not fs.exists(top):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted((int(n[8:]), fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))) for n in names if n.startswith("segment-"))

    def path(self, start: int) -> str:
        return f"{self.folder.rstrip('/')}/segment-{start:020d}"

    def append(self, rows: DataFrame) -> int | None:
        """Write ``(seq, arrival_ms, raw)`` rows as the next segment; its first sequence number, None for no rows.

        A message that is too long is refused. A repeated append of the same batch replaces itself.
        """
        sized = F.assert_true(F.coalesce(F.octet_length("raw"), F.lit(0)) <= MAX_RECORD_BYTES, F.lit("message is too long for the journal"))
        checked = rows.select("seq", "arrival_ms", "raw").where(sized.isNull()).withColumn("crc", _crc())
        start = checked.agg(F.min("seq")).first()[0]
        if start is None:
            return None
        checked.sortWithinPartitions("seq").write.mode("overwrite").parquet(self.path(start))
        return start

    def verify(self) -> int:
        """The last sequence number that can be replayed; raises :class:`JournalError` for damage before the tail."""
        starts = self.segments()
        if not starts:
            return 0
        every = None
        for start in starts:  # one plan over all segments, one row for each of them comes back
            part = self._read(start).withColumn("start", F.lit(start))
            every = part if every is None else every.unionByName(part)
        bad = ~F.col("crc").eqNullSafe(_crc())
        rows = every.groupBy("start").agg(
            F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"), F.min(F.when(bad, F.col("seq"))).alias("bad")
        ).collect()
        found = {r.start: r for r in rows}
        expected = starts[0]
        for k, start in enumerate(starts):
            r, final = found.get(start), k + 1 == len(starts)
            if start != expected:
                raise JournalError(f"sequence gap: expected {expected} but segment {start} follows")
            if r is None:
                if final:
                    return expected - 1
                raise JournalError(f"segment {start} is empty")
            if r.bad is not None and not final:
                raise JournalError(f"checksum of message {r.bad} is wrong before the last segment")
            high = r.high if r.bad is None else r.bad - 1
            if r.low != start:
                raise JournalError(f"segment {start} begins with {r.low}")
            if r.bad is None and (r.n != r.d or r.high - r.low + 1 != r.n):
                raise JournalError(f"segment {start} has a gap or a repeated number")
            expected = high + 1
        return expected - 1

    def replay(self, after: int = 0) -> DataFrame:
        """Verified rows past a sequence number; a torn end is left out."""
        last = self.verify()
        starts = self.segments()
        chosen = [s for k, s in enumerate(starts) if k + 1 == len(starts) or starts[k + 1] > after + 1]
        if not chosen:
            return self.spark.createDataFrame([], SCHEMA).drop("crc")
        rows = self.spark.read.schema(SCHEMA).parquet(*(self.path(s) for s in chosen))
        return rows.where((F.col("seq") > after) & (F.col("seq") <= last)).drop("crc")

    def _read(self, start: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path(start))

    def heal(self) -> int:
        """Cut off a torn end for good, and set aside segments that were never finished; the last sequence number."""
        fs, _ = fs_of(self.spark, self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        last = self.verify()
        for start, done in self._found():
            if not done or start > last:
                fs.rename(path(self.path(start)), path(f"{self.folder}/quarantine-{start:020d}-{time.time_ns()}"))
        starts = self.segments()
        if starts and self._read(starts[-1]).where(F.col("seq") > last).limit(1).count():
            sound = f"{self.folder}/healing-{starts[-1]:020d}"
            self._read(starts[-1]).where(F.col("seq") <= last).write.mode("overwrite").parquet(sound)
            fs.rename(path(self.path(starts[-1])), path(f"{self.folder}/quarantine-{starts[-1]:020d}-{time.time_ns()}"))
            fs.rename(path(sound), path(self.path(starts[-1])))
        return last

    def compact(self, anchor: int) -> list[int]:
        """Delete segments that a snapshot at ``anchor`` covers whole; the last segment stays."""
        fs, _ = fs_of(self.spark, self.folder)
        starts, gone = self.segments(), []
        for start, following in zip(starts, starts[1:]):
            if following <= anchor + 1:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(start)), True)
                gone.append(start)
        return gone


def recover(snapshot: DataFrame | None, anchor: int, resolved: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Latest states after a snapshot at ``anchor`` and the messages past it.

    ``resolved`` holds the lifted messages with their chains. Chains that the
    tail touches are folded again from their own messages; the others are taken
    from the snapshot as they are. ``columns`` are those of the snapshot, if it does not hold all.
    """
    if snapshot is None:
        return fold.latest_states(fold.versions(resolved, columns=columns))
    touched = resolved.where(F.col("seq") > anchor).select("chain_id").distinct()
    again = fold.latest_states(fold.versions(resolved.join(touched, "chain_id", "left_semi"), columns=columns))
    return snapshot.join(touched, "chain_id", "left_anti").unionByName(again)


def announce(states: DataFrame) -> DataFrame:
    """One RECOVERY change per chain: the restored state, without a state or a message before it."""
    return states.select(
        "*", F.lit("RECOVERY").alias("change_kind"), F.lit(None).cast("string").alias("prev_ord_status"), F.col("last_update_ts").alias("change_ts"),
    )


def snapshot_and_compact(journal: Journal, snapshots, states: DataFrame, last_seq: int, keep: int = 2) -> list[int]:
    """Write a snapshot, then drop the segments that the *oldest* kept valid snapshot covers: recovery may fall back to it."""
    snapshots.write(states, last_seq, keep)
    anchors = snapshots.anchors()
    return journal.compact(anchors[0]) if anchors else []


def cursors(log: DataFrame, source: str = "source", offset: str = "offset") -> DataFrame:
    """``(source, offset, seq)``: how far each source has been taken, kept with the state."""
    return log.groupBy(source).agg(F.max_by(offset, "seq").alias(offset), F.max("seq").alias("seq"))


@dataclass
class Cadence:
    """When a checkpoint is due: after so many records or seconds, whichever is first (0: never by that)."""

    records: int = 0
    seconds: float = 0.0
    clock: Callable[[], float] = time.monotonic
    _since: int = field(default=0, repr=False)
    _at: float | None = field(default=None, repr=False)

    def due(self, n: int) -> bool:
        """Count ``n`` more records; true when a checkpoint is due, which starts the count anew."""
        now = self.clock()
        self._at = now if self._at is None else self._at
        self._since += n
        late = 0 < self.records <= self._since or 0 < self.seconds <= now - self._at
        if late and self._since:
            self._since, self._at = 0, now
            return True
        return False


def stored_bytes(spark: SparkSession, folder: str) -> int:
    return sum(size for _, size in files(spark, folder))
