"""Exact substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one text; a word is removed when a
window that covers it also starts anywhere else. Not every window is indexed:
each window has an anchor, the ``ANCHOR``-word run inside it with the smallest
hash, and equal windows have equal anchors, so a window can only repeat when its
anchor does.

* The index is log-structured: immutable runs, bucketed and sorted by hash, in a
  folder that a later session can open again. A new batch is aggregated and
  merge-joined with the run of everything before it, bucket by bucket, so the
  history is neither shuffled nor sorted again; counts are added up and the
  result is written as the next run, which replaces the older one (compaction).
  A hash that occurred once keeps where.
* Anchors that occurred once are taken from each text's list; what is left are
  the candidates. Their windows are verified by content: 128-bit BLAKE2b digests
  of the windows' words, joined by one space, are aggregated over all texts;
  digests that occurred once name the candidates to drop. All others are repeats.

Equal texts are judged once, with their number as weight. Aggregations combine
before the shuffle and keep no lists by hash, so a passage in a third of all
texts costs one row for each task. Texts are shuffled only if they hold a
candidate: a bit set of fixed size filters the others in place.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, unchanged.

Defined cases: null text has no words; texts shorter than a window lose
nothing; two rows with one text repeat each other (all windows go), whatever
their ids; very long texts are processed whole; other columns are ignored, and
kept by :func:`clean`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertape.llm.common import Words, byte_set, flag_maybe, key_filter, map_text, mix64, partitions_for, settings, slices, utf8
from ordertape.plans import stage

WINDOW = 35
ANCHOR = 12
BATCHES = 2
_SPACE = byte_set(0x20, *range(0x09, 0x0E))
_BASE = 0xD6E8FEB86659FD93


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes (one for each start; runs may cross texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power, width = hashes.copy(), np.uint64(base), 1
    # doubling: runs of 1, 2, 4 ... words, combined from the binary digits of size
    total, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            if total is None:
                total, done = out.copy(), width
            else:
                m = min(len(total), len(out) - done)
                shift = np.uint64(pow(base, done, 1 << 64))
                total = total[:m] + out[done:done + m] * shift
                done += width
        rest >>= 1
        if rest:
            step = np.uint64(pow(base, width, 1 << 64))
            out = out[:len(out) - width] + out[width:] * step
            width *= 2
    del power
    return mix64(total[:n])


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Smallest or largest value of every run of ``size``."""
    width = 1
    while width * 2 <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return x if width == size else pick(x[:len(x) - (size - width)], x[size - width:])


def window_starts(first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Whether each word starts a window inside its text."""
    n = int(first[-1])
    ok = np.zeros(n, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            ok[a:b - size + 1] = True
    return ok


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word numbers of the anchors of all windows of the given texts."""
    ok = window_starts(words.first)
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    span = WINDOW - ANCHOR + 1
    a = rolling(words.hashes, ANCHOR, _BASE)
    low = _sliding(a, span, np.minimum)
    low = np.where(ok[:len(low)], low, np.uint64(0))
    # a run is an anchor when it is the smallest of some window that holds it
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero((_sliding(padded, span, np.maximum)[:len(a)] == a) & (a != 0))
    return a[chosen], chosen


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = utf8(part.column(3))
            words = Words(texts, _SPACE)
            found, at = anchors(words)
            edges = np.searchsorted(at, words.first)
            first = words.first.tolist()
            digests = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in texts]
            where = (at - np.repeat(words.first[:-1], np.diff(edges))).astype(np.int32)
            offsets = pa.array(edges.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(np.diff(np.array(first, np.int64))), pa.array(digests),
                 pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(where))],
                names=["doc_id", "k1", "k2", "n_words", "sha", "hashes", "at"],
            )


_ROW = "hash bigint, n bigint, k1 bigint, k2 bigint, at int"


class FingerprintIndex:
    """A run of ``(hash, n, k1, k2, at)`` bucketed and sorted by hash; the last three say where a hash with ``n = 1`` is.

    ``folder`` holds the runs (``run-<number>-<buckets>``); opened again it continues after its newest finished run.
    A run has a quarter as many buckets, and so files, as the session has shuffle partitions: its rows are narrow.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, (folder or stage.new_path(spark, "fingerprints")).rstrip("/")
        self.number, self.buckets, self.run = 0, -(-partitions_for(spark.range(0)) // 4), None
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path(self.folder)):
            names = sorted(s.getPath().getName() for s in fs.listStatus(path(self.folder)))
            for name in reversed([n for n in names if n.startswith("run-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]):
                self.number, self.buckets = int(name.split("-")[1]), int(name.split("-")[2])
                self.run = self._table(self._path())
                break

    def _path(self) -> str:
        return f"{self.folder}/run-{self.number:08d}-{self.buckets:06d}"

    def _table(self, path: str) -> DataFrame:
        """The run with its buckets known to Spark: an entry in the session's catalog over the folder."""
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_ROW}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.name = name
        return self.spark.table(name)

    def merged(self, batch: DataFrame) -> DataFrame:
        """The next run: a batch of ``(hash, weight, k1, k2, at)`` rows merge-joined with the run before."""
        fresh = batch.groupBy("hash").agg(F.sum("weight").alias("n"), F.any_value("k1").alias("k1"), F.any_value("k2").alias("k2"), F.any_value("at").alias("at"))
        if self.run is None:
            return fresh
        old = self.run.select("hash", F.col("n").alias("m"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("at").alias("oat"))
        return old.hint("merge").join(fresh, "hash", "full").select(
            "hash", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"),
            F.coalesce("o1", "k1").alias("k1"), F.coalesce("o2", "k2").alias("k2"), F.coalesce("oat", "at").alias("at"),
        )

    def settings(self) -> dict[str, str]:
        """As many shuffle partitions as buckets, and the order inside a bucket's one file trusted."""
        return {"spark__sql__shuffle__partitions": str(self.buckets), "spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}

    def add(self, batch: DataFrame) -> None:
        """Merge a batch in and compact: the new run replaces the old one once it is complete."""
        before, name = self._path(), getattr(self, "name", None)
        with settings(self.spark, **self.settings()):
            rows = self.merged(batch)
            self.number += 1
            temporary = f"run_{uuid.uuid4().hex}"
            writer = rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("compression", "zstd")
            writer.option("path", self._path()).saveAsTable(temporary)
            self.spark.sql(f"DROP TABLE {temporary}")  # the entry only: the files are in the index's folder
        self.run = self._table(self._path())
        if name is not None:
            self.spark.sql(f"DROP TABLE {name}")
            stage.delete(self.spark, before)

    def single(self) -> DataFrame:
        return self.run.where("n = 1").select("k1", "k2", "at")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {getattr(self, 'name', 'none')}")
        stage.delete(self.spark, self.folder)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"), text.alias("text")
    )


def _covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Words covered by windows at ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def _candidates(n_words: int, at: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of ``at``."""
    last = n_words - WINDOW
    if last < 0 or not len(at):
        return np.zeros(0, np.int64)
    change = np.zeros(last + 2, np.int64)
    np.add.at(change, np.maximum(0, at - (WINDOW - ANCHOR)), 1)
    np.add.at(change, np.minimum(last, at) + 1, -1)
    return np.flatnonzero(np.cumsum(change)[:-1] > 0)


def window_digests(text: bytes, starts: np.ndarray) -> np.ndarray:
    """128-bit digests of the windows at ``starts``, as two columns of 64 bits: of their words, joined by one space."""
    words = text.split()
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = hashlib.blake2b
    found = b"".join([digest(joined[a:b], digest_size=16).digest() for a, b in zip(begins[starts].tolist(), ends[starts + WINDOW - 1].tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(w1, w2, weight, k1, k2, at)`` of every candidate window."""
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(4)[k].as_buffer().to_pybytes()
            starts = _candidates(len(text.split()), np.asarray(batch.column(3)[k].values))
            key = [batch.column(c)[k] for c in (2, 0, 1)]
            for a in range(0, len(starts), 50_000):
                part = starts[a:a + 50_000]
                found = window_digests(text, part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[:, 0]), pa.array(found[:, 1]), *(pa.repeat(x, len(part)) for x in key), pa.array(part.astype(np.int32))],
                    names=["w1", "w2", "weight", "k1", "k2", "at"],
                )


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [{"start": a, "stop": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows of each candidate text, and the digest of what is left."""
    for batch in batches:
        for part in slices(batch, "text"):
            removed, spans, digests = [], [], []
            for weight, at, text, single in zip(part.column(2).to_pylist(), part.column(3), utf8(part.column(4)), part.column(5)):
                words = (text or b"").split()
                if weight > 1:
                    covered = np.full(len(words), len(words) >= WINDOW)
                else:
                    starts = _candidates(len(words), np.asarray(at.values))
                    if single.is_valid:
                        starts = np.setdiff1d(starts, np.asarray(single.values), assume_unique=True)
                    covered = _covered(len(words), starts)
                removed.append(int(covered.sum()))
                spans.append(_spans(covered))
                digests.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered.tolist()) if not c)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(spans, _SPAN), pa.array(digests, pa.string())],
                names=["k1", "k2", "n_removed", "spans", "kept_sha256"],
            )


_JUDGED = "k1 bigint, k2 bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept_sha256 string"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """``(rows, texts)``: one row per input row (``doc_id, k1, k2, n_words, sha``) and the verdict on each distinct text that holds a candidate."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col)
    rows = stage.save(
        map_text(keyed, _marks, f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, sha string, hashes array<bigint>, at array<int>"), "marks"
    )
    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # one row for each distinct text: its weight, one of its rows, its anchors
    texts = stage.save(
        rows.where("size(hashes) > 0").groupBy("k1", "k2").agg(
            F.count(F.lit(1)).alias("weight"), F.min(rid).alias("rid"), F.any_value("hashes").alias("hashes"), F.any_value("at").alias("at")
        ), "texts",
    )
    index = FingerprintIndex(spark)
    for k in range(batches):
        mine = texts.where(F.pmod("k1", F.lit(batches)) == k).select("weight", "k1", "k2", F.explode(F.arrays_zip("hashes", "at")).alias("x"))
        index.add(mine.select(F.col("x.hashes").alias("hash"), "weight", "k1", "k2", F.col("x.at").alias("at")))
    single = index.single().groupBy("k1", "k2").agg(F.collect_list("at").alias("single"))  # no longer than the text's own list
    left = texts.select("k1", "k2", "weight", "rid", "at").join(single, ["k1", "k2"], "left").select(
        "k1", "k2", "weight", "rid", F.when(F.col("single").isNull(), F.col("at")).otherwise(F.array_except("at", "single")).alias("at")
    )
    candidates = stage.save(left.where("size(at) > 0"), "candidates")
    stage.drop(texts)
    index.drop()
    kept = flag_maybe(keyed, key_filter(candidates, "k1"), F.col("k1"), "maybe").where("maybe").drop("maybe").withColumn("rid", rid)
    held = stage.save(
        candidates.join(kept.drop("doc_id"), ["k1", "k2", "rid"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "weight", "at", "text"), "held"
    )
    stage.drop(candidates)
    windows = map_text(held, _digests, "w1 bigint, w2 bigint, weight bigint, k1 bigint, k2 bigint, at int")
    once = windows.groupBy("w1", "w2").agg(
        F.sum("weight").alias("n"), F.any_value("k1").alias("k1"), F.any_value("k2").alias("k2"), F.any_value("at").alias("at")
    ).where("n = 1")
    dropped = stage.save(once.groupBy("k1", "k2").agg(F.collect_list("at").alias("single")), "once")
    verdict = stage.save(map_text(held.join(dropped, ["k1", "k2"], "left"), _judge, _JUDGED), "verdicts")
    stage.drop(held, dropped)
    return rows, verdict.where("n_removed > 0")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row."""
    rows, verdict = judge(docs, id_col, text_col, batches)
    return rows.select("doc_id", "k1", "k2", "n_words", "sha").join(verdict.drop("spans"), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def _cut(text_col: str, chars_col: str | None, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                names = part.schema.names
                at, cut = names.index(text_col), names.index(spans_col)
                texts = utf8(part.column(at))
                for k, spans in enumerate(part.column(cut)):
                    if spans.is_valid:
                        texts[k] = remove(texts[k], [(s["start"], s["stop"]) for s in spans.as_py()])
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.binary()).cast(part.column(at).type)
                if chars_col is not None:
                    n = names.index(chars_col)
                    new = [None if t is None else len(t.decode()) for t in texts]
                    changed = part.column(cut).is_valid().to_pylist()
                    columns[n] = pa.array([x if c else o for x, c, o in zip(new, changed, part.column(n).to_pylist())], part.column(n).type)
                del columns[cut]
                yield pa.RecordBatch.from_arrays(columns, names=[c for c in names if c != spans_col])

    return run


def remove(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans``; the separators between kept neighbours stay, one blank stands for a cut."""
    words = Words([text], _SPACE)
    out, at = [], 0
    for a, b in [*spans, (len(words.starts), len(words.starts))]:
        if a > at:
            out.append(text[words.starts[at]:words.ends[a - 1]])
        at = b
    return b" ".join(out)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated words cut from the text, every row and column kept; untouched texts stay as they are."""
    rows, verdict = judge(docs, id_col, text_col, batches)
    stage.drop(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2, spans, hit = (f"__{n}_{uuid.uuid4().hex}" for n in ("k1", "k2", "spans", "hit"))
    cut = verdict.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans))
    # only texts that may have a verdict are shuffled to it; the others pass in place
    keyed = flag_maybe(docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(17), text)}), key_filter(verdict, "k1"), F.col(k1), hit)
    touched = keyed.where(hit).join(cut, [k1, k2], "left").drop(k1, k2, hit)
    rest = keyed.where(~F.col(hit)).drop(k1, k2, hit)
    return map_text(touched.select(*docs.columns, spans), _cut(text_col, chars_col, spans), docs.schema).unionByName(rest)
