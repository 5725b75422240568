"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertape.plans import stage

#: Bytes of text that a worker turns into arrays at once (not a cap: longer texts form their own slice).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(col: Column | str) -> Column:
    """crc32 of an id's decimal text, unsigned; null ids count as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < n:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def share(spark: SparkSession, value):
    """Broadcast a bounded object together with its class, so that workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(broadcast):
    return cloudpickle.loads(broadcast.value)


#: Bits of a key filter, whatever the table's size; with far more keys than bits it lets every row through.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bit set over 64-bit keys as a stage table of ``(w, m)``: at most ``FILTER_BITS / 64`` rows, which bounds its broadcast."""
    at = keys.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).cast("int").alias("b"))
    return stage.save(at.selectExpr("b >> 6 AS w", "shiftleft(1L, b & 63) AS m").groupBy("w").agg(F.bit_or("m").alias("m")), "bits")


def flag_maybe(rows: DataFrame, bits: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the key may be in the filter. A broadcast join, so texts stay where they are."""
    w, m = f"{name}_w", f"{name}_m"
    at = F.pmod(key, F.lit(FILTER_BITS)).cast("int")
    found = rows.withColumns({w: F.shiftright(at, 6), name: at.bitwiseAND(F.lit(63))}).join(F.broadcast(bits.select(F.col("w").alias(w), F.col("m").alias(m))), w, "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(m), F.col(name)).bitwiseAND(F.lit(1)), F.lit(0)) == 1
    return found.withColumn(name, hit).drop(w, m)


#: Rows of text that travel to a Python worker at once, at most.
BATCH_ROWS = 512


def map_text(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` for rows that hold texts; the session's Arrow batches become small enough for long texts.

    The bound is a session setting because Spark has none for a single operator; a smaller one is left as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(conf.get(name))
    if held <= 0 or held > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for plans that are run inside the block (``__`` stands for a point); restored afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words:
    """Words of several texts found and hashed by array operations.

    ``space`` marks the byte values that separate words. ``starts`` and ``ends``
    index ``data`` (all texts, joined by line feeds), ``first[k]:first[k + 1]``
    are the words of text ``k`` and ``hashes`` are 64-bit hashes of their bytes.
    """

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, texts: list[bytes | None], space: np.ndarray, blank: "np.ndarray | None" = None) -> None:
        self.raw = b"\n".join(t or b"" for t in texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        outside = space[self.data]
        if blank is not None:
            outside = blank(self.data, outside)
        inside = np.empty(len(outside) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(outside, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.data) + 1
        held = Words._powers
        if held is None or len(held[0]) < n:
            size = max(n, SLICE_BYTES + 4096)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            held = (np.cumprod(up), np.cumprod(down))
            if n <= 4 * SLICE_BYTES:
                Words._powers = held
        sums = np.zeros(n, np.uint64)
        terms = sums[1:]  # all steps in place: one array of the slice's size
        terms += self.data
        terms += np.uint64(1)
        terms *= held[0][:n - 1]
        np.cumsum(terms, out=terms)
        return mix64((sums[self.ends] - sums[self.starts]) * held[1][self.starts])

    def text(self, word: int) -> bytes:
        return self.raw[self.starts[word]:self.ends[word]]


def byte_set(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out
