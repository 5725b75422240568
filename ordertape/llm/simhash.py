"""SimHash near-duplicate classes by tiled exact comparison of fingerprints.

A text's words are its maximal runs of non-blank bytes after lower-casing A-Z;
its features are the 3-word shingles, repeats included (the whole sequence when
it has one or two words). A fingerprint bit is set when it is set in more than
half of the shingles' XXH64 values (seed 42). Documents are linked when their
fingerprints differ in at most ``radius`` bits; classes are the connected
components of those links.

Comparison is exact at every size. Two fingerprints within 3 bits agree on one
of four 16-bit blocks and, inside the other 48 bits, on one of four 12-bit
blocks, so every pair meets under one of 16 keys of 28 compared bits. Distinct
fingerprints of a key are ordered by population count and compared in tiles
with numpy exclusive-or and bit counts; a pair of tiles whose population counts
lie further apart than the radius is skipped. A key with more fingerprints than
a tile is cut into tiles of one population count each; pairs of tiles within the
radius are dealt out and the others never formed, so no task holds an unbounded
group, and each task returns a spanning forest of its links instead of all pairs.

Defined cases: null or blank text has fingerprint zero and links like any
other; repeated rows and equal texts share a fingerprint; null ids keep their
row and do not name a class; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertape.llm.common import flag_maybe, key_filter, map_text, partitions_for, settings, slices, utf8
from ordertape.operators.components import connected_components
from ordertape.plans import stage

RADIUS = 3
TILE = 2048


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of one text (UTF-8 bytes)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - 2)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(2, len(words) - 1):].tolist()
    digest = xxhash.xxh64_intdigest
    half, counts = n / 2, np.zeros(64, np.int64)
    for k in range(0, n, 8192):  # bounded working memory for very long texts
        values = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k:k + 8192], stops[k:k + 8192])], np.uint64)
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts > half).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp bigint")


def _keys(nodes: DataFrame) -> DataFrame:
    """``(key, fp)``: the 16 keys under which a fingerprint meets its neighbours."""
    keys = []
    for block in range(4):
        value = F.shiftrightunsigned("fp", 16 * block).bitwiseAND(F.lit(0xFFFF))
        # the other 48 bits, closed up
        low = F.col("fp").bitwiseAND(F.lit((1 << (16 * block)) - 1))
        rest = F.shiftleft(F.shiftrightunsigned("fp", 16 * block + 16), 16 * block).bitwiseOR(low) if block < 3 else low
        for inner in range(4):
            sub = F.shiftrightunsigned(rest, 12 * inner).bitwiseAND(F.lit(0xFFF))
            keys.append(
                F.lit(block * 4 + inner).cast("bigint") * F.lit(1 << 28) + F.shiftleft(value, 12).bitwiseOR(sub)
            )
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


class _Forest:
    """Union by smallest member over small integers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, tile: int = 256) -> Iterator[tuple[int, int]]:
    """Index pairs within the radius; both sides are ordered by population count."""
    lp, rp = np.bitwise_count(left), np.bitwise_count(right)
    for i in range(0, len(left), tile):
        a, ap = left[i:i + tile], lp[i:i + tile]
        for j in range(0, len(right), tile):
            b, bp = right[j:j + tile], rp[j:j + tile]
            if int(bp[0]) - int(ap[-1]) > radius or int(ap[0]) - int(bp[-1]) > radius:
                continue
            hit = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            for x, y in zip(*np.nonzero(hit)):
                yield i + int(x), j + int(y)


def _links(values: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one tile, or between the two sides of a tile pair."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, side = values[order], side[order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    forest, out = _Forest(len(values)), []
    for x, y in near_pairs(values[left], values[right], radius):
        a, b = int(left[x]), int(right[y])
        if a != b and forest.join(a, b):
            out.append((a, b))
    return [(int(values[a]), int(values[b])) for a, b in out]


def _compare(radius: int):
    names = ["a", "b"]

    def flush(block: np.ndarray, fps: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``block``: start of each group; most groups are small and are compared all at once."""
        n = len(fps)
        ends = np.append(block[1:], n)
        sizes = ends - block
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        small = sizes <= 16
        group = np.repeat(np.arange(len(block)), sizes)
        keep = small[group]
        f, s, g = fps[keep], side[keep], group[keep]
        for shift in range(1, 16):
            same = g[shift:] == g[:-shift]
            if not same.any():
                break
            x, y = f[:-shift][same], f[shift:][same]
            mixed = (s[:-shift][same] != s[shift:][same]) | (s[shift:][same] == 2)
            hit = mixed & (np.bitwise_count(x ^ y) <= radius)
            out_a.append(x[hit])
            out_b.append(y[hit])
        for k in np.flatnonzero(~small):
            part = slice(block[k], ends[k])
            pairs = _links(fps[part], np.where(side[part] == 2, 0, side[part]), radius)
            if pairs:
                p = np.array(pairs, np.uint64)
                out_a.append(p[:, 0])
                out_b.append(p[:, 1])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the group that the last batch left open
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held:
                cols = [np.concatenate([h[k] for h in held] + [cols[k]]) for k in range(4)]
                held = []
            key, tile, fps, side = cols
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
            last = starts[-1]
            held = [tuple(c[last:] for c in cols)]
            if len(starts) > 1:
                yield from flush(starts[:-1], fps[:last].view(np.uint64), side[:last])
        if held:
            yield from flush(np.array([0]), held[0][2].view(np.uint64), held[0][3])

    return run


def linked_fingerprints(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that span every class."""
    if radius > 3:
        raise ValueError("16 keys are exact up to a radius of 3")
    keyed = _keys(nodes)
    bits = F.bit_count("fp")
    big = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("key")
    counted = keyed.join(big, "key").groupBy("key", bits.alias("p")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("t"))
    # tiles of each population count of a large key: at most 65 entries
    tiles = counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("p", "t"))).alias("tiles"))
    rows = keyed.join(tiles, "key", "left").withColumn("p", bits)
    # small key: one tile (side 2: all pairs). Large key: a tile holds one population count, and only tiles whose counts differ by no
    # more than the radius meet, one task group for each pair
    code = lambda p, t: p * F.lit(1 << 16) + t
    mine = code(F.col("p"), F.pmod(F.xxhash64("fp"), F.try_element_at("tiles", F.col("p"))).cast("int"))
    reach = F.sequence(F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(64)))
    none = F.array().cast("array<int>")
    others = F.flatten(F.transform(reach, lambda q: F.coalesce(
        F.transform(F.sequence(F.lit(1), F.try_element_at("tiles", q)), lambda t: code(q, t - 1)), none)))
    spread = F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("tile"), F.lit(2).alias("side")))).otherwise(
        F.transform(
            others,
            lambda o: F.struct(
                (F.least(mine, o).cast("bigint") * F.lit(1 << 32) + F.greatest(mine, o)).alias("tile"),
                F.when(mine == o, F.lit(2)).when(mine < o, F.lit(0)).otherwise(F.lit(1)).alias("side"),
            ),
        )
    )
    dealt = rows.select("key", "fp", F.explode(spread).alias("t")).select("key", F.col("t.tile").alias("tile"), "fp", F.col("t.side").alias("side"))
    sorted_rows = dealt.repartition(partitions_for(nodes), "key", "tile").sortWithinPartitions("key", "tile")
    return sorted_rows.mapInArrow(_compare(radius), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    ``component_id`` is the smallest id reachable over links, the row's own
    included (null only when no row of the class has an id).
    """
    fps = stage.save(fingerprints(docs, id_col, text_col), "simhash")
    nodes = stage.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="10000"):  # numbers, not texts
        links = stage.save(linked_fingerprints(nodes.select("fp"), radius), "simhash-links")
    joined = connected_components(links, "a", "b")
    stage.drop(links)
    labelled = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    # nodes are distinct fingerprints, so a class of copies counts once here
    lowest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(lowest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id names their class: one document of each group, all columns kept.

    Rows that repeat an id (the same document twice) are reduced to one, the
    smallest by text; rows without an id cannot be told apart and stay.
    """
    found = stage.save(classes(docs, id_col, text_col, radius), "simhash-classes")
    # documents move only when their id may be among those to drop; the others pass in place
    dropped = stage.save(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__drop")).distinct(), "dropped")
    key = f"__key_{uuid.uuid4().hex}"
    keyed = flag_maybe(docs, key_filter(dropped.select(F.xxhash64("__drop").alias("key")), "key"), F.xxhash64(F.col(id_col)), key)
    judged = keyed.where(key).drop(key)
    judged = judged.join(dropped, judged[id_col] == dropped["__drop"], "left_anti")
    rows = keyed.where(~F.col(key)).drop(key).unionByName(judged)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    stage.drop(found)
    if repeated:
        named = rows.where(F.col(id_col).isNotNull())
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
        named = named.withColumn(key, F.row_number().over(order)).where(F.col(key) == 1).drop(key)
        rows = named.unionByName(rows.where(F.col(id_col).isNull()))
    return rows
