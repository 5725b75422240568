"""Embedding near-duplicates by inverted lists and product quantisation, with exact rerank.

Unit vectors are assigned to the nearest of ``n_lists`` coarse centroids and
their residuals are coded in ``SUBSPACES`` subspaces of 256 codes. Two
neighbours with different lists lie on either side of the border between them;
a vector therefore also visits every list whose border is within ``margin`` (no
cap on their number), and a pair is found when either visits the other's list.
The margin is measured, not assumed: pairs of exactly the least cosine are made
from sample vectors and directions between sample vectors, so that they vary as
the data do, real pairs of the sample are added, and the margin is what
``SURE`` of them need. Closer pairs need less.

The visitor is compared with the decoded members (asymmetric: the visitor is not
quantised) by a matrix product. By the triangle inequality a neighbour's
distance to the decoded member is at most ``r = sqrt(2 - 2 t)`` plus its stored
coding error, so this filter loses nothing. What passes is compared by cosine in
double precision.

Lists hold about ``LIST_SIZE`` members, so their number grows with the table, up
to ``MAX_LISTS`` lists; beyond some 67 million vectors the lists grow. Where the
vectors spread evenly over many dimensions the number of visited lists grows as
well (on 64 even dimensions about with the power 0.7 of their number); a lower
``sure`` trades that for recall. A list is dealt to tasks of at most about
``TILE`` members and ``VISITORS`` visitors; a longer one is cut on both sides.
Where two neighbours visit each other's lists, the pair counts in the lower one.
Identical vectors are one node with a multiplicity. Tasks return link counts and
a spanning forest of the links they saw, not all pairs.

Centroids, codes and margin are fitted on a bounded sample (four vectors for
each list and at least ``SAMPLE``, those with the smallest hash); every vector
is indexed and every vector is a query.

Defined cases: a vector that is null or empty, is zero, or holds a null or
non-finite component links with nothing and is its own component; vectors of
another length than most link only among vectors of their length; repeated rows
link with each other; an empty table gives an empty result; null ids keep their
row and name no component unless alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import partitions_for, share, shared_value
from ordertape.llm.simhash import _Forest
from ordertape.operators.components import connected_components
from ordertape.plans import stage

COSINE = 0.9
SAMPLE = 16_384
LIST_SIZE = 1024
MAX_LISTS = 65_536
TILE = 2048
VISITORS = 8192
SUBSPACES = 8
#: Share of the measured pairs that the margin must find, and the least number of pairs to measure.
SURE = 1.0
MEASURED = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (large components cannot overflow)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norms = (centers**2).sum(axis=1)
    step = max(1, 1 << 22 >> len(centers).bit_length())  # bounded working memory for any number of centers
    return np.concatenate([np.argmin(norms - 2 * x[a:a + step] @ centers.T, axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    centers: np.ndarray
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]
    reach: float
    margin: float = math.inf

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list, codes and coding error of unit vectors."""
        home = _nearest(x, self.centers)
        rest = x - self.centers[home]
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        return home, codes, np.linalg.norm(rest - self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def borders(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Distance of each vector to the border between its own list and every other (infinite for its own)."""
        norms = (self.centers**2).sum(axis=1)
        own = self.centers[home]
        over = norms - norms[home][:, None] - 2 * (x @ self.centers.T - np.einsum("ij,ij->i", x, own)[:, None])
        apart = np.sqrt(np.maximum(norms + norms[home][:, None] - 2 * own @ self.centers.T, 0))
        out = np.where(apart > 1e-12, over / np.maximum(2 * apart, 1e-12), 0.0)
        out[np.arange(len(x)), home] = math.inf
        return out

    def visits(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of vector and other list that it visits."""
        step = max(1, 1 << 22 >> len(self.centers).bit_length())
        rows, lists = [], []
        for a in range(0, len(x), step):
            i, j = np.nonzero(self.borders(x[a:a + step], home[a:a + step]) <= self.margin)
            rows.append(i + a)
            lists.append(j)
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def needed_margins(held: Quantiser, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The margin with which each pair would be found: the lesser of both vectors' distances to the border between their lists."""
    a, b = _nearest(x, held.centers), _nearest(y, held.centers)
    apart = held.centers[b] - held.centers[a]
    norms = (held.centers**2).sum(axis=1)
    length = np.maximum(2 * np.linalg.norm(apart, axis=1), 1e-12)
    over = norms[b] - norms[a]
    there, back = (over - 2 * np.einsum("ij,ij->i", x, apart)) / length, -(over - 2 * np.einsum("ij,ij->i", y, apart)) / length
    return np.where(a == b, 0.0, np.minimum(there, back))


def measured_margin(held: Quantiser, sample: np.ndarray, cosine: float, rng: np.random.Generator, sure: float = SURE) -> float:
    """The margin that a share ``sure`` of the measured pairs needs, with a slack of 5 %; half the reach is always enough."""
    if len(held.centers) < 2:
        return 0.0
    turn = math.sqrt(max(0.0, 1 - cosine**2))
    made = []
    for _ in range(max(2, MEASURED // len(sample))):
        other = sample[rng.permutation(len(sample))]
        way = other - np.einsum("ij,ij->i", other, sample)[:, None] * sample
        length = np.linalg.norm(way, axis=1)
        ok = length > 1e-9
        made.append(needed_margins(held, sample[ok], cosine * sample[ok] + turn * way[ok] / length[ok][:, None]))
    real = []
    for a in range(0, min(len(sample), 2048), 256):
        i, j = np.nonzero(sample[a:a + 256] @ sample.T >= cosine)
        apart = i + a != j
        real.append(needed_margins(held, sample[i[apart] + a], sample[j[apart]]))
    needs = [np.concatenate(made), np.concatenate(real)]
    return min(1.05 * max((float(np.quantile(n, sure)) for n in needs if len(n)), default=0.0), held.reach / 2) + 1e-9


def fit(sample: np.ndarray, n_lists: int, cosine: float = COSINE, subspaces: int = SUBSPACES, seed: int = 7, sure: float = SURE) -> Quantiser:
    rng = np.random.default_rng(seed)
    centers = _kmeans(sample, n_lists, rng, 8 if n_lists <= 1024 else 2)
    dims = sample.shape[1]
    some = sample[:SAMPLE]
    rest = some - centers[_nearest(some, centers)]
    edges = np.linspace(0, dims, min(subspaces, dims) + 1).astype(int)
    cuts = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]
    books = [_kmeans(rest[:, a:b], 256, rng, 5) for a, b in cuts]
    held = Quantiser(centers, cuts, books, math.sqrt(max(0.0, 2 - 2 * cosine)))
    held.margin = measured_margin(held, some, cosine, rng, sure)
    return held


def _vectors(column: pa.Array | pa.ChunkedArray, n: int, dims: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(n, dims)


def _index(shared, dims: int):
    """Rows of vectors with their list, code, coding error and the other lists that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared_value(shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_vectors(batch.column(2), batch.num_rows, dims))
            home, codes, error = held.assign(x)
            rows, lists = held.visits(x, home)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(x)))))
            near = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lists.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), near],
                names=["list", "node", "count", "vector", "code", "error", "near"],
            )

    return run


class _Tile:
    """Members of a list: vectors, decoded codes and the least product that a neighbour's residual can have with each."""

    def __init__(self, held: Quantiser, dims: int, list_id: int, rows: pa.Table) -> None:
        n = rows.num_rows
        self.list, self.node, self.count = list_id, rows.column("node").to_numpy(), rows.column("count").to_numpy()
        self.x = unit(_vectors(rows.column("vector"), n, dims))
        near = rows.column("near").combine_chunks()
        self.goes = np.repeat(np.arange(n), np.diff(near.offsets.to_numpy())) * len(held.centers) + near.flatten().to_numpy()
        back = held.decode(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(n, -1))
        # visitor . member with the lengths in a further component: half of what the squared distance falls short of its limit
        limit = (held.reach + rows.column("error").to_numpy() + 1e-9) ** 2 + 1e-5 + 1e-6 * dims  # with the rounding of single precision
        self.back = np.concatenate((back, np.ones((n, 1))), axis=1).astype(np.float32)
        self.least = (((back**2).sum(axis=1) - limit) / 2).astype(np.float32)


def _meet(held: Quantiser, cosine: float, visitors: np.ndarray, to: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between visitors and members, as pairs of their places."""
    for a in range(0, len(visitors), 256):
        rest = visitors[a:a + 256] - held.centers[to.list]
        looked = np.concatenate((rest, -(rest**2).sum(axis=1, keepdims=True) / 2), axis=1).astype(np.float32) @ to.back.T
        hits = np.flatnonzero(looked >= to.least)
        for b in range(0, len(hits), 1 << 16):
            i, j = np.divmod(hits[b:b + (1 << 16)], len(to.node))
            exact = np.einsum("ij,ij->i", visitors[i + a], to.x[j]) >= cosine
            yield i[exact] + a, j[exact]


_FOUND = "node bigint, links bigint, other bigint"


def _compare(shared, dims: int, cosine: float):
    """Link counts and forest edges of one part of a list: its members among themselves (first chunk) and with visitors."""

    def group(key: tuple, table: pa.Table) -> pa.Table:
        held, chunk = shared_value(shared), key[2].as_py()
        guests = table.filter(pc.field("home").is_valid())
        to = _Tile(held, dims, key[0].as_py(), table.filter(pc.field("home").is_null()))
        n = len(to.node)
        node = np.concatenate((to.node, guests.column("node").to_numpy()))
        count = np.concatenate((to.count, guests.column("count").to_numpy()))
        links, forest, edges = np.zeros(len(node), np.int64), _Forest(len(node)), []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(links, i, count[j])
            np.add.at(links, j, count[i])
            edges.extend((p, q) for p, q in zip(i.tolist(), j.tolist()) if forest.join(p, q))

        if n and chunk == 0:
            for i, j in _meet(held, cosine, to.x, to):
                add(i[i < j], j[i < j])
        if n and guests.num_rows:
            home = guests.column("home").to_numpy()
            for i, j in _meet(held, cosine, unit(_vectors(guests.column("vector"), guests.num_rows, dims)), to):
                # a member that visits the guest's list meets it there as well: the pair counts in the lower list
                twice = (home[i] < to.list) & np.isin(j * len(held.centers) + home[i], to.goes)
                add(i[~twice] + n, j[~twice])
        hit = np.flatnonzero(links)
        # one row per linked node (its links here), and one per edge of the forest
        return pa.table({
            "node": pa.array(node[hit].tolist() + [int(node[p]) for p, _ in edges], pa.int64()),
            "links": pa.array(links[hit].tolist() + [0] * len(edges), pa.int64()),
            "other": pa.array([None] * len(hit) + [int(node[q]) for _, q in edges], pa.int64()),
        })

    return group


def _parts(listed: DataFrame, tile: int, visitors: int) -> DataFrame:
    """Members and visitors of every part ``(list, tile, chunk)``; ``home`` is null for members.

    A visitor meets all tiles of a list; a member of a list with several tiles visits the higher ones. The visitors of a tile are dealt to
    chunks. Only lists longer than a tile, or with more visitors than a chunk, have more than one part.
    """
    members = listed.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    guests = listed.select(F.explode("near").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("v"))
    sizes = members.join(guests, "list", "left").select(
        "list", F.ceil(F.col("m") / tile).cast("int").alias("tiles"),
        F.greatest(F.lit(1), F.ceil((F.coalesce("v", F.lit(0)) + F.when(F.col("m") > tile, F.col("m")).otherwise(0)) / visitors)).cast("int").alias("chunks"),
    )
    sizes = F.broadcast(stage.save(sizes, "list-sizes"))  # at most MAX_LISTS rows
    tiled = lambda df: df.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("chunks")).cast("int"))
    span = lambda a, b: F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    zero = F.lit(0)
    held = tiled(listed)
    stay = held.select("list", F.col("own").alias("tile"), span(zero, F.col("chunks") - 1).alias("chunk"), F.lit(None).cast("int").alias("home"),
                       "node", "count", "vector", "code", "error", "near")
    higher = held.where("tiles > 1").select("list", span(F.col("own") + 1, F.col("tiles") - 1).alias("tile"), "chunk", F.col("list").alias("home"), "node", "count", "vector")
    come = listed.select(F.explode("near").alias("to"), "list", "node", "count", "vector").select(F.col("to").alias("list"), F.col("list").alias("home"), "node", "count", "vector")
    come = tiled(come).select("list", span(zero, F.col("tiles") - 1).alias("tile"), "chunk", "home", "node", "count", "vector")
    return stay.unionByName(higher, allowMissingColumns=True).unionByName(come, allowMissingColumns=True)


def _search(nodes: DataFrame, dims: int, cosine: float, total: int, list_size: int, tile: int, visitors: int, sure: float) -> DataFrame:
    """``(node, links, other)``: partial link counts, and forest edges where ``other`` is set."""
    spark = nodes.sparkSession
    n_lists = max(1, min(MAX_LISTS, total // list_size))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, 4 * n_lists)).select("vector").toArrow().column("vector")
    x = unit(_vectors(sample, len(sample), dims))
    shared = share(spark, fit(x, min(n_lists, max(1, len(x) // 4)), cosine, sure=sure))
    kind = nodes.schema["vector"].dataType.simpleString()
    row = f"list int, node bigint, count bigint, vector {kind}, code binary, error double, near array<int>"
    listed = stage.save(nodes.select("node", "count", "vector").repartition(partitions_for(nodes)).mapInArrow(_index(shared, dims), row), "pq")
    return _parts(listed, tile, visitors).groupBy("list", "tile", "chunk").applyInArrow(_compare(shared, dims, cosine), _FOUND)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    list_size: int | None = None, tile: int | None = None, visitors: int = VISITORS, sure: float = SURE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row; ``list_size`` and ``tile`` are ``LIST_SIZE`` and ``TILE`` unless given."""
    list_size, tile = list_size or LIST_SIZE, tile or TILE
    v = F.col("vector")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | F.forall(v, lambda c: c == 0)
    # single precision stays as it is; anything else is held in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")).select(
        "vec_id", "vector", F.coalesce(~bad, F.lit(False)).alias("ok"),
    )
    # identical vectors share a 128-bit key; a row without a usable vector has none
    keyed = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(17), "vector")))
    distinct = keyed.where("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count"), F.any_value("vector").alias("vector")
    )
    nodes = stage.save(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for size, total in sorted(tuple(r) for r in nodes.groupBy(F.size("vector")).agg(F.count(F.lit(1))).collect()):
        part = _search(nodes.where(F.size("vector") == size), size, cosine, total, list_size, tile, visitors, sure)
        found = part if found is None else found.unionByName(part)
    key = keyed.select("vec_id", "k1", "k2", "ok")
    if found is None:
        return key.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage.save(found, "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null"), "node", "other")
    named = nodes.select("k1", "k2", "node", "rep", "count").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    summary = named.join(lowest, "root").join(links, "node", "left").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links")
    )
    out = key.join(summary, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("ok"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
