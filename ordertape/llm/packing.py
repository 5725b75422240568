"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Texts are tokenised, an end id is appended, and only documents longer than a
sequence are cut. Full pieces are sequences of their own. The shorter ones are
dealt by hash into shards of about ``SHARD`` pieces, which bounds every task
whatever the table's size; each shard is evolved on several islands at once. A
chromosome is a list of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold the same pieces and packs the
displaced pieces: first in exchange for pieces that fill a bin worse, then by
best fit; mutation empties the worst bins. A shard whose number of bins is the
least that its total size allows is done, which ends the search at once where
many short pieces fill every gap. Between epochs
each island receives the best packing of its neighbour (a shuffle of packings,
not of texts). The best packing of each shard is the result.

Whitespace-separated chunks are tokenised once for each slice of text, most of them
by array operations; this equals tokenising the whole text because the tokenizer
never joins across white space.

Defined cases: null text counts as empty and becomes a piece of the end id;
rows that repeat an id are packed each (``copy`` tells them apart); very long
texts are processed whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import SLICE_BYTES, map_text, partitions_for, slices
from ordertape.plans import stage

CAPACITY = 2048
END_ID = 0
SHARD = 4096
ISLANDS = 3
GENERATIONS = 24
POPULATION = 6
#: Generations without fewer bins after which a search ends.
PATIENCE = 5
#: Longest word in bytes that is merged by array operations; longer ones go to the tokenizer.
_LONGEST = 48
#: What the array operations reproduce: the normal form and lower case leave the letters of Latin-1 apart, and these words are cut out.
_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_OTHER, _LETTER, _DIGIT, _MARK = range(4)


class Merges:
    """Byte-pair merges of many short words at once: of each word the pair of lowest rank, the leftmost among equals, round by round."""

    _BITS, _EMPTY, _NONE = 18, np.uint32(0xFFFFFFFF), np.int32(1 << 24)

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        letters = [chr(b if b in printable else next(others)) for b in range(256)]
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        if max(vocab.values()) >= 0xFFFF or len(np.unique(keys)) < len(keys):
            raise ValueError("too many tokens, or a pair that is merged in two ways")
        # open addressing: a key lies at its place or in the unbroken run of used places behind it
        self.keys, self.ranks = np.full(1 << self._BITS, self._EMPTY), np.zeros(1 << self._BITS, np.int32)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == self._EMPTY]
            place, one = np.unique(at[free], return_index=True)
            self.keys[place], self.ranks[place] = keys[free[one]], free[one]
            todo = np.setdiff1d(todo, free[one], assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self._BITS) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self._BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair; ``_NONE`` where it is never merged."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], self._NONE)
        rest = np.flatnonzero((held != keys) & (held != self._EMPTY))
        at = at[rest]
        while len(rest):
            at = at + 1 & ((1 << self._BITS) - 1)
            held, mine = self.keys[at], keys[rest]
            same = held == mine
            out[rest[same]] = self.ranks[at[same]]
            more = ~same & (held != self._EMPTY)
            rest, at = rest[more], at[more]
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (none empty, none over ``_LONGEST`` bytes) in one run, and the number of ids of each."""
        count, found = np.empty(len(starts), np.int64), []
        for n in np.unique(lengths).tolist():
            words = np.flatnonzero(lengths == n)
            symbols = self.inner[data[starts[words] + np.arange(n)[:, None]]]
            symbols[-1] = self.final[data[starts[words] + n - 1]]
            for ended, ids in self._rounds(symbols, words):
                count[ended] = len(ids)
                found.append((ended, ids))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        for ended, ids in found:
            at = first[ended]
            for k, row in enumerate(ids):
                out[at + k] = row
        return out, count

    def _rounds(self, symbols: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A row for each place, a column for each word; each round takes a place from every word that is left.

        Keys hold the rank and, in six bits, the place of a pair.
        """
        place = np.arange(len(symbols), dtype=np.int32)[:, None]
        keys = self.rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(len(symbols) - 1, len(words)) << 6 | place[:-1]
        while len(symbols) > 1:
            least = keys.min(axis=0)
            left = least < 1 << 29
            if not left.all():
                yield words[~left], symbols[:, ~left]
                symbols, keys, least, words = symbols[:, left], keys[:, left], least[left], words[left]
            if not len(words):
                return
            p, column = least & 63, np.arange(len(words))
            symbols = np.where(place[:len(symbols) - 1] <= p, symbols[:-1], symbols[1:])
            symbols[p, column] = self.made[least >> 6]
            # pairs behind the merged one move up by a place, and the two that it is part of now are looked up
            keys = np.where(place[:len(keys) - 1] < p, keys[:-1], keys[1:] - 1)
            for at, on in ((p - 1, p > 0), (p, p < len(keys))):
                at, on = at[on], column[on]
                keys[at, on] = self.rank(symbols[at, on], symbols[at + 1, on]) << 6 | at
        yield words, symbols


class ChunkTokenizer:
    """Ids of white-space separated chunks.

    Chunks of printable ASCII but the apostrophe and of Latin-1's letters are cut into words and merged by array
    operations, where the tokenizer's settings are those that these reproduce. All others go to the tokenizer; the first
    ``most`` different ones are remembered (frequent ones come early), later ones are tokenised again in each slice of text
    that holds them.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.full, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as file:
            self.merges = self._merges(json.load(file))

    def _merges(self, told: dict) -> Merges | None:
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        forms, cuts = (told.get("normalizer") or {}).get("normalizers", []), cut.get("pretokenizers", [])
        plain = model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = {x["type"] for x in forms} == _NORMALIZERS and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        if not (plain and known and told.get("post_processor") is None and told.get("truncation") is None and told.get("padding") is None):
            return None
        blanks = [(x["pattern"], x["content"]) for x in forms if x["type"] == "Replace"]
        if blanks != [({"Regex": r"\s+"}, " ")] or cuts[0]["pattern"] != {"Regex": _WORDS} or cuts[0]["behavior"] != "Removed" \
                or not cuts[0]["invert"] or cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"):
            return None
        kind = np.full(256, _OTHER, np.uint8)
        kind[33:127] = _MARK
        kind[ord("0"):ord("9") + 1] = _DIGIT
        kind[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]] = _LETTER
        kind[ord("'")] = _OTHER
        for token in told.get("added_tokens", []):  # the tokenizer looks for these itself
            first = token["content"][:1]
            if not first or first.isspace() or token.get("lstrip") or token.get("rstrip"):
                return None
            kind[[x.encode()[0] for x in (first.lower(), first.upper())]] = _OTHER
        self.kind = kind
        try:
            return Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        except (KeyError, ValueError):
            return None

    def _encoded(self, chunks: list[str]) -> list[np.ndarray]:
        out = list(map(self.known.get, chunks))
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.full.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4")
            if len(self.known) < self.most:
                self.known[chunks[k]] = out[k]
        return out

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks in one run, where each chunk starts in it and its number of ids; chunks hold no ASCII white space."""
        n = len(chunks)
        start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        other, flat = np.ones(n, bool), np.zeros(0, "<u4")
        if self.merges is not None and n:
            wide = pa.types.is_large_string(chunks.type)
            bounds = np.frombuffer(chunks.buffers()[1], np.int64 if wide else np.int32)[chunks.offset:chunks.offset + n + 1].astype(np.int64)
            data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            bounds -= bounds[0]
            kind = self.kind[data]
            behind = np.zeros(len(data), bool)  # second byte of a letter of Latin-1
            behind[1:] = data[:-1] == 0xC3
            bad = (kind == _OTHER) | ((data & 0xC0 == 0x80) & ~behind) | (behind & ((data == 0x97) | (data == 0xB7)))
            upper = (data >= 65) & (data <= 90) | behind & (data <= 0x9E)
            lower = data + (upper.view(np.uint8) << 5)
            begin = np.ones(len(data), bool)
            begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            begin[bounds[:-1][bounds[:-1] < len(data)]] = True
            words = np.flatnonzero(begin)
            lengths = np.diff(words, append=len(data))
            first = np.searchsorted(words, bounds)
            before = np.concatenate(([0], np.cumsum(bad)))
            other = before[bounds[1:]] > before[bounds[:-1]]
            other[np.searchsorted(bounds, words[lengths > _LONGEST], side="right") - 1] = True
            mine = np.where(other, 0, np.diff(first))
            use = np.repeat(~other, np.diff(first))
            flat, count = self.merges.words(lower, words[use], lengths[use])
            edges, sums = np.concatenate(([0], np.cumsum(mine))), np.concatenate(([0], np.cumsum(count)))
            start, size = sums[edges[:-1]], np.diff(sums[edges])
        rest = np.flatnonzero(other)
        if len(rest):
            more = self._encoded(chunks.take(pa.array(rest)).to_pylist())
            size[rest] = [len(x) for x in more]
            start[rest] = len(flat) + np.cumsum(size[rest]) - size[rest]
            flat = np.concatenate([flat, *more])
        return flat, start, size

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one run, and where each text starts in it (one more at the end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        # blanks at the ends give empty chunks, which have no ids
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        flat, start, size = self.ids(words.dictionary)
        index = words.indices.to_numpy()
        lengths = size[index]
        ends = np.cumsum(lengths)
        at = np.repeat(start[index] - (ends - lengths), lengths)
        at += np.arange(len(at))
        bounds = np.concatenate(([0], ends))[offsets - offsets[0]]
        return flat[at], bounds


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small batches as one of about ``most`` bytes at most, so that their common words are read once; larger ones as they are."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """``(doc_id, copy, piece, start, length, ids_crc32)``; ``copy`` numbers rows so that repeated ids stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process keeps its tokenizer and its words from task to task
        import tokenizers

        held = tokenizers.__dict__.setdefault("_ordertape_chunks", {})
        if tokenizer not in held:
            held[tokenizer] = ChunkTokenizer(tokenizer)
        tok = held[tokenizer]
        for batch in _gathered(batches, 4 * SLICE_BYTES):
            for part in slices(batch, "text", 4 * SLICE_BYTES):
                ids, bounds = tok.texts(part.column(1))
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False)
                first = bounds + np.arange(len(bounds))
                whole = np.diff(first)
                count = -(-whole // capacity)
                rows = np.repeat(np.arange(len(whole)), count)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(whole[rows] - start, capacity)
                at, view = first[rows] + start, memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("copy"))
    return map_text(rows, run, f"doc_id {kind}, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Packing:
    """Bins of piece numbers; free space per bin is kept in a bit set for best fit."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def fill(self, items: list[int]) -> "Packing":
        """Best fit, larger pieces first."""
        by_free: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.free):
            if f:
                by_free.setdefault(f, []).append(b)
                mask |= 1 << f
        sizes = self.sizes
        for item in sorted(items, key=lambda k: (-sizes[k], k)):
            size = sizes[item]
            fits = mask >> size
            if fits:
                f = size + (fits & -fits).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    mask &= ~(1 << f)
                self.bins[b].append(item)
            else:
                b, f = len(self.bins), self.capacity
                self.bins.append([item])
                self.free.append(f)
            f -= size
            self.free[b] = f
            if f:
                by_free.setdefault(f, []).append(b)
                mask |= 1 << f
        return self

    def key(self) -> tuple[int, int]:
        """Fewer bins first; then the more uneven filling, which leaves room to improve."""
        return len(self.bins), -sum((self.capacity - f) ** 2 for f in self.free)

    def keep(self, bins: list[int]) -> "Packing":
        out = Packing(self.sizes, self.capacity)
        out.bins = [list(self.bins[b]) for b in bins]
        out.free = [self.free[b] for b in bins]
        return out


def exchange(packing: Packing, loose: list[int], rng: np.random.Generator, most: int = 200) -> list[int]:
    """Fill bins better with displaced pieces: one or two of them for a piece, or one for two, where the bin gets fuller.

    Returns the pieces that are displaced then: they are smaller, so best fit finds more room for them.
    """
    sizes = packing.sizes
    pool = sorted((sizes[i], i) for i in loose)
    open_bins = [b for b, f in enumerate(packing.free) if f]
    for b in rng.permutation(open_bins)[:most].tolist():
        room, items = packing.free[b], packing.bins[b]
        if not room or not pool:
            continue
        best, change = 0, None
        outs = [(sizes[i], (i,)) for i in items] + [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(items[:6]) for j in items[k + 1:6]]
        for size, out in outs:
            k = bisect_right(pool, (size + room, math.inf)) - 1
            if k >= 0 and pool[k][0] - size > best:
                best, change = pool[k][0] - size, (out, (k,))
            low, high = 0, k
            while len(out) == 1 and low < high and best < room:  # the best pair of displaced pieces that fits
                both = pool[low][0] + pool[high][0]
                if both > size + room:
                    high -= 1
                else:
                    if both - size > best:
                        best, change = both - size, (out, (low, high))
                    low += 1
        if change is not None:
            out, into = change
            packing.bins[b] = [i for i in items if i not in out] + [pool[k][1] for k in into]
            packing.free[b] = room - best
            for k in sorted(into, reverse=True):
                del pool[k]
            for i in out:
                insort(pool, (sizes[i], i))
    return [i for _, i in pool]


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """Inject a run of the father's best-filled bins into the mother."""
    order = sorted(range(len(father.bins)), key=lambda b: father.free[b])
    top = order[:max(1, len(order) // 2)]
    a = int(rng.integers(len(top)))
    n = max(1, int(rng.integers(1, max(2, len(top) // 2))))
    given = top[a:a + n]
    held = {item for b in given for item in father.bins[b]}
    keep, loose = [], []
    for b, items in enumerate(mother.bins):
        if any(i in held for i in items):
            loose += [i for i in items if i not in held]
        else:
            keep.append(b)
    child = mother.keep(keep)
    child.bins += [list(father.bins[b]) for b in given]
    child.free += [father.free[b] for b in given]
    return child.fill(exchange(child, loose, rng))


def mutate(packing: Packing, rng: np.random.Generator) -> Packing:
    """Empty the worst-filled bins and some random ones, then repack."""
    if len(packing.bins) < 3:
        return packing
    order = sorted(range(len(packing.bins)), key=lambda b: -packing.free[b])
    out = set(order[:max(2, len(order) // 50)]) | {int(b) for b in rng.integers(0, len(order), max(1, len(order) // 30))}
    loose = [i for b in sorted(out) for i in packing.bins[b]]
    kept = packing.keep([b for b in range(len(packing.bins)) if b not in out])
    return kept.fill(exchange(kept, loose, rng))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int, population: int = POPULATION) -> list[int]:
    """The best packing found, as a bin number for each piece; ``elites`` are packings to start from.

    It ends early where the total size allows no packing with fewer bins, and after ``PATIENCE`` generations that found none.
    """
    rng = np.random.default_rng(seed)
    n, least = len(sizes), -(-sum(sizes) // capacity)
    pool: list[Packing] = []
    for assign in elites:
        p = Packing(sizes, capacity)
        p.bins = [[] for _ in range(max(assign, default=-1) + 1)]
        for item, b in enumerate(assign):
            p.bins[b].append(item)
        p.free = [capacity - sum(sizes[i] for i in items) for items in p.bins]
        pool.append(p)
    pool.append(Packing(sizes, capacity).fill(list(range(n))))
    while len(pool) < population and min(p.key()[0] for p in pool) > least:
        # seeds: pack a random half by best fit, then the rest
        chosen = rng.permutation(n)
        pool.append(Packing(sizes, capacity).fill(chosen[:n // 2].tolist()).fill(chosen[n // 2:].tolist()))
    fewest, idle = n + 1, 0
    for _ in range(generations):
        pool.sort(key=Packing.key)
        bins = pool[0].key()[0]
        fewest, idle = (bins, 0) if bins < fewest else (fewest, idle + 1)
        if bins <= least or idle >= PATIENCE:
            break  # no packing can have fewer bins, or none is found
        del pool[population:]
        # the better parent of two draws each; the child is kept with what mutation makes of it
        a, b = (int(min(rng.integers(0, len(pool), 2))) for _ in range(2))
        child = crossover(pool[a], pool[b], rng)
        pool += [child, mutate(child, rng)]
    best = min(pool, key=Packing.key)
    assign = [0] * n
    for b, items in enumerate(best.bins):
        for i in items:
            assign[i] = b
    return assign


_STATE = "shard bigint, island int, items array<bigint>, sizes array<int>, bins array<array<int>>"


def _epoch(capacity: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, island, items, sizes, elites in zip(*(batch.column(k).to_pylist() for k in range(5))):
                best = evolve(sizes, capacity, zlib.crc32(f"{shard} {island} {epoch}".encode()), elites or [], generations)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([island], pa.int32()), pa.array([items], pa.list_(pa.int64())),
                     pa.array([sizes], pa.list_(pa.int32())), pa.array([[best]], pa.list_(pa.list_(pa.int32())))],
                    names=["shard", "island", "items", "sizes", "bins"],
                )

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = 2,
         generations: int = GENERATIONS) -> DataFrame:
    """``cut`` (from :func:`pieces`) with ``sequence_id`` and ``offset``."""
    keyed = stage.save(cut.withColumn("n", F.monotonically_increasing_id()), "pieces")
    short = keyed.where(F.col("length") < capacity)
    count = short.count()
    shards = max(1, -(-count // shard))
    dealt = short.select(
        F.pmod(F.xxhash64("n"), F.lit(shards)).alias("shard"), F.struct("n", F.col("length").cast("int").alias("s")).alias("p")
    ).groupBy("shard").agg(F.sort_array(F.collect_list("p")).alias("p"))
    # a shard holds about SHARD pieces by construction: its list is bounded
    state = dealt.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("p.n").alias("items"), F.col("p.s").alias("sizes"),
        F.array().cast("array<array<int>>").alias("bins"),
    )
    for epoch in range(epochs):
        spread = state.repartition(max(partitions_for(cut), min(shards * islands, 4 * partitions_for(cut))), "shard", "island")
        evolved = stage.save(spread.mapInArrow(_epoch(capacity, generations, epoch), _STATE), "islands")
        if epoch + 1 < epochs:
            # elite migration round the ring: each island keeps its best and receives its neighbour's
            sent = evolved.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("bins").alias("guest"))
            state = evolved.join(sent, ["shard", "island"]).withColumn("bins", F.concat("bins", "guest")).drop("guest")
    best = evolved.select(
        "shard", F.struct(F.array_max(F.element_at("bins", 1)).alias("b"), "island").alias("rank"), "items", "sizes",
        F.element_at("bins", 1).alias("bin"),
    ).groupBy("shard").agg(F.min_by(F.struct("items", "sizes", "bin"), "rank").alias("x"))
    placed = best.mapInArrow(_offsets, "n bigint, sequence_id bigint, offset bigint")
    base = F.lit(1 << 40)
    packed = short.join(placed, "n")
    full = keyed.where(F.col("length") >= capacity).select("*", (base + F.col("n")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full).drop("n")


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence number (shard in the upper bits) and place of each piece in its sequence."""
    for batch in batches:
        for shard, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items, sizes, bins = (np.array(x[k], np.int64) for k in ("items", "sizes", "bin"))
            order = np.lexsort((items, bins))
            ends = np.cumsum(sizes[order])
            before = ends - sizes[order]
            first = np.flatnonzero(np.concatenate(([True], bins[order][1:] != bins[order][:-1]))) if len(order) else order
            offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
            # a shard's bins number less than 2^20 (one piece each at most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[order]), pa.array((shard << 20) + bins[order]), pa.array(offset)], names=["n", "sequence_id", "offset"]
            )
