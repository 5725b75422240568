"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The test items are indexed: for each term, postings (item, impact) in item
order, cut into blocks that carry their largest impact. Every document is cut
into overlapping passages, each three times as long as the longest item, that
advance by that length, so any copy of an item with inserted words lies wholly
inside one passage as long as it is no more than twice as long as the longest item.
Each passage is a query. Impacts are BM25 impacts divided by the item's score
for its own text, so a score is the share of the item's weight that the passage
covers and one threshold fits items of any length.

Block-max WAND answers all passages of many documents at once. The most frequent
terms of each item are its non-essential ones as long as they make up at most
``COMMON_MASS`` of it: they add no more than that share. For every passage the
block maxima of its other terms are added up for each block of ``BLOCK`` items;
a block that cannot reach the threshold with the share of its common terms is
skipped, whatever its items. In the blocks that are left the items' partial
scores decide in the same way, and a passage with an item that can still reach
the threshold goes through the pivot loop of block-max WAND over all its terms,
which retrieves every item at or above the threshold. A retrieved item is
verified against the passage: its question (all but the last sentence) and its
answer (the last sentence) are compared by five-word shingles, and it counts
when ``overlap`` of the item's shingles and half of those of either part occur.

The index is broadcast in shards of ``SHARD_ITEMS`` items, which bounds its
size; documents are scanned once and not shuffled.

Defined cases: null or blank texts and items match nothing; items without a
shingle of five words use their whole word sequence; repeated items are
reported each; repeated rows are judged alike; other columns are ignored; an
empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import Words, byte_set, map_text, share, shared_value, slices, utf8

SHARD_ITEMS = 20_000
BLOCK = 16
COMMON_MASS = 0.3
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
#: Length of a passage in strides; a stride is as long as the longest item.
SPAN = 3
#: A word is a maximal run of letters, digits, underscores and non-ASCII characters, A-Z lower-cased; the
#: punctuation blocks U+0080-00BF and U+2000-203F are not part of words.
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
_PUNCTUATION = re.compile(rb"\xc2.|\xe2\x80.", re.S)
_SPACE = byte_set(*(b for b in range(128) if not (chr(b).isalnum() or b == 95)))
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def _blank(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    two = np.flatnonzero(data[:-1] == 0xC2)
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    for at in (two, two + 1, three, three + 1, three + 2):
        outside[at] = True
    return outside


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(_PUNCTUATION.sub(b" ", text.lower())) if text else []


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))}


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last; an item of one sentence is its own answer."""
    parts = [p for p in _SENTENCE.split(text) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return [w for p in parts[:-1] for w in words_of(p)], words_of(parts[-1])


@dataclass
class Index:
    ids: list
    vocab: dict[bytes, int]
    #: per term: item numbers, impacts, largest impact of each block, largest impact
    items: list[list[int]]
    impacts: list[list[float]]
    block_max: list[list[float]]
    term_max: list[float]
    whole: list[set]
    question: list[set]
    answer: list[set]
    longest: int
    #: whether a term has postings left besides the items' common terms, those postings as one run, and the common share of each item
    rare: np.ndarray
    offsets: np.ndarray
    flat_items: np.ndarray
    flat_impacts: np.ndarray
    common_share: np.ndarray
    #: the same postings by block: where a term's blocks are, the blocks and their largest impacts, and the largest common share of each block
    block_offsets: np.ndarray
    flat_blocks: np.ndarray
    flat_block_max: np.ndarray
    block_common: np.ndarray


def build(ids: list, texts: list[bytes | None], k1: float = 1.2, b: float = 0.75) -> Index:
    kept = [(i, t) for i, t in zip(ids, texts) if words_of(t)]
    docs = [words_of(t) for _, t in kept]
    mean = sum(map(len, docs)) / max(1, len(docs))
    holds: dict[bytes, dict[int, int]] = {}
    for k, words in enumerate(docs):
        for w in words:
            holds.setdefault(w, {}).setdefault(k, 0)
            holds[w][k] += 1
    weight: dict[bytes, dict[int, float]] = {}
    own = np.zeros(len(docs))
    for w, tf in holds.items():
        idf = math.log(1 + (len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
        weight[w] = {k: idf * n * (k1 + 1) / (n + k1 * (1 - b + b * len(docs[k]) / mean)) for k, n in tf.items()}
        for k, x in weight[w].items():
            own[k] += x
    vocab = {w: t for t, w in enumerate(weight)}
    items, impacts, block_max = [], [], []
    for w in weight:
        at = sorted(weight[w])
        x = [float(weight[w][k] / own[k]) for k in at]
        items.append(at)
        impacts.append(x)
        block_max.append([max(x[k:k + BLOCK]) for k in range(0, len(x), BLOCK)])
    parts = [question_and_answer(t) for _, t in kept]
    # per item, the most frequent terms up to COMMON_MASS are left to the bound; the other postings are kept
    common_share, kept_items, kept_impacts = np.zeros(len(docs)), [[] for _ in items], [[] for _ in items]
    frequency = np.array([len(x) for x in items])
    for k, words in enumerate(docs):
        mine = sorted({vocab[w] for w in words}, key=lambda t: (-frequency[t], t))
        open_ = True
        for t in mine:
            x = impacts[t][bisect_left(items[t], k)]
            open_ = open_ and common_share[k] + x <= COMMON_MASS
            if open_:
                common_share[k] += x
            else:
                kept_items[t].append(k)
                kept_impacts[t].append(x)
    rare = np.array([bool(x) for x in kept_items] + [False])
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in kept_items]))).astype(np.int64)
    flat_items, flat_impacts = np.array([k for x in kept_items for k in x], np.int64), np.array([v for x in kept_impacts for v in x])
    term = np.repeat(np.arange(len(items)), np.diff(offsets))
    # postings of a term are in item order, so those of a block stand together
    heads = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (flat_items[1:] // BLOCK != flat_items[:-1] // BLOCK)))) if len(term) else term
    blocks = -(-len(docs) // BLOCK)
    block_common = np.zeros(blocks)
    np.maximum.at(block_common, np.arange(len(docs)) // BLOCK, common_share)
    return Index(
        [i for i, _ in kept], vocab, items, impacts, block_max, [max(x) for x in impacts] + [0.0],
        [shingles(d) for d in docs], [shingles(q) for q, _ in parts], [shingles(a) for _, a in parts],
        max(map(len, docs), default=0), rare, offsets, flat_items, flat_impacts, common_share,
        np.concatenate(([0], np.cumsum(np.bincount(term[heads], minlength=len(items))))).astype(np.int64), flat_items[heads] // BLOCK,
        np.maximum.reduceat(flat_impacts, heads) if len(heads) else flat_impacts, block_common,
    )


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose score reaches the threshold, by block-max WAND over the given distinct terms."""
    cursors = [(index.items[t][0], t, 0) for t in terms]
    out = []
    slack = threshold - 1e-9
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, (_, t, _) in enumerate(cursors):
            bound += index.term_max[t]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # a finer bound: the blocks that could hold the item
        fine, reach = 0.0, None
        for _, t, at in cursors[:pivot + 1]:
            ids = index.items[t]
            at = bisect_left(ids, item, at)
            if at < len(ids):
                block = at // BLOCK
                fine += index.block_max[t][block]
                last = ids[min(len(ids), (block + 1) * BLOCK) - 1]
                reach = last if reach is None else min(reach, last)
        if fine >= slack and cursors[0][0] == item:
            score = sum(index.impacts[t][at] for d, t, at in cursors[:pivot + 1] if d == item)
            if score >= slack:
                out.append((item, score))
            goal = item + 1
        elif fine >= slack:
            goal = item
        else:  # no item before the end of the nearest block can qualify, unless the next cursor starts earlier
            goal = (item if reach is None else reach) + 1
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
            goal = max(goal, item + 1)
        alive = []
        for k, c in enumerate(cursors):
            if k <= pivot and c[0] < goal:
                ids = index.items[c[1]]
                at = bisect_left(ids, goal, c[2])
                if at == len(ids):
                    continue
                c = (ids[at], c[1], at)
            alive.append(c)
        cursors = alive
    return out


@dataclass
class Hit:
    item: int
    score: float
    overlap: float
    question: float
    answer: float
    start: int


def _postings(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term code: which entry it is, repeated, and where its postings lie."""
    start, size = offsets[codes], offsets[codes + 1] - offsets[codes]
    before = np.cumsum(size) - size
    return np.repeat(np.arange(len(codes)), size), np.repeat(start - before, size) + np.arange(int(size.sum()))


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value[order], first)


def _candidate_windows(index: Index, codes: np.ndarray, window: np.ndarray, lowest: np.ndarray, threshold: float) -> np.ndarray:
    """Windows in which some item could reach the threshold; ``window``: the last window of each word, ``lowest``: the first of its text."""
    keep = index.rare[codes]
    codes, window, lowest = codes[keep], window[keep], lowest[keep]
    terms, blocks, items = len(index.rare), len(index.block_common), len(index.ids)
    pairs = np.unique(np.concatenate([np.maximum(window - back, lowest) * terms + codes for back in range(SPAN)]))
    window, codes = pairs // terms, pairs % terms
    least = threshold - 1e-9
    # bounds of whole blocks
    entry, at = _postings(index.block_offsets, codes)
    if not len(at):
        return np.zeros(0, np.int64)
    key, bound = _sums(window[entry] * blocks + index.flat_blocks[at], index.flat_block_max[at])
    able = key[bound + index.block_common[key % blocks] >= least]
    if not len(able):
        return np.zeros(0, np.int64)
    # partial scores of the items of the blocks that are left
    open_ = np.isin(window, able // blocks)
    window, codes = window[open_], codes[open_]
    entry, at = _postings(index.offsets, codes)
    place = np.minimum(np.searchsorted(able, inside := window[entry] * blocks + index.flat_items[at] // BLOCK), len(able) - 1)
    left = able[place] == inside
    if not left.any():
        return np.zeros(0, np.int64)
    key, partial = _sums(window[entry[left]] * items + index.flat_items[at[left]], index.flat_impacts[at[left]])
    return np.unique(key[partial + index.common_share[key % items] >= least] // items)


def _verify(index: Index, words: list[bytes], terms: list[int], start: int, threshold: float, overlap: float, best: dict[int, Hit]) -> None:
    found = wand(index, terms, threshold)
    held = {SHINGLE: shingles(words)} if found else {}

    def part(wanted: set) -> float:
        n = len(next(iter(wanted)))
        if n not in held:
            held[n] = shingles(words, n)
        return len(wanted & held[n]) / len(wanted)

    for i, score in found:
        hit = Hit(i, score, part(index.whole[i]), part(index.question[i]), part(index.answer[i]), start)
        if hit.overlap >= overlap and hit.question >= 0.5 and hit.answer >= 0.5:
            if i not in best or (hit.overlap, hit.score) > (best[i].overlap, best[i].score):
                best[i] = hit


class Coder:
    """Term codes of many texts at once: words are hashed by array operations and looked up among the terms' hashes."""

    def __init__(self, index: Index) -> None:
        terms = Words([w for w in index.vocab], _SPACE, _blank)
        order = np.argsort(terms.hashes)
        self.hashes, self.order, self.none = terms.hashes[order], order, len(index.vocab)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def codes(self, texts: list[bytes | None]) -> list[np.ndarray]:
        words = Words([t.lower() if t else t for t in texts], _SPACE, _blank)
        out = np.full(len(words.hashes), self.none, np.int64)
        maybe = np.flatnonzero(self.filter[(words.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words.hashes[maybe]), max(0, self.none - 1))
        hit = self.hashes[at] == words.hashes[maybe] if self.none else np.zeros(0, bool)
        out[maybe[hit]] = self.order[at[hit]]
        return np.split(out, words.first[1:-1]) if texts else []


def search_all(index: Index, texts: list[bytes | None], threshold: float = THRESHOLD, overlap: float = OVERLAP,
               coder: Coder | None = None) -> list[list[Hit]]:
    """Verified items of each whole text, the best passage of each item."""
    found: list[dict[int, Hit]] = [{} for _ in texts]
    if not index.ids:
        return [[] for _ in texts]
    none, stride = len(index.vocab), index.longest
    coder = Coder(index) if coder is None else coder
    codes = coder.codes(texts)
    words: dict[int, list[bytes]] = {}
    # window w of a text holds its words [w * stride, (w + SPAN) * stride); windows of all texts are numbered in one run
    sizes = np.array([len(c) for c in codes], np.int64)
    base = np.cumsum(sizes // stride + 1) - (sizes // stride + 1)
    lowest = np.repeat(base, sizes)
    window = lowest + np.concatenate([np.arange(n) // stride for n in sizes]) if codes else lowest
    able = _candidate_windows(index, np.concatenate(codes), window, lowest, threshold) if codes else window
    owner = np.searchsorted(base, able, side="right") - 1
    for w, k in zip(able.tolist(), owner.tolist()):
        start = int(w - base[k]) * stride
        inside = codes[k][start:start + SPAN * stride]
        terms = np.unique(inside[inside < none])
        if k not in words:
            words[k] = words_of(texts[k])
        _verify(index, words[k][start:start + SPAN * stride], terms.tolist(), start, threshold, overlap, found[k])
    return [[hits[i] for i in sorted(hits)] for hits in found]


def search(index: Index, text: bytes | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[Hit]:
    return search_all(index, [text], threshold, overlap)[0]


def shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SHARD_ITEMS) -> Iterator[Index]:
    """Indexes of at most about ``size`` items each; items are dealt by hash, and one shard at a time is on the driver."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    n = max(1, math.ceil(rows.count() / size))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield build(part.column("item_id").to_pylist(), [t.encode() if t else None for t in part.column("text").to_pylist()])


_HIT = "score double, overlap double, question_overlap double, answer_overlap double, start_word bigint"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``(doc_id, item_id, score, overlap, question_overlap, answer_overlap, start_word)``: verified leaks only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, {_HIT}"
    )
    found = None
    for index in shards(benchmark, item_col, item_text_col):
        shared = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared_value(shared)
            coder = Coder(held)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, hits = [], []
                    for doc, mine in zip(part.column(0).to_pylist(), search_all(held, utf8(part.column(1)), threshold, overlap, coder)):
                        ids += [doc] * len(mine)
                        hits += mine
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, part.column(0).type), pa.array([held.ids[h.item] for h in hits]).cast(item_type),
                            *(pa.array([getattr(h, n) for h in hits], pa.float64()) for n in ("score", "overlap", "question", "answer")),
                            pa.array([h.start for h in hits], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "start_word"],
                    )

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        part = map_text(rows, run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified leak, all columns kept; rows are judged in place, nothing is joined."""
    kept = docs
    schema = docs.schema
    for index in shards(benchmark):
        shared = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared_value(shared)
            coder = Coder(held)
            for batch in batches:
                for part in slices(batch, text_col):
                    at = part.schema.get_field_index(text_col)
                    clean = [not hits for hits in search_all(held, utf8(part.column(at)), coder=coder, **options)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        kept = map_text(kept, run, schema)
    return kept
