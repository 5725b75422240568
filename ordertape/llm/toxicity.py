"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a text are the presence of its words and of word stems (prefixes of
4, 5 and 6 letters), hashed to ``BUCKETS``. A logistic model is fitted on
labelled texts; for every training text that mentions an identity term, copies
are made in which the term is swapped for the others of its group or removed,
and the squared change of the score's logit is penalised. Weights on neutral
group mentions are thus driven to be equal and small, whatever the labels of the
sample happen to say about them.

The fit uses a bounded, documented sample of labelled rows
(``max_labelled``, the rows with the smallest hash of their id). The learned
weights are a fixed-size table; scoring reads every whole text once and
shuffles nothing.

Defined cases: null and empty texts get the score of a text without features;
several labels of one id count as several rows; unlabelled and null-labelled
rows never train; when the sample holds one class only every score is its smoothed share;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import crc_of_id, map_text, share, shared_value, slices

BUCKETS = 1 << 18
MAX_LABELLED = 12_000
#: Groups of identity terms that may stand for each other, in the languages of the corpus; a parameter of :func:`train`.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch"), ("schwarze", "weiße", "asiaten", "europäer"), ("schwule", "lesben", "heteros"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"), ("behinderte", "blinde", "gehörlose"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío"), ("negros", "blancos", "asiáticos", "latinos", "europeos"), ("gays", "lesbianas", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros"), ("discapacitados", "ciegos", "sordos"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif"), ("noirs", "blancs", "asiatiques", "européens"), ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers"), ("handicapés", "aveugles", "sourds"),
)
_WORD = re.compile(r"[^\W\d_]+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def word_buckets(word: str) -> list[int]:
    """Buckets of one lower-case word: the word and its stems."""
    found = [_bucket(word)]
    found += [_bucket(f"{word[:k]}*") for k in (4, 5, 6) if len(word) >= k]
    return found


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def buckets_of(words: set[str], memo: dict[str, list[int]]) -> np.ndarray:
    out: list[int] = []
    for w in words:
        b = memo.get(w)
        if b is None:
            b = word_buckets(w)
            if len(memo) < 400_000:
                memo[w] = b
        out += b
    return np.unique(np.array(out, np.int32)) if out else np.zeros(0, np.int32)


def counterfactuals(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[set[str]]:
    """Versions of a text's words with one identity term swapped for each other of its group, and removed."""
    out = []
    for group in groups:
        for term in group:
            if term in words:
                rest = words - {term}
                out.append(rest)
                out += [rest | {other} for other in group if other != term]
    return out


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        z = self.bias + float(self.weights[buckets].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))


def swaps_of(words: set[str], memo: dict[str, list[int]], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[tuple[list[int], list[int]]]:
    """Buckets gained and lost by each counterfactual version of a text."""
    versions = counterfactuals(words, groups)
    if not versions:
        return []
    base = buckets_of(words, memo)
    return [
        (np.setdiff1d(changed, base).tolist(), np.setdiff1d(base, changed).tolist())
        for changed in (buckets_of(other, memo) for other in versions)
    ]


def fit(feats: list[np.ndarray], labels: list[int], swaps: list[tuple[list[int], list[int]]],
        steps: int = 150, l2: float = 1e-4, swap: float = 1.0, least_z: float = 3.0) -> Model:
    """Full-batch class-balanced logistic regression (Adam) with the counterfactual penalty.

    Buckets take part when they occur in two rows at least and their share
    differs between the classes by ``least_z`` standard errors.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS, np.float32))
    ones, zeros = y.sum(), len(y) - y.sum()
    in_one, in_zero = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, label in zip(feats, labels):
        (in_one if label else in_zero)[f] += 1
    share = (in_one + in_zero) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / zeros))
    z = (in_one / ones - in_zero / zeros) / error
    used = np.flatnonzero((in_one + in_zero >= 2) & (np.abs(z) >= least_z))
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    kept = [p[p >= 0] for p in (place[f] for f in feats)]
    cols = np.concatenate(kept)
    row_of = np.repeat(np.arange(len(kept)), [len(f) for f in kept])
    # differences caused by a swap, as sparse rows of +1 and -1
    d_row, d_col, d_val = [], [], []
    for k, (gained, lost) in enumerate(swaps):
        for part, sign in ((gained, 1.0), (lost, -1.0)):
            p = place[np.array(part, np.int64)]
            p = p[p >= 0]
            d_row += [k] * len(p)
            d_col += p.tolist()
            d_val += [sign] * len(p)
    d_row, d_col, d_val = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_val, np.float64)
    # each class weighs the square root of its share, a middle way between prior and balance
    weight = np.where(y == 1, np.sqrt(zeros / ones), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(len(used)), float(np.log(ones / zeros))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(row_of, w[cols], len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        grad = np.bincount(cols, error[row_of], len(used)) + l2 * w
        if swaps:
            change = np.bincount(d_row, d_val * w[d_col], len(swaps))
            grad += swap * np.bincount(d_col, d_val * change[d_row], len(used)) / len(swaps)
        full = np.append(grad, error.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.99 * v + 0.01 * full * full
        move = 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        w -= move[:-1]
        bias -= move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(float(bias), weights)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = 5, held: int = 0, max_labelled: int = MAX_LABELLED,
          groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``max_labelled`` of them (smallest id hash)."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id("doc_id"), F.lit(folds)) != held)
    )
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        pair = pa.struct([("gained", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, "text"):
                words = [words_of(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array([buckets_of(w, memo) for w in words], pa.list_(pa.int32())),
                        pa.array([[{"gained": g, "lost": o} for g, o in swaps_of(w, memo, groups)] for w in words], pa.list_(pair)),
                    ],
                    names=["doc_id", "y", "buckets", "swaps"],
                )

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_text(
        texts.select("doc_id", "y", "text"),
        lift, f"doc_id {kind}, y int, buckets array<int>, swaps array<struct<gained: array<int>, lost: array<int>>>"
    ).toArrow()
    ids = [str(x) for x in found.column("doc_id").to_pylist()]
    order = sorted(range(len(ids)), key=ids.__getitem__)  # the fit does not depend on how tasks finish
    buckets, y, swaps = found.column("buckets"), found.column("y").to_pylist(), found.column("swaps").to_pylist()
    feats = [np.asarray(buckets[k].values, np.int32) if buckets[k].is_valid else np.zeros(0, np.int32) for k in order]
    return fit(feats, [y[k] for k in order], [(s["gained"], s["lost"]) for k in order for s in swaps[k] or ()])


class LiveBuckets(dict):
    """Weighted buckets of white-space separated chunks, remembered; emptied when it has grown large."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.live, self.most = model.weights != 0, most

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = tuple(b for w in words_of(chunk) for b in word_buckets(w) if self.live[b])
        if len(self) >= self.most:
            self.clear()
        self[chunk] = found
        return found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared_value(shared)
        live = LiveBuckets(held)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column(1).to_pylist():
                    found = set().union(*map(live.__getitem__, set(text.split()))) if text else ()
                    out.append(held.score(np.array(sorted(found), np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **names: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    model = train(docs, labels, folds=folds, held=held, **names)
    return score(docs, model).select(
        "doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(folds)) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
