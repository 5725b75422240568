"""Language identification with hyperdimensional letter profiles.

Every letter symbol owns a random +-1 vector of ``DIM`` components. A trigram is
bound as ``shift2(a) * shift1(b) * c`` (cyclic shifts mark the position), a text
bundles its trigrams by addition and a language prototype bundles all training
texts of the language. A text goes to the language whose prototype has the
largest cosine.

The text vector is never built: its dot product with a prototype is linear in
the trigram counts, so a table of (trigram, prototype) dot products, computed
once from the same vectors, gives the same number by one lookup a letter. The
norm of the text vector uses the quasi-orthogonality of bound vectors
(``DIM * sum(count^2)``); it scales the score and cannot change the winner.

Letters are lower-cased; a run of anything else is one blank, which is a symbol
of its own. Trigram counts for training cover every training row and are
aggregated before the shuffle; what reaches the driver is bounded by symbols^3
times the number of languages.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
with no training rows every text is ``und``; rows repeat freely; other columns
are ignored; an empty table gives an empty result. Ties go to the language name
that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ordertape.llm.common import crc_of_id, map_text, share, shared_value, slices

DIM = 2048
SYMBOLS = 64
SEED = 20240607
UNDETERMINED = "und"


def symbol_table() -> np.ndarray:
    """Symbol of every code point below 65536: 0 blank, 1-26 a-z, 27-63 other letters by a fixed hash."""
    table = np.zeros(65536, np.uint8)
    for cp in range(128, 65536):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = 27 + (cp * 2654435761 % 4294967296) % 37
    for k in range(26):
        table[97 + k] = table[65 + k] = 1 + k
    return table


def _codes(text: str, table: np.ndarray) -> np.ndarray | None:
    """Trigram codes of a text, or None when it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    big = points > 65535
    if big.any():
        symbols = table[np.where(big, 0, points)]
        for k in np.flatnonzero(big):
            if chr(points[k]).isalpha():
                symbols[k] = 27 + (int(points[k]) * 2654435761 % 4294967296) % 37
    else:
        symbols = table[points]
    if not symbols.any():
        return None
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols = symbols[keep]
    return (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]


def letter_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.choice(np.array([-1.0, 1.0], np.float32), size=(SYMBOLS, DIM))


@dataclass
class Profiles:
    languages: list[str]
    #: (symbols^3, languages): dot product of each bound trigram with each unit prototype, over sqrt(DIM)
    dots: np.ndarray


def prototypes(languages: list[str], counts: np.ndarray) -> Profiles:
    """``counts``: (languages, symbols^3) trigram counts of the training texts."""
    c = letter_vectors()
    b, a = np.roll(c, 1, axis=1), np.roll(c, 2, axis=1)
    dots = np.zeros((SYMBOLS ** 3, max(1, len(languages))), np.float32)
    for k in range(len(languages)):
        grid = counts[k].reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float32)
        proto = np.zeros(DIM, np.float64)
        for x in np.flatnonzero(grid.reshape(SYMBOLS, -1).any(axis=1)):
            proto += a[x] * (b * (grid[x] @ c)).sum(axis=0, dtype=np.float64)
        norm = np.linalg.norm(proto)
        unit = (proto / norm if norm else proto).astype(np.float32)
        for x in range(SYMBOLS):
            dots[x * SYMBOLS ** 2:(x + 1) * SYMBOLS ** 2, k] = ((b * (a[x] * unit)) @ c.T).ravel()
    return Profiles(languages, dots / np.sqrt(np.float32(DIM)))


def train(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Bundle every row with a text and a language (and ``where``) into prototypes."""
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = symbol_table(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                codes = _codes(text.as_py(), table)
                if codes is not None:
                    name = lang.as_py()
                    grams, n = np.unique(codes, return_counts=True)
                    if name not in sums:
                        sums[name] = np.zeros(SYMBOLS ** 3, np.int64)
                    sums[name][grams] += n
        for name, total in sums.items():
            grams = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams)), pa.array(grams.astype(np.int32)), pa.array(total[grams])],
                names=["lang", "gram", "n"],
            )

    found = map_text(rows, count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    at = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), SYMBOLS ** 3), np.int64)
    counts[[at[n] for n in names], found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return prototypes(languages, counts)


def _score(text: str | None, table: np.ndarray, profiles: Profiles) -> tuple[str, float]:
    codes = _codes(text, table) if text else None
    if codes is None or not profiles.languages:
        return UNDETERMINED, 0.0
    grams, n = np.unique(codes, return_counts=True)
    cosines = (n.astype(np.float64) @ profiles.dots[grams]) / np.sqrt(float((n.astype(np.float64) ** 2).sum()))
    best = int(np.argmax(cosines))
    return profiles.languages[best], float(min(1.0, max(0.0, cosines[best])))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its cosine (clipped to 0..1) added; columns of those names are replaced."""
    shared = share(docs.sparkSession, profiles)
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c not in (lang_out, score_out)]
    schema = StructType([*(docs.schema.fields[k] for k in kept), StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = symbol_table(), shared_value(shared)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                found = [_score(t.as_py(), table, held) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=[f.name for f in schema.fields],
                )

    return map_text(docs, run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold and predict every row: ``(doc_id, held_out, lang_pred, score)``."""
    fold = F.pmod(crc_of_id(id_col), F.lit(folds))
    profiles = train(docs, fold != held, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == held).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, profiles).drop("text")
