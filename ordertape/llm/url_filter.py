"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path follows it up to ``?``, ``#`` or the end. A rule names
a host and a path prefix, fits the host and all its subdomains, and the longest
fitting rule decides. Rules are evaluated as built-in expressions.

Urls without a rule are judged by gradient-boosted regression trees (logistic
loss, histogram splits) over length, depth, digit ratio, entropy, parameter
counts and statistics of the host suffix and of the first path segment. The trees are
trained from labelled urls: by default the urls that a rule has judged, the only
labels there are without others. The fit uses a bounded sample (``MAX_LABELLED``
urls with the smallest hash). A training url sees suffix and segment statistics
of the other ``FOLDS - 1`` folds only, so its own label is never among its
features; the fitted model keeps those of all folds. Every url is scored.

Defined cases: null urls, or urls without ``://``, have an empty host and path
and are judged by the trees; without labelled urls of both verdicts the trees
give the share of blocks (allow when there are none); repeated rows are judged
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import map_text, share, shared_value, slices

MAX_LABELLED = 20_000
FOLDS = 5
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
    "parameters", "query_length", "fragment", "extension", "secure", "port", "suffix_rate", "suffix_log_count",
    "segment_rate", "segment_log_count",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``"block com/en/"`` or ``"allow example.com/en/7"``."""
    verdict, _, target = text.strip().partition(" ")
    if verdict not in ("block", "allow") or not target:
        raise ValueError(f"not a rule: {text!r}")
    host, slash, path = target.partition("/")
    return Rule(host, slash + path, verdict == "block")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest fitting rule, else null (equally long: the longer host, then the name)."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _parts(url: str) -> tuple[str, str, str, str, str]:
    scheme, sep, rest = url.partition("://")
    if not sep:
        return "", "", "", "", ""
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest, re.S)
    return scheme, m[1].lower(), m[2], m[3] or "", m[4] or ""


def _suffix(host: str) -> str:
    return ".".join(host.split(":")[0].split(".")[-2:])


def _segment(path: str) -> str:
    return path.lstrip("/").split("/")[0]


def _entropy(text: str) -> float:
    n = len(text)
    counts: dict[str, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    return -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0


@dataclass
class Trees:
    prior: float
    edges: list[np.ndarray] = field(default_factory=list)
    #: per tree: feature, threshold, left, right, value arrays; a leaf has feature -1
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    #: labelled count and block share of host suffixes and first path segments
    suffixes: dict[str, tuple[int, float]] = field(default_factory=dict)
    segments: dict[str, tuple[int, float]] = field(default_factory=dict)

    def features(self, urls: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)))
        for k, url in enumerate(urls):
            url = url or ""
            scheme, host, path, query, fragment = _parts(url)
            n, rate = self.suffixes.get(_suffix(host), (0, self.prior))
            n2, rate2 = self.segments.get(_segment(path), (0, self.prior))
            out[k] = (
                len(url), len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0,
                sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), url.count("-"), _entropy(url),
                query.count("&") + 1 if query else 0, len(query), bool(fragment), "." in path.rsplit("/", 1)[-1],
                scheme.lower() == "https", ":" in host, rate, math.log1p(n), rate2, math.log1p(n2),
            )
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), _logit(self.prior))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(32):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            z += value[at]
        return z

    def block_score(self, urls: Sequence[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.features(urls)), -30, 30)))


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _rates(keys: Sequence[str], y: np.ndarray, prior: float, weight: float = 10.0) -> dict[str, tuple[int, float]]:
    sums: dict[str, list[float]] = {}
    for key, label in zip(keys, y):
        s = sums.setdefault(key, [0, 0.0])
        s[0] += 1
        s[1] += label
    return {k: (int(n), (b + weight * prior) / (n + weight)) for k, (n, b) in sums.items()}


def _counted(urls: Sequence[str | None], y: np.ndarray, rows: np.ndarray, prior: float) -> Trees:
    """A model without trees, with the statistics of ``rows``."""
    parts = [_parts(urls[i] or "") for i in rows]
    return Trees(prior, suffixes=_rates([_suffix(p[1]) for p in parts], y[rows], prior), segments=_rates([_segment(p[2]) for p in parts], y[rows], prior))


def fit(urls: Sequence[str], blocked: Sequence[int], rounds: int = 40, depth: int = 4, bins: int = 32,
        rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boost ``rounds`` trees on labelled urls (1: block)."""
    y = np.array(blocked, float)
    if not len(y):
        return Trees(0.0)
    prior = float(y.mean())
    model = _counted(urls, y, np.arange(len(y)), prior)
    if prior in (0.0, 1.0):
        return model
    fold = np.array([zlib.crc32((u or "").encode()) % FOLDS for u in urls])
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(FOLDS):
        mine = np.flatnonzero(fold == k)
        if len(mine):
            x[mine] = _counted(urls, y, np.flatnonzero(fold != k), prior).features([urls[i] for i in mine])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), _logit(prior))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes.append([-1, 0.0, -1, -1, -rate * g / (h + ridge)])
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    size = len(edges[f]) + 1
                    n = np.bincount(binned[rows, f], minlength=size).cumsum()[:-1]
                    gl = np.bincount(binned[rows, f], grad[rows], size).cumsum()[:-1]
                    hl = np.bincount(binned[rows, f], hess[rows], size).cumsum()[:-1]
                    if not len(n):
                        continue
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] is not None:
                go = binned[rows, best[1]] <= best[2]
                nodes[me][:2] = [best[1], float(edges[best[1]][best[2]])]
                nodes[me][2] = grow(rows[go], level + 1)
                nodes[me][3] = grow(rows[~go], level + 1)
            return me

        grow(np.arange(len(y)), 0)
        table = np.array(nodes, float)
        tree = (table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])
        model.trees.append(tree)
        z += Trees(0.5, trees=[tree]).raw(x)
    return model


def train(urls: DataFrame, url_col: str, block_col: str, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fit on at most ``max_labelled`` labelled urls (smallest hash; null labels are not used)."""
    rows = urls.select(F.col(url_col).alias("url"), F.col(block_col).cast("int").alias("y")).where("y in (0, 1)")
    sample = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled).toArrow()
    return fit(sample.column("url").to_pylist(), sample.column("y").to_pylist())


def judge(pages: DataFrame, rules: Sequence[str | Rule], id_col: str = "page_id", url_col: str = "url",
          model: Trees | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row; ``score`` is the trees' block probability."""
    parsed = [r if isinstance(r, Rule) else parse_rule(r) for r in rules]
    blocking = [r.name for r in parsed if r.block]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), parsed))
    ruled = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocking).cast("int"))
    if model is None:
        model = train(rows.select("url", ruled.alias("y")), "url", "y")
    shared = share(pages.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared_value(shared)
        for batch in batches:
            for part in slices(batch, "url"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.block_score(part.column(1).to_pylist()))], names=[*part.schema.names, "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    scored = map_text(rows, run, f"page_id {kind}, url string, host string, path string, rule string, score double")
    block = F.coalesce(ruled == 1, F.col("score") >= 0.5)
    return scored.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "score")
