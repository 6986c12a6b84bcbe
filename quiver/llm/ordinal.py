"""Quality classifier: cumulative-link regression on ordered grades over hashed words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import free_name

#: Labelled rows that the fit reads at most, and hashed features that get a weight at most: both bound the task that fits.
MAX_ROWS = 8000
MAX_FEATURES = 200_000
#: A feature may get a weight if its share among the texts at or below some grade differs from that of all: so many of
#: those chosen may be false, whatever the number of features and texts (Benjamini and Hochberg's rule on a bound of the
#: chance). Of these, the clearest get one, one for so many labelled texts. Both bars move with the number of texts.
FALSE_SHARE = 0.05
TEXTS_A_FEATURE = 16
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_CAPITAL = re.compile(r"[A-Z]")
_CACHE = 300_000


def features(text: str | None) -> set[str]:
    """Distinct letter runs, digit runs and symbol runs in lower case, the first four and six characters of longer ones
    (words of one stem share them), and three shares in tenths: of distinct tokens, of
    tokens equal to the one before, and of capitals. Null or blank: none.
    """
    text = text or ""
    tokens = _TOKEN.findall(text.lower())
    out = set(tokens)
    if tokens:
        distinct = len(out)
        out |= {"\0^" + t[:k] for k in (4, 6) for t in out if len(t) > k}
        n, capitals = len(tokens), len(_CAPITAL.findall(text))
        letters = max(1, len(text) - text.count(" "))
        out.add(f"\0distinct {10 * distinct // n} {min(n.bit_length(), 8)}")
        out.add(f"\0again {10 * sum(map(str.__eq__, tokens, tokens[1:])) // n}")
        out.add(f"\0capitals {10 * capitals // letters}")
    return out


def hashed(token: str) -> int:
    return zlib.crc32(token.encode())


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(cut[k] - sum of the weights of a text's features); cuts ascend."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: tuple[float, ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(grades: np.ndarray, n_grades: int, row: np.ndarray, col: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray:
    """Features that get a weight, by place; ``row`` and ``col`` say which text has which.

    The chance that as many of a feature's texts lie at or below a grade is bounded by exp(-texts * divergence).
    """
    chance, z = np.zeros(len(seen)), np.zeros(len(seen))
    for k in range(n_grades - 1):
        low = (grades <= k).astype(float)
        p = low.mean() if n else 0.0
        if not 0 < p < 1:
            continue
        hits = np.bincount(col, low[row], len(seen))
        share = hits / seen
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where(share > 0, share * np.log(share / p), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - p)), 0)
        chance = np.minimum(chance, -seen * off)
        z = np.maximum(z, np.abs(hits - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p) * (1 - seen / n), 1e-3)))
    chance = chance + np.log(2 * max(1, n_grades - 1))  # either side of each cut
    often = np.flatnonzero(seen >= 2)
    ordered = np.sort(chance[often])
    passed = np.flatnonzero(ordered <= np.log(FALSE_SHARE * np.arange(1, len(ordered) + 1) / max(1, len(ordered))))
    clear = often[chance[often] <= ordered[passed[-1]]] if len(passed) else often[:0]
    return np.sort(clear[np.argsort(-z[clear], kind="stable")[: min(MAX_FEATURES, max(1, n // TEXTS_A_FEATURE))]])


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 1e-3, steps: int = 800, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty on the shared weights, by Adam on all rows at a time.

    ``rows`` has each text's distinct feature hashes. Fewer than two grades: no weights, and every text gets the only
    grade, or the highest if there is none.
    """
    flat = np.concatenate([np.zeros(0, np.uint32), *rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = _telling(np.array(grades), n_grades, row, col, seen, len(rows))
    keys = found[keep]
    if len(np.unique(grades)) < 2:
        only = int(grades[0]) if len(grades) else n_grades - 1
        return OrdinalModel(keys[:0], np.zeros(0), tuple(-40.0 if k < only else 40.0 for k in range(n_grades - 1)))
    place = np.full(len(found), -1)
    place[keep] = np.arange(len(keep))
    used = place[col] >= 0
    row, col = row[used], place[col[used]]
    # Presence is not divided by a text's length: that would drown one telling word of a long text.
    theta = np.r_[np.zeros(len(keys)), np.linspace(-1, 1, n_grades - 1)]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, raw = theta[: len(keys)], theta[len(keys) :]
        cuts = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
        edges = np.r_[-np.inf, cuts, np.inf]
        s = np.bincount(row, w[col], len(rows))
        up, dn = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        p = np.maximum(up - dn, 1e-9)
        gu, gd = up * (1 - up) / p, dn * (1 - dn) / p
        gs = (gu - gd) / len(rows)
        gw = np.bincount(col, gs[row], len(keys)) + l2 * w / len(rows) ** 0.5
        gc = np.array([(gd[grades == k + 1].sum() - gu[grades == k].sum()) / len(rows) for k in range(n_grades - 1)])
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.r_[gw, tail[0], tail[1:] * np.exp(raw[1:])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = theta[len(keys) :]
    return OrdinalModel(keys, theta[: len(keys)], tuple(np.cumsum(np.r_[raw[:1], np.exp(raw[1:])]).tolist()))


def fit(labelled: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on rows of ``labelled`` with a text and a grade in 0..n_grades-1; others are ignored.

    At most ``max_rows`` rows are read, those of least id hash, so the choice doesn't depend on order or partitions.
    They are one task's, which fits as well: only the weights, cuts and their number reach the driver.
    """
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), grade.cast("int").alias("grade"))
    src = src.where(F.col("text").isNotNull() & F.col("grade").between(0, n_grades - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += ((np.unique(np.fromiter(map(hashed, features(t.as_py())), np.uint32)).tobytes(), g) for t, g in zip(batch.column(1), batch.column(2).to_pylist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in _parts(_fit_rows(rows, n_grades))], names=["keys", "weights", "cuts"])

    chosen = src.orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("text")).limit(max_rows).coalesce(1)
    found = chosen.mapInArrow(run, "keys binary, weights binary, cuts binary").collect()
    if not found:
        return _fit_rows([], n_grades)
    keys, weights, cuts = (np.frombuffer(x, t) for x, t in zip(found[0], (np.uint32, np.float64, np.float64), strict=True))
    return OrdinalModel(keys, weights, tuple(cuts.tolist()))


def _fit_rows(rows: list[tuple[bytes, int]], n_grades: int) -> OrdinalModel:
    """Fit on rows of feature hashes and grade, in an order of their own."""
    rows = sorted(rows)
    return fit_arrays([np.frombuffer(f, np.uint32) for f, _ in rows], np.array([g for _, g in rows], np.int64), n_grades)


def _parts(model: OrdinalModel) -> tuple[np.ndarray, ...]:
    return model.keys.astype(np.uint32), model.weights.astype(np.float64), np.array(model.cuts, np.float64)


def latent(model: OrdinalModel, text: Column) -> Column:
    """Sum of the weights of a text's features; null counts as a text without any."""
    keys, weights = model.keys, model.weights

    def score(texts: pa.Array) -> pa.Array:
        known = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        cache: dict[str, float] = _word_cache(known)
        out = np.fromiter((sum(map(cache.__getitem__, features(t.as_py()))) for t in texts), np.float64, len(texts))
        return pa.array(out)

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(text)


class _Weights(dict):
    """Weight by word; words are hashed once. Emptied when large."""

    def __init__(self, known: dict[int, float]):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        w = self[token] = self.known.get(hashed(token), 0.0)
        return w


_caches: dict[int, _Weights] = {}


def _word_cache(known: dict[int, float]) -> _Weights:
    key = hash(tuple(sorted(known.items())[:50])) ^ len(known)
    if key not in _caches:
        _caches.clear()
        _caches[key] = _Weights(known)
    return _caches[key]


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text", least_grade: int | None = None) -> DataFrame:
    """``df`` with expected_grade and tail_probability = P(grade >= least_grade), the highest grade by default.

    Every row, repeated ones too, comes back once, with all its columns; columns of those two names are replaced. Texts
    are read whole; null is scored like an empty text. An empty table gives none.
    """
    top = len(model.cuts)
    at = top if least_grade is None else least_grade
    own = free_name(df, "latent")
    wide = df.withColumn(own, latent(model, F.col(text_col).cast("string")))
    above = [1 - 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col(own) - F.lit(c))))) for c in model.cuts]
    expected = sum(above[1:], above[0])
    tail = above[at - 1] if at else F.lit(1.0)
    return wide.withColumns({"expected_grade": expected, "tail_probability": tail}).drop(own)


def graded(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit grades 0 (low quality), 1 (good but toxic) and 2 (good) on labelled documents.

    Documents are found by a broadcast of the chosen labels, at most ``max_rows`` rows of three numbers. A document with
    several labels counts by the worst; labels with a null, or without a document with a text, don't count. Without
    labels every text gets the highest grade.
    """
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("__id"), F.when(F.col("q") == 0, 0).when(F.col("x") == 1, 1).otherwise(2).alias("__grade"))
    with_text = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return fit(with_text, F.col("__grade"), 3, "doc_id", "text", max_rows)
