"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

fit() makes one pass over the labelled documents; what leaves the executors are class counts, sums and outer
products, merged in two levels. Covariances are shrunk towards the pooled one and its diagonal; their Cholesky
factors and log-determinants are computed once and kept in the model. A score is the difference of the two
Mahalanobis log densities, put on a 0 to 1 scale by a logistic curve fitted to a histogram of the training
differences.

Edge cases: null and empty texts have the statistics of an empty text and get a score; labels that are null count
for nothing; a document with several labels counts once for each; without both classes the score is the share of
label 1 (0.5 without labels); repeated rows are scored each; an empty table gives an empty result; an
input column named score is replaced, and keep_good returns rows as they were.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, map_texts, restored, sheltered, texts_of, without

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "log_longest_word", "upper", "digits", "symbols", "exclaim", "stops", "commas",
    "other_punctuation", "high_bytes", "entropy", "adjacent_repeats", "distinct_words", "repeated_windows", "repeated_lines", "short_words",
)


def _groups() -> np.ndarray:
    """256 x 8 membership of bytes in the character groups that are counted."""
    sets = [range(65, 91), range(48, 58), b"#*$%&|<>", b"!", b".?;:", b",", b"\"'()[]{}-_/\\@+=~^`", range(128, 256)]
    out = np.zeros((256, len(sets)))
    for j, s in enumerate(sets):
        out[list(s), j] = 1
    return out


GROUPS = _groups()


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of a whole text: logs of counts, logits of shares."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(float)
    n = len(raw)
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda k, of: math.log((k + 0.5) / (max(0, of - k) + 0.5))
    p = counts[counts > 0] / max(1, n)
    sizes = list(map(len, words))
    adjacent = sum(map(eq, words, words[1:]))
    windows = max(0, m - 2)
    distinct = len(set(zip(words, words[1:], words[2:]))) if windows else 0  # noqa: B905
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(lines)), sum(sizes) / max(1, m), math.log1p(max(sizes, default=0)),
        *(share(k, n) for k in counts @ GROUPS),
        float(-(p * np.log(p)).sum()), share(adjacent, m), share(len(set(words)), m), share(windows - distinct, windows),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(1 for s in sizes if s < 4), m),
    ]


def matrix_of(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


@dataclass
class Model:
    """mean, inverse Cholesky factor and log constant by class; slope and shift of the logistic curve."""

    classes: list[tuple[np.ndarray, np.ndarray, float]]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 minus that of label 0."""
        logs = [c - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, c in self.classes]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed(self.difference(x)) + self.shift, -60, 60)))


def squashed(d: np.ndarray) -> np.ndarray:
    """Differences grow with the square of the distance; on this scale a straight line in the logit fits."""
    return np.arcsinh(d / 2)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, work, fields: str) -> DataFrame:
    """work(batch) over the documents that may be learnt from, joined to their labels."""
    rows = docs.where(~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"]])
    for f in T._parse_datatype_string(fields).fields:
        schema = schema.add(f)
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    return map_texts(rows, "text", schema, work).join(known, "doc_id")


def _sums(rows: DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Counts, sums and outer products by class; each partition adds up its own, some tasks add up those."""
    fields = "label int, n double, s array<double>, q array<double>"

    def first(batches):
        n, s, q = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                s[k] += part.sum(axis=0)
                q[k] += part.T @ part
        yield _batch(n, s, q)

    def merge(batches):
        n, s, q = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
        for batch in batches:
            for k, m, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n[k] += m
                s[k] += a
                q[k] += np.reshape(b, (width, width))
        yield _batch(n, s, q)

    def _batch(n, s, q):
        return pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(s), pa.list_(pa.float64())), pa.array([x.ravel() for x in q], pa.list_(pa.float64()))],
            names=["label", "n", "s", "q"],
        )

    got = rows.select("x", "label").mapInArrow(first, fields).repartition(8).mapInArrow(merge, fields).collect()
    n, s, q = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
    for r in got:
        n[r.label] += r.n
        s[r.label] += r.s
        q[r.label] += np.reshape(r.q, (width, width))
    return n, s, q


def discriminant(n: np.ndarray, s: np.ndarray, q: np.ndarray, shrink: float, ridge: float) -> Model:
    total, width = n.sum(), s.shape[1]
    if n.min() < 2:
        return Model([], constant=float(n[1] / total) if total else 0.5)
    means = s / n[:, None]
    scatter = [q[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / total
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    classes = []
    for k in (0, 1):
        a = min(1.0, shrink + width / n[k])  # little data leans on the target
        cov = (1 - a) * scatter[k] / n[k] + a * target + ridge * np.eye(width)
        factor = np.linalg.cholesky(cov)
        const = math.log(n[k] / total) - np.log(np.diag(factor)).sum()
        classes.append((means[k], np.linalg.inv(factor), float(const)))
    return Model(classes)


BINS, EDGE = 400, 20.0


def _calibrated(model: Model, rows: DataFrame, width: int) -> Model:
    """Logistic curve through a histogram of the training differences."""

    def bins(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                d = np.clip(squashed(model.difference(x)), -EDGE, EDGE - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(((d + EDGE) * BINS / (2 * EDGE)).astype(np.int32)), batch.column(1)], names=["bin", "label"])

    got = rows.select("x", "label").mapInArrow(bins, "bin int, label int").groupBy("bin", "label").count().collect()
    at = np.array([(r.bin + 0.5) * 2 * EDGE / BINS - EDGE for r in got])
    y = np.array([r.label for r in got], dtype=float)
    c = np.array([r["count"] for r in got], dtype=float)
    w = logistic_line(at, y, c)
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def logistic_line(at: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """slope and shift of the logistic curve of least loss through labels y, c times each at `at`. Newton steps are halved
    until they lower the loss, which is convex, so classes that are all but separated don't throw them off."""
    design = np.stack([at, np.ones_like(at)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((c * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

    w = np.zeros(2)
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (c * (p - y)) + ridge * w
        hess = (design.T * (c * p * (1 - p))) @ design + ridge * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        gain = float(grad @ step)
        while (then := loss(w - size * step)) > now - 1e-4 * size * gain and size > 1e-12:
            size /= 2
        if size <= 1e-12 or now - then <= 1e-12 * max(1.0, abs(now)):
            break
        w, now = w - size * step, then
    return w


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", shrink: float = 0.05, ridge: float = 1e-3) -> Model:
    """The model of all labelled documents outside the held-out fold."""
    from .common import persist_shared

    width = len(STATISTICS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix_of(texts_of(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = persist_shared(_labelled(docs, labels, label, doc_id, text, work, "x array<double>").select("x", "label"), "statistics")
    model = discriminant(*_sums(rows, width), shrink, ridge)
    return model if model.constant is not None else _calibrated(model, rows, width)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score."""
    docs = without(docs, "score")
    schema = extended(docs.schema, ("score", "double"))
    names = schema.names

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(matrix_of(texts_of(batch, text))))], names=names)

    return map_texts(docs, text, schema, work)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """docs whose score reaches the threshold, columns unchanged."""
    scored = score(sheltered(docs, text=columns.get("text", "text")), fit(docs, labels, **columns))
    return restored(scored.where(F.col("score") >= threshold))
