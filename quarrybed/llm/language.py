"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords: the byte 2- to 4-grams of its lower-cased words with their
edges, hashed to BUCKETS. Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a
sample of SAMPLE documents at most (one a language at least), drawn by hash and spread over all languages; only their
bucket counts reach the driver. As both layers are linear, scoring looks up one row of class logits per subword. A temperature and a
rejection threshold are calibrated on sample rows that training did not see.

Edge cases: null texts and texts without a letter are `und` with score 0; without a labelled document all are `und`;
ties go to the language first in order; very long texts are read whole; repeated rows are predicted each; input
columns named like an output are replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, map_texts, texts_of, without
from .quality import held_out

BUCKETS = 1 << 15
SAMPLE = 4096
#: Languages the model has room for: a row of logits a bucket for each. More are an error, none is left out.
LANGUAGES = 4096
GRAMS = (2, 3, 4)
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: ASCII letters stay, other ASCII separates words; bytes of other characters are letters.
FOLD = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    return bool(ASCII_LETTER.search(raw)) or (not raw.isascii() and any(map(str.isalpha, raw.decode())))


def subwords(raw: bytes | None) -> np.ndarray:
    """The bucket of every subword of a text."""
    if not raw:
        return np.zeros(0, dtype=np.int64)
    folded = raw.decode().lower().encode().translate(FOLD).split()
    return buckets_of(np.frombuffer(b" " + b" ".join(folded) + b" ", dtype=np.uint8)) if folded else np.zeros(0, dtype=np.int64)


def buckets_of(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint32)
    space = a == 32
    out = []
    for n in GRAMS:
        if len(a) < n:
            continue
        m = len(a) - n + 1
        h = np.full(m, 2166136261 + n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ x[j : j + m]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        keep = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            keep &= ~space[j : j + m]
        if n == 2:
            keep &= ~(space[:m] & space[1 : m + 1])
        out.append(h[keep] & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray = field(repr=False)  # BUCKETS x languages
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(bags), len(self.languages)))
        for i, b in enumerate(bags):
            if len(b):
                counts = np.bincount(b, minlength=BUCKETS).astype(np.float32) if len(b) > BUCKETS // 4 else None
                out[i] = (counts @ self.logits if counts is not None else self.logits[b].sum(axis=0, dtype=np.float64)) / len(b)
        z = (out + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], *, dim: int = 16, epochs: int = 12, rate: float = 4.0, target: float = 0.99, seed: int = 7) -> Model:
    """bags: (buckets, counts) of each text. Every fifth text calibrates and is not trained on."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out = rng.normal(0, 0.1, (dim, len(languages)))
    bias = np.zeros(len(languages))
    ids = np.arange(len(bags))
    fit_on = ids[ids % 5 > 0] if len(bags) >= 20 else ids
    share = np.bincount(labels[fit_on], minlength=len(languages)).astype(float)
    weight = np.where(share > 0, share.sum() / np.maximum(share, 1) / max(1, (share > 0).sum()), 0)
    steps, done = epochs * len(fit_on), 0
    for _ in range(epochs):
        for i in rng.permutation(fit_on):
            b, c = bags[i]
            if len(b):
                f = c / c.sum()
                hidden = f @ emb[b]
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                lr = rate * (1 - done / steps) * min(4.0, weight[labels[i]])
                back = out @ p
                out -= 0.1 * lr * np.outer(hidden, p)
                bias -= 0.01 * lr * p
                emb[b] -= lr * len(b) ** 0.5 * f[:, None] * back
            done += 1
    model = Model(languages, (emb @ out).astype(np.float32), bias)
    rest = ids[ids % 5 == 0] if len(bags) >= 20 else ids
    return calibrated(model, [bags[i] for i in rest], labels[rest], target)


def calibrated(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, target: float) -> Model:
    """The temperature of least log loss, and the lowest threshold above which `target` of the answers are right."""
    if not len(labels):
        return model
    z = np.stack([(c @ model.logits[b] / max(1, c.sum()) if len(b) else np.zeros(len(model.languages))) + model.bias for b, c in bags])

    def probs(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(probs(t)[np.arange(len(labels)), labels] + 1e-12).mean()))
    p = probs(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(precision >= target)
    model.threshold = float(top[order[ok[-1]]]) if len(ok) and ok[-1] < len(order) - 1 else 0.0
    return model


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """The model of a sample of the documents outside the held-out fold; None without any."""
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.pmod("key", F.lit(1 << 30))).alias("least")).limit(LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(r.lang for r in counts)
    each = max(1, sample // len(languages))
    # a draw below the language's share; its smallest draw of all is always in
    share = docs.sparkSession.createDataFrame([(r.lang, max(int(each / r.n * (1 << 30)), r.least + 1)) for r in counts], "_lang string, _below bigint")
    draw = F.pmod("key", F.lit(1 << 30))
    rows = usable.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(draw < F.col("_below")).select("key", "lang", "text")
    drawn = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if sum(r.n for r in drawn) > max(sample, len(languages)) * 1.5:
        # repeated rows are drawn together: of equal ones one is enough
        rows = rows.dropDuplicates(["key", "lang"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [np.unique(subwords(t), return_counts=True) for t in texts_of(batch, "text")]
        blob = [b.astype("<u4").tobytes() + c.astype("<u4").tobytes() for b, c in bags]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blob, pa.binary())], names=["key", "lang", "bag"])

    got = map_texts(rows, "text", T._parse_datatype_string("key bigint, lang string, bag binary"), work).toArrow()
    keys, langs, blobs = (got.column(i).to_pylist() for i in range(3))
    order = sorted(range(len(keys)), key=lambda i: (keys[i], langs[i]))
    bags, at = [], {x: i for i, x in enumerate(languages)}
    for i in order:
        both = np.frombuffer(blobs[i], dtype="<u4").astype(np.int64)
        bags.append((both[: len(both) // 2], both[len(both) // 2 :].astype(float)))
    return train(bags, np.array([at[langs[i]] for i in order], dtype=int), languages)


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", reject: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected (below the calibrated threshold; then lang_pred is `und` if `reject`)."""
    docs = without(docs, "lang_pred", "score", "rejected")
    schema = extended(docs.schema, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))
    names = schema.names

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text)
        p = model.probabilities([subwords(t) for t in texts]) if model else None
        pred, score, low = [], [], []
        for i, t in enumerate(texts):
            known = p is not None and has_letter(t)
            best = int(p[i].argmax()) if known else 0
            s = float(p[i][best]) if known else 0.0
            out = not known or s < model.threshold
            pred.append(UNKNOWN if not known or (out and reject) else model.languages[best])
            score.append(min(1.0, s))
            low.append(out)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(low)], names=names)

    return map_texts(docs, text, schema, work, 2 << 20)
