"""Quality by supervised subword embeddings.

Words and character trigrams (of bytes, digits folded to one, any white space to one) are hashed to places with learnt
vectors; a document is the average of the vectors of all its units; a softmax over two labels reads the average. A word
equal to the one before it gives the unit SAME besides. Learnt by plain stochastic gradient descent in numpy, a document
a step, on a bounded sample. As softmax and average are linear in the vectors, scoring needs one number per place: its
vector's share of the difference of the two logits.

Nulls: a null text is empty: no units, so it scores by the bias alone, as every text without a unit does. Rows without label or id
teach nothing but are scored; repeated rows are scored each. With labels of one kind only, that kind is certain; with none, 0.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, Words, table, texts
from .samples import contract, labelled

BITS, DIM = 17, 8
SAME = 2 << BITS
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1200
PARTS, HELD, THRESHOLD = 4, 2, 0.7

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[48:58] = 48
_FOLD[~IS_WORD] = 32


def units(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(where each unit lies, its place) by kind: trigrams (byte positions, in order), words and repeats (word numbers)."""
    c = _FOLD[data]
    if len(c) >= 3:
        g = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        ok = np.ones(len(g), bool)
        for k in (1, 2):  # not across two texts
            edge = offs[1:-1] - k
            ok[edge[(edge >= 0) & (edge < len(g))]] = False
        at = np.flatnonzero(ok)
        grams = (at, g[at].astype(np.int64))
    else:
        grams = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = Words(data, offs)
    h = words.hashes()
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    again = again[~np.isin(again, words.of)]
    return [grams, (words.starts, (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64)), (words.starts[again], np.full(len(again), SAME))]


def learn(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 10, rate: float = 60.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs: places and counts. Returns the vectors of all places, and the softmax's weights and biases of both labels."""
    size = SAME + 1
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    total, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            place, count = docs[i]
            lr = rate * (1 - done / total)
            done += 1
            if not len(place):
                continue
            part = (count / count.sum()).astype(np.float32)
            own = e[place]
            hidden = part @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ out
            out -= 0.01 * lr * np.outer(p, hidden)
            bias -= 0.0005 * lr * p
            e[place] = own - lr * part[:, None] * back
    return e, out, bias


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, **how) -> tuple[np.ndarray, float]:
    """What each place adds to the logit (before averaging), and the bias."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(SAME + 1, np.float32), 30.0 * (2 * share - 1)
    e, out, bias = learn(docs, y, **how)
    return (e @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = PARTS, held: int = HELD, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offs in texts(b):
                kinds = units(data, offs)
                found: list[bytes] = []
                cuts = [np.searchsorted(where, offs) for where, _ in kinds]
                for i in range(n):
                    place, count = np.unique(np.concatenate([p[c[i] : c[i + 1]] for (_, p), c in zip(kinds, cuts, strict=True)]), return_counts=True)
                    found.append(np.concatenate([place, count]).astype("<i4").tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, n), "y": b.column(2).slice(at, n), "units": pa.array(found, pa.binary())})

    rows = labelled(docs, labels, label, parts, held, per_class).select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, "doc_id long, y int, units binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.units))
    flat = [np.frombuffer(r.units, "<i4") for r in rows]
    return fit([(x[: len(x) // 2], x[len(x) // 2 :]) for x in flat], np.array([r.y for r in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score. The model is broadcast; its size is fixed by BITS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, bias = shared.value
        for b in batches:
            for at, n, data, offs in texts(b):
                total, count = np.zeros(n), np.zeros(n)
                for where, place in units(data, offs):
                    cut = np.searchsorted(where, offs)
                    total += np.diff(np.concatenate([[0.0], np.cumsum(adds[place], dtype=np.float64)])[cut])
                    count += np.diff(cut)
                z = bias + total / np.maximum(count, 1)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, n), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contract(score(docs, train(docs, table(spark, sf_dir, "labels"))), PARTS, HELD, THRESHOLD)
