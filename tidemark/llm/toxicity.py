"""Toxicity by a factorization machine over hashed terms.

logit = w0 + sum_i w_i + sum_{i<j} <v_i, v_j> over the distinct terms of a document, so that two terms that are
harmless alone can add up when they meet. Terms are runs of ASCII letters and digits and of non-ASCII bytes, ASCII
case folded, hashed to 2**BITS places. Learnt by AdaGrad on a bounded sample. As chance pairs of rare terms would drown the rest,
a term has weights only if it tells the labels apart, alone or in a pair: if its share of documents differs between the labels by
MIN_Z standard errors, or if the labels of the documents that have both it and some other term are, by Hoeffding's bound, too far from what
the terms that tell alone predict to be met once by chance among all pairs (CHANCE). Every pair of terms is judged, however rare: a pair
is tried unless a bound shows that no pair of its term can pass. Terms that are harmless alone, even without any trend of their own, are so
found by their meeting.

Nulls: a null text is empty and scores as one; rows without label, or whose id is null, teach nothing but are scored.
Repeated rows are scored each. No labels of one kind: every score is the share of label 1 among those known, 0 if there are
none. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TERM, TERM_CODES, Words, table, texts
from .samples import contract, labelled

BITS, RANK, MIN_DOCS, MIN_Z = 26, 4, 3, 3.5
#: How many pairs chance may let through, of all pairs of terms; predictions are held to be no surer than SURE.
CHANCE, SURE = 0.01, 0.99
#: Pairs that meet at once, and how many multiplications of a product take the time of one.
MEETINGS, DENSE_GAIN = 1 << 19, 900
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 4000
PARTS, HELD, THRESHOLD = 3, 1, 0.7


def terms(data: np.ndarray, offs: np.ndarray, names: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs of a piece, in order; with ``names``, sorted places, only those, by their number."""
    words = Words(data, offs, TERM)
    place = (words.hashes(codes=TERM_CODES) >> np.uint64(64 - BITS)).astype(np.int64)
    row = words.doc()
    if names is not None:
        keep = np.flatnonzero(mask[place & 0xFFFF])
        at = np.searchsorted(names, place[keep])
        same = names[np.minimum(at, len(names) - 1)] == place[keep]
        row, place = row[keep][same], at[same]
    pairs = np.unique((row << BITS) | place)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def low_mask(names: np.ndarray) -> np.ndarray:
    """Which values the low 16 bits of names take: rules most other terms out at once."""
    mask = np.zeros(1 << 16, bool)
    mask[names & 0xFFFF] = True
    return mask


@dataclass
class FactorizationMachine:
    """``names``: the places that have weights, sorted, never empty; w and v by number."""

    bias: float
    names: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, row: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.w[number], n)
        for f in range(self.v.shape[1]):
            v = self.v[number, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def _counts(docs: list[np.ndarray], *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct places, sorted, in how many documents each is, and the sums of each of ``values`` over those documents. Document by document: no array but one of a place's own size is as long as the sample."""
    place = np.concatenate([*docs, np.zeros(0, np.int32)])
    place.sort()
    names = place[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])]
    del place
    out = np.zeros((1 + len(values), len(names)))
    for d, *v in zip(docs, *values, strict=True):
        out[:, np.searchsorted(names, d)] += np.array([1.0, *v])[:, None]
    return names.astype(np.int64), *out


def telling(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose share of documents differs between the labels by MIN_Z standard errors, and the log odds that each one speaks for label 1 with."""
    names, seen, ones = _counts(docs, y)
    share = y.mean()
    z = (ones - seen * share) / np.sqrt(seen * share * (1 - share) * np.maximum(1 - seen / len(y), 1e-9))
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((seen - ones + 0.5) / (len(y) - y.sum() + 1))
    keep = (seen >= MIN_DOCS) & (np.abs(z) >= MIN_Z)
    return names[keep], odds[keep]


def _products(row: np.ndarray, col: np.ndarray, size: int, y: np.ndarray, p: np.ndarray, fewest: float, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of terms, and of the documents that have both: how many, how many of label 1, the sum of p. By products of blocks of terms. Pairs with fewer than ``fewest`` documents may be left out."""
    edge = np.searchsorted(col, np.arange(0, size + block, block))

    def part(k: int) -> np.ndarray:
        x = np.zeros((len(y), min(block, size - k * block)), np.float32)
        x[row[edge[k] : edge[k + 1]], col[edge[k] : edge[k + 1]] - k * block] = 1
        return x

    for i in range(len(edge) - 1):
        left = part(i)
        sides = np.empty((3, left.shape[1], len(y)), np.float32)
        for side, v in zip(sides, (1, y, p), strict=True):
            np.multiply(left.T, np.float32(v), out=side)
        sides = sides.reshape(-1, len(y))
        for j in range(i, len(edge) - 1):
            n, k, q = np.split((sides @ (left if i == j else part(j))).astype(float), 3)
            if i == j:
                np.fill_diagonal(n, 0)
            some = np.flatnonzero((n.ravel() > 0) & (n.ravel() >= fewest))
            width = n.shape[1]
            yield (i * block + some // width, j * block + some % width, *(v.ravel()[some] for v in (n, k, q)))


def _met(row: np.ndarray, col: np.ndarray, size: int, y: np.ndarray, p: np.ndarray, fewest: float, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same, document by document: each term with the later terms of its documents, some terms at a time. ``col`` is sorted."""
    order = np.argsort(row, kind="stable")
    terms_of, start = col[order], np.searchsorted(row[order], np.arange(len(y) + 1))
    length = np.diff(start)
    first = np.searchsorted(col, np.arange(size + 1))
    cost = np.concatenate([[0], np.cumsum(length[row])])[first]  # meetings before each term
    lo = 0
    while lo < size:
        hi = int(max(lo + 1, min(np.searchsorted(cost, cost[lo] + MEETINGS, "right") - 1, lo + MEETINGS // size, size)))
        d = row[first[lo] : first[hi]]
        n = length[d]
        at = np.repeat(start[d] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b, d = np.repeat(col[first[lo] : first[hi]], n), terms_of[at], np.repeat(d, n)
        later = b > a
        key, d = (a[later] - lo) * size + b[later], d[later]
        n = np.bincount(key, minlength=(hi - lo) * size)
        often = (n > 0) & (n >= fewest)
        some = np.flatnonzero(often)
        if len(some):
            mine = often[key]
            place, d = np.searchsorted(some, key[mine]), d[mine]
            yield lo + some // size, some % size, n[some].astype(float), np.bincount(place, y[d], len(some)), np.bincount(place, p[d], len(some))
        lo = hi


def interacting(docs: list[np.ndarray], y: np.ndarray, p: np.ndarray, block: int = 512) -> np.ndarray:
    """Places that stand in a pair whose documents' labels chance does not explain; ``p``: what is predicted for each document.

    With n documents that have both terms, k of label 1 and q predicted for them on average, chance has a k as far off with a probability of
    exp(-n KL(k / n, q)) at most, whatever the single predictions are. That exponent is at most the sum of (y - p)^2 / (p (1 - p)) over the
    documents of either term, and n of one label bring it to n log(1 / (1 - SURE)) at most: terms below are left out, which loses no pair.
    The rest meet by matrix products of blocks of ``block`` terms over the documents, or document by document, whichever costs less: where a few
    documents are mispredicted, all their terms are left, and most of those are rare.
    """
    p = np.clip(p, 1 - SURE, SURE)
    names, seen, ones, off = _counts(docs, y, (y - p) ** 2 / (p * (1 - p)))
    least = np.log(max(len(names), 2) ** 2 / 2 / CHANCE)
    names = names[(off >= least) & (np.maximum(ones, seen - ones) * -np.log(1 - SURE) >= least)]
    numbers = [_numbers(names, d) for d in docs]
    row = np.repeat(np.arange(len(docs)), [len(x) for x in numbers])
    col = np.concatenate([*numbers, np.zeros(0, np.int64)])
    del numbers
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    keep = np.zeros(len(names), bool)
    per = np.bincount(row, minlength=len(docs)).astype(float)
    # A matrix product costs documents times terms squared, pairs met document by document the squares of the documents' terms.
    meet = _met if (per**2).sum() * DENSE_GAIN < len(docs) * float(len(names)) ** 2 else _products
    for a, b, n, k, q in meet(row, col, len(names), y, p, least / -np.log(1 - SURE), block):
        share, want = k / n, np.clip(q / n, 1 - SURE, SURE)
        far = n * (share * np.log(np.maximum(share, 1e-12) / want) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - want)))
        hit = far >= least
        keep[a[hit]] = keep[b[hit]] = True
    return names[keep]


def calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Probabilities of label 1 from logits that were learnt with both labels weighing the same: a slope and an intercept fitted by Newton's method."""
    x = np.stack([np.ones(len(z)), z - z.mean()], axis=1)
    c = np.array([np.log(y.mean() / (1 - y.mean())), 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        c = c + np.clip(np.linalg.solve((x * v[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (y - p)), -1, 1)
    return 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))


def _numbers(names: np.ndarray, d: np.ndarray) -> np.ndarray:
    at = np.searchsorted(names, d)
    return at[names[np.minimum(at, len(names) - 1)] == d] if len(names) else at[:0]


def fit(docs: list[np.ndarray], y: np.ndarray, rank: int = RANK, **how) -> FactorizationMachine:
    """docs: each one's distinct places. First with the terms that tell alone; then, on what those leave over, terms that tell in pairs join them."""
    share = float(y.mean()) if len(y) else 0.0
    nothing = FactorizationMachine(float(np.log((share + 1e-13) / (1 - share + 1e-13))), np.zeros(1, np.int64), np.zeros(1), np.zeros((1, rank)))
    if not 0 < share < 1:
        return nothing
    names, odds = telling(docs, y)
    first = learn(docs, y, names, odds, rank, **how) if len(names) else nothing
    numbers = [_numbers(first.names, d) for d in docs]
    z = first.logits(np.repeat(np.arange(len(docs)), [len(x) for x in numbers]), np.concatenate(numbers), len(docs))
    pairs = np.setdiff1d(interacting(docs, y, calibrated(z, y)), names)
    if not len(pairs):
        return first
    every = np.concatenate([names, pairs])
    order = np.argsort(every)
    return learn(docs, y, every[order], np.concatenate([odds, np.zeros(len(pairs))])[order], rank, **how)


def learn(docs: list[np.ndarray], y: np.ndarray, names: np.ndarray, start: np.ndarray, rank: int = RANK, epochs: int = 15, rate: float = 0.3, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> FactorizationMachine:
    """Single weights begin at ``start``; both labels weigh the same in the loss."""
    share = float(y.mean())
    docs = [_numbers(names, d) for d in docs]
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(0.0, names, start.copy(), rng.normal(0, 0.01, (len(names), rank)))
    gw, gv, gb = np.full(len(names), 1e-6), np.full((len(names), rank), 1e-4), 1e-6
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    order = np.arange(len(docs))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            row = np.repeat(np.arange(len(own)), [len(docs[i]) for i in own])
            at = np.concatenate([docs[i] for i in own])
            g = (1 / (1 + np.exp(-np.clip(m.logits(row, at, len(own)), -30, 30))) - y[own]) * weight[own] / len(own)
            touched, which = np.unique(at, return_inverse=True)
            dw = np.bincount(which, g[row], len(touched)) + decay * m.w[touched]
            gw[touched] += dw * dw
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            for f in range(rank):
                s = np.bincount(row, m.v[at, f], len(own))
                dv = np.bincount(which, g[row] * (s[row] - m.v[at, f]), len(touched)) + decay * m.v[touched, f]
                gv[touched, f] += dv * dv
                m.v[touched, f] -= 0.1 * rate * dv / np.sqrt(gv[touched, f])
            db = float(g.sum())
            gb += db * db
            m.bias -= rate * db / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = PARTS, held: int = HELD, per_class: int = PER_CLASS) -> FactorizationMachine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offs in texts(b):
                row, place = terms(data, offs)
                cut = np.searchsorted(row, np.arange(n + 1))
                place = place.astype("<i4")
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, n), "y": b.column(2).slice(at, n), "places": pa.array([place[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())})

    rows = labelled(docs, labels, label, parts, held, per_class).select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, "doc_id long, y int, places binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.places))
    return fit([np.frombuffer(r.places, "<i4") for r in rows], np.array([r.y for r in rows], float))


def with_score(docs: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores. The model, no larger than the sample it was fitted on, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model, low_mask(model.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mask = shared.value
        for b in batches:
            z = [m.logits(*terms(data, offs, m.names, mask), n) for _, n, data, offs in texts(b)]
            z = np.concatenate([*z, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def accepted(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, name).where(F.col(name) < threshold).drop(name)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contract(score(docs, train(docs, table(spark, sf_dir, "labels"))), PARTS, HELD, THRESHOLD)
