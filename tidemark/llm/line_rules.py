"""Quality rules and line labels: base counts of a text, and a linear-chain conditional random field over its lines.

Viterbi decoding marks each line that has a word as content or boilerplate; a text is kept if the base rules pass and
content lines hold at least MIN_SHARE of its words. The field is trained by climbing its log-likelihood to a tolerance
(forward-backward in numpy) on all lines of a bounded sample of labelled documents: lines start with their document's
label and without transitions, then lines of poor documents are decoded anew and the whole field is fitted.

Nulls: a null text has no word, so base_failed is true and kept false; doc_id may be null. Repeated rows are judged each.
Without labels of both kinds the field is not fitted and every line counts as content. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, Words, mix, run_hashes, table, texts
from .samples import labelled

#: Labelled documents of each class that the field is fitted on, at most.
PER_CLASS = 1500
#: Transitions of a chain in training; a longer document goes on in another chain, given the label of the line that both share.
CHAIN = 64
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 50, 50, 0.5

FEATURES = ("bias", "symbols", "upper", "bars", "marks", "again", "same_words", "repeats", "short", "long", "digits")
_U = np.uint64
_ALL = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_ALL[10] = 0


def _in(chars: str) -> np.ndarray:
    x = np.zeros(256, bool)
    x[[ord(c) for c in chars]] = True
    return x


SYMBOL, BAR, MARK, DIGIT = _in("#*$%&|<>"), _in("|"), _in("!"), _in("0123456789")
UPPER, LETTER = _in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Set flags between edges[i] and edges[i + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])


def _seen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how often its key occurs, and whether it did before."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.cumsum(new) - 1
    count, before = np.empty(len(key), np.int64), np.empty(len(key), bool)
    count[order] = np.bincount(group)[group] if len(key) else 0
    before[order] = ~new
    return count, before


class Lines:
    """Base counts of each text of a piece, and its lines that have a word: row, words, features."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        words = Words(data, offs)
        h, doc = words.hashes(), words.doc()
        salt = mix(np.arange(1, n + 1, dtype=_U))
        self.n_words = np.diff(words.of)
        self.word_chars = _sums(IS_WORD[data] & ((data & 0xC0) != 0x80), offs)
        self.n_symbols = _sums(SYMBOL[data], offs)
        g, at = words.grams(h, 3)
        twice = at[_seen(g ^ salt[doc[at]])[0] > 1]
        covered = np.zeros(len(h) + 2, bool)
        for k in range(3):
            covered[twice + k] = True
        covered = covered[: len(h)]
        self.n_repeat_words = _sums(covered, words.of)

        behind = np.setdiff1d(np.flatnonzero(data == 10) + 1, offs)
        starts = np.unique(np.concatenate([offs[:-1][offs[:-1] < len(data)], behind]))
        line_of_word = np.searchsorted(starts, words.starts, "right") - 1
        has, first_word = np.unique(line_of_word, return_index=True)
        ends = np.append(starts[1:], len(data))
        at, to = starts[has], ends[has]
        self.row = doc[first_word]
        edges = np.append(first_word, len(h))
        self.words = np.diff(edges)
        # A line's bytes without the newline that ends it.
        whole = run_hashes(data, starts, ends, _ALL)[has]
        again = _seen(whole ^ salt[self.row])[1]
        self.n_dup_lines = np.bincount(self.row[again], minlength=n)

        def within(flags: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(flags)])
            return c[to] - c[at]

        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        letters = np.maximum(within(LETTER[data]), 1)
        share = lambda x: x / np.maximum(self.words, 1)
        self.x = np.stack([
            np.ones(len(has)), share(within(SYMBOL[data])) >= 0.5, within(UPPER[data]) / letters >= 0.5, share(within(BAR[data])) >= 0.2,
            share(within(MARK[data])) >= 0.5, again, share(_sums(same, edges)) >= 0.3, share(_sums(covered, edges)) >= 0.5,
            self.words < 3, self.words >= 20, within(DIGIT[data]) / (letters + 1) >= 0.3,
        ], axis=1).astype(float) if len(has) else np.zeros((0, len(FEATURES)))
        self.of = np.searchsorted(self.row, np.arange(n + 1))


# ---------------------------------------------------------------- the field; label 1 is content

def viterbi(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """s[i]: what label 1 scores more than label 0 at line i; t[a][b]: score of label b after a."""
    (t00, t01), (t10, t11) = t.tolist()
    a = b = 0.0
    back = []
    for i, x in enumerate(s.tolist()):
        if i:
            p, q = a + t00 < b + t10, a + t01 <= b + t11
            back.append((p, q))
            a, b = (b + t10 if p else a + t00), (b + t11 if q else a + t01)
        b += x
    label = b >= a
    out = [label]
    for p, q in reversed(back):
        label = q if label else p
        out.append(label)
    return np.array(out[::-1], bool)


class Chains:
    """Sequences of lines for training, all in step t at once: the longest first, so that those still going are a prefix."""

    def __init__(self, x: list[np.ndarray], weight: list[float], given: list[bool] | None = None):
        self.order = np.argsort([-len(v) for v in x], kind="stable")
        self.length = np.array([len(x[i]) for i in self.order])
        self.weight = np.array([weight[i] for i in self.order])
        #: Chains whose first label is given, so that it explains what follows and is not explained itself.
        self.given = np.array(given, bool)[self.order] if given is not None else np.zeros(len(x), bool)
        self.steps = int(self.length.max())
        self.going = np.searchsorted(-self.length, -np.arange(self.steps), "left")  # sequences longer than t
        #: Row and step of each line, in the order of ``x`` put together.
        self.seq = np.repeat(np.argsort(self.order), [len(v) for v in x])
        self.step = np.concatenate([np.arange(len(v)) for v in x])
        self.x = np.concatenate(x)

    def value(self, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted log-likelihood of the labels ``y`` (of all lines), under those that are given, and its gradient, by forward-backward."""
        n, go = len(self.length), self.going
        s = np.zeros((self.steps, n))
        s[self.step, self.seq] = self.x @ w
        f, b = np.zeros((self.steps, 2, n)), np.zeros((self.steps, 2, n))
        label = np.zeros((self.steps, n), np.int8)
        label[self.step, self.seq] = y
        f[0, 1] = s[0]
        f[0, 1 - label[0, self.given], np.flatnonzero(self.given)] = -1e9
        for k in range(1, self.steps):
            m = go[k]
            for c in (0, 1):
                f[k, c, :m] = np.logaddexp(f[k - 1, 0, :m] + t[0, c], f[k - 1, 1, :m] + t[1, c])
            f[k, 1, :m] += s[k, :m]
        for k in range(self.steps - 2, -1, -1):
            m = go[k + 1]
            on = b[k + 1, 1, :m] + s[k + 1, :m]
            for a in (0, 1):
                b[k, a, :m] = np.logaddexp(t[a, 0] + b[k + 1, 0, :m], t[a, 1] + on)
        last = f[self.length - 1, :, np.arange(n)]
        z = np.logaddexp(last[:, 0], last[:, 1])
        row_weight = self.weight[self.seq]
        p = np.exp(f[self.step, 1, self.seq] + b[self.step, 1, self.seq] - z[self.seq])
        dw = self.x.T @ (row_weight * (y - p))
        value = float((row_weight * y) @ s[self.step, self.seq] - self.weight @ z)
        dt = np.zeros((2, 2))
        for k in range(1, self.steps):
            m = go[k]
            u, v = label[k - 1, :m], label[k, :m]
            for a in (0, 1):
                for c in (0, 1):
                    seen = float(self.weight[:m][(u == a) & (v == c)].sum())
                    want = float(self.weight[:m] @ np.exp(f[k - 1, a, :m] + t[a, c] + (s[k, :m] if c else 0) + b[k, c, :m] - z[:m]))
                    dt[a, c] += seen - want
                    value += seen * t[a, c]
        return value, dw, dt


def climb(value, start: np.ndarray, tolerance: float = 1e-5, most: int = 200) -> np.ndarray:
    """The maximum of a concave function (value, gradient) by the quasi-Newton method of Broyden, Fletcher, Goldfarb and Shanno."""
    x, h = start.copy(), np.eye(len(start))
    v, g = value(x)
    for _ in range(most):
        if np.abs(g).max() < tolerance:
            break
        d, size = h @ g, 1.0
        while True:
            new_v, new_g = value(x + size * d)
            if new_v >= v + 1e-4 * size * (d @ g) or size < 1e-8:
                break
            size /= 2
        if size < 1e-8:
            break
        step, turn = size * d, g - new_g
        x, v, g = x + step, new_v, new_g
        if (c := step @ turn) > 1e-12:
            left = np.eye(len(x)) - np.outer(step, turn) / c
            h = left @ h @ left.T + np.outer(step, step) / c
    return x


def fit(docs: list[np.ndarray], y: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """docs: the features of each one's lines. Returns weights and transitions.

    Both labels weigh the same, and so do all documents of a label, whatever their length. Long documents are chains of CHAIN
    transitions each, the next one given the last label of the one before, so that every line and every transition counts
    once, those between chains too, and the work grows with the lines.
    """
    k = len(FEATURES)
    if len(np.unique(y)) < 2:
        return np.where(np.arange(k) == 0, 30.0, 0.0), np.zeros((2, 2))
    share = np.bincount(y)
    parts = [(i, a) for i, x in enumerate(docs) for a in range(0, max(len(x) - 1, min(len(x), 1)), CHAIN)]
    first = np.cumsum([0, *map(len, docs)])
    line = np.concatenate([np.arange(first[i] + a, min(first[i] + a + CHAIN + 1, first[i + 1])) for i, a in parts])
    chains = Chains([docs[i][a : a + CHAIN + 1] for i, a in parts], [0.5 / share[y[i]] / len(docs[i]) for i, _ in parts], [a > 0 for _, a in parts])
    label = np.repeat(y, [len(x) for x in docs])

    def solve(transitions: bool, start: np.ndarray) -> np.ndarray:
        def value(p: np.ndarray) -> tuple[float, np.ndarray]:
            v, dw, dt = chains.value(label[line], p[:k], p[k:].reshape(2, 2))
            return v - 0.5 * decay * float(p @ p), np.concatenate([dw, dt.ravel() * transitions]) - decay * p

        return climb(value, start)

    p = solve(False, np.zeros(k + 4))
    # Not every line of a poor document is boilerplate: they are decoded anew, documents in full, before transitions are learnt.
    label = np.concatenate([np.ones(len(x), int) if v else viterbi(x @ p[:k], p[k:].reshape(2, 2)).astype(int) for x, v in zip(docs, y, strict=True)])
    p = solve(True, p)
    return p[:k], p[k:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """The field, from all lines of the sampled documents; two bytes a line come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offs in texts(b):
                x = Lines(data, offs)
                own = [np.packbits(x.x[x.of[i] : x.of[i + 1]].astype(bool), axis=1).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, n), "y": b.column(2).slice(at, n), "lines": pa.array(own, pa.binary())})

    rows = labelled(docs, labels, label, 1, 1, per_class).select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, "doc_id long, y int, lines binary").collect()
    rows = sorted((r for r in rows if r.lines), key=lambda r: (r.doc_id, r.lines))
    lines = [np.unpackbits(np.frombuffer(r.lines, np.uint8).reshape(-1, 2), axis=1)[:, : len(FEATURES)].astype(float) for r in rows]
    return fit(lines, np.array([r.y for r in rows]))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], min_share: float = MIN_SHARE) -> DataFrame:
    """The contract's columns, and content_share: the part of a text's words that lies in content lines (0 without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for b in batches:
            for at, n, data, offs in texts(b):
                x = Lines(data, offs)
                s = x.x @ w
                content = np.zeros(n)
                for i in np.flatnonzero(np.diff(x.of)):
                    own = slice(x.of[i], x.of[i + 1])
                    content[i] = x.words[own][viterbi(s[own], t)].sum()
                share = content / np.maximum(x.n_words, 1)
                failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).slice(at, n), "n_words": pa.array(x.n_words, pa.int64()), "word_chars": pa.array(x.word_chars, pa.int64()),
                    "n_symbols": pa.array(x.n_symbols, pa.int64()), "n_dup_lines": pa.array(x.n_dup_lines, pa.int64()), "n_repeat_words": pa.array(x.n_repeat_words, pa.int64()),
                    "base_failed": pa.array(failed), "kept": pa.array(~failed & (share >= min_share)), "content_share": pa.array(share),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_line_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
