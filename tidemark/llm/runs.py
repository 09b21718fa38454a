"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

1. The words are cut into Lempel-Ziv blocks: each is the longest piece that began before. Around the seams of two
   neighbouring blocks longest common extensions forward and backward give squares (xx) that cover the leftmost place
   of every kind of square.
2. Squares whose half is itself a repetition are left out; the others are marked at their place in the suffix tree. From
   there suffix links are followed: a square without its first word, with that word at its end, is a square if the tree
   has it. While the text goes on so the walk is a stretch of the text; where it does not, the node is asked for a
   branch with that word. It ends at a marked place or when there is no branch. All kinds of squares are then marked.
3. Each kind's occurrences are the leaves below its place; neighbouring ones of one period are a run.

The suffix tree is kept as suffix array, common prefixes and range minima: a place is an interval of leaves and a
length. All texts of a batch are one sequence whose words differ from text to text, so that no match crosses a border.
Words whose neighbourhood of ``least / 2`` words comes but once in a text (or between such words) lie in no run of
``least`` words and are left out before. Words are compared by 64-bit hashes.

Nulls: a null text has no words. Texts without a run have an empty list. Repeated rows are rows of their own, and an
empty table gives no rows. Memory is linear in a batch's or one long text's words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, WORD, Words, arrow_map, ids_of, mix, table, texts

#: Words of the shortest run.
LEAST = 12
#: Extensions that are looked up at a time.
STEP = 1 << 20
_U = np.uint64


class RangeMin:
    """Least values of ranges: inside blocks of 16 by running minima, over blocks by a table of powers of two."""

    SIZE = 16

    def __init__(self, values: np.ndarray):
        pad = -len(values) % self.SIZE
        self.values = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)])
        blocks = self.values.reshape(-1, self.SIZE)
        self.up = np.minimum.accumulate(blocks, 1).ravel()
        self.down = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)] if len(blocks) else []
        while len(self.levels[-1:]) and len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            a = self.levels[-1]
            self.levels.append(np.minimum(a[:-half], a[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low..high, both included, low <= high."""
        out = np.minimum(self.down[low], self.up[high])
        a, b = low // self.SIZE, high // self.SIZE
        if len(one := np.flatnonzero(a == b)):
            x, last = low[one], high[one]
            least = self.values[x]
            for _ in range(1, self.SIZE):
                x = np.minimum(x + 1, last)
                np.minimum(least, self.values[x], out=least)
            out[one] = least
        wide = b - a - 1
        for level in range(len(self.levels)):
            at = np.flatnonzero((wide >= 1 << level) & (wide < 2 << level))
            if len(at):
                t = self.levels[level]
                out[at] = np.minimum(out[at], np.minimum(t[a[at] + 1], t[b[at] - (1 << level)]))
        return out


class Suffixes:
    """Suffix array of a sequence of small numbers, places in it, common prefixes of neighbours."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.seq = seq
        self.sa = np.argsort(seq, kind="stable").astype(np.int32)
        sorted_ = seq[self.sa]
        new = np.ones(n, bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.zeros(n + 1, np.int64)  # place of the first of a group; past the end: less than all
        rank[n] = -1
        rank[self.sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        k = 1
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        while len(open_):
            at = self.sa[open_].astype(np.int64)
            key = rank[at] * (n + 2) + rank[np.minimum(at + k, n)] + 1
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.sa[open_] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
            open_ = open_[~(new & np.append(new[1:], True))]
            k *= 2
        self.rank = rank[:n].astype(np.int32)
        self.common = self._common()
        self.least = RangeMin(self.common)

    def _common(self) -> np.ndarray:
        """Words that a suffix shares with the one before it: a text's next suffix shares at least one less."""
        n = len(self.seq)
        before = np.full(n, -1, np.int32)
        before[self.sa[1:]] = self.sa[:-1]
        out = np.zeros(n, np.int32)
        s, b, o, m = memoryview(np.append(self.seq, -1).astype(np.int32)), memoryview(before), memoryview(out), 0
        for i in range(n):
            j = b[i]
            if j < 0:
                m = 0
                continue
            while s[i + m] == s[j + m] and i + m < n and j + m < n:
                m += 1
            o[i] = m
            if m:
                m -= 1
        return out[self.sa]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (different) share; 0 where one is outside."""
        out = np.zeros(len(i), np.int64)
        n = len(self.seq)
        at = np.flatnonzero((np.minimum(i, j) >= 0) & (np.maximum(i, j) < n))
        if len(at):
            a, b = self.rank[i[at]].astype(np.int64), self.rank[j[at]].astype(np.int64)
            out[at] = self.least.of(np.minimum(a, b) + 1, np.maximum(a, b))
        return out

    def edge(self, at: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
        """The last place from ``at`` on, in the direction of step (1 or -1), whose suffixes all share ``length`` words with that at ``at``."""
        n = len(self.seq)
        got = at.astype(np.int64).copy()
        wide = np.ones(len(at), np.int64)
        growing, todo = np.ones(len(at), bool), np.arange(len(at))
        while len(todo):
            x, w = got[todo], wide[todo]
            to = x + step * w
            inside = (to >= 0) & (to < n)
            ok = np.zeros(len(todo), bool)
            y, z = x[inside], to[inside]
            ok[inside] = self.least.of(np.minimum(y, z) + 1, np.maximum(y, z)) >= length[todo[inside]]
            got[todo[ok]] = to[ok]
            growing[todo[~ok]] = False
            g = growing[todo]
            wide[todo] = np.where(g, w * 2, w // 2)
            todo = todo[wide[todo] > 0]
        return got


def blocks(s: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: the places are taken off a list in the order of the suffix array, the last word first, so that a place's neighbours are those before it in the text."""
    n = len(s.seq)
    longest = np.zeros(n, np.int32)
    common = np.append(s.common, 0).astype(np.int32)
    prev, next_ = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    rank, p, q, c, out = (memoryview(x) for x in (s.rank, prev, next_, common, longest))
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b, left, right = c[r], c[q[r]] if q[r] < n else 0, p[r], q[r]
        out[i] = a if a > b else b
        if left >= 0:
            q[left] = right
        if right < n:
            p[right] = left
            c[right] = a if a < b else b
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += out[i] or 1
    return np.array(starts, np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range: which one, and its numbers."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def covering(s: Suffixes, back: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of squares, among them one that leads to the leftmost of each kind. ``back`` is of the sequence from its end."""
    n = len(s.seq)
    h = blocks(s)
    ends = np.append(h[1:], n)
    after = np.append(ends[1:], n)
    found = []

    def seams(seam: np.ndarray, first: np.ndarray, last: np.ndarray, from_left: bool) -> None:
        """Around each seam: periods 1 to last - first, against the words before it (in its block) or after it."""
        count = last - first
        total = np.cumsum(count)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(STEP, total[-1], STEP)), [len(seam)]])) if len(seam) else [0]
        for a, b in itertools.pairwise(cuts):
            which, k = _ranges(np.ones(b - a, np.int64), count[a:b])
            at = seam[a:b][which]
            other = at - k if from_left else at + k
            k1, k2 = s.extension(at, other), back.extension(n - at, n - other)
            low = np.minimum(at, other)
            start = np.maximum(low - k2, low - k + 1)
            ok = (k1 + k2 >= k) & (k1 > 0)
            if not from_left:
                ok &= (k2 > 0) & (start + k <= ends[a:b][which])
            found.append((start[ok], k[ok]))

    inner = h[1:]
    seams(inner, h[:-1], inner, True)
    seams(h, h, np.minimum(after, n), False)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def primitive(s: Suffixes, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half from start is no repetition: for no prime p of k has it the period k / p."""
    ok, rest = np.ones(len(k), bool), k.copy()
    if not len(k):
        return ok
    factor = np.zeros(int(k.max()) + 1, np.int64)
    for p in range(2, int(k.max() ** 0.5) + 1):
        if not factor[p]:
            x = factor[p * p :: p]
            x[x == 0] = p
    factor = np.where(factor == 0, np.arange(len(factor)), factor)
    while len(todo := np.flatnonzero(rest > 1)):
        p = factor[rest[todo]]
        d = k[todo] // p
        ok[todo] &= s.extension(start[todo], start[todo] + d) < k[todo] - d
        rest[todo] //= p
    return ok


def vocabulary(s: Suffixes, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First leaf and half length of each kind of square, from squares that cover them."""
    n = len(s.seq)
    width = n + 1
    marked = np.zeros(0, np.int64)
    while len(start):
        # The walk along the text, at most once around; stretches of one period that overlap are one.
        along = np.minimum(s.extension(start, start + k) - k, k - 1)
        order = np.lexsort((start, k))
        start, k, last = start[order], k[order], (start + along)[order]
        reach = np.maximum.accumulate(k * width + last)
        new = np.ones(len(start), bool)
        new[1:] = k[1:] * width + start[1:] > reach[:-1]
        first = np.flatnonzero(new)
        start, k, last = start[first], k[first], reach[np.append(first[1:], len(new)) - 1] - k[first] * width
        which, at = _ranges(start, last - start + 1)
        kinds = s.edge(s.rank[at], 2 * k[which], -1) * width + k[which]
        marked = np.union1d(marked, kinds)
        # Where the text does not go on: the node of the square without its first word is asked for a branch.
        end = np.flatnonzero(last - start + 1 < k)
        e, k = last[end], k[end]
        low, high = s.edge(s.rank[e + 1], 2 * k - 1, -1), s.edge(s.rank[e + 1], 2 * k - 1, 1)
        word = s.seq[e]
        seq = np.append(s.seq, -1)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            less = seq[np.minimum(s.sa[middle] + 2 * k[todo] - 1, n)] < word[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
        at = s.sa[low].astype(np.int64)
        ok = seq[np.minimum(at + 2 * k - 1, n)] == word
        start, k = at[ok], k[ok]
        kinds = s.edge(s.rank[start], 2 * k, -1) * width + k
        kinds, one = np.unique(kinds, return_index=True)
        fresh = one[~np.isin(kinds, marked)]
        start, k = start[fresh], k[fresh]
    return marked // width, marked % width


def suspects(words: np.ndarray, window: int) -> np.ndarray:
    """Places of the words near which ``window`` words come again, found anew between the others until none goes."""
    at = np.arange(len(words))
    while len(words) >= window:
        grams = np.zeros(len(words) - window + 1, _U)
        for k in range(window):
            grams *= _U(0x9FB21C651E98DF25)
            grams += words[k : k + len(grams)]
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        near = np.zeros(len(words), bool)
        for k in range(window):
            near[k : k + len(again)] |= again
        if near.all():
            return at
        part = np.cumsum(~near)[near].astype(_U)
        words, at = mix(words[near] ^ mix(part + _U(1))), at[near]
    return at[:0]


def runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of the runs of at least ``least`` words among numbered words, by start and period."""
    at = suspects(words, (least + 1) // 2)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    # Words of different stretches differ, so that no square reaches over what was left out.
    stretch = np.cumsum(np.append(True, np.diff(at) > 1)).astype(_U)
    seq = np.unique(mix(words[at] ^ mix(stretch)), return_inverse=True)[1].astype(np.int32)
    s = Suffixes(seq)
    start, k = covering(s, Suffixes(seq[::-1].copy()))
    ok = primitive(s, start, k)
    low, k = vocabulary(s, start[ok], k[ok])
    which, leaves = _ranges(low, s.edge(low, 2 * k, 1) - low + 1)
    width = len(seq) + 1
    places = np.sort(k[which] * width + s.sa[leaves])
    new = np.flatnonzero(np.append(True, np.diff(places) != 1)) if len(places) else np.zeros(0, np.int64)
    start, k = places[new] % width, places[new] // width
    length = np.diff(np.append(new, len(places))) - 1 + 2 * k
    long = length >= least
    start, length, k = at[start[long]], length[long], k[long]
    order = np.lexsort((k, start))
    return start[order], length[order], k[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch)
            for first, n, data, offs in texts(batch):
                w = Words(data, offs)
                start, length, period = runs(mix(w.hashes() ^ mix(w.doc().astype(_U) + _U(1))), least)
                row = np.searchsorted(w.of, start, "right") - 1
                fields = [pa.array(x) for x in (start - w.of[row], length, period)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
                change = np.zeros(len(w) + 1, np.int64)  # words after the first period of a run go
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(np.diff(w.of)), lists, _kept(w, np.cumsum(change[:-1]) == 0)], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def _kept(w: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    docs = len(w.of) - 1
    at = np.flatnonzero(keep)
    of = np.searchsorted(at, w.of)
    last = np.zeros(len(at), bool)
    last[of[1:][np.diff(of) > 0] - 1] = True
    size = w.ends[at] - w.starts[at] + ~last  # a word and the separator after it, but for a document's last
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.starts[at]] += 1
    np.subtract.at(edge, w.starts[at] + size, 1)
    out = np.where(IS_WORD[w.data], w.data, 0x20)[np.cumsum(edge[:-1], dtype=np.int8) > 0].astype(np.uint8)
    total = np.append(0, np.cumsum(size))[of].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(total), pa.py_buffer(out)]).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period; word numbers from 0) and collapsed: the words that no run has after its first period, joined by one space."""
    id_ = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), _found(least), f"doc_id {id_}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth text, by the CRC of its id, goes on with some of its own words again and again."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    x = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    x = x.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ')"
    return x.select("doc_id", F.when(F.col("n") > 0, F.expr(again)).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12, over all of ``documents``; n_words follows."""
    x = periodic_runs(folded(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    x = x.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return x.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("b.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
