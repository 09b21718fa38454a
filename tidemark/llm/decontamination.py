"""Benchmark decontamination by spaced-seed hashing.

A mask is laid on every place of a token sequence; the hash of the tokens under its ones ignores the others, so an overlap
with substituted tokens still meets under some mask. Training and benchmark hashes are joined, and around each hit the
two texts are compared on the hit's diagonal: any window of MIN_OVERLAP tokens and more, or of the whole item if that is
shorter, in which at least 80 % match (a match counts 1, a mismatch -4, the sum is not negative) makes the pair contaminated.

Diagonals are tried in order of their hits, until one has such a window: its best window is what is reported. A hash is one row of a
text and one of an item, however often they repeat it, so repetitive texts and items meet in rows that grow with their lengths.

A filter of fixed size (FILTER_BITS), built from all benchmark hashes by Spark's bitmap aggregate, is broadcast, so that
only training hashes that may meet one are kept for the join; it grows with neither table. With a hit goes the part
of its text that the longest item can reach, so documents are read once.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, ASCII case folded. Items of less than MIN_OVERLAP tokens have
masks of their own length: with s substitutions allowed they are cut into s + 2 blocks, and each pair of blocks is a mask, so that
one mask misses all substituted places wherever they are. Nulls: null texts and items have no token and meet nothing; a null
item_id is left out. A null doc_id is carried as such; repeated rows (equal doc_id and text) give one row. Empty tables: no rows.
Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, TERM, TERM_CODES, Words, mix, parted, table, texts, written

MASKS = ("11101101", "1101011001", "1011001101", "110010100011")
MIN_OVERLAP, MISMATCH = 13, 4
FILTER_BITS = 24
_U = np.uint64


def short_masks(n: int) -> list[str]:
    """Masks of an item of n tokens, of which one fifth may be substituted: all pairs of its blocks."""
    cuts = np.linspace(0, n, n // 5 + 3).round().astype(int) if n >= 5 else [0, n]
    parts = list(itertools.pairwise(cuts))
    chosen = itertools.combinations(parts, 2) if len(parts) > 1 else [parts]
    return ["".join("1" if any(a <= i < b for a, b in two) else "0" for i in range(n)) for two in chosen]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a piece, and where each text's begin."""
    words = Words(data, offs, TERM)
    return words.hashes(codes=TERM_CODES), words.of


def seeds(h: np.ndarray, of: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The mask's hash at every place where it fits in one text, and the places."""
    left = np.repeat(of[1:], np.diff(of)) - np.arange(len(h))
    at = np.flatnonzero(left >= len(mask))
    x = np.full(len(at), number + 1, _U)
    for k, c in enumerate(mask):
        if c == "1":
            x *= _U(0x9FB21C651E98DF25)
            x += h[at + k]
    return mix(x), at


def by_hash(of: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Owner and hash of each distinct (owner, hash), and its places in order, packed as 32-bit integers."""
    order = np.lexsort((places, hashes, of))
    of, hashes, places = of[order], hashes[order], places[order].astype("<i4")
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    cuts = np.append(np.flatnonzero(new), len(of)).astype(np.int32) * np.int32(4)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(places.tobytes())])
    return of[new], hashes[new], packed


def benchmark_hashes(items: DataFrame, masks: list[str]) -> DataFrame:
    """hash, item_id, ats: a row for each distinct hash of an item, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, data, offs in texts(b):
                h, of = tokens(data, offs)
                found = []
                for number, mask in enumerate(masks):
                    x, at = seeds(h, of, mask, number)
                    row = np.searchsorted(of, at, "right") - 1
                    if number >= len(MASKS):  # only items that are just as long
                        whole = np.diff(of)[row] == len(mask)
                        x, at, row = x[whole], at[whole], row[whole]
                    found.append((row, x, at - of[row]))
                row, x, ats = by_hash(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_pydict({"hash": pa.array(x.view(np.int64)), "item_id": b.column(0).take(pa.array(first + row)), "ats": ats})

    return items.mapInArrow(run, "hash long, item_id long, ats binary")


def benchmark_tokens(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, data, offs in texts(b):
                h, of = tokens(data, offs)
                yield pa.RecordBatch.from_pydict({"item_id": b.column(0).slice(first, n), "item": pa.array([h[of[i] : of[i + 1]].tobytes() for i in range(n)], pa.binary())})

    return items.mapInArrow(run, "item_id long, item binary")


def _bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> _U(64 - FILTER_BITS)).astype(np.int64), (x & _U((1 << FILTER_BITS) - 1)).astype(np.int64)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """One bit per place, two places per hash: 2**FILTER_BITS bits from at most 2**FILTER_BITS / 32768 rows."""
    high, low = F.shiftrightunsigned("hash", 64 - FILTER_BITS), F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    places = hashes.select(F.explode(F.array(high, low)).alias("p")).select((F.col("p") + 1).alias("p"))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[from, to) of MIN_OVERLAP places and more (of all, if there are fewer) with at least 80 % matches: of all such windows the one
    with the most matches, then the shortest, then the first. (0, 0) if there is none."""
    n = len(same)
    least = min(MIN_OVERLAP, n)
    matches = np.concatenate([[0], np.cumsum(same)])
    total = matches - MISMATCH * (np.arange(n + 1) - matches)  # does not fall from ``from`` to ``to`` where the share is reached
    start = np.arange(n - least + 1)
    to = np.searchsorted(-np.maximum.accumulate(total[::-1])[::-1], -total[start], "right") - 1  # the last place that is as high
    start, to = start[to - start >= least], to[to - start >= least]
    if not len(start):
        return 0, 0
    to = np.maximum(start + least, np.searchsorted(matches, matches[to]))
    top = np.lexsort((start, to - start, matches[start] - matches[to]))[0]
    return int(start[top]), int(to[top])


def diagonals(shared: list[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> np.ndarray:
    """Distinct differences of places of a text and an item under the same hash; those with most hits first, then the smallest.

    Where both repeat a hash so often that the pairs of places are more than ``most``, hits are counted by a convolution: its
    work grows with the length of the text and the item, not with their product.
    """
    found, held = [], 0
    values, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(more: np.ndarray, count: np.ndarray) -> None:
        nonlocal values, hits
        values, which = np.unique(np.concatenate([values, more]), return_inverse=True)
        hits = np.bincount(which, np.concatenate([hits, count])).astype(np.int64)

    for p, a in shared:
        p, a = p.astype(np.int64), a.astype(np.int64)
        if len(p) * len(a) <= most:
            found.append((p[:, None] - a[None, :]).ravel())
            held += len(found[-1])
            if held > 4 * most:
                merge(np.concatenate(found), np.ones(held, np.int64))
                found, held = [], 0
            continue
        n, m = int(np.ptp(p)) + 1, int(np.ptp(a)) + 1
        x, y = np.zeros(n), np.zeros(m)
        x[p - p.min()] = 1
        y[a.max() - a] = 1
        size = 1 << (n + m - 1).bit_length()
        count = np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: n + m - 1]).astype(np.int64)
        at = np.flatnonzero(count)
        merge(at + int(p.min()) - int(a.max()), count[at])
    if held:
        merge(np.concatenate(found), np.ones(held, np.int64))
    return values[np.lexsort((values, -hits))]


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per contaminated document and item: doc_id, text_key (a hash of the text), item_id, overlap, matched, start (token of the text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    known = written(benchmark_tokens(items).where(F.length("item") > 0), "bench-items")
    lengths = known.select((F.length("item") / 8).cast("int").alias("n"))
    short = sorted(r.n for r in lengths.where(F.col("n") < MIN_OVERLAP).distinct().collect())
    reach = (lengths.agg(F.max("n")).first()[0] or 0) + max(map(len, MASKS))
    masks = [*MASKS, *(m for n in short for m in short_masks(n))]
    hashes = written(benchmark_hashes(items, masks), "bench-hashes")
    shared = spark.sparkContext.broadcast(hash_filter(hashes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for first, n, data, offs in texts(b):
                h, of = tokens(data, offs)
                found_x, found_at = [], []
                for number, mask in enumerate(masks):
                    x, at = seeds(h, of, mask, number)
                    p, q = _bits(x)
                    hit = np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
                    q = q[hit]
                    hit = hit[((bits[q >> 3] >> (q & 7).astype(np.uint8)) & 1).astype(bool)]
                    found_x.append(x[hit])
                    found_at.append(at[hit])
                x, at = np.concatenate(found_x), np.concatenate(found_at)
                if not len(x):
                    continue
                order = np.argsort(at, kind="stable")
                x, at = x[order], at[order]
                row = np.searchsorted(of, at, "right") - 1
                apart = np.concatenate([[False], (np.diff(at) > 2 * reach) | (np.diff(row) > 0)])
                lo = np.flatnonzero(np.concatenate([[True], apart[1:]]))
                hi = np.append(lo[1:], len(x))
                rows = row[lo]
                start = np.maximum(of[rows], at[lo] - reach)
                end = np.minimum(of[rows + 1], at[hi - 1] + reach)
                part, x, places = by_hash(np.cumsum(apart), x, at - of[row])
                cuts = pa.array(np.searchsorted(part, np.arange(len(lo) + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).take(pa.array(first + rows)), "text_key": b.column(2).take(pa.array(first + rows)), "start": pa.array(start - of[rows], pa.int32()),
                    "tokens": pa.array([h[s:e].tobytes() for s, e in zip(start, end, strict=True)], pa.binary()),
                    "hashes": pa.ListArray.from_arrays(cuts, pa.array(x.view(np.int64))), "places": pa.ListArray.from_arrays(cuts, places),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    parts = written(rows.mapInArrow(scan, "doc_id long, text_key long, start int, tokens binary, hashes array<long>, places array<binary>").withColumn("part", F.xxhash64("doc_id", "text_key", "start")), "bench-parts")
    hits = parts.select("part", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("part", F.col("h.hashes").alias("hash"), F.col("h.places").alias("places"))
    # A row for each hash that a part and an item share, however often either repeats it. On a hash that very many documents
    # share, adaptive execution splits this join's skewed side.
    pairs = hits.join(hashes, "hash").groupBy("part", "item_id").agg(F.collect_list(F.struct("places", "ats")).alias("shared"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (start, raw, item, shared) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)):
                t, u = np.frombuffer(raw, _U), np.frombuffer(item, _U)
                for d in diagonals([(np.frombuffer(x["places"], "<i4"), np.frombuffer(x["ats"], "<i4")) for x in shared]).tolist():
                    a = d - start  # of the item's first token in t
                    lo, hi = max(0, -a), min(len(u), len(t) - a)
                    if hi <= lo:
                        continue
                    same = t[a + lo : a + hi] == u[lo:hi]
                    s, e = best_stretch(same)
                    if e - s >= min(MIN_OVERLAP, len(u)):
                        out.append((i, int(same[s:e].sum()), e - s, d + lo + s))
                        break
            pick = b.select(["doc_id", "text_key", "item_id"]).take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_pydict({n: pick.column(n) for n in ("doc_id", "text_key", "item_id")} | {"overlap": pa.array([x[2] for x in out], pa.int32()), "matched": pa.array([x[1] for x in out], pa.int32()), "start": pa.array([x[3] for x in out], pa.int32())})

    both = pairs.join(parts.select("part", "doc_id", "text_key", "start", "tokens").dropDuplicates(["part"]), "part").join(known, "item_id")
    verified = both.select("doc_id", "text_key", "item_id", "start", "tokens", "item", "shared").mapInArrow(verify, "doc_id long, text_key long, item_id long, overlap int, matched int, start int")
    best = F.max(F.struct("matched", "overlap", (-F.col("start")).alias("s"))).alias("b")
    return verified.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", F.col("b.overlap").alias("overlap"), F.col("b.matched").alias("matched"), (-F.col("b.s")).alias("start"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every contaminated document with each benchmark item that it overlaps."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns. Texts are shuffled only for rows that may be contaminated."""
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_key").alias("key")]
    bad = written(overlaps(docs, items).select(*key).distinct(), "bench-bad")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"))
    sure, maybe = parted(own, bad, ["id", "key"])
    return sure.unionByName(maybe.join(bad, ["id", "key"], "left_anti")).select("row.*")
