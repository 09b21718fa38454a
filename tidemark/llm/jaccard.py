"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct shingles of ``words`` words (the whole sequence as one if it has fewer), ASCII letters folded.
Two sets link when 100 * intersection >= ``percent`` * union; op7's are WORDS and PERCENT. Exact for all pairs of different sets, but for chance of 64-bit hashes:

1. Equal sets are one class, known by a hash of the set; from here on a class is one record however many copies it has.
2. Tokens get one order for all sets: a fixed part of the hash space first, by document frequency (counted by one shuffle
   over all documents), then the rest likewise, then the frequent class (FREQUENT of all documents and more), counted before in one pass.
   A set whose first part alone holds its prefix sends only that part.
3. Linked sets share g + 1 tokens of prefixes that are extended by g. If one of those is rare (RARE sets and less have it), its single-token
   key finds the pair. If none is, two fall into one of g hash groups, so the pairs of the other tokens within each group, the
   2-token combinations, are keys as well. A token of frequency 1 meets nothing and needs no key.
4. Classes under one key are compared with the key's hub (the class with the fewest tokens of its own), which takes as many pairs as
   rows; what is linked to the hub needs no comparison among itself. Other members are compared in blocks of at most BLOCK sets, by one
   matrix product per pair of blocks: those near the hub against the others, and the others among themselves.
   Members of one component need no comparison, so each is compared with one hub first, and with others only if that leaves them apart.
   All this is done on parities first, a bit per hash bucket and about as many buckets as tokens: two sets differ in at least as many
   tokens as their parities in bits, so no link is lost, and what is not alike falls out at a 64th of the bytes of sets. For what is left
   the sets are fetched and compared exactly, with the hub, and in blocks where more than one component is around it.
5. Components of all links; a document's component is the smallest doc_id of its classes.

Nulls: a null text is empty: no shingle, its own component, as is every empty text. A null doc_id stays null and never names a component
unless nothing else does. Repeated rows are equal sets. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Words, mix, parted, table, texts, written
from .components import components

#: Share of documents from which a token is of the frequent class, at least FREQUENT_LEAST of them. Bounds the class: no more tokens than mean set size / FREQUENT.
FREQUENT, FREQUENT_LEAST = 0.0025, 32
#: Documents of a piece in which a token is reported to that count, at least.
LOCAL_LEAST = 4
BLOCK = 192
#: Sets that have a token, up to which it is a key of its own; more common ones are keys in combinations only.
RARE = 32
FILTER_BITS = 24
#: Shingle length and share of op7; other callers name their own.
WORDS, PERCENT = 3, 90
_U = np.uint64


def shingles(data: np.ndarray, offs: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted set of each text of a piece."""
    words = Words(data, offs)
    h = words.hashes(lower=True)
    g, at = words.grams(h, n)
    cut = np.searchsorted(at, words.of)
    out = []
    for i in range(len(offs) - 1):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
        elif words.of[i + 1] > words.of[i]:
            x = _U(1)
            with np.errstate(over="ignore"):
                for y in h[words.of[i] : words.of[i + 1]]:
                    x = x * _U(0x9FB21C651E98DF25) + y
            out.append(mix(np.array([x ^ _U(0x5BD1E995)])))
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    x = (int(mix(s).sum(dtype=_U)) + len(s) * 0x9E3779B97F4A7C15) % 2**64
    return int(mix(np.array([x], _U)).view(np.int64)[0])


def least(percent: int = PERCENT) -> int:
    """Below this size a set links with equal ones only; for 90, 8 / 9 < 0.9."""
    return -(-percent // (100 - percent))


def overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any set that it links with, at least; also the least size of such a set."""
    return -(-percent * n // 100)


def needed(n: int, percent: int = PERCENT) -> int:
    """The prefix: what is left of a set of n when all but one of the least common tokens are taken away, plus one."""
    return n - overlap(n, percent) + 1


def groups(n: int, percent: int = PERCENT) -> int:
    """Hash groups for the combinations of a set of n tokens."""
    return 1 << max(0, (needed(n, percent) // 4).bit_length() - 1)


def first(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether tokens are in the part of the hash space that is counted first: nearly twice what prefixes take of a set, in sixteenths."""
    return (mix(tokens) & _U(15)) < _U(min(16, max(4, -(-29 * (100 - percent) // 100))))


def parity(s: np.ndarray) -> bytes:
    """Of a set, whether each bucket of its hashes holds an odd number of them; buckets are a power of two, as many as tokens or more."""
    buckets = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & _U(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(differ, n, m, percent: int = PERCENT):
    """Whether sets of n and m tokens that differ in so many tokens and more can link."""
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the length of the other, which keeps it a parity."""
    if len(a) < len(b):
        a, b = b, a
    x, k = int.from_bytes(a, "little"), 8 * len(a)
    while k > 8 * len(b):
        k //= 2
        x = (x >> k) ^ (x & ((1 << k) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def close_in_block(n: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int = PERCENT, columns: int = 8192) -> np.ndarray:
    """Which members have another one, of another side, that they may link with by their parities; side -1 is a side of one's own."""
    out = np.zeros(len(n), bool)
    length = np.array([8 * len(b) for b in bits])
    rows = {int(k): np.flatnonzero(length == k) for k in np.unique(length)}
    flat = {k: np.unpackbits(np.frombuffer(b"".join(bits[i] for i in at), np.uint8), bitorder="little").reshape(len(at), k) for k, at in rows.items()}
    for k, at in rows.items():
        own = flat[k]
        for k2 in (k, 2 * k):
            if k2 not in rows:
                continue
            other, at2 = flat[k2], rows[k2]
            if k2 > k:
                other = other[:, :k] ^ other[:, k:]
            dot = np.zeros((len(at), len(at2)), np.float32)
            for c in range(0, k, columns):
                dot += (1 - 2 * own[:, c : c + columns].astype(np.float32)) @ (1 - 2 * other[:, c : c + columns].astype(np.float32)).T
            hit = may_link(((k - dot) / 2).astype(np.int64), n[at][:, None], n[at2][None, :], percent) & ((side[at][:, None] != side[at2][None, :]) | (side[at] == -1)[:, None]) & (at[:, None] != at2[None, :])
            out[at] |= hit.any(axis=1)
            out[at2] |= hit.any(axis=0)
    return out


# ---------------------------------------------------------------- passes over the texts

def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: doc_id, set size, signature, hash of the text. kind 1: token, documents that have it, in pieces where they are LOCAL_LEAST and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offs in texts(b, most=4 << 20):
                sets = shingles(data, offs, words)
                sig = np.array([signature(s) for s in sets], np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(n, np.int8)), "a": b.column(0).slice(at, n), "b": pa.array(size), "c": pa.array(sig), "d": b.column(2).slice(at, n)})
                _, once = np.unique(sig, return_index=True)
                tokens, count = np.unique(np.concatenate([sets[i] for i in once]), return_counts=True)
                keep = count >= max(LOCAL_LEAST, FREQUENT * n)
                if keep.any():
                    k = int(keep.sum())
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(k, np.int8)), "a": pa.array(tokens[keep].view(np.int64)), "b": pa.array(count[keep]), "c": pa.array(np.zeros(k, np.int64)), "d": pa.array(np.zeros(k, np.int64))})

    return docs.select("id", "text", F.xxhash64("text")).mapInArrow(run, "kind byte, a long, b long, c long, d long")


def _frequent(summaries: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent class, by token, and its counts."""
    least = max(FREQUENT_LEAST, FREQUENT * n_docs)
    rows = summaries.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).where(F.col("n") >= least).collect()
    t, c = np.array([r.token for r in rows], np.int64).view(_U), np.array([r.n for r in rows], np.int64)
    order = np.argsort(t)
    return t[order], c[order]


def _token_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """Rows (token, sig) of each set, and one (sig, sig, info): size, rare tokens sent of the first part and of the rest, frequent tokens in order, parity."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        done: set[int] = set()
        for b in batches:
            for _, _, data, offs in texts(b):
                keys, sigs, infos = [], [], []
                for s in shingles(data, offs, words):
                    if len(s) < least(percent) or (sig := signature(s)) in done:
                        continue
                    done.add(sig)
                    length = needed(len(s), percent) + groups(len(s), percent)
                    at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                    often = common[at] == s if len(common) else np.zeros(len(s), bool)
                    rare = s[~often]
                    early = first(rare, percent)
                    sent, rest, most = rare[early], 0, np.zeros(0, _U)
                    if len(sent) < length:
                        rest = len(rare) - len(sent)
                        own = s[often]
                        most = own[np.lexsort((own, count[at[often]]))][:length] if len(rare) < length else most
                        sent_all = rare
                    else:
                        sent_all = sent
                    keys += [sent_all.view(np.int64), np.array([sig], np.int64)]
                    sigs.append(np.full(len(sent_all) + 1, sig, np.int64))
                    infos += [None] * len(sent_all) + [np.concatenate([np.array([len(s), len(sent), rest, len(most)], _U), most]).tobytes() + parity(s)]
                if keys:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "sig": pa.array(np.concatenate(sigs)), "info": pa.array(infos, pa.binary())})
                if len(done) > 500_000:
                    done.clear()

    return docs.select("text").mapInArrow(run, "key long, sig long, info binary")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """Of (token, sig) rows, those whose token several sets have: sig, token, df; info rows pass. Works on sorted partitions, a run of one token at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key: np.ndarray, sig: np.ndarray) -> pa.RecordBatch | None:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
            key, sig = key[new], sig[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            df = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
            keep = df > 1
            if not keep.any():
                return None
            n = int(keep.sum())
            return pa.RecordBatch.from_pydict({"sig": pa.array(sig[keep]), "token": pa.array(key[keep]), "df": pa.array(df[keep]), "info": pa.nulls(n, pa.binary())})

        held_key, held_sig = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            info = b.column(2)
            is_info = np.asarray(info.is_valid())
            key, sig = np.asarray(b.column(0)), np.asarray(b.column(1))
            if is_info.any():
                at = pa.array(np.flatnonzero(is_info))
                yield pa.RecordBatch.from_pydict({"sig": b.column(1).take(at), "token": pa.nulls(len(at), pa.int64()), "df": pa.nulls(len(at), pa.int64()), "info": info.take(at)})
                key, sig = key[~is_info], sig[~is_info]
            key, sig = np.concatenate([held_key, key]), np.concatenate([held_sig, sig])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if out := emit(key[:last], sig[:last]):
                yield out
            held_key, held_sig = key[last:], sig[last:]
        if out := emit(held_key, held_sig):
            yield out

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "sig").mapInArrow(run, "sig long, token long, df long, info binary")


def prefix_keys(n: int, early: int, rest: int, most: np.ndarray, shared: np.ndarray, df: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Keys of one set, and how many of the tokens it sent are its own alone. shared: its rare tokens of frequency 2 and more."""
    early_ones = first(shared, percent)
    order = np.lexsort((shared, df, ~early_ones))
    shared, count = shared[order], df[order]
    in_first = int(early_ones.sum())
    parts = [(early - in_first, 0, in_first), (rest - (len(shared) - in_first), in_first, len(shared))]
    keys = []
    for g in {groups(overlap(n, percent), percent), groups(n, percent)}:
        left, picked = needed(n, percent) + g, []
        for own, start, end in parts:
            left -= own
            picked.append(np.arange(start, min(end, start + max(left, 0))))
            left -= len(picked[-1])
            if left <= 0:
                break
        at = np.concatenate(picked)
        alone = count[at] <= RARE
        keys.append(mix(shared[at[alone]]))
        often = np.concatenate([shared[at[~alone]], most[: max(left, 0)]])
        if len(often) > 1:
            group = (often % _U(g)).astype(np.int64)
            for k in np.unique(group):
                x = np.sort(often[group == k])
                i, j = np.triu_indices(len(x), 1)
                keys.append(mix(x[i] * _U(0x9FB21C651E98DF25) + x[j] + _U(g)))
    return np.unique(np.concatenate(keys)), early + rest - len(shared)


def _index(shared: DataFrame, percent: int) -> DataFrame:
    """key, sig, n, own for every set that has keys; and a row of its parity (bits), without a key."""
    grouped = shared.groupBy("sig").agg(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "df"))).alias("t"), F.max("info").alias("info"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, infos, sigs = b.column(1), b.column(2), np.asarray(b.column(0))
            cut = np.asarray(t.offsets)
            flat = t.values
            token, df = np.asarray(flat.field(0)).view(_U), np.asarray(flat.field(1))
            keys, count, sizes, owns, bits = [], [], [], [], []
            for i, raw in enumerate(infos.to_pylist()):
                n, early, rest, n_most = map(int, np.frombuffer(raw, _U, 4))
                k, own = prefix_keys(n, early, rest, np.frombuffer(raw, _U, n_most, 32), token[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]], percent)
                keys.append(k)
                count.append(len(k))
                sizes.append(n)
                owns.append(own)
                bits.append(raw[32 + 8 * n_most :])
            repeat = lambda x: np.repeat(np.array(x, np.int64), count)
            total = int(np.sum(count))
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "sig": pa.array(repeat(sigs)), "n": pa.array(repeat(sizes)), "own": pa.array(repeat(owns)), "bits": pa.nulls(total, pa.binary())})
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(some), pa.int64()), "sig": pa.array(sigs[some]), "n": pa.array(np.array(sizes)[some]), "own": pa.array(np.array(owns)[some]), "bits": pa.array([bits[i] for i in some], pa.binary())})

    return grouped.select("sig", "t", "info").mapInArrow(run, "key long, sig long, n long, own long, bits binary")


# ---------------------------------------------------------------- sets of candidates, and their links

def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit per hashed id, of fixed size: 2**FILTER_BITS bits from at most 2**FILTER_BITS / 32768 rows."""
    p = (F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS) + 1).alias("p")
    rows = ids.select(p).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """sig, set of the classes in ``wanted`` (sig, id: their smallest doc_id); reads the texts again, but keeps those of wanted ids only."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shared.value, set()
        for b in batches:
            p = np.asarray(b.column(2))
            keep = np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            for at, n, data, offs in texts(b):
                ids, out = b.column(0).slice(at, n).to_pylist(), []
                for i, s in zip(ids, shingles(data, offs, words), strict=True):
                    if len(s) and (row := (signature(s), i)) not in done:  # repeated rows once a task
                        done.add(row)
                        out.append((*row, s.tobytes()))
                yield pa.RecordBatch.from_pydict({"sig": pa.array([x[0] for x in out], pa.int64()), "id": pa.array([x[1] for x in out], pa.int64()), "set": pa.array([x[2] for x in out], pa.binary())})

    known = F.coalesce("id", F.lit(NO_ID))
    rows = docs.select(known.alias("id"), "text", F.shiftrightunsigned(F.xxhash64(known), 64 - FILTER_BITS).alias("p"))
    found = rows.mapInArrow(run, "sig long, id long, set binary")
    return found.join(wanted.withColumnRenamed("id", "rep"), "sig").where("id = rep").select("sig", "set").dropDuplicates(["sig"])


def linked(common, a, b, percent: int = PERCENT):
    return 100 * common >= percent * (a + b - common)


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, sig of the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if linked(int((y[at] == x).sum()), len(x), len(y), percent):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(out, pa.int64())) for k in (0, 1)], ["hub", "sig"])

    # Only sets that are in a pair are shuffled; the list of those is broadcast by Spark if it is small.
    own = sets.join(pairs.select("sig").distinct(), "sig", "left_semi")
    hubs = sets.select(F.col("sig").alias("hub"), F.col("set").alias("hub_set")).join(pairs.select("hub").distinct(), "hub", "left_semi")
    both = pairs.join(own, "sig").join(hubs, "hub")
    return both.select("hub", "sig", "set", "hub_set").mapInArrow(run, "hub long, sig long")


def links_in_block(sig: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, columns: int = 8192) -> list[tuple[int, int]]:
    """Links between different components that join them up (not all of them): sets as rows of a 0/1 matrix over the tokens that two sets and more have."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    token, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[which]
    row, col = row[keep], number[which[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(col, [start, start + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[lo:hi], col[lo:hi] - start] = 1
        common += m @ m.T
    hit = linked(common.astype(np.int64), size[:, None], size[None, :], percent) & (comp[:, None] != comp[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            parent[a] = b
            out.append((int(sig[i]), int(sig[j])))
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """hub, kind, i, j, and what ``rows`` (hub, sig, side, n_near, n_far and more) carry: members of a hub in pairs of blocks, so that
    any two that are not both on the near side meet in one. A small group is one block."""
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumn("k_far", blocks("n_far")).withColumn("k_near", blocks("n_near"))
    spot = F.pmod(F.xxhash64("sig"), F.when(F.col("side"), F.col("k_near")).otherwise(F.col("k_far"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Block pairs: ("f", i, j) of far blocks i <= j; ("n", i, j) of near block i and far block j.
    alone = F.col("n_near") + F.col("n_far") <= BLOCK
    far_far = F.transform(every("k_far"), lambda j: F.struct(F.lit("f").alias("kind"), F.least(j, F.col("spot")).alias("i"), F.greatest(j, F.col("spot")).alias("j")))
    near_far = F.transform(every("k_near"), lambda i: F.struct(F.lit("n").alias("kind"), i.alias("i"), F.col("spot").alias("j")))
    near = F.transform(every("k_far"), lambda j: F.struct(F.lit("n").alias("kind"), F.col("spot").alias("i"), j.alias("j")))
    whole = F.array(F.struct(F.lit("w").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    far = F.when(F.col("n_near") > 0, F.concat(far_far, near_far)).otherwise(far_far)
    pairs = F.when(alone, whole).when(F.col("side"), near).otherwise(far)
    more = [c for c in rows.columns if c not in ("n_near", "n_far", "k_near", "k_far")]
    return rows.withColumn("spot", spot).select(*more, F.explode(F.array_distinct(pairs)).alias("b")).select(*more, "b.*")


def _sides(members: DataFrame, near: DataFrame) -> DataFrame:
    """members with side: whether (hub, sig) is in ``near``."""
    return members.join(near.select("hub", "sig", F.lit(True).alias("side")), ["hub", "sig"], "left").withColumn("side", F.coalesce("side", F.lit(False)))


def _close(members: DataFrame, parities: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """By parities: (hub, sig) of members that may link with the hub; and of those that may link with another member though not both with the hub."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = [i for i in range(len(n)) if may_link(differ(x[i], y[i]), n[i], m[i], percent)]
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["hub", "sig"])

    def block(t: pa.Table) -> pa.Table:
        keep = close_in_block(np.asarray(t["n"]), np.where(np.asarray(t["side"]), 0, -1), t["bits"].to_pylist(), percent)
        return t.select(["hub", "sig"]).filter(pa.array(keep))

    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    own = parities.select("sig", "bits")
    both = members.where(fits).join(own, "sig").join(own.select(F.col("sig").alias("hub"), F.col("bits").alias("hub_bits")), "hub")
    near = written(both.select("hub", "sig", "n", "hub_n", "bits", "hub_bits").mapInArrow(pairs, "hub long, sig long"), "jaccard-near")
    named = _sides(members.select("hub", "sig", "n"), near)
    per = named.groupBy("hub").agg(F.sum(F.col("side").cast("long")).alias("n_near"), F.sum((~F.col("side")).cast("long")).alias("n_far")).where("n_far > 0 AND n_near + n_far > 1")
    dealt = _dealt(named.join(per, "hub")).join(own, "sig")
    found = dealt.select("hub", "kind", "i", "j", "sig", "n", "side", "bits").groupBy("hub", "kind", "i", "j").applyInArrow(block, "hub long, sig long")
    return near, written(found.distinct(), "jaccard-close")


def _in_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """hub, sig, comp, side of members: the component, and whether it is the hub's."""
    of = lambda df, c, name: df.join(labels.select(F.col("node").alias(c), F.col("label").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    named = of(of(members.select("hub", "sig"), "sig", "comp"), "hub", "hub_comp")
    return named.select("hub", "sig", "comp", (F.col("comp") == F.col("hub_comp")).alias("side"))


def _rest(members: DataFrame, labels: DataFrame, parities: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members of hubs around which several components are left. members: hub, sig without the hub itself.

    Blocks are compared by parities first, across components only; sets go to blocks only for members that have a partner by these.
    """
    named = _in_components(members, labels)
    # A member that is not in the hub's component, of another one than some other member, is work.
    per = named.groupBy("hub").agg(F.sum(F.col("side").cast("long")).alias("n_near"), F.sum((~F.col("side")).cast("long")).alias("n_far"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    work = written(per.where("c0 <> c1 AND n_far > 0 AND n_near + n_far > 1").select("hub", "n_near", "n_far"), "jaccard-work")

    def alike(t: pa.Table) -> pa.Table:
        keep = close_in_block(np.asarray(t["n"]), np.unique(np.asarray(t["comp"]), return_inverse=True)[1], t["bits"].to_pylist(), percent)
        return t.select(["hub", "kind", "i", "j", "sig", "comp"]).filter(pa.array(keep))

    def run(t: pa.Table) -> pa.Table:
        sig, once = np.unique(np.asarray(t["sig"]), return_index=True)
        found = links_in_block(sig, np.asarray(t["comp"])[once], [np.frombuffer(x, _U) for x in t["set"].take(pa.array(once)).to_pylist()], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    dealt = _dealt(named.join(work, "hub")).join(parities.select("sig", "n", "bits"), "sig").select("hub", "kind", "i", "j", "sig", "comp", "n", "bits")
    left = written(dealt.groupBy("hub", "kind", "i", "j").applyInArrow(alike, "hub long, kind string, i int, j int, sig long, comp long"), "jaccard-alike")
    return left.join(sets, "sig").select("hub", "kind", "i", "j", "sig", "comp", "set").groupBy("hub", "kind", "i", "j").applyInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; and text_key, a hash of its text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    summaries = written(_summaries(docs, words), "jaccard-sets")
    per_doc = summaries.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("sig"), F.col("d").alias("text_key"))
    classes = written(per_doc.where("n > 0").groupBy("sig").agg(F.min("id").alias("id")), "jaccard-classes")
    frequent = _frequent(summaries, per_doc.count())

    index = written(_index(_shared_tokens(_token_rows(docs, frequent, words, percent)), percent), "jaccard-index")
    keys, parities = index.where("key IS NOT NULL"), index.where("key IS NULL")
    hubs = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("own", "sig", "n")).alias("h")).where("m > 1").select("key", F.col("h.sig").alias("hub"), F.col("h.n").alias("hub_n"))
    members = written(keys.join(hubs, "key").where("sig <> hub").select("hub", "sig", "n", "hub_n").distinct(), "jaccard-members")
    near, more = _close(members, parities, percent)
    kept = near.union(more).distinct()
    wanted = kept.select("sig").union(near.select("hub")).distinct().join(classes, "sig").select("sig", F.coalesce("id", F.lit(NO_ID)).alias("id"))
    sets = written(_sets_of(docs, written(wanted, "jaccard-wanted"), words), "jaccard-candidates")
    # Each member with the hub that most members may link with: as many pairs as members. Of the other pairs, those are compared that this leaves apart.
    weight = near.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    first_hub = written(near.join(weight, "hub").groupBy("sig").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub")).select("hub", "sig"), "jaccard-near")
    links = written(_compare(first_hub, sets, percent), "jaccard-links")
    labels = components(links.select(F.col("hub").alias("a"), F.col("sig").alias("b")))
    apart = written(_in_components(near, labels).where("NOT side").select("hub", "sig").join(first_hub, ["hub", "sig"], "left_anti"), "jaccard-near")
    steps = [lambda: _compare(apart, sets, percent).select(F.col("hub").alias("a"), F.col("sig").alias("b")), lambda: _rest(kept, labels, parities, sets, percent)]
    for step in steps:
        more = written(step(), "jaccard-links")
        if more.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    named = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "id", F.coalesce("label", "sig").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    final = named.join(smallest, "label").select("sig", "component_id", "label")
    some = per_doc.where("n > 0").join(final, "sig")
    return some.unionByName(per_doc.where("n = 0").withColumn("component_id", F.col("id")).withColumn("label", F.lit(None).cast("long"))).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "text_key", "label")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component the row with its smallest doc_id (then text hash) stays; of rows equal in doc_id and text, one. Texts without a shingle all stay.

    What goes, and what is there more than once, are tables of ids and hashes. Texts are shuffled only for rows that may be in them.
    """
    found = written(grouped(docs, words, percent), "jaccard-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    pair = F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_key").alias("key")
    top = found.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("top")).select(F.coalesce("top.doc_id", F.lit(NO_ID)).alias("id"), F.col("top.text_key").alias("key"))
    # By id and hash, not by label: a group may hold a large part of all rows.
    gone = written(found.where("label IS NOT NULL").select(*pair).distinct().join(top, ["id", "key"], "left_anti"), "jaccard-gone")
    twice = written(found.select(*pair).groupBy("id", "key").count().where("count > 1").select("id", "key"), "jaccard-twice")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"))
    sure, maybe = parted(own, gone.unionByName(twice), ["id", "key"])
    return sure.unionByName(maybe.join(gone, ["id", "key"], "left_anti").dropDuplicates(["id", "key"])).select("row.*")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
