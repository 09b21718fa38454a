"""What the corpus operators share: shared storage, Arrow batches as byte arrays, vectorised words.

Text is handled as the UTF-8 bytes of an Arrow column, so that one numpy call works on thousands of
documents. Words are ``[^\\x20\\x09-\\x0D]+``; those separators are single bytes that never occur inside
a multi-byte character, so byte positions and words agree with what a regular expression finds.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir, written  # noqa: F401

#: Bytes of text that one numpy step takes at a time; a longer document is a step of its own.
CHUNK = 1 << 20
#: Bytes that are hashed at a time: the tables of powers have this length, however long a text or a word is.
WINDOW = 1 << 17
#: A word as a Java / RE2 / Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null doc_id where ids are compared.
NO_ID = -(1 << 63)
#: Bits of the bitmap that ``parted`` broadcasts: 512 rows of 4 KB at most, however many keys there are.
PARTED_BITS = 24


def parted(rows: DataFrame, some: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose keys (never null) are surely not in ``some``, and those whose keys may be: by a bitmap of fixed size, so that only the latter,
    with what they carry, need a shuffle to be checked."""
    place = (F.shiftrightunsigned(F.xxhash64(*keys), 64 - PARTED_BITS) + 1).alias("_place")
    bits = some.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    x = rows.select("*", place).withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(bits), "_bucket", "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    x = x.select(*rows.columns, F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))
    return x.where("NOT _maybe").drop("_maybe"), x.where("_maybe").drop("_maybe")


# ---------------------------------------------------------------- Arrow batches

def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def release() -> None:
    """Hand freed memory back to the system: a worker is used again from stage to stage, and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch of about ``most`` bytes: first row, rows, bytes, offsets (rows + 1, from 0). Null: empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to - at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    release()


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


# ---------------------------------------------------------------- words

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; in place on a fresh array."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if lower:
        codes[65:91] = codes[97:123]
    codes[~IS_WORD] = 0
    return codes


CODES, CODES_LOWER = _codes(False), _codes(True)
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)

#: Terms: runs of ASCII letters and digits and of non-ASCII bytes, so that marks around a word don't matter.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
TERM_CODES = np.where(TERM, CODES_LOWER, 0).astype(np.uint64)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def of(p: int) -> np.ndarray:
        x = np.full(WINDOW, p, _U)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(_P), of(_P_INV)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end), by the codes of its bytes and their places in the run.

    Runs are in order and don't overlap; bytes between two runs must have code 0. A run longer than WINDOW is folded part by part.
    """
    out = np.zeros(len(starts), _U)
    up, down = _powers()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + WINDOW, "right"))
        if j > i:
            x = codes[data[base : ends[j - 1]]]
            x *= up[: len(x)]
            at = starts[i:j] - base
            out[i:j] = np.add.reduceat(x, at) * down[at]
            i = j
            continue
        total, scale = 0, 1
        for k in range(base, int(ends[i]), WINDOW):
            x = codes[data[k : min(k + WINDOW, int(ends[i]))]]
            total += int((x * up[: len(x)]).sum(dtype=_U)) * scale
            scale = scale * pow(_P, WINDOW, 1 << 64) % (1 << 64)
        out[i] = total % (1 << 64)
        i += 1
    return mix(out)


class Words:
    """The words of a piece: byte ``starts`` and ``ends``, ``of`` (rows + 1: where each document's words begin)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD):
        self.data, self.offs = data, offs
        w = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = w
        before &= ~edge
        self.starts = np.flatnonzero(w & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = w
        after &= ~edge
        self.ends = np.flatnonzero(w & ~after[1:]) + 1
        self.of = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Each word's row in the piece."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def hashes(self, lower: bool = False, codes: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (ASCII letters folded if ``lower``), equal for equal words only, but for chance of 2**-64."""
        return run_hashes(self.data, self.starts, self.ends, codes if codes is not None else CODES_LOWER if lower else CODES)

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words inside one document, and where each window's first word is."""
        if len(h) < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        left = np.repeat(self.of[1:], np.diff(self.of)) - np.arange(len(h))
        at = np.flatnonzero(left >= n)
        x = np.zeros(len(at), _U)
        for k in range(n):
            x *= _U(0x9FB21C651E98DF25)
            x += h[at + k]
        return mix(x), at


def hash_of(word: str, lower: bool = False) -> int:
    """The hash of one word, as ``Words.hashes`` gives it."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hashes(lower)[0])


def learns(parts: int, held: int) -> "F.Column":
    """Rows that a model may learn labels from: crc32(doc_id as text) mod ``parts`` is not ``held``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts != held
