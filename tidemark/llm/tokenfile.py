"""Token ids as directly addressable codes: a file format, its Spark writer and its Spark reader.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunks, one after another,
of the ids that have one; a bitmap beside it says which of them go on to level k + 1, and a rank directory
(set bits before each block of 512) gives the place there. So any token of a file is found with one rank per
level, and no block is decoded on the way.

A file holds consecutive documents in ascending (doc_id, crc32 of the text) order. Nulls: a null doc_id
sorts first and stays null, a null text is empty (the end id alone). Repeated rows stay, each with its own
ids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, new_path, release, table, texts
from .encode import encoder, vocabulary

MAGIC = b"TMDAC001"
BLOCK = 512
#: Tokens after which a task closes a file: bounds what a task holds.
FILE_TOKENS = 2_000_000


class Level:
    """Chunks, continuation bitmap and rank directory of one level."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, directory: np.ndarray):
        self.chunks, self.bits, self.directory = chunks, bits, directory

    @classmethod
    def of(cls, values: np.ndarray) -> Level:
        go_on = values > 0xFF
        bits = np.packbits(go_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1)
        return cls((values & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))

    def continues(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before position i: one directory entry and at most one block."""
        block, start = i // BLOCK, i // BLOCK * BLOCK
        whole = self.bits[start // 8 : i // 8]
        rest = int(self.bits[i // 8]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.directory[block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()


class TokenFile:
    """A file's documents: ids (None for null), where each one's tokens start, and the coded tokens."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, levels: list[Level]):
        self.doc_ids, self.known, self.starts, self.levels = doc_ids, known, starts, levels

    @classmethod
    def of(cls, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, tokens: np.ndarray) -> TokenFile:
        levels, rest = [], tokens.astype(np.uint32)
        while not levels or len(rest):
            levels.append(Level.of(rest))
            rest = rest[rest > 0xFF] >> np.uint32(8)
        return cls(doc_ids.astype("<i8"), known.astype(np.uint8), starts.astype("<u8"), levels)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC + struct.pack("<QI", len(self.doc_ids), len(self.levels)))
        for x in (self.doc_ids, self.known, self.starts):
            out.write(x.tobytes())
        for x in self.levels:
            out.write(struct.pack("<QQQ", len(x.chunks), len(x.bits), len(x.directory)))
            out.write(x.chunks.tobytes() + x.bits.tobytes() + x.directory.astype("<u4").tobytes())
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> TokenFile:
        assert raw[:8] == MAGIC, "not a token file"
        n, n_levels = struct.unpack_from("<QI", raw, 8)
        at = 20

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, dtype, count, at)
            at += x.nbytes
            return x

        doc_ids, known, starts = take("<i8", n), take("u1", n), take("<u8", n + 1)
        levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<QQQ", raw, at)
            at += 24
            levels.append(Level(take("u1", a), take("u1", b), take("<u4", c)))
        return cls(doc_ids, known, starts, levels)

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        value = shift = 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.continues(i):
                break
            i, shift = level.rank(i), shift + 8
        return value

    def tokens(self) -> np.ndarray:
        out = self.levels[0].chunks.astype(np.uint32)
        at = np.arange(len(out))
        for k, level in enumerate(self.levels[:-1]):
            at = at[np.unpackbits(level.bits, count=len(level.chunks), bitorder="little").astype(bool)]
            out[at] |= self.levels[k + 1].chunks.astype(np.uint32) << np.uint32(8 * k + 8)
        return out


class StoredFile:
    """A token file where it lies: opening it reads the heads of its parts, and a token one chunk, one block of a bitmap and one directory entry a level.

    ``read(at, n)`` returns n bytes of the file from ``at``.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 20)
        assert head[:8] == MAGIC, "not a token file"
        self.n_docs, n_levels = struct.unpack_from("<QI", head, 8)
        self.starts_at = 20 + 9 * self.n_docs
        at, self.levels = self.starts_at + 8 * (self.n_docs + 1), []
        for _ in range(n_levels):
            chunks, bits, entries = struct.unpack("<QQQ", read(at, 24))
            self.levels.append((at + 24, at + 24 + chunks, at + 24 + chunks + bits))
            at += 24 + chunks + bits + 4 * entries
        self.n_tokens = struct.unpack("<QQQ", read(self.levels[0][0] - 24, 24))[0]

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, directory in self.levels:
            value |= self.read(chunks + i, 1)[0] << shift
            block = i // BLOCK
            own = int.from_bytes(self.read(bits + block * (BLOCK // 8), BLOCK // 8), "little")
            if not own >> (i % BLOCK) & 1:
                break
            before = struct.unpack("<I", self.read(directory + 4 * block, 4))[0]
            i, shift = before + (own & ((1 << i % BLOCK) - 1)).bit_count(), shift + 8
        return value

    def document(self, k: int) -> tuple[int, int]:
        """[start, end) of the k-th document's tokens."""
        return struct.unpack("<QQ", self.read(self.starts_at + 8 * k, 16))


def open_file(path: str) -> StoredFile:
    where, at = _at(path)
    f = where.open_input_file(at)

    def read(begin: int, n: int) -> bytes:
        f.seek(begin)
        return f.read(n)

    return StoredFile(read)


#: Names that Spark has for a store, by the name for it here; file, hdfs, viewfs, gs and s3 are the same.
STORES = {"s3a": "s3", "s3n": "s3"}


def _at(path: str) -> tuple:
    from pyarrow import fs

    scheme, sign, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}{sign}{rest}")


def _store(path: str, raw: bytes) -> None:
    """Put a file where all executors see it; written under a name of its own, so that a task run twice does no harm."""
    folder, _, name = path.rpartition("/")
    where, at = _at(folder)
    where.create_dir(at, recursive=True)
    with where.open_output_stream(f"{at}/{name}") as out:
        out.write(raw)


MANIFEST = "part int, seq int, path string, n_tokens long"


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every text, add ``end_id``, write the files under ``path``; returns the manifest (the files that count), stored beside them."""
    spark = docs.sparkSession
    files = f"{path}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, count = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held, count
            starts = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))])
            name = f"{files}/{uuid.uuid4().hex}.tmdac"
            _store(name, TokenFile.of(*(np.concatenate([x[k] for x in held]) for k in (0, 1)), starts, np.concatenate([x[3] for x in held])).dumps())
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "n_tokens": pa.array([int(starts[-1])], pa.int64())})
            seq, held, count = seq + 1, [], 0
            release()
            return row

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocab)
        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.is_valid())
            doc_ids = np.asarray(doc_ids.fill_null(0))
            for at, n, data, offs in texts(batch, most=min(CHUNK, file_tokens)):
                ids, of = enc.encode(data, offs)
                ids = np.insert(ids, of[1:], end_id)
                held.append((doc_ids[at : at + n], known[at : at + n], np.diff(of) + 1, ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)))
                count += len(ids)
                if count >= file_tokens:
                    yield close()
        if held:
            yield close()

    by = [F.asc_nulls_first("doc_id"), F.crc32(F.coalesce("text", F.lit("")))]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(_parts(spark), *by).sortWithinPartitions(*by)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before it), n_tokens, tokens (little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, at = _at(path)
                with where.open_input_stream(at) as f:
                    file = TokenFile.loads(f.read())
                tokens, starts = file.tokens().astype("<u4"), file.starts.astype(np.int64)
                own = tokens
                for k in range(0, len(file.doc_ids), 2000):
                    s = starts[k : k + 2001]
                    own = tokens[s[0] : s[-1]]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.doc_ids[k : k + 2000], pa.int64(), mask=file.known[k : k + 2000] == 0),
                        "start": pa.array(before + s[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(s), pa.int64()),
                        "tokens": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s) - 1, [None, pa.py_buffer((s - s[0]) * 4), pa.py_buffer(own.tobytes())]).cast(pa.binary()),
                    })
                del file, tokens, starts, own
                release()

    # One row per file, so the running sum is over as many rows as there are files, not documents.
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).cast("long").alias("before"))
    return placed.repartition(_parts(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, tokens binary")


def token_digest(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    back = read_tokens(write_tokens(docs, path, vocab or vocabulary()))
    return back.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract of op9: the digest of every document's ids, from the files."""
    return token_digest(table(spark, sf_dir, "documents"))
