"""Token counts by section: documents are encoded whole, once, and tokens fall to sections by their offsets.

A token's span of characters comes from the byte length of its id; spans and sections, both in order, are
joined as intervals. A token that crosses a boundary goes whole to one section, by ``rule``: "start", the
section of its first byte; "end", of its last byte; "most", the one with most of its bytes, the earlier on a tie.
So the counts of a document's sections add up to its tokens.

Sections are the lines of a text, each with the newline that ends it (so they cover the text), or what
``sections`` returns, or the columns of a row (``tokens_by_field``). Nulls: a null text is empty and has the one section 0 with no token; doc_id may be null.
Repeated rows each give their sections. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts
from .encode import encoder, vocabulary

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sections begin, as bytes of the piece, and of which text: at each text, and behind each newline but a text's last byte."""
    behind = np.setdiff1d(np.flatnonzero(data == 10) + 1, offs)
    cut = np.concatenate([offs[:-1], behind])
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, behind, "right") - 1])
    order = np.lexsort((row, cut))
    return cut[order], row[order]


def tokens_by_section(docs: DataFrame, vocab: str, rule: str = "start", sections: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = lines) -> DataFrame:
    """A row per section: its characters [start, end), its tokens, and how many of those cross one of its boundaries."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _attributed(rows, vocab, rule, lambda data, offs, _: sections(data, offs))


def tokens_by_field(docs: DataFrame, fields: list[str], vocab: str, rule: str = "start", joint: str = "\n") -> DataFrame:
    """The same with a section per column in ``fields``: the document is their texts in order, each but the last with ``joint``
    behind it, and is encoded whole. A null field is empty: a section of its joint alone. The section is the field's number."""
    texts_ = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if k == len(fields) - 1 else F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(joint)) for k, c in enumerate(fields)]
    sizes = [F.octet_length(t) for t in texts_]
    starts = F.array(*(sum(sizes[:k], F.lit(0)).cast("long") for k in range(len(fields))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*texts_).alias("text"), starts.alias("starts"))

    def sections(data: np.ndarray, offs: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = batch.column(2).flatten().to_numpy()
        row = np.repeat(np.arange(len(offs) - 1), len(fields))
        return own + offs[row], row

    return _attributed(rows, vocab, rule, sections)


def _attributed(rows: DataFrame, vocab: str, rule: str, sections: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    if rule not in ("start", "end", "most"):
        raise ValueError(f"no such rule: {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            doc_ids = batch.column(0)
            for at, n, data, offs in texts(batch):
                ids, of = enc.encode(data, offs)
                size = enc.n_bytes[ids]
                end = np.cumsum(size)
                begin = end - size
                cut, row = sections(data, offs, batch.slice(at, n))
                first = np.searchsorted(row, np.arange(n))
                a, b = np.searchsorted(cut, begin, "right") - 1, np.searchsorted(cut, end - 1, "right") - 1
                to = {"start": a, "end": b}.get(rule)
                if to is None:
                    to = _most(cut, begin, end, a, b)
                count = np.bincount(to, minlength=len(cut))
                crossing = np.bincount(to[a != b], minlength=len(cut))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offs[row]]
                stop = np.append(cut[1:], len(data))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc_ids.slice(at, n).take(pa.array(row)),
                    "section": pa.array(np.arange(len(cut)) - first[row], pa.int32()),
                    "start": pa.array(chars[cut] - base, pa.int64()),
                    "end": pa.array(chars[stop] - base, pa.int64()),
                    "n_tokens": pa.array(count, pa.int64()),
                    "n_crossing": pa.array(crossing, pa.int64()),
                })

    return rows.mapInArrow(run, SCHEMA)


def _most(cut: np.ndarray, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    to = a.copy()
    for i in np.flatnonzero(a != b):  # few
        edges = np.concatenate([[begin[i]], cut[a[i] + 1 : b[i] + 1], [end[i]]])
        to[i] = a[i] + int(np.argmax(np.diff(edges)))
    return to


def op10_section_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by the line of each token's first byte."""
    return tokens_by_section(table(spark, sf_dir, "documents"), vocabulary(), "start")
