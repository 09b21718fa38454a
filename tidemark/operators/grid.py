"""Scores against labels, a date at a time. A date's names are one group of a row each, with scores and labels side by side:
nothing is made long before it is summed, and what leaves a date is a row a subject, label and bucket."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def mid_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks of sorted values from 1, ties averaged."""
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    n = np.diff(np.append(at, len(v)))
    return np.repeat(at + (n + 1) / 2, n)


def residual(y: np.ndarray, a: np.ndarray, b: np.ndarray, sector: np.ndarray, least: int = 20) -> np.ndarray:
    """``cross.residuals`` of one date; what is missing is NaN."""
    out = np.full(len(y), np.nan)
    ok = ~(np.isnan(y) | np.isnan(a) | np.isnan(b))
    kinds, which = np.unique(sector[ok], return_inverse=True)
    if ok.sum() < max(least, len(kinds) + 3):
        return out
    size = np.bincount(which)
    y, a, b = (v[ok] - (np.bincount(which, v[ok]) / size)[which] for v in (y, a, b))
    aa, ab, bb, ay, by = ((p * q).sum() for p, q in ((a, a), (a, b), (b, b), (a, y), (b, y)))
    det = aa * bb - ab * ab
    if det > 1e-12:
        out[ok] = y - (ay * bb - by * ab) / det * a - (by * aa - ay * ab) / det * b
    return out


class Day:
    """One date: its columns as doubles (null: NaN), and rows in order of each score and then of ``tie``."""

    def __init__(self, t: pa.Table, scores: Sequence[str], ys: Mapping[tuple[str, int], str], tie: str, own: tuple[str, str, str] | None):
        self.t, names = t, t.column(tie).to_numpy()
        self.scores = {s: self.doubles(s) for s in scores}
        self.order = {s: np.lexsort((names, v)) for s, v in self.scores.items()}
        self.ys = {k: self.doubles(c) for k, c in ys.items() if c in t.column_names}
        if own:  # the label that is found on the spot, of each horizon's raw one
            a, b, sector = self.doubles(own[0]), self.doubles(own[1]), t.column(own[2]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            for (label, h), y in [(k, v) for k, v in self.ys.items() if k[0] == "raw"]:
                self.ys["residual", h] = np.floor(residual(y, a, b, sector) * 100 + 0.5) / 100
                self.ys[label, h] = np.floor(y * 10000 + 0.5) / 10000

    def doubles(self, c: str) -> np.ndarray:
        return self.t.column(c).cast(pa.float64()).to_numpy()

    def cells(self) -> Iterator[tuple[str, str, int, np.ndarray, np.ndarray]]:
        """subject, label, h, rows that have both in order of the score, the label's values."""
        for (label, h), y in self.ys.items():
            have = ~np.isnan(y)
            for s, v in self.scores.items():
                rows = self.order[s]
                yield s, label, h, rows[(have & ~np.isnan(v))[rows]], y

    def rank_sums(self, least: int) -> Iterator[tuple]:
        before: tuple = (None, None, None)
        for s, label, h, rows, y in self.cells():
            if len(rows) < least:
                continue
            same = np.zeros(len(y), bool)
            same[rows] = True
            if before[0] is not y or not np.array_equal(before[1], same):
                by_y = rows[np.argsort(y[rows], kind="stable")]
                ry = np.empty(len(y))
                ry[by_y] = mid_ranks(y[by_y])
                before = (y, same, ry)
            rx, ry = mid_ranks(self.scores[s][rows]), before[2][rows]
            yield s, label, h, len(rows), rx.sum(), ry.sum(), (rx * ry).sum(), (rx * rx).sum(), (ry * ry).sum()

    def buckets(self, least: int, weight: str, n: int = 10) -> Iterator[tuple]:
        w = np.exp(self.doubles(weight))
        for s, label, h, rows, y in self.cells():
            if len(rows) < least:
                continue
            at = np.arange(len(rows)) * n // len(rows)
            v, x = y[rows], w[rows]
            has = ~np.isnan(x)
            sums = (np.bincount(at, minlength=n), np.bincount(at, np.floor(v * 10000 + 0.5), n), np.bincount(at[has], (x * v)[has], n), np.bincount(at[has], x[has], n))
            yield from ((s, label, h, k, int(c), int(m), float(p), float(q)) for k, (c, m, p, q) in enumerate(zip(*sums, strict=True)) if c)


def _by_date(df: DataFrame, date: str, keep: Sequence[str], fields: str, rows) -> DataFrame:
    """date, ``keep`` (what all rows of a date share) and ``fields`` of what ``rows`` finds on each date."""
    cols = [f.split()[0] for f in fields.split(", ")]
    shared = [df.schema[c] for c in (date, *keep)]

    def run(t: pa.Table) -> pa.Table:
        out = list(zip(*rows(t), strict=True)) or [()] * len(cols)
        one = [pa.array([t.column(f.name)[0].as_py()] * len(out[0]), t.column(f.name).type) for f in shared]
        return pa.table([*one, *(pa.array(np.array(v) if not v or not isinstance(v[0], str) else v) for v in out)], [*(f.name for f in shared), *cols]).cast(pa.schema([*((f.name, t.column(f.name).type) for f in shared), *((c, _TYPES[f.split()[1]]) for c, f in zip(cols, fields.split(", "), strict=True))]))

    return df.groupBy(date).applyInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in shared), fields]))


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def rank_sums(df: DataFrame, scores: Sequence[str], ys: Mapping[tuple[str, int], str], date: str, tie: str, least: int, keep: Sequence[str] = (), own: tuple[str, str, str] | None = None) -> DataFrame:
    """date, keep, subject, label, h, n and the sums of tie-averaged ranks that ``cross.rank_correlation`` takes, of cells of ``least`` names and more. ys: column of each (label, h). own: columns of size, beta and sector, which give a residual label of each raw one."""
    return _by_date(df, date, keep, "subject string, label string, h int, n long, sx double, sy double, sxy double, sxx double, syy double", lambda t: Day(t, scores, ys, tie, own).rank_sums(least))


def bucket_sums(df: DataFrame, scores: Sequence[str], ys: Mapping[tuple[str, int], str], date: str, tie: str, least: int, weight: str, keep: Sequence[str] = (), own: tuple[str, str, str] | None = None) -> DataFrame:
    """date, keep, subject, label, h, decile, n, the labels' sum in ten-thousandths, weighed sum and weights (exp of ``weight``) of tenths by score."""
    return _by_date(df, date, keep, "subject string, label string, h int, decile long, n long, k long, wy double, w double", lambda t: Day(t, scores, ys, tie, own).buckets(least, weight))
