"""Recurrences along a series as a scan: any series is cut into blocks, and no task needs more of it than a block.

A step ``state' = A state + b`` is an affine map, and maps compose: a block of bars is folded once into its own map, the
maps are chained (blocks of blocks, then those of a series), and each block is folded again from the state before it.
Folds are built-in functions over a block's sorted rows; a series of ten million bars is 153 blocks of 256 blocks of
256 positions, in as many tasks as there are partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Positions of a block, and blocks of a block of blocks. Bars on one day in five make blocks of some fifty.
SIZE = 256

_VECTOR = "array<double>"


def _vector(values: Sequence[str]) -> str:
    return f"cast(array({', '.join(values)}) AS {_VECTOR})"


def _applied(m: str, v: str) -> str:
    """Map m (its images of the unit vectors and, last, of nothing) at v: the images weighed by v, and the shift."""
    return f"aggregate(sequence(0, size({v}) - 1), element_at({m}, -1), (z, k) -> zip_with(z, {m}[k], (p, q) -> p + q * {v}[k]))"


def _then(first: str, second: str) -> str:
    """The map of two after each other: directions go through the second's images alone, the shift through all of it."""
    shiftless = f"aggregate(sequence(0, size(v) - 1), transform(v, w -> 0D), (z, k) -> zip_with(z, {second}[k], (p, q) -> p + q * v[k]))"
    return f"transform({first}, (v, i) -> if(i = size({first}) - 1, {_applied(second, 'v')}, {shiftless}))"


def affine_scan(rows: DataFrame, key: str, order: str, position: Column, inputs: dict[str, str], step: Callable[[Callable[[int], str], bool], Sequence[str]], reach: Sequence[Sequence[int]], name: str = "state") -> DataFrame:
    """Adds n (a row's place in its series, from 1) and ``name`` (the state after the row, from zeros).

    ``position`` is a number that grows with ``order``, about one a row; a block is SIZE of them. ``inputs``: SQL of what a row adds, from
    x (the row's columns, n, and prev: the row before, null for the first). ``step(s, adds)`` gives the SQL of the new numbers from the
    old ones, s(i), and the row x with its inputs; without what the inputs add if ``adds`` is false. ``reach[j]`` lists the numbers that
    the j-th tells on, itself first. Rows with a null key or order are series and rows like others (nulls first); ties of order are
    in the order of their columns. Rows may come with their _block, dealt by key and _block.
    """
    cols = [order, *(c for c in rows.columns if c not in (key, order, "_block"))]
    quoted = [f"`{c}`" for c in cols]
    block = F.col("_block") if "_block" in rows.columns else F.floor(position / SIZE)
    cut = rows.select(key, block.alias("_block"), F.struct(*(F.col(c) for c in quoted)).alias("_x"))
    blocks = written(cut.groupBy(key, "_block").agg(F.array_sort(F.collect_list("_x")).alias("_rows")), "series-blocks")

    def beside(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
        """a with what b (_k, _b and more) has for its key and ``column``."""
        return a.join(b, [F.col(key).eqNullSafe(F.col("_k")), F.col(column).eqNullSafe(F.col("_b"))]).drop("_k", "_b")

    series = Window.partitionBy("_k").orderBy("_b")  # a row a block
    starts = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.size("_rows").alias("_n"), F.element_at("_rows", -1).alias("_last"))
    starts = starts.select("_k", "_b", (F.sum("_n").over(series) - F.col("_n")).alias("_n"), F.lag("_last").over(series).alias("_prev"))
    own = ", ".join(f"'{c}', x.{q}" for c, q in zip(cols, quoted, strict=True))
    both = ", ".join([f"'{c}', x.{q}" for c, q in zip(cols, quoted, strict=True)] + ["'n', x.n"] + [f"'_{k}', {v}" for k, v in inputs.items()])
    numbered = f"transform(_rows, (x, i) -> named_struct({own}, 'n', _n + i + 1, 'prev', if(i = 0, _prev, _rows[i - 1])))"
    placed = beside(blocks, starts, "_block").select(key, "_block", F.expr(f"transform({numbered}, x -> named_struct({both}))").alias("_rows"))

    state = len(reach)
    zeros = _vector(["0D"] * state)
    maps = []
    for own_dims in reach:
        here = {i: f"s[{k}]" for k, i in enumerate(own_dims)}
        new = step(lambda i, here=here: here.get(i, "0D"), False)
        fold = f"aggregate(_rows, {_vector(['1D'] + ['0D'] * (len(own_dims) - 1))}, (s, x) -> {_vector([new[i] for i in own_dims])})"
        maps.append(f"transform(array({fold}), v -> {_vector([f'v[{own_dims.index(i)}]' if i in own_dims else '0D' for i in range(state)])})[0]")
    maps.append(f"aggregate(_rows, {zeros}, (s, x) -> {_vector(step(lambda i: f's[{i}]', True))})")
    maps = placed.select(key, "_block", F.floor(F.col("_block") / SIZE).alias("_super"), F.expr(f"array({', '.join(maps)})").alias("_m"))
    supers = written(maps.groupBy(key, "_super").agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_maps")), "series-maps")
    whole = supers.select(F.col(key).alias("_k"), "_super", F.expr(f"aggregate(slice(_maps, 2, size(_maps)), _maps[0]._m, (m, x) -> {_then('m', 'x._m')})").alias("_m"))

    chain = f"named_struct('v', {_applied('x._m', 'a.v')}, 'out', concat(a.out, array(named_struct('_b', x._b, '_v', a.v))))"
    begun = lambda items, first: F.inline(F.expr(f"aggregate({items}, named_struct('v', {first}, 'out', cast(array() AS array<struct<_b: bigint, _v: {_VECTOR}>>)), (a, x) -> {chain}, a -> a.out)"))
    tops = whole.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(F.col("_super").alias("_b"), "_m"))).alias("_s")).select("_k", begun("_s", zeros))
    inner = beside(supers, tops, "_super").select(F.col(key).alias("_k"), begun("transform(_maps, x -> named_struct('_b', x._block, '_m', x._m))", "_v"))
    joined = beside(placed, inner, "_block")
    step_out = f"transform(array({_vector(step(lambda i: f'a.v[{i}]', True))}), v -> named_struct('v', v, 'out', concat(a.out, array(v))))[0]"
    states = F.expr(f"aggregate(_rows, named_struct('v', _v, 'out', cast(array() AS array<{_VECTOR}>)), (a, x) -> {step_out}, a -> a.out)")
    done = joined.select(key, F.inline(F.arrays_zip(F.col("_rows").alias("r"), states.alias("v"))))
    return done.select(key, *(F.col("r")[c].alias(c) for c in cols), F.col("r.n").alias("n"), F.col("v").alias(name))
