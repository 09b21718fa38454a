from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashes
from tidemark.operators.series import fnv1a
from tidemark.sources import versioned

ROW = "run string, k long, v string"


def mulberry(seed, n):
    """The generator as a loop over its state."""
    out = []
    for _ in range(n):
        seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
        t = (seed ^ seed >> 15) * (seed | 1) & 0xFFFFFFFF
        t = (t + (t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) ^ t
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_hashes_as_columns(spark):
    texts = ["", "a", "SYM|2024-01-05", "é", "x" * 300]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").orderBy("i").select(hashes.fnv1a(F.col("t")), hashes.unit(F.col("t"))).collect()
    assert [r[0] for r in got] == [*map(fnv1a, texts), None] and got[1][1] == fnv1a("a") / 2**32
    for seed in (0, 7, 12345, 2**32 - 1):
        assert [r[0] for r in spark.range(20).orderBy("id").select(hashes.mulberry32(F.lit(seed), F.col("id"))).collect()] == mulberry(seed, 20)


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "store")
    table = lambda run, ks: spark.createDataFrame([(k, f"{run}{k}") for k in ks], "k long, v string")
    read = lambda name, run=None: sorted((r.run, r.k) for r in versioned.committed(spark, root, name, "k long, v string", run).collect())
    assert read("signals") == []
    versioned.commit_run({"runs": table("a", [1]), "signals": table("a", [1, 2]), "rejections": table("a", [])}, root, "a")
    broken = table("b", [9]).withColumn("v", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):  # the second table of the run fails: its first is written, its manifest is not
        versioned.commit_run({"runs": table("b", [5]), "signals": broken}, root, "b")
    assert read("runs") == [("a", 1)] and read("signals") == [("a", 1), ("a", 2)] and read("rejections") == []
    versioned.commit_run({"runs": table("b", [6]), "signals": table("b", [7])}, root, "b")
    versioned.commit_run({"runs": table("a", [3]), "signals": table("a", [4])}, root, "a")  # once more: the last version counts
    assert read("runs") == [("a", 3), ("b", 6)] and read("signals") == [("a", 4), ("b", 7)] and read("signals", "b") == [("b", 7)]


def test_upserts_in_any_order_give_one_table(spark, tmp_path):
    rng = random.Random(3)
    loads = [[(rng.randint(1, 8), rng.choice(["x", "y"]), at, rng.randint(0, 99)) for _ in range(12)] for at in (1, 1, 2, 3)]
    want = {}
    for k, p, at, v in itertools.chain(*loads):
        want[k, p] = max(want.get((k, p), (at, v)), (at, v))
    schema = "k long, p string, at long, v long"
    for n, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2, 2, 3])):
        store = str(tmp_path / str(n))
        for i in order:
            versioned.upsert(store, spark.createDataFrame(loads[i], schema), ["k", "p"], ["at"], "p")
        assert {(r.k, r.p): (r.at, r.v) for r in spark.read.schema(schema).parquet(store).collect()} == want


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    store, schema = tmp_path / "s", "k long, p string, at long"
    versioned.upsert(str(store), spark.createDataFrame([(1, "x", 1), (2, "y", 1)], schema), ["k", "p"], ["at"], "p")
    before = {f.name for f in (store / "p=x").iterdir()}
    versioned.upsert(str(store), spark.createDataFrame([(3, "y", 2)], schema), ["k", "p"], ["at"], "p")
    assert {f.name for f in (store / "p=x").iterdir()} == before
    assert sorted(r.k for r in spark.read.schema(schema).parquet(str(store)).collect()) == [1, 2, 3]
