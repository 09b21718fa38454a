from __future__ import annotations

import bisect
import collections
import hashlib
import zlib

import pytest

from conftest import DATA, rows_of
from tidemark.llm import sharding

SMALL = f"{DATA}/sf0.001"


def test_ring_equals_sql(spark, duck):
    assert rows_of(sharding.op11_sharding(spark, SMALL).toPandas()) == rows_of(duck.sql(sharding.oracle()).to_df())


def hashed(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain(rows, shards, nodes, slack, seed="ring-1"):
    """The walk a row at a time: what a shard is offered in a round it takes in ring order while there is room."""
    points = sorted((hashed(seed, s, n) >> 44, s, n) for s in range(shards) for n in range(nodes))
    room = [-int(-(1 + slack) * len(rows) // shards)] * shards if slack else [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    waiting = []
    for d, t in rows:
        t = (t or "").encode()
        key = hashed(seed, "null" if d is None else d, len(t) + 16, zlib.crc32(t))
        arc = bisect.bisect_left(points, (key >> 44, -1, -1))
        wrapped = arc == len(points)
        waiting.append((arc % len(points), not wrapped, key, str(d), len(t) + 16, zlib.crc32(t), d))
    waiting.sort(key=lambda w: w[:3] + (w[6] is not None, w[6] or 0) + w[4:6])
    order = [s for _, s, _ in points]
    taken = collections.Counter()
    for hop in range(shards):
        left = []
        for w in waiting:
            shard = list(dict.fromkeys(order[w[0]:] + order[: w[0]]))[hop]
            if room[shard]:
                room[shard] -= 1
                taken[w[6], w[4], w[5], shard, order[w[0]], hop] += 1
            else:
                left.append(w)
        waiting = left
    assert not waiting
    return taken


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (None, None), (4, "ü" * 1000), (5, "a")] + [(7, "same text")] * 40 + [(i, f"text {i % 5}") for i in range(10, 60)]


@pytest.mark.parametrize("shards, nodes, slack", [(7, 3, 0.0), (7, 3, 0.5), (3, 1, 0.0), (1, 4, 0.0), (90, 2, 0.0)])
def test_rows_walk_as_the_plain_ring_says(spark, shards, nodes, slack, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 3)  # repeated rows go out in several pieces
    got = sharding.place(spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "0 AS size", "1 AS shard", "2 AS key"), shards, nodes, slack).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.home, r.hops) for r in got) == plain(ODD, shards, nodes, slack)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) <= -int(-(1 + slack) * len(ODD) // shards) and (slack or max(counts) - min(counts) <= 1)


def test_empty_table(spark):
    assert sharding.place(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    for slack, most in ((0.0, 0.12), (0.5, 0.05)):  # a 41st shard needs 0.024 of all rows; by a remainder 0.976 would move
        a, b = (sharding.place(docs, n, slack=slack).toPandas().set_index("doc_id").shard for n in (40, 41))
        assert (a != b.reindex(a.index)).mean() < most
