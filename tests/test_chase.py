from __future__ import annotations

import collections
import datetime as dt
import json
import os

from tidemark.streaming import chase

EVENT = "order_id long, ts timestamp, seq long, status string, instrument string, kind string, price double, chase boolean"
START = dt.datetime(2024, 1, 1, 10)


def replay(spark, folder, ticks, calls, **how):
    """Each tick's events in a batch of their own, six seconds apart, with an event of an ended order that moves the clock."""
    (folder / "in").mkdir(parents=True)
    for k, own in enumerate(ticks):
        at = (START + dt.timedelta(seconds=6 * k)).isoformat()
        path = folder / "in" / f"{k:03}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("order_id", "seq", "status", "instrument", "kind", "price", "chase"), e, strict=True), ts=at)) for e in [*own, (0, k, "CANCELLED", "", "", None, False)]))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))

    def quote(instrument, price):
        if instrument == "broken":
            raise ValueError("no book")
        return {"rising": min((price or 0) + 1, 103.0), "flat": 50.0}[instrument]

    def modify(order, price, key):
        with open(calls, "a") as f:
            f.write(f"{key} {price}\n")

    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    got = []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = chase.chased_orders(events, quote, modify, event_time=True, **how)
        q = out.writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).outputMode("update").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_order = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r[0], r[1])):
        by_order[r[0]].append(r[2:])
    return by_order


def test_attempts_failures_and_ends(spark, tmp_path):
    first = [
        (1, 1, "OPEN", "rising", "LIMIT", 100.0, True), (2, 1, "OPEN", "broken", "LIMIT", 100.0, True), (3, 1, "OPEN", "rising", "LIMIT", 1.0, True),
        (4, 1, "OPEN", "rising", "LIMIT", 1.0, False), (5, 1, "PARTIAL", "flat", "MARKET", 50.0, True), (6, 1, "PENDING", "flat", "LIMIT", 50.0, True),
    ]
    ticks = [first, [(1, 1, "CANCELLED", "rising", "LIMIT", 9.0, True)], [], [], [(3, 2, "COMPLETED", "rising", "LIMIT", 1.0, True)], *[[] for _ in range(26)]]
    got = replay(spark, tmp_path, ticks, tmp_path / "calls")
    actions = {k: [x[0] for x in v] for k, v in got.items()}
    assert set(actions) == {1, 2, 3, 5}  # 4 is not chased, 6 not open yet
    assert actions[1] == ["modified"] * 3 + ["unchanged"] * 22 and [x[1] for x in got[1]] == [101.0, 102.0] + [103.0] * 23
    assert got[1][-1] == ("unchanged", 103.0, 25, 0, "25 attempts exhausted") and got[1][-2][-1] is None
    assert got[2] == [("failed", 100.0, 0, k, "no book") for k in (1, 2, 3)]
    assert 1 <= len(actions[3]) <= 4 and set(actions[3]) == {"modified"}
    assert actions[5] == ["modified"] + ["unchanged"] * 24  # the price is the same, the kind of order is not
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    assert len(set(calls)) == len(calls) == 3 + len(actions[3]) + 1 and "1:1 101.0" in calls


def test_waits_while_closed_and_replays_alike(spark, tmp_path):
    opens = int((START + dt.timedelta(seconds=20)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    ticks = [[(1, 1, "OPEN", "rising", "LIMIT", 100.0, True)], *[[] for _ in range(8)]]
    runs = [replay(spark, tmp_path / str(k), ticks, tmp_path / f"calls{k}", allowed=lambda ms: ms >= opens, attempts=2) for k in (1, 2)]
    assert runs[0] == runs[1] == {1: [("modified", 101.0, 1, 0, None), ("modified", 102.0, 2, 0, "2 attempts exhausted")]}
    assert (tmp_path / "calls1").read_text() == (tmp_path / "calls2").read_text() == "1:1 101.0\n1:2 102.0\n"
