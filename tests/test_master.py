from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import master as M

D = dt.date


def test_option_band(spark):
    near, far, gone = D(2024, 1, 4), D(2024, 1, 11), D(2024, 1, 2)
    c = [("N", near, 100.0 + 50 * k, s) for k in range(6) for s in ("CE", "PE")] + [("N", far, 175.0, "CE"), ("N", gone, 160.0, "PE"), ("B", near, 10.0, "CE"), ("B", near, 10.0, "PE"), ("S", gone, 5.0, "CE"), ("Q", near, 1.0, "CE"), ("Q", near, 2.0, "CE")]
    contracts = spark.createDataFrame(c, "name string, expiry date, strike double, side string")
    spots = spark.createDataFrame([("N", 225.0), ("B", 10.0), ("S", 5.0), ("Q", None)], "name string, ltp double")
    got = sorted((r.name, r.strike, r.side, r.step, r.atm) for r in M.option_band(contracts, spots, F.lit(D(2024, 1, 4)), 1).collect())
    assert got == [("N", k, s, 50.0, 250.0) for k in (200.0, 250.0, 300.0) for s in ("CE", "PE")]
    assert M.option_band(contracts.limit(0), spots, F.lit(near), 1).count() == 0


def test_first_part_wins(spark):
    schema = "k int, t int, v string"
    a = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (None, 1, "n")], schema)
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 2), (None, 2, 2)], "v string, k int, t int")
    got = {(r.k, r.t, r.v) for r in M.first_wins([a, b, a.limit(0)], ["k"], ["t"]).collect()}
    assert got == {(1, 4, "b"), (2, 2, None), (None, 1, "n")}
    assert M.first_wins([a.limit(0)], ["k"], ["t"]).count() == 0


def test_stamp_changes_with_contents_only(spark):
    rows = [("b", 'say "x"'), ("b", "é"), ("a", "z"), ("b", "é"), (None, "q"), ("c", None)]
    stamp = lambda r: M.dictionary_stamp(spark.createDataFrame(r, "name string, alias string"), "name", "alias", "av").collect()[0].stamp
    want = json.dumps([["a", ["z"]], ["b", ['say "x"', "é"]]], separators=(",", ":"), ensure_ascii=False)
    assert stamp(rows) == stamp(rows[::-1] + rows) == "av-" + hashlib.sha256(want.encode()).hexdigest()[:12]
    assert stamp(rows + [("a", "y")]) != stamp(rows) and stamp([]) == "av-" + hashlib.sha256(b"[]").hexdigest()[:12]
