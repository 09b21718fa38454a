from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from conftest import DATA, rows_of
from tidemark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, block string, kind int"
SPACES = " \t\n\x0b\f\r"


def test_repair_equals_sql(spark, duck):
    assert rows_of(conversations.op13_conversations(spark, f"{DATA}/sf0.001").toPandas()) == rows_of(duck.sql(conversations.oracle()).to_df())


def cheapest(rows):
    """All edits of a short conversation, tried one by one: cost, audit, repaired lines."""
    best = (0, "", []) if not rows else None
    seen, kinds = set(), []
    for role, text in rows:
        end = text.rstrip(SPACES)
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "none")
        seen.add((role, text))
    gaps = [[()], *[[(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]] * (len(rows) + 1)][1:]
    for inserted in itertools.product(*gaps):
        for edits in itertools.product(("D", "K", "user", "assistant"), repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for role in inserted[k]:
                    cost, audit = cost + 3, audit + "I"
                    lines.append((role, ""))
                if k < len(rows):
                    (role, text), e = rows[k], edits[k]
                    if e == "D":
                        cost, audit = cost + 4, audit + "D"
                        continue
                    if kinds[k] in ("blank", "duplicate"):
                        break
                    cost, audit = cost + 3 * (e != "K") + 3 * (kinds[k] == "truncated"), audit + ("K" if e == "K" else "R")
                    lines.append((role if e == "K" else e, text))
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best, kinds


def plain(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(((t, r or " " if r != "" else "", " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    (cost, audit, lines), kinds = cheapest([(r, t) for _, r, t in rows])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


@pytest.mark.parametrize("block", [1, 2, 256])
def test_edits_are_the_cheapest_of_all(spark, block, monkeypatch):
    """Blocks of any length give the same: chained folds are one fold."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(3)
    rows = [(None, None, "user", "a."), (None, 4, "assistant", "b."), (1, None, None, None), (2, 1, "user", "x."), (2, 1, "user", "x."), (3, -5, "", "y."), (3, 7, "tool", "ü" * 2000)]
    for conv in range(10, 40):
        rows += [(conv, rng.choice([None, k, k, k + 3]), rng.choice(["system", "user", "user", "assistant", "other"]), rng.choice(["a.", "b!", "no end", " \t\n", "a.", "c? \n"])) for k in range(rng.randint(1, 4))]
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)).collect()}
    groups = {}
    for c, *r in rows:
        groups.setdefault(c, []).append(r)
    assert got == {c: plain(r) for c, r in groups.items()}


def test_damage_and_what_nothing_is_left_of(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t, r, x in ((0, "system", "Be brief. "), (1, "user", "what?!"), (None, None, None))]
    got = sorted(map(str, conversations.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()))
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            want += [(c, t, "user" if fate == 4 else r, "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x)] * (1 + (fate == 3))
    assert got == sorted(str(spark.createDataFrame([w], "conv_id long, turn long, role string, text string").first()) for w in want)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    raw = spark.createDataFrame([(gone, 0, "user", "x.", "x", 1)], SCHEMA)
    assert list(conversations.repair(conversations.damaged(raw), raw).first()) == [gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()]
    assert conversations.repair(raw.limit(0)).count() == 0


def test_a_long_conversation(spark):
    """One conversation of many blocks equals the SQL's fold of it in one piece."""
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b.", "c!", "open", ""]) if k % 3 else f"turn {k}.") for k in range(3000)]
    raw = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.register("conversations", raw.toPandas())
    assert rows_of(conversations.repair(conversations.damaged(raw), raw).toPandas()) == rows_of(c.sql(conversations.oracle()).to_df())
