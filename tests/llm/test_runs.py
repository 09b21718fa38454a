from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from conftest import DATA
from tidemark.llm import runs
from tidemark.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least=12):
    """Every period tried at every place."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            root = words[i : i + q]
            if j - i + q >= max(least, 2 * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    return mix(np.array(words, np.uint64) + np.uint64(5))


def found(words, least=12):
    return list(zip(*(x.tolist() for x in runs.runs(numbered(words), least)), strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_every_period_and_place(seed):
    rng = random.Random(seed)
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 4, 8])
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            i, root = rng.randint(0, len(words)), [rng.randrange(letters) for _ in range(rng.randint(1, 8))]
            words[i:i] = root * rng.randint(2, 5)
        assert found(words, 2) == plain(words, 2) and found(words) == plain(words)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_words_with_many_squares():
    for words in (fibonacci(400), [bin(i).count("1") % 2 for i in range(512)], [i & -i for i in range(1, 300)], [0] * 300, [0] * 100 + [1] + [0] * 100):
        assert found(words, 2) == plain(words, 2)


def test_time_in_proportion_and_pieces(monkeypatch):
    took = []
    for n in (40_000, 160_000):
        began = time.process_time()
        assert found([i % (n // 6) for i in range(n)]) == [(0, n, n // 6)]
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]
    monkeypatch.setattr(runs, "STEP", 7)
    assert found(fibonacci(200), 2) == plain(fibonacci(200), 2)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    got = plain(words)
    gone = set()
    for i, length, q in got:
        gone.update(range(i + q, i + length))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(got, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (len(got), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{i},{m},{q}\n" for i, m, q in got)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(runs, "table", lambda *_: docs)
    return {(r.doc_id, r.n_words): tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in runs.op12_runs(spark, "").collect()}


def test_the_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("length(text) < 8000")
    got = query(spark, docs, monkeypatch)
    assert got == {(r.doc_id, len(WORD.findall(r.text))): expected(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[0] > 0 for r in got.values()) > 10


def test_odd_texts(spark, monkeypatch):
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one"), (-5, "ü " * 40), (-6, "a b c " * 3), (-7, "a b c " * 4 + "d"), (-8, "\x0b".join(["é x"] * 30)), (None, "p q r s t u v w"), (-9, "la " * 30 + "x y z " * 9 + "la " * 14)]
    rows += [(i, t) for i, t in zip(tenth, [None, "", "one", "two words", "a b c d e f g h i j k l m n o p q r s t u v w x y z", *[" ".join(f"w{k}" for k in range(n)) for n in range(10, 30)]], strict=False)]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, runs int, start string")
    assert query(spark, docs.repartition(3), monkeypatch) == {(i, len(WORD.findall(t or ""))): expected(i, t) for i, t in rows}
    assert query(spark, docs.limit(0), monkeypatch) == {}
    x = runs.periodic_runs(docs.where("doc_id = -6").union(docs.where("doc_id = -6")), 6).collect()
    assert len(x) == 2 and x[0].collapsed == "a b c" and [tuple(r) for r in x[0].runs] == [(0, 9, 3)]
