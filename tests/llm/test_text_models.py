from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from conftest import DATA
from tidemark.llm import line_rules, pii, quality_model, toxicity

HELD = f"{DATA}/sf0.1"
ODD = [(1, None), (None, ""), (2, "x"), (2, "x"), (3, "idiot " * 60_000), (4, "\n \n\t")]


def odd(spark):
    return spark.createDataFrame([(t, i, 0.5, 1) for i, t in ODD], "text string, doc_id long, score double, y int")


@pytest.mark.parametrize(("op", "label", "parts", "held", "least"), [(quality_model.op4_quality, "quality", 4, 2, 0.98), (toxicity.op8_toxicity, "toxic", 3, 1, 0.95)])
def test_held_out_accuracy(spark, op, label, parts, held, least):
    got = op(spark, HELD).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % parts == held for i in got.doc_id]).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    m = got[got.held_out].merge(spark.read.parquet(f"{HELD}/labels.parquet").toPandas(), on="doc_id")
    assert (m.predicted == m[label]).mean() >= least


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_odd_rows_and_labels(spark, module):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = module.score(docs, module.train(docs, lab)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert module.score(docs.limit(0), module.train(docs, labels)).count() == 0


def test_a_pair_of_terms_tells_more_than_each():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        docs.append(np.unique(np.concatenate([rng.integers(100, 160, 6), [1] * a, [2] * b])).astype(np.int64))
        y.append(float(a and b))
    m = toxicity.fit(docs, np.array(y), epochs=60)
    z = m.logits(np.array([0, 1, 2, 2]), np.searchsorted(m.names, [1, 2, 1, 2]), 3)
    assert z[0] < 0 and z[1] < 0 and z[2] > 0 and np.linalg.norm(m.v[np.searchsorted(m.names, 1)]) > 0.1


def test_terms_that_tell_only_by_their_meeting():
    """Label 1 where just one of two terms occurs: neither alone, nor both, has any trend."""
    rng = np.random.default_rng(1)
    docs = [np.unique(np.concatenate([rng.integers(100, 160, 6), [1] * (k % 2), [2] * (k // 2 % 2)])).astype(np.int64) for k in range(1200)]
    y = np.array([float(k % 2 != k // 2 % 2) for k in range(1200)])
    assert not len(np.intersect1d(toxicity.telling(docs[:1000], y[:1000])[0], [1, 2]))
    m = toxicity.fit(docs[:1000], y[:1000])
    own = [toxicity._numbers(m.names, d) for d in docs[1000:]]
    z = m.logits(np.repeat(np.arange(200), [len(x) for x in own]), np.concatenate(own), 200)
    assert ((z > 0) == y[1000:]).mean() > 0.98
    still = toxicity.fit(docs[:1000], rng.permutation(y[:1000]))  # labels without sense: no pair is taken for one that tells
    assert not len(np.intersect1d(still.names, [1, 2]))


def test_rare_terms_that_tell_only_by_their_meeting():
    """As above, with terms that 0.7 % of the documents have."""
    rng = np.random.default_rng(4)
    n = 6000
    docs, y = [], []
    for k in range(n):
        own = {0: [1], 1: [2], 2: [1, 2]}.get(k % 286, [])
        y.append(float(len(own) == 1) if own else float(rng.random() < 0.5))
        docs.append(np.unique(np.concatenate([rng.integers(100, 160, 6), own])).astype(np.int64))
    y = np.array(y)
    has = [sum(t in d for d in docs) / n for t in (1, 2)]
    assert max(has) < 0.008
    assert set(toxicity.interacting(docs, y, np.full(n, 0.5))) == {1, 2}
    m = toxicity.fit(docs, y)
    own = [toxicity._numbers(m.names, np.array(d)) for d in ([1], [2], [1, 2])]
    z = m.logits(np.repeat(np.arange(3), [len(x) for x in own]), np.concatenate(own), 3)
    assert z[0] > 0 and z[1] > 0 and z[2] < 0


def test_pairs_equal_all_pairs_one_by_one():
    """The bounds lose no pair: every pair of terms judged on its own documents."""
    import itertools

    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(0, 40, 8) ** 2 // 40) for _ in range(400)]
    y = np.array([float({3, 7} <= set(d) or {0, 12} <= set(d) or rng.random() < 0.05) for d in docs])
    p = rng.random(400) * 0.3
    q = np.clip(p, 1 - toxicity.SURE, toxicity.SURE)
    terms = sorted(set(np.concatenate(docs)))
    least, want = np.log(len(terms) ** 2 / 2 / toxicity.CHANCE), set()
    for a, b in itertools.combinations(terms, 2):
        own = np.array([a in d and b in d for d in docs])
        if own.any():
            k, w = y[own].mean(), q[own].mean()
            far = own.sum() * sum(u * np.log(u / v) for u, v in ((k, w), (1 - k, 1 - w)) if u > 0)
            want |= {a, b} if far >= least else set()
    for block in (4, 7, 512):
        assert set(toxicity.interacting(docs, y, p, block)) == want
    assert len(want) >= 4 and not len(toxicity.interacting([np.zeros(0, np.int64)] * 3, y[:3], p[:3]))


def test_logits_equal_the_sum_over_pairs():
    import itertools

    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(0.3, np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)))
    docs = [rng.choice(9, k, replace=False) for k in (0, 1, 2, 5, 9)]
    got = m.logits(np.repeat(np.arange(5), [len(d) for d in docs]), np.concatenate(docs), 5)
    assert got == pytest.approx([0.3 + sum(m.w[i] for i in d) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(d, 2)) for d in docs])


def test_quality_equals_vectors_averaged_and_softmax(spark):
    """Units cut out of the bytes one by one, their vectors averaged, the softmax of two labels."""
    from tidemark.llm.common import hash_of

    rng = np.random.default_rng(3)
    rows = [(1, "a b b 12 x9é\n\tb b"), (2, ""), (3, None), (4, "ab"), (5, "Zw " * 40), (6, "ñ 日本 1 2 3"), (7, "a"), (7, "a b")]
    known = [(np.unique(rng.integers(0, quality_model.SAME + 1, 40)), None) for _ in range(30)]
    e, out, bias = quality_model.learn([(p, np.ones(len(p))) for p, _ in known], rng.integers(0, 2, 30))

    def units(t):
        b = [48 if 48 <= c < 58 else 32 if c in b" \t\n\r\v\f" else c for c in (t or "").encode()]
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            yield ((x << 16 | y << 8 | z) * 0x9E3779B1 % 2**32) >> (32 - quality_model.BITS)
        before = None
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            yield (1 << quality_model.BITS) + (hash_of(w) >> (64 - quality_model.BITS))
            if w == before:
                yield quality_model.SAME
            before = w

    want = []
    for i, t in rows:
        own = list(units(t))
        z = out @ (np.mean([e[u] for u in own], axis=0) if own else np.zeros(quality_model.DIM)) + bias
        want.append((i, np.exp(z[1]) / np.exp(z).sum()))
    model = ((e @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))
    got = quality_model.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(i, pytest.approx(p, abs=1e-5)) for i, p in sorted(want)]


def test_samples_take_an_id_once(spark):
    from tidemark.llm.samples import labelled

    docs = spark.createDataFrame([(1, f"t{k % 3}", 0) for k in range(500)] + [(2, "b", 1), (3, "c", 1), (None, "d", 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (9, 1)], "doc_id long, quality int")
    got = labelled(docs, labels, "quality", 1, 1, 10).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(1, 1), (2, 0)]


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    g = list(zip(w, w[1:], w[2:], strict=False))
    n, pos = collections.Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            pos |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(pos), len(w) < 50 or 100 * len(pos) > 50 * len(w)


def test_base_counts(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    odd_rows = [(None, "a b c a b c\n\na b c a b c\n \n x|é"), (2000, "\n\n"), (2001, None), (2002, "# # #\n# # #\n# # # "), (2002, "q")]
    docs = docs.union(spark.createDataFrame(odd_rows, "doc_id long, text string"))
    model = line_rules.train(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    want = collections.Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    got = line_rules.judge(docs, model).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert line_rules.judge(docs.limit(0), model).count() == 0
    wide = docs.select("text", docs.doc_id.alias("n_words"), "doc_id", docs.text.alias("kept"))  # clashing names
    assert collections.Counter(map(tuple, line_rules.judge(wide, model).collect())) == collections.Counter(map(tuple, got))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_lines_part_clean_from_poor(spark, size):
    docs, labels = (spark.read.parquet(f"{DATA}/{size}/{x}.parquet") for x in ("documents", "labels"))
    got = line_rules.judge(docs, line_rules.train(docs, labels)).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.2


def test_viterbi_and_gradient_by_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    x, w, t = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(2, 2))
    s = x @ w
    value = lambda y: sum(s[i] for i in range(5) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))
    paths = list(itertools.product([0, 1], repeat=5))
    assert tuple(line_rules.viterbi(s, t).astype(int)) == max(paths, key=value)
    y = np.array([1, 0, 0, 1, 1])
    _, dw, dt = line_rules.Chains([x[:2], x, x[:1]], [0, 1, 0]).value(np.concatenate([y[:2], y, y[:1]]), w, t)
    assert line_rules.Chains([x], [1]).value(y, w, t)[0] == pytest.approx(value(y) - np.logaddexp.reduce([value(p) for p in paths]))
    like = lambda w, t: sum((x @ w)[i] for i in range(5) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)) - np.logaddexp.reduce([sum((x @ w)[i] for i in range(5) if p[i]) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
    for k in range(3):
        d = np.eye(3)[k] * 1e-6
        assert dw[k] == pytest.approx((like(w + d, t) - like(w - d, t)) / 2e-6, abs=1e-4)
    d = np.array([[0, 1e-6], [0, 0]])
    assert dt[0, 1] == pytest.approx((like(w, t + d) - like(w, t - d)) / 2e-6, abs=1e-4)


def test_a_chain_that_goes_on_is_given_its_first_label():
    """Two chains that share line 2: the second one explains lines 3 and 4 given the label of line 2; value by all paths, gradient by differences."""
    import itertools

    rng = np.random.default_rng(8)
    x, w, t, y = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(2, 2)), (1, 0, 1, 1, 0)

    def like(w, t):
        def score(p, a, b):
            return sum((x @ w)[i] for i in range(a, b) if p[i - a]) + sum(t[u, v] for u, v in zip(p, p[1:], strict=False))

        out = 0.0
        for a, b, given in ((0, 3, False), (2, 5, True)):
            paths = [p for p in itertools.product([0, 1], repeat=3) if not given or p[0] == y[a]]
            out += score(y[a:b], a, b) - np.logaddexp.reduce([score(p, a, b) for p in paths])
        return out

    chains = line_rules.Chains([x[:3], x[2:]], [1, 1], [False, True])
    v, dw, dt = chains.value(np.array([*y[:3], *y[2:]]), w, t)
    assert v == pytest.approx(like(w, t))
    for k in range(3):
        d = np.eye(3)[k] * 1e-6
        assert dw[k] == pytest.approx((like(w + d, t) - like(w - d, t)) / 2e-6, abs=1e-4)
    for a, b in itertools.product([0, 1], repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = 1e-6
        assert dt[a, b] == pytest.approx((like(w, t + d) - like(w, t - d)) / 2e-6, abs=1e-4)


def test_transitions_between_chains_are_learnt(monkeypatch):
    """Documents cut every 64 lines teach nearly the field that uncut ones do."""
    rng = np.random.default_rng(9)
    k = len(line_rules.FEATURES)
    docs = [(rng.random((rng.integers(1, 200), k)) < (0.3 + 0.3 * (i % 2))).astype(float) for i in range(60)]
    for d in docs:
        d[:, 0] = 1
    y, fields = np.arange(60) % 2, []
    for cut in (64, 10_000):
        monkeypatch.setattr(line_rules, "CHAIN", cut)
        fields.append(line_rules.fit(docs, y)[1])
    assert np.abs(fields[0] - fields[1]).max() < 0.2


def plain_spans(t):
    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(len(y := x.lstrip("0")) < 4 and int(y or 0) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return out


CASES = ["a.b@c.d.e, x@y", "1.2.3.4.5 300.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 and +12 345", "é a@b.c ü 10.0.0.1", "a@b.c@d.e", "a@b.c_@d.e a@b-.c. @x.y a@b a.b@c..d +@-.-", "0" * 5000 + ".1.1.1 1.2.3.256 1.2.3.0255", "1.2.3.4.5.6.7.8.9", "4111111111111111 4111111111111111 4111-1111-1111-1111-111", "+1 2 3 +12-34 (5) 67 89 ", "٣٣٣٣ 1٣.2.3.4", None, "", "9" * 20_000]


def test_base_spans(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(CASES)] + [(None, "a@b.cd")] * 2, "doc_id long, text string"))
    field = pii.fit(pii.train_counts(docs))
    want = collections.Counter((r.doc_id, hashlib.sha256(",".join(plain_spans(r.text)).encode()).hexdigest(), *(sum(s.startswith(k + ":") for s in plain_spans(r.text)) for k in pii.KINDS)) for r in docs.collect())
    got = pii.find(docs, field).collect()
    assert collections.Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(set(plain_spans(texts[r.doc_id])) <= set(r.spans.split(",")) for r in got if r.spans)
    wide = docs.select("text", docs.doc_id.alias("spans"), "doc_id", docs.text.alias("n_ip"))  # clashing names
    assert collections.Counter(map(tuple, pii.find(wide, field).collect())) == collections.Counter(map(tuple, got))
    assert pii.find(docs.limit(0), pii.fit(pii.train_counts(docs.limit(0)))).count() == 0


def test_a_number_in_full_pulls_its_short_form():
    from types import SimpleNamespace

    full, short = "+1 (017) 555-7713", "017 555 7713"
    base = pii.base_spans(full + " x " + short)
    t = pii.tokens(full + " x " + short, base)
    assert t.skip.tolist() == [[0, 1]] and list(t.label) == [4, 0] and list(t.cut) == [False, False]
    cells = [SimpleNamespace(features=x, label=y, before=-1, skip=0, n=n) for x, y, n in ((t.features[0], 4, 500), (t.features[1], 0, 12), (1, 0, 500))]
    field = pii.fit(cells)
    alone = pii.beliefs(pii.tokens(short, []), field)[0, 4]
    both = pii.beliefs(t, field)[1, 4]
    assert both > alone + 0.05


def test_messages_equal_enumeration_on_a_tree():
    import itertools

    rng = np.random.default_rng(3)
    f = pii.Field(rng.normal(size=(5, pii.N_FEATURES)), rng.normal(size=(5, 5)), rng.normal(size=5))
    t = pii.Tokens([0, 1, 2], [1, 2, 3], [3, 5, 9], [0, 0, 0], [False] * 3, [(0, 1)], [(1, 2)])
    x = ((np.array(t.features)[:, None] >> np.arange(pii.N_FEATURES)) & 1) @ f.w.T
    p = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        v = np.exp(sum(x[i, y[i]] for i in range(3)) + f.chain[y[0], y[1]] + (f.skip[y[1]] if y[1] == y[2] else 0))
        for i in range(3):
            p[i, y[i]] += v
    assert pii.beliefs(t, f, 200, 1e-12) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-6)


@pytest.mark.parametrize("unit", ["a", "0", "1.", "a@", "+1", "(", "a@b.c ", "+1 ", " 1", "a.", "1-", "w1 "])
def test_spans_take_time_in_proportion_to_the_text(unit):
    import time

    for text in (unit * (2_000_000 // len(unit)), "x@" + unit * (2_000_000 // len(unit)) + "@"):
        began = time.perf_counter()
        pii.tokens(text, pii.base_spans(text))
        assert time.perf_counter() - began < 20  # a quadratic pattern takes hours


def test_memory_of_a_text_full_of_numbers():
    """Six megabytes of different ten-digit numbers, each a token: a few hundred bytes a token at most, with interpreter and text."""
    import subprocess
    import sys

    code = """
import random, resource
from tidemark.llm import pii
rng = random.Random(1)
text = " ".join(str(rng.randrange(10**9, 10**10)) for _ in range(550_000))
pii.added_spans(text, pii.base_spans(text), pii.fit([]))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout) < 350


def test_messages_in_blocks_of_any_size(monkeypatch):
    text = " ".join(f"+1 (017) 555-{i % 40:04d} and 017 555 {i % 60:04d}, 10.0.0.{i % 9}" for i in range(120))
    rng = np.random.default_rng(4)
    f = pii.Field(rng.normal(size=(5, pii.N_FEATURES)), rng.normal(size=(5, 5)) / 4, rng.normal(size=5) / 4)
    t = pii.tokens(text, pii.base_spans(text)[::2])
    whole = pii.beliefs(t, f, 300, 1e-7)
    monkeypatch.setattr(pii, "BLOCK", 7)
    assert len(t.skip) > 100 and np.abs(pii.beliefs(t, f, 300, 1e-7) - whole).max() < 1e-4


def test_the_field_on_the_table(spark):
    """What it adds is right; and a number given in full is found again in a short form, by its skip link alone."""
    import random

    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")
    field = pii.fit(pii.train_counts(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = [(i, k, texts[i][s:e]) for i in texts for k, s, e in pii.added_spans(texts[i], pii.base_spans(texts[i]), field)]
    assert len(added) >= 2 and all(k == 2 and len(t) == 16 and pii.luhn(t) for _, k, t in added)  # cards side by side, which the pattern drops
    unlinked = pii.Field(field.w, field.chain, np.zeros(len(pii.LABELS)))
    rng, n, linked, alone, other = random.Random(1), 0, 0, 0, 0
    for t in texts.values():
        phones = [t[s:e] for k, s, e in pii.base_spans(t) if k == 3]
        if phones:
            short = re.sub("[()]", "", phones[0][3:])
            wrong = re.sub("[0-9]", lambda m: str(rng.randrange(10)), short)
            hit = lambda x, f: any(k == 3 and (t + " call " + x + " now")[s:e] == x for k, s, e in pii.added_spans(t + " call " + x + " now", pii.base_spans(t + " call " + x + " now"), f))  # noqa: B023, E731
            n, linked, alone, other = n + 1, linked + hit(short, field), alone + hit(short, unlinked), other + hit(wrong, field)
    assert n > 100 and linked >= 0.95 * n and alone == 0 and other == 0
