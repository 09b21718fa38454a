from __future__ import annotations

import zlib

import numpy as np
import pytest

from conftest import DATA
from tidemark.llm import attribution, encode, tokenfile
from tidemark.llm.common import texts

ODD = ["a \n\nb it's  x", "", "  lead  two \n\n tab\t\tz ", "don't.'s it's,'ll", "é, ü!! «q» — ,. x1,y2 3.5", "<|endoftext|> a", "　x   y", "a|b ### $$$5 'a '", "日本語 テキスト。 ok", "\x1c\x1d a", "x\x85\n\n y", "a...b ,,c . d", "w" * 5000]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.vocabulary())
    return lambda s: t.encode(s or "", add_special_tokens=False)


def test_encoder_equals_library(lib):
    import duckdb
    import pyarrow as pa

    more = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/sf0.001/documents.parquet'").fetchall()]
    e = encode.Encoder(encode.vocabulary())
    for _ in range(2):  # the second time from what it keeps
        for s in (ODD, ODD * 3 + more):
            for at, n, data, offs in texts(pa.record_batch({"text": s}), most=20_000):
                ids, of = e.encode(data, offs)
                for i in range(n):
                    assert ids[of[i] : of[i + 1]].tolist() == lib(s[at + i]).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_file_round_trip_and_access(n):
    rng = np.random.default_rng(n)
    tokens = rng.choice([0, 5, 255, 256, 50_000, 65_535, 65_536, 2**24 - 1, 2**32 - 1], n).astype(np.uint32)
    starts = np.array([0, n // 3, n // 3, n])
    f = tokenfile.TokenFile.loads(tokenfile.TokenFile.of(np.array([7, 8, 0]), np.array([1, 1, 0]), starts, tokens).dumps())
    assert f.tokens().tolist() == tokens.tolist() and f.starts.tolist() == starts.tolist() and f.known.tolist() == [1, 1, 0]
    assert [f.token(i) for i in range(n)] == tokens.tolist()
    raw, took = tokenfile.TokenFile.of(np.array([7, 8, 0]), np.array([1, 1, 0]), starts, tokens).dumps(), []
    stored = tokenfile.StoredFile(lambda at, k: (took.append(k), raw[at : at + k])[1])
    assert [stored.token(i) for i in range(n)] == tokens.tolist() and max(took) <= 64 and [stored.document(k) for k in range(3)] == list(zip(starts.tolist(), starts[1:].tolist(), strict=False))


def plain(rows, lib):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = [*lib(t).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digest(spark, lib):
    got = tokenfile.op9_token_files(spark, f"{DATA}/sf0.001").orderBy("start").collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in got] == plain(rows, lib)


def test_digest_of_nulls_repeats_and_nothing(spark, lib):
    rows = [(3, "b c"), (None, None), (1, ""), (3, "b c"), (3, "a"), (None, "x" * 300_000)]
    df = spark.createDataFrame([(t, i, 1, "z") for i, t in rows], "text string, doc_id long, start int, tokens string")
    assert [tuple(r) for r in tokenfile.token_digest(df).orderBy("start").collect()] == plain(rows, lib)
    assert tokenfile.token_digest(df.limit(0)).count() == 0


def test_small_files_make_the_same_rows(spark, lib):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(60)
    from tidemark.llm.common import new_path

    m = tokenfile.write_tokens(df, new_path(spark, "t"), encode.vocabulary(), file_tokens=500)
    assert m.count() > 10
    row = m.orderBy("part", "seq").first()
    stored = tokenfile.open_file(row.path)
    first = tokenfile.read_tokens(m.where(m.path == row.path)).orderBy("start").first()
    assert [stored.token(i) for i in range(*stored.document(0))] == np.frombuffer(first.tokens, "<u4").tolist()
    back = tokenfile.read_tokens(m).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.tokens)) for r in back] == plain([tuple(r) for r in df.select("doc_id", "text").collect()], lib)


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_sections(spark, lib, rule):
    rows = [(i, t) for i, t in enumerate(["", "\n", "a\n\n\nb c\n", "x\n\n\n\n\ny", "one", "l1\nl2 é\r\n\r\nl3", *ODD])] + [(None, None), (99, "p\nq"), (99, "p\nq")]
    got = {}
    for r in attribution.tokens_by_section(spark.createDataFrame(rows, "doc_id long, text string"), encode.vocabulary(), rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    for i, t in rows[:-2]:
        t = t or ""
        starts = [0, *(k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t))]
        own = sorted(got[i])
        assert [x[:3] for x in own] == [(k, s, e) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(t)], strict=True))]
        e = lib(t)
        assert sum(x[3] for x in own) == len(e.ids)
        if rule == "start" and t.isascii():
            want = [0] * len(starts)
            for a, _ in e.offsets:
                want[max(k for k, s in enumerate(starts) if s <= a)] += 1
            assert [x[3] for x in own] == want
    assert sorted(got[99]) == [(0, 0, 2, 2), (0, 0, 2, 2), (1, 2, 3, 1), (1, 2, 3, 1)]


def test_a_crossing_token_follows_the_rule(spark):
    def cut(data, offs):
        return np.array([0, 3]), np.array([0, 0])

    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    by = {rule: [(r.n_tokens, r.n_crossing) for r in attribution.tokens_by_section(df, encode.vocabulary(), rule, cut).orderBy("section").collect()] for rule in ("start", "end", "most")}
    assert by == {"start": [(1, 1), (1, 0)], "end": [(0, 0), (2, 1)], "most": [(1, 1), (1, 0)]}


def test_fields(spark, lib):
    """Tokens of columns that are one document; empty and null fields, clashing names, repeats."""
    rows = [(1, "Title here", "the body\nof it", 5), (2, None, "x", None), (3, "", "", 0), (3, "", "", 0), (None, "é ü", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, section string, start int")
    got = {}
    for r in attribution.tokens_by_field(df, ["text", "section", "start"], encode.vocabulary()).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    for i, *fields in rows:
        parts = [("" if x is None else str(x)) + ("\n" if k < 2 else "") for k, x in enumerate(fields)]
        ends = np.cumsum([len(p) for p in parts]).tolist()
        own = sorted(set(got[i]))
        assert [x[:3] for x in own] == [(k, e - len(p), e) for k, (p, e) in enumerate(zip(parts, ends, strict=True))]
        assert sum(x[3] for x in own) == len(lib("".join(parts)).ids)
    assert len(got[3]) == 6 and attribution.tokens_by_field(df.limit(0), ["text"], encode.vocabulary()).count() == 0


def test_a_very_long_text_in_every_operator(spark):
    """One text of 64 MB among short ones: each operator gives its rows for it."""
    from pyspark.sql import functions as F
    from tidemark.llm import decontamination, jaccard, line_rules, pii, quality_model, toxicity

    words = " ".join(f"w{k * 7919 % 30011}" for k in range(1500))
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(words + "\n"), (64 << 20) // len(words)).alias("text"))
    docs = long.union(spark.createDataFrame([(1, "a short one"), (2, words)], "doc_id long, text string"))
    n = (64 << 20) // len(words)
    model = np.zeros(quality_model.SAME + 1, np.float32), 0.5
    assert quality_model.score(docs, model).count() == 3
    machine = toxicity.fit([np.array([1, 2]), np.array([3])] * 20, np.array([1.0, 0.0] * 20))
    assert toxicity.score(docs, machine).count() == 3
    got = {r.doc_id: r for r in line_rules.judge(docs, (np.zeros(len(line_rules.FEATURES)), np.zeros((2, 2)))).collect()}
    assert got[0].n_words == 1500 * n and got[0].n_dup_lines == n - 1 and got[0].base_failed
    assert pii.find(docs, pii.fit([])).count() == 3
    found = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 0}  # the long one repeats the words of the third
    items = spark.createDataFrame([(5, " ".join(words.split()[100:120]))], "item_id long, text string")
    assert {(r.doc_id, r.matched) for r in decontamination.overlaps(docs, items).collect()} == {(0, 20), (2, 20)}
    ids = {r.doc_id: r.n_tokens for r in tokenfile.token_digest(docs).collect()}
    sections = {r.doc_id: r.n for r in attribution.tokens_by_section(docs, encode.vocabulary()).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert ids == {k: v + 1 for k, v in sections.items()} and ids[0] > 10_000_000
