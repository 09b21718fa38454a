from __future__ import annotations

import collections
import html
import random
import re

import numpy as np
import pytest

from conftest import DATA, rows_of
from tidemark.llm import decontamination, jaccard, mixing, pages, tokenfile, toxicity
from tidemark.llm.components import components

SMALL = f"{DATA}/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- pages

def test_pages_of_the_table(spark):
    got = pages.op2_main_text(spark, f"{DATA}/sf0.01").toPandas()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    assert len(got) == len(raw)
    for r in got.itertuples():
        a = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split()) and r.n_chars == len(r.text)


PAGE = """<html><body><header><h1>Site</h1></header><nav>menu</nav><div id="main"><div class="post-12"><h2>T &amp; x</h2><p>One <b>bo</b>ld<p>Two&nbsp; <a href=x>link</a> text
goes on and on for a while here</div><div class="comments"><p>nice post really very nice comment with a lot of text in it yes yes yes</p></div></div><aside>side</aside><form>f</form><script>"<p>no"</script><footer>f</footer></body></html>"""


def test_odd_pages(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "http://a/y", ""), (4, "zz", "<p>loose &lt; text"), (5, "http://a/z", "<body><article>cut <b>off</b> here<p>and <i"), (1, "http://a/x", PAGE), (None, "http://b/", "<div" * 20_000)]
    got = pages.extract(spark.createDataFrame([(h, u, i, "t") for i, u, h in rows], "html string, url string, page_id long, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[1] == "T & x One bold Two link text goes on and on for a while here"
    assert [text[k] for k in (2, 3, 4, 5)] == ["", "", "loose < text", "cut off here and"]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_host_s_path_wins_over_a_page_s_own(spark):
    usual = '<body><div class="post-{i}"><p>' + "some words of the text " * 20 + '</div><div class="box"><p>short</div></body>'
    odd = '<body><div class="post-9"><p>a brief note</div><div class="box"><p>' + "long filler text of the box " * 30 + "</div></body>"
    rows = [(i, "http://h/", usual.format(i=i)) for i in range(5)] + [(9, "http://h/", odd)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "a brief note"


def test_votes_on_what_lies_inside(spark):
    """On a host a class whose text comes again is boilerplate whatever its name; one whose text differs is not, though its name may say so. One page's copies are one voter."""
    page = '<body><article><h1>same title</h1><div class="x9 box">read more of us</div><div class="alert">warning of day {i}</div><p>' + "text {i} and so on " * 20 + "</p></article></body>"
    rows = [(i, "http://h/", page.format(i=i)) for i in range(5)] + [(10 + i, "http://few/", page.format(i=7)) for i in range(6)] + [(20, "http://one/", page.format(i=8))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = lambda i: f"text {i} and so on " * 19 + f"text {i} and so on"
    assert [got[i] for i in range(5)] == [f"same title warning of day {i} {body(i)}" for i in range(5)]
    assert got[10] == got[15] == f"same title read more of us {body(7)}" and got[20] == f"same title read more of us {body(8)}"


def test_formulas_drawings_and_deep_pages(spark):
    deep = "<div>" * 3000
    rows = [
        (1, "<article><p>It is <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> here <svg><title>t</title><text>drawn</text></svg> and <object data=a>instead</object>.</p></article>"),
        (2, "<article>" + deep + "<p>low down</p><nav>menu <b>deep</b></nav><div class=ad><div>buy <p>this</div> now</div> end" + "</div>" * 3000 + "<p>after</p></article>"),
        (3, "<article>" + "<div><b>y</b>" * 20_000 + "</article>"),
        (4, "<article><p>" + "word " * 1_000_000 + "</p></article>"),
    ]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert got[1].text == "It is x+1 here drawn and instead."
    assert got[2].text == "low down end after" and got[3].text == " ".join(["y"] * 20_000) and got[4].n_chars == 4_999_999


def test_names_decide_nothing_for_good(spark):
    """Inside an article a block stays unless its whole name says what it is, votes and links can overrule that, and tags and roles are final."""
    body = "<p>" + "the text of page {i} goes on " * 12 + "</p>"
    one = "<article>" + body + '<div class="related-work">earlier work {i}</div><div class="search">we search {i}</div><div class="share">a share of {i}</div><section id="comments-on-policy">policy {i}</section><div class="share-links"><a href=x>tweet</a></div><div class="comments">nice {i}</div><div class="ad-slot">buy {i}</div></article>'
    many = '<body><div class="ad">' + body + "</div><nav>menu</nav></body>"
    rows = [(0, "http://one/", one.format(i=0))] + [(10 + i, "http://many/", one.format(i=i)) for i in range(6)] + [(20 + i, "http://ad/", many.format(i=i)) for i in range(6)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: " ".join([f"the text of page {i} goes on"] * 12)
    for page, i in [(0, 0)] + [(10 + i, i) for i in range(6)]:
        assert got[page] == f"{text(i)} earlier work {i} we search {i} a share of {i} policy {i}"


def test_votes_equal_a_plain_count(spark):
    """The winning paths, and what the votes drop and keep, counted page by page."""
    got = {r.host: (r.win, sorted(r["drop"] or []), sorted(r.keep or [])) for r in pages.winners(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")).collect()}
    votes, seen, kinds = collections.defaultdict(dict), collections.defaultdict(set), {}
    for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect():
        host = re.match("https?://([^/:]+)", r.url)[1].lower()
        pieces, containers = pages.parse(r.html)
        top, score = pages.best(pieces, containers)
        if top is None:
            continue
        n, s = votes[host].get(top.path, (0, 0))
        votes[host][top.path] = n + 1, s + score
        main, found = pages.parts(pieces, top)
        for path, (h, maybe, _) in found.items():
            seen[host, path].add((h, main))
            kinds[host, path] = maybe
    want = {h: (min(v, key=lambda p: (-v[p][0], -round(v[p][1]), p)), [], []) for h, v in votes.items()}
    for (host, path), x in sorted(seen.items()):
        times = collections.Counter(h for h, _ in x)
        if len(x) >= pages.LEAST_VOTERS:
            again = 2 * sum(n for n in times.values() if n > 1) >= len(x)
            if again or kinds[host, path]:
                want[host][1 if again else 2].append(path)
    assert got == want


def test_short_items_are_found_with_all_substitutions_allowed(spark):
    """Items of 1 to 12 tokens with a fifth substituted, at all combinations of places: each is found, and with one more substitution none."""
    import itertools

    items, docs, want = [], [], set()
    for n in range(1, 13):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for subs in range(n // 5 + 2):
            for places in itertools.islice(itertools.combinations(range(n), subs), 70):
                d = len(docs)
                docs.append((d, " ".join([f"x{d}", *(f"s{d}p{k}" if k in places else w for k, w in enumerate(words)), f"y{d}"])))
                if subs <= n // 5:
                    want.add((d, n))
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_recall_of_longer_items(spark):
    """Items of 13 to 30 tokens with 80 % kept, substituted at random places: nine in ten and more are found."""
    rng = random.Random(6)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(13, 31)]
    docs = []
    for n, text in items:
        for _ in range(30):
            words = text.split()
            for k in rng.sample(range(n), n // 5):
                words[k] = f"s{len(docs)}p{k}"
            docs.append((len(docs), " ".join(words)))
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r.doc_id for r in got}) >= 0.9 * len(docs)


# ---------------------------------------------------------------- mixing

def test_mixture_equals_sql(spark, duck):
    assert rows_of(mixing.op6_mixture(spark, SMALL).toPandas()) == rows_of(duck.sql(mixing.oracle()).to_df())


def test_mixture_of_odd_rows(spark, duck):
    rows = [(1, "a b c", None), (None, None, "z"), (2, "", "z"), (2, "x y", "a"), (2, "x y", "a"), (3, "q " * 500, "b"), (4, "w", "c"), (5, "v", "")]
    df = spark.createDataFrame([(s, t, i, 7) for i, t, s in rows], "source string, text string, doc_id long, size int")
    ours = mixing.mix(df.drop("size")).toPandas()
    duck.register("odd_docs", df.toPandas())
    assert rows_of(ours) == rows_of(duck.sql(mixing.oracle("odd_docs")).to_df())
    assert (ours.taken <= 2 * ours["size"]).all() and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text = ''")).first().target == 0
    assert rows_of(mixing.mix(df).toPandas()) == rows_of(ours)


def test_targets_by_rounds(spark):
    rng = random.Random(8)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 700, 9000]) for i in range(12)} | {None: 40}
    order = [*sorted(k for k in sizes if k), None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    want, capped, goal = {}, {}, 1.5 * sum(sizes.values())
    while True:
        rest = goal - sum(capped.values())
        unit = sum(w for k, w in weight.items() if k not in capped)
        want = capped | {k: rest * w / unit for k, w in weight.items() if k not in capped}
        over = {k: 2.0 * sizes[k] for k, v in want.items() if k not in capped and v > 2 * sizes[k]}
        if not over:
            break
        capped |= over
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- the join

def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        out.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    return out


def plain_join(rows):
    sets = sets_of(rows)
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                part[root(i)] = root(j)
    comp = collections.defaultdict(list)
    for k in range(len(rows)):
        comp[root(k)].append(rows[k][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return collections.Counter((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def check_join(spark, rows):
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, n int, sig string")
    assert collections.Counter(tuple(r) for r in jaccard.join(df).collect()) == plain_join(rows)


def near_copies(seed, groups=12, copies=14, words=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 8, 11, 12, words, 3 * words]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_near_copies(spark, seed):
    check_join(spark, near_copies(seed))


def test_join_with_many_frequent_tokens(spark, monkeypatch):
    """All tokens frequent, blocks of few sets: combinations and block pairs do the work."""
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    check_join(spark, near_copies(3, groups=6, copies=30))


def test_join_of_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(40))
    check_join(spark, [(1, "a b"), (None, "a b"), (5, "A\tB"), (2, None), (3, ""), (4, w), (7, w + " x"), (None, w + " y"), (4, w), (8, "a  b c"), (9, "a b c"), (None, "only"), (10, "long " * 60_000), (11, "Long " * 50_000)])
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_groups(rows, n, percent):
    """Texts' groups as sets of row numbers, by comparing all pairs of sets of n-word shingles."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for _, t in rows]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in words]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part = [part[j] if x == part[i] else x for x in part]
    return part


@pytest.mark.parametrize(("n", "percent", "often"), [(5, 80, 32), (5, 80, 2), (2, 70, 32)])
def test_join_of_other_shingles_and_shares(spark, monkeypatch, n, percent, often):
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", often)
    rows = near_copies(4, groups=8, words=90)
    part, ids = plain_groups(rows, n, percent), [i for i, _ in rows]
    want = {i: min(ids[k] for k in range(len(rows)) if part[k] == part[x]) for x, i in enumerate(ids)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n, percent).collect()} == want


def test_one_of_each_at_0_8(spark):
    """Edits 50 words apart: 3-word shingles are less than 0.9 alike, 5-word shingles more than 0.8."""
    w = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join("x" if i % 50 == 25 else x for i, x in enumerate(w)))], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.one_of_each(docs, words=5, percent=80).collect()] == [1] and jaccard.one_of_each(docs).count() == 2


def test_rows_are_parted_by_a_bitmap(spark):
    from tidemark.llm.common import parted

    rows = spark.range(20_000).selectExpr("id", "id % 7 AS key", "'t' AS row")
    some = rows.where("id % 50 = 3").select("id", "key")
    sure, maybe = parted(rows, some, ["id", "key"])
    assert maybe.join(some, ["id", "key"], "left_semi").count() == some.count() and sure.count() + maybe.count() == 20_000 and maybe.count() < some.count() + 20
    assert parted(rows, some.limit(0), ["id", "key"])[1].count() == 0 and sure.columns == rows.columns


def test_one_of_each(spark):
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(7, w, 1), (4, w + " x", 2), (4, w + " x", 2), (None, w, 3), (2, None, 4), (None, "q", 5), (None, "q", 6)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    assert got.columns == ["doc_id", "text", "n_chars"] and sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(4, w + " x"), (2, None), (0, "q")], key=lambda x: (x[0], x[1] or ""))


def test_prefixes_share_a_key():
    """Any two sets that link share a key, whatever is frequent."""
    rng = np.random.default_rng(5)
    universe = rng.integers(1, 2**63, 500).astype(np.uint64)
    df = {int(t): int(d) for t, d in zip(universe, rng.integers(2, 60, 500), strict=True)}
    for _ in range(300):
        n = int(rng.integers(9, 120))
        a = rng.choice(universe, n, replace=False)
        b = np.unique(np.concatenate([a[int(rng.integers(0, 1 + n // 20)) :], rng.choice(universe, int(rng.integers(0, 1 + n // 20)))]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) < 9 or not jaccard.linked(common, len(a), len(b)):
            continue
        for limit in (1, 30, 99):
            keys = []
            for s in (a, b):
                freq = np.array([df[int(t)] for t in s])
                rare, often = s[freq <= limit], s[freq > limit]
                early = int(jaccard.first(rare).sum())
                order = np.lexsort((often, freq[freq > limit]))
                keys.append(jaccard.prefix_keys(len(s), early, len(rare) - early, often[order], rare, freq[freq <= limit])[0])
            assert len(np.intersect1d(*keys))


def test_parities_lose_no_link():
    """Parities never differ in more bits than sets in tokens; pairs and blocks agree; what is not alike falls out."""
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        base = rng.integers(1, 2**63, 3000).astype(np.uint64)
        sets = []
        for _ in range(60):
            n = int(rng.choice([70, 100, 120, 130, 600, 1100]))
            own = rng.integers(1, 2**63, int(rng.integers(0, n // 4))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: n - len(own)] if rng.random() < 0.7 else rng.integers(1, 2**63, n).astype(np.uint64), own])))
        n, bits, side = np.array([len(s) for s in sets]), [jaccard.parity(s) for s in sets], rng.choice([-1, -1, 0, 1], 60)
        want, may = np.zeros(60, bool), np.zeros((60, 60), bool)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                d = jaccard.differ(bits[i], bits[j])
                assert d <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
                may[i, j] = i != j and (side[i] != side[j] or side[i] == -1) and jaccard.may_link(d, n[i], n[j], percent)
                if may[i, j] and len(bits[i]) in (len(bits[j]), 2 * len(bits[j]), len(bits[j]) / 2):
                    want[i] = True
                assert i == j or not jaccard.linked(len(np.intersect1d(a, b)), n[i], n[j], percent) or jaccard.may_link(d, n[i], n[j], percent)
        assert (jaccard.close_in_block(n, side, bits, percent) == want).all() and 0 < want.sum() < 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(50, 40), (40, 50), (60, 60), (100, 30), (30, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 1), **dict.fromkeys([30, 40, 50, 100], 30)}


# ---------------------------------------------------------------- benchmark

def terms(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))


def plain_overlaps(docs, items):
    out = set()
    for d, t in docs:
        w = terms(t)
        for i, u in items:
            v = terms(u)
            need = min(decontamination.MIN_OVERLAP, len(v))
            if not v:
                continue
            places = collections.defaultdict(list)
            for k, x in enumerate(v):
                places[x].append(k)
            for a in sorted({j - k for j, x in enumerate(w) if x in places for k in places[x]}):  # other diagonals match nowhere
                lo, hi = max(0, -a), min(len(v), len(w) - a)
                s, e = decontamination.best_stretch(np.array([w[a + k] == v[k] for k in range(lo, hi)]))
                if e - s >= need:
                    out.add((d, i))
                    break
    return out


def test_exact_and_substituted_passages(spark):
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([4, 9, 20, 45])))) for i in range(15)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(150)]
        if d % 3:
            v = items[d % 15][1].split()
            v = [x if rng.random() > 0.1 * (d % 2) else rng.choice(vocab) for x in v]
            at = rng.choice([0, 40, 150])
            w[at:at] = [x.upper() + "," for x in v]
        docs.append((d, " ".join(w)))
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, want = {(r.doc_id, r.item_id) for r in got}, plain_overlaps(docs, items)
    assert found <= want and len(found) >= 0.95 * len(want) and {p for p in want if p[0] % 2 == 0} <= found


def share_reached(w, v):
    """The definition: on some diagonal some window of 13 tokens and more (of the whole item, if shorter) with 80 % matches."""
    need = min(decontamination.MIN_OVERLAP, len(v))
    for a in range(-len(v) + 1, len(w)):
        same = [w[a + k] == v[k] for k in range(max(0, -a), min(len(v), len(w) - a))]
        for s in range(len(same)):
            for e in range(s + need, len(same) + 1):
                if 5 * sum(same[s:e]) >= 4 * (e - s):
                    return True
    return False


def test_best_stretch_is_the_best_of_all_windows():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        same = rng.random(int(rng.integers(1, 45))) < rng.choice([0.5, 0.8, 0.85, 0.95])
        least = min(decontamination.MIN_OVERLAP, len(same))
        windows = [(-int(same[s:e].sum()), e - s, s) for s in range(len(same)) for e in range(s + least, len(same) + 1) if 5 * same[s:e].sum() >= 4 * (e - s)]
        s, e = decontamination.best_stretch(same)
        assert (s, e) == (0, 0) if not windows else (-int(same[s:e].sum()), e - s, s) == min(windows)


def test_passages_broken_near_the_share(spark):
    words = lambda p, n: [f"{p}{k}" for k in range(n)]
    broken = [(13, [k]) for k in range(13)] + [(16, [3]), (20, [6, 10, 14]), (40, range(3, 40, 5)), (13, [2, 6, 9]), (16, range(0, 16, 3)), (30, range(2, 30, 3))]
    items, docs = [], []
    for i, (n, at) in enumerate(broken):
        v = words(f"i{i}x", n)
        items.append((i, " ".join(v)))
        docs.append((i, " ".join([*words("a", 30), *("odd" if k in at else x for k, x in enumerate(v)), *words("b", 30)])))
    want = {(d, i) for d, t in docs for i, u in items if d == i and share_reached(t.split(), u.split())}
    assert {i for _, i in want} == set(range(16))  # the last three are under the share
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_diagonals_by_convolution():
    rng = np.random.default_rng(6)
    for _ in range(20):
        shared = [(np.unique(rng.integers(5, 900, int(rng.integers(1, 80)))).astype("<i4"), np.unique(rng.integers(0, 400, int(rng.integers(1, 80)))).astype("<i4")) for _ in range(4)]
        hits = collections.Counter(int(p) - int(a) for x, y in shared for p in x for a in y)
        want = sorted(hits, key=lambda d: (-hits[d], d))
        assert decontamination.diagonals(shared).tolist() == want == decontamination.diagonals(shared, most=50).tolist()


def test_repetitive_texts_and_items(spark):
    """100,000 equal tokens in both, and a period of three: a row a hash, no product of places."""
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "x y z " * 30_000), (3, "b " * 100_000), (4, "a " * 11 + "q"), (5, "a " * 13)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 100_000), (2, "z x y " * 20_000), (3, "c " * 100_000)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontamination.overlaps(docs, items).collect()}
    assert got == {(1, 1, 100_000), (2, 2, 60_000), (5, 1, 13)}


def test_odd_documents_and_items(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "k l m"
    docs = spark.createDataFrame([(None, "x " + a, 1), (1, None, 2), (2, "", 3), (3, "K, L; m!", 4), (3, "K, L; m!", 4), (4, "k l z m", 5), (5, "p " * 90_000 + a, 6)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(0, a, "s"), (1, b, "s"), (2, None, "s"), (None, "q r", "s"), (3, "", "s")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id, r.start) for r in decontamination.overlaps(docs, items).collect()} == {(None, 0, 1), (3, 1, 0), (5, 0, 90_000)}
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.item_id for r in left.collect()) == [2, 3, 5]
    assert decontamination.overlaps(docs.limit(0), items).count() == 0 == decontamination.overlaps(docs, items.limit(0)).count()


# ---------------------------------------------------------------- the pipeline

def test_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline as p
    from tidemark.llm.common import table

    docs = table(spark, SMALL, "documents")
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in bad]
    part, least = plain_groups([(r.doc_id, r.text) for r in rows], 5, 80), {}
    for r, k in zip(rows, part, strict=True):
        least[k] = min(r.doc_id, least.get(k, r.doc_id))
    blank = {r.doc_id for r in rows if not re.search(r"[^\x20\x09-\x0D]", r.text or "")}
    rows = [r for r, k in zip(rows, part, strict=True) if r.doc_id == least[k] or r.doc_id in blank]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    dirty = {d for d, _ in plain_overlaps([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in dirty]
    taken = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    rows = [r for r in rows for _ in range(1 if not taken[r.doc_id].size else -(-taken[r.doc_id].taken // taken[r.doc_id].size))]
    want = tokenfile.token_digest(spark.createDataFrame(rows, docs.schema))
    got = p.run(spark, SMALL)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (1, "a b c", "en", "s", 5), (3, "word " * 30_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        assert name == "token_files" or out.columns == docs.columns
        assert out.count() > 0
