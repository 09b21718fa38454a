"""Main text of web pages by consensus host paths.

A page's containers are scored by the text they hold, less what is in links and in parts that are never main text; each
container has a path of generalised tags and classes (digits to one sign, at most two classes), and a page votes for
the path of its best one. Votes are counted per host in Spark; every page is then extracted anew from the path that won on its host,
or from its own best one where the page has no container of that path.

The host's pages also vote on what lies inside: a path whose text comes again on other pages (pages with another main text, so
that copies of a page are one voter) is boilerplate whatever its name, if it does so for half of LEAST_VOTERS voters and more. Names
decide nothing for good: a NOTICE or a block of LINKS is kept where as many voters show that its text differs from page to page, an
advert or reader comments (ASIDE, whose text differs anyway) where it is half of the main text on half of them. On a host with
fewer voters a NOTICE or an ASIDE goes, a block of LINKS goes if half of its text is inside links. Tags, roles and hidden
attributes alone (NEVER_TAGS, NEVER_ROLES) are final.

Text: character references decoded, white space inside a block to one space, blocks joined by one space in page order.
Elements below DEPTH are part of the one there, for paths; what is never main text is left out at any depth.
Nulls: null html is empty; a page without text gives "" and 0; a null url is a host of its own. Repeated rows give a row each,
and vote each. Ties of votes: the higher sum of scores, then the smaller path. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select title annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object svg text tspan math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover semantics".split())
#: Opening one of these ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("body main article section div td".split())

NEVER_TAGS = frozenset("nav aside footer form button dialog menu head".split())
#: Names of classes and ids, by what they say of a block. A name counts if it is made of these words and LAYOUT alone: "comments-list" does, "comments-on-policy" doesn't.
NOTICES = "banner promo promos promotion notice notices alert alerts side widget respond replies reply foot header toolbar copyright legal"
LINKS = "search nav navbar navigation menu breadcrumb breadcrumbs related recommend recommended recommendations share sharing social login signup masthead pagination pager subscribe subscription"
APART = "ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup modal newsletter sidebar comment comments commentlist disqus footer"
LAYOUT = "box list block area section container wrapper wrap bar top bottom left right main inner outer item items unit slot panel row col column content body group links link buttons button form tags # site page post article text small large full"
NOTICE, LINK, ASIDE = 1, 2, 3
_SAYS = {w: k for k, words in ((NOTICE, NOTICES), (LINK, LINKS), (ASIDE, APART)) for w in words.split()}
_LAYOUT = frozenset(LAYOUT.split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Elements below this depth are taken as part of the one there, as browsers do: bounds paths and walks up.
DEPTH = 512
#: Pages of different main text that must have a path before they decide whether it is boilerplate.
LEAST_VOTERS = 4
# Possessive: a tag that doesn't end is given up after one pass.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>?", re.S)
_STRAY = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_BEGINS = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "path", "never", "maybe", "parent", "depth")

    def __init__(self, tag: str, path: str, never: bool, maybe: int, parent: Node | None):
        self.tag, self.path, self.never, self.maybe, self.parent = tag, path, never, maybe, parent
        self.depth = parent.depth + 1 if parent else 0


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): (x or y or z) for k, x, y, z in _ATTR.findall(attrs)} if attrs.strip() else {}


def _never(tag: str, a: dict[str, str], parent: Node) -> bool:
    inside = "/article" in parent.path or "/main" in parent.path
    return (
        parent.never or tag in NEVER_TAGS or tag == "header" and not inside or a.get("role", "").lower() in NEVER_ROLES
        or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    )


@functools.lru_cache(1 << 12)
def says(names: str) -> int:
    """What the names of a block say it may be: 0 (nothing), NOTICE, LINK or ASIDE, the highest that any says."""
    most = 0
    for name in _DIGITS.sub("#", names).lower().split():
        words = [w for w in re.split("[-_]+|(?<=[a-z])(?=#)", name) if w]
        kinds = [_SAYS.get(w, 0) for w in words if w not in _LAYOUT]
        if kinds and min(kinds):
            most = max(most, *kinds)
    return most


def _maybe(tag: str, a: dict[str, str]) -> int:
    return says(f"{a.get('class', '')} {a.get('id', '')}") if a and tag not in ("html", "body", "article", "main") else 0


def _open(tag: str, attrs: str, parent: Node) -> Node:
    a = _attributes(attrs)
    maybe = _maybe(tag, a)
    classes = ".".join(sorted(_DIGITS.sub("#", c) for c in a.get("class", "").split())[:2])
    return Node(tag, f"{parent.path}/{tag}{'.' + classes if classes else ''}", _never(tag, a, parent), maybe, parent)


def parse(page: str) -> tuple[list[tuple[str, Node, bool]], list[Node]]:
    """Pieces of text with the node each is in and whether a block begins before it; and the containers."""
    root = Node("", "", False, 0, None)
    at, node, pieces, containers, fresh = 0, root, [], [], True
    # Open elements below DEPTH, how many of each tag, and how many were open when text was muted (0: it is not).
    deep: list[str] = []
    n_deep: dict[str, int] = {}
    muted = 0

    def text(s: str) -> None:
        nonlocal fresh
        if s:
            s = html.unescape(s) if "&" in s else s
            if not node.never and not muted:
                pieces.append((s, node, fresh))
                fresh = False

    while b := _BEGINS.search(page, at):
        # A tag with a stray quote ends at its first ">"; one that is cut off by the end of the page is no text.
        m = _TAG.match(page, b.start()) or _STRAY.match(page, b.start())
        text(page[at : b.start()])
        if not m:
            at = len(page)
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            fresh = True
        if m[1]:
            if n_deep.get(tag):
                while True:
                    n_deep[last := deep.pop()] -= 1
                    if last == tag:
                        break
                muted = muted if len(deep) >= muted else 0
                continue
            up = node
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table", "body") and tag in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
                deep, n_deep, muted = [], {}, 0
            continue
        if not deep and (tag in ENDS_P or tag in SIBLINGS):
            ends = SIBLINGS.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            up = node
            while up is not root and up.tag not in ends and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up.tag in ends:
                node = up.parent
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if node.depth >= DEPTH:
            deep.append(tag)
            n_deep[tag] = n_deep.get(tag, 0) + 1
            muted = muted or (len(deep) if _never(tag, a := _attributes(m[3]), node) or _maybe(tag, a) in (NOTICE, ASIDE) else 0)
            continue
        node = _open(tag, m[3], node)
        if tag in CONTAINERS and not node.never:
            containers.append(node)
    text(page[at:])
    return pieces, containers


def best(pieces: list, containers: list[Node]) -> tuple[Node | None, float]:
    """The container with the highest score: own and paragraph text in full, what lies a container deeper at half, links off."""
    if not containers:
        return None, 0.0
    score = dict.fromkeys(map(id, containers), 0.0)
    for s, node, _ in pieces:
        n, up, weight = len(s.strip()), node, 1.0
        if not n:
            continue
        linked, maybe = False, False
        while up is not None:
            linked |= up.tag == "a"
            maybe |= up.maybe > 0
            if maybe:  # what may be boilerplate speaks for no container
                break
            if id(up) in score:
                score[id(up)] += (-0.5 if linked else 1.0) * n * weight
                weight *= 0.5 if up.tag != "section" else 0.9
            up = up.parent
    for c in containers:
        score[id(c)] *= {"article": 1.6, "main": 1.3, "body": 0.8}.get(c.tag, 1.0)
    top = max(containers, key=lambda c: score[id(c)])
    return (top, score[id(top)]) if score[id(top)] > 0 else (None, 0.0)


def linked(pieces: list) -> set[int]:
    """Blocks named as links (their ids) of which half of the text and more is inside links."""
    size: dict[int, list[int]] = {}
    for s, node, _ in pieces:
        n = len(s.strip())
        in_link, up, seen = False, node, []
        while n and up is not None:
            in_link |= up.tag == "a"
            if up.maybe == LINK:
                seen.append((id(up), in_link))
            up = up.parent
        for x, inside in seen:
            t = size.setdefault(x, [0, 0])
            t[0] += n
            t[1] += n * inside
    return {x for x, (n, m) in size.items() if 2 * m >= n}


def blocks(pieces: list, inside: list[Node], drop: frozenset[str] = frozenset(), keep: frozenset[str] = frozenset()) -> str:
    """Text of the pieces inside, without paths in ``drop`` and without what may be boilerplate, unless its path is in ``keep``."""
    wanted = dict.fromkeys(map(id, inside), True)
    of_links = linked(pieces)
    out: list[str] = []
    own: list[str] = []
    for s, node, fresh in pieces:
        up, walked = node, []
        while up is not None and id(up) not in wanted:
            walked.append(up)
            if up.path in drop or up.maybe and up.path not in keep and (up.maybe != LINK or id(up) in of_links):
                up = None
                break
            up = up.parent
        found = up is not None and wanted[id(up)]
        for x in walked:  # each element is judged once
            wanted[id(x)] = found
        if fresh and own:
            out.append("".join(own))
            own = []
        if found:
            own.append(s)
    if own:
        out.append("".join(own))
    return " ".join(" ".join(x.split()) for x in out if x.strip())


def parts(pieces: list, top: Node) -> tuple[int, dict[str, tuple[int, int, bool]]]:
    """A hash of the text of a container; and of that of each path inside it that has a class or a telling name, with what its name says and whether it is half of the text and more.

    Only what a class or a name sets apart is up for votes: plain headings and paragraphs are the text itself.
    """
    found: dict[str, list[int]] = {}
    total = size = 0
    below: dict[int, list[Node]] = {id(top): []}
    for s, node, _ in pieces:
        up, walked = node, []
        while up is not None and id(up) not in below:
            walked.append(up)
            up = up.parent
        if up is None:
            continue
        own = below[id(up)]
        for x in reversed(walked):
            own = below[id(x)] = [*own, x] if x.maybe or "." in x.path.rpartition("/")[2] else own
        if text := " ".join(s.split()):
            h = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
            total, size = (total * 31 + h) % 2**63, size + len(text)
            for x in own:
                y = found.setdefault(x.path, [0, x.maybe, 0])
                y[0], y[2] = (y[0] * 31 + h) % 2**63, y[2] + len(text)
    return total, {path: (h, maybe, 2 * n >= size) for path, (h, maybe, n) in found.items()}


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """host, win (the path with most votes of the host's pages), drop and keep (paths inside that are boilerplate, or are not in spite of their name).

    Votes of a batch are summed before they are shuffled; a page's vote on what lies inside is a row a path, without its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], list[float]] = {}
            inner: dict[tuple, None] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces, containers = parse(page or "")
                top, score = best(pieces, containers)
                if top is not None:
                    v = votes.setdefault((host, top.path), [0, 0.0])
                    v[0] += 1
                    v[1] += score
                    main, found = parts(pieces, top)
                    inner |= dict.fromkeys((host, path, h, main, maybe, most) for path, (h, maybe, most) in found.items())
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in votes] + [k[0] for k in inner], pa.string()), "path": pa.array([k[1] for k in votes] + [k[1] for k in inner], pa.string()),
                "n": pa.array([v[0] for v in votes.values()] + [None] * len(inner), pa.int64()), "score": pa.array([round(v[1]) for v in votes.values()] + [None] * len(inner), pa.int64()),
                "part": pa.array([None] * len(votes) + [k[2] for k in inner], pa.int64()), "main": pa.array([None] * len(votes) + [k[3] for k in inner], pa.int64()), "maybe": pa.array([None] * len(votes) + [k[4] for k in inner], pa.int64()), "most": pa.array([None] * len(votes) + [k[5] for k in inner], pa.bool_()),
            })

    cast = written(pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, path string, n long, score long, part long, main long, maybe long, most boolean"), "host-votes")
    votes = cast.where("n IS NOT NULL").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    won = votes.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path")).alias("w")).select("host", F.col("w.path").alias("win"))
    # A text of a path counts the pages of different main text that have it: one page and its copies are one voter.
    what = [F.max("maybe").alias("maybe"), F.bool_or("most").cast("int").alias("most")]
    same = cast.where("n IS NULL").groupBy("host", "path", "part", "main").agg(*what).groupBy("host", "path", "part").agg(F.count(F.lit(1)).alias("m"), F.max("maybe").alias("maybe"), F.sum("most").alias("most"))
    paths = same.groupBy("host", "path").agg(F.max("maybe").alias("maybe"), F.sum("most").alias("most"), F.sum("m").alias("voters"), F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("again")).where(F.col("voters") >= LEAST_VOTERS)
    again = 2 * F.col("again") >= F.col("voters")
    differs = ~again & F.when(F.col("maybe") == ASIDE, 2 * F.col("most") >= F.col("voters")).otherwise(F.col("maybe") > 0)
    sides = paths.groupBy("host").agg(F.collect_list(F.when(again, F.col("path"))).alias("drop"), F.collect_list(F.when(differs, F.col("path"))).alias("keep"))
    return won.join(sides, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (what was extracted; null if nothing)."""
    won = written(winners(pages), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, paths = [], []
            for page, win, drop, keep in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                drop, keep = frozenset(drop or ()), frozenset(keep or ())
                pieces, containers = parse(page or "")
                own = [c for c in containers if c.path == win]
                if not own:
                    top, _ = best(pieces, containers)
                    own = [top] if top is not None else []
                text = blocks(pieces, own, drop, keep)
                if not own and not containers:  # a fragment without any container
                    text = blocks(pieces, [n for _, n, _ in pieces])
                found.append(text)
                paths.append(own[0].path if own else None)
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(found, pa.string()), "n_chars": pa.array(list(map(len, found)), pa.int64()), "path": pa.array(paths, pa.string())})

    # Spark broadcasts the winners if the table as written is small, and else joins by shuffle with its skew handling.
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", _host().alias("host"))
    joined = rows.join(won, "host", "left").select("page_id", "url", "html", "win", "drop", "keep")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
