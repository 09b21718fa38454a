"""Personal data: fixed patterns, and a skip-chain conditional random field over whatever looks like them.

Every run that could be an e-mail address or a number is a token of the field; the labels are none, email, ip, card,
phone. A run of numbers too long for any kind is a token a word. A token has its own features and a link to the one before it; and
skip links join tokens of a document, however far apart, that hold the same digits or address, or the same last SIMILAR digits.
Loopy sum-product messages over those links pull such tokens to one label, so a number given in full once is found again where it is
abbreviated. A word between the tokens cannot be personal data, so it is fixed to none and drops out of the field; so is
a number of less than SIMILAR digits without three dots, as it has no skip link.

What the patterns find is evidence: those tokens are clamped to their label. The others are hidden. The field is trained by
pseudo-likelihood on all documents; there a token counts as none, unless a skip link ties it to a token that the patterns found or it was cut
from a run that the patterns cannot judge: nothing is known of such a token, and it teaches nothing. Features are few, so tokens are counted by (features, label, neighbours'
labels) and only the counts come to the driver: their number is bounded by the alphabet of features, not by the table.
Spans of the patterns are kept; the field adds a hidden token where its belief in a kind is over BELIEF.

All patterns take time in proportion to the text, whatever it repeats. Nulls: a null text has no data; doc_id may be null.
Repeated rows give their spans each. Empty table: no rows, and no training: nothing is added then. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Fixed patterns of the contract.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address in two parts, so that a long run of letters is passed once: what ends at the sign, and what follows it.
LOCAL, DOMAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: What may be personal data at all.
CANDIDATE = re.compile(r"(?<![^\s@<>,;])[^\s@<>,;]++@[^\s@<>,;]++|\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9])*+")
NUMBER_WORD = re.compile(r"\+?\(?[0-9](?:[().-]{0,2}+[0-9])*+")
SIMILAR, LONGEST, BELIEF, ITERATIONS = 7, 19, 0.9, 30
#: Where the weights of skip links are before any are seen: equal tokens tend to be of one kind.
SKIP_PRIOR = 2.0
CLAMP = -1e3


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(d: str) -> bool:
    return (sum(map(int, d[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in d[-2::-2])) % 10 == 0


def octets(s: str) -> bool:
    """Whether all parts between dots are numbers up to 255, however many zeros they begin with."""
    return all(x.isdigit() and (len(y := x.lstrip("0")) < 3 or len(y) == 3 and y <= "255") for x in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = []
    if "@" in text:
        end = 0
        for m in LOCAL.finditer(text):
            start, at = max(m.start(), end), m.end()
            if start < at - 1 and (domain := DOMAIN.match(text, at)):
                end = domain.end()
                out.append((0, start, end))
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= m.end() - m.start() < 38 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- tokens of the field

N_FEATURES = 17


@dataclass
class Tokens:
    """Columns, some forty bytes a token: a text may be nothing but numbers."""

    start: array
    end: array
    features: array  # a bit each
    label: array  # by the patterns
    cut: array
    chain: list[tuple[int, int]] | None  # links of neighbours; None: all
    skip: np.ndarray  # links of two tokens each


def candidates(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end, text of each token, and whether it was cut from a run that is too long for the patterns to judge."""
    for m in CANDIDATE.finditer(text):
        if "@" in m[0] or len(m[0]) <= LONGEST or len(digits(m[0])) <= LONGEST:
            yield m.start(), m.end(), m[0], False
        else:
            yield from ((w.start(), w.end(), w[0], True) for w in NUMBER_WORD.finditer(text, m.start(), m.end()))


def tokens(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """The field of one text. Skip links tie a token to the last one with its key: as many links as tokens, not pairs."""
    out = Tokens(array("q"), array("q"), array("q"), array("b"), array("b"), None, np.zeros((0, 2), np.int64))
    whole, tail, mails = array("q"), array("q"), array("b")  # hashes of what a token shares with others
    spans = sorted((s, e, k) for k, s, e in base)
    j = 0
    for s, e, word, cut in candidates(text):
        d = digits(word)
        mail = "@" in word
        n, dots = len(d), word.count(".")
        if not mail and n < SIMILAR and dots != 3:
            continue
        i = len(out.start)
        bits = (
            1, mail, mail and "." in word[word.find("@"):], mail and word[-1].isalnum(), not mail and word[0] == "+", not mail and "(" in word,
            not mail and dots == 3 and n <= 12, not mail and dots == 3 and n <= 12 and octets(word.strip("+(")),
            not mail and " " in word, not mail and "-" in word, not mail and n < 8, not mail and 8 <= n <= 9, not mail and 10 <= n <= 11, not mail and 12 <= n <= 15,
            not mail and 16 <= n <= 19, not mail and 16 <= n <= 19 and luhn(d), not mail and n > LONGEST,
        )
        while j < len(spans) and spans[j][1] <= s:
            j += 1
        out.start.append(s)
        out.end.append(e)
        out.features.append(sum(1 << k for k, b in enumerate(bits) if b))
        out.label.append(spans[j][2] + 1 if j < len(spans) and spans[j][0] < e else 0)
        out.cut.append(cut)
        whole.append(hash(word.lower() if mail else d))
        tail.append(hash((i, 0)) if mail else hash(d[-SIMILAR:]))
        mails.append(mail)
    before = [_last_with(np.frombuffer(k, np.int64)) for k in (whole, tail)]
    before[1][(before[1] == before[0]) | (np.frombuffer(mails, np.int8) > 0)] = -1
    ends = [np.flatnonzero(x >= 0) for x in before]
    out.skip = np.concatenate([np.stack([x[e], e], 1) for x, e in zip(before, ends, strict=True)])
    return out


def _last_with(keys: np.ndarray) -> np.ndarray:
    """For each key the last place before it with the same one; -1 if there is none."""
    out = np.full(len(keys), -1)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


# ---------------------------------------------------------------- training and messages

@dataclass
class Field:
    w: np.ndarray  # labels x features
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # what equal labels of linked tokens add, by label


def train_counts(docs: DataFrame) -> list:
    """Tokens of all documents, counted by features, label and the labels around them; hidden ones of which nothing is known are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[int, int, int, int], int] = {}
            for text in (x.as_py() for x in b.column(0)):
                if not text or not _HINT.search(text):
                    continue
                t = tokens(text, base_spans(text))
                skip = np.zeros(len(t.start), np.int64)  # labels at skip links, a bit each
                bit = 1 << np.frombuffer(t.label, np.int8).astype(np.int64)
                for one, other in (t.skip.T, t.skip.T[::-1]):
                    np.bitwise_or.at(skip, one, bit[other])
                skip = array("q", skip.tobytes())
                for i, (x, y) in enumerate(zip(t.features, t.label, strict=True)):
                    if not y and (skip[i] > 1 or t.cut[i]):
                        continue
                    key = (x, y, t.label[i - 1] if i else -1, skip[i])
                    count[key] = count.get(key, 0) + 1
            if count:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("features", "label", "before", "skip", "n"), zip(*((*k, v) for k, v in count.items()), strict=True), strict=True)})

    counted = docs.select("text").mapInArrow(run, "features long, label long, before long, skip long, n long")
    return counted.groupBy("features", "label", "before", "skip").agg(F.sum("n").alias("n")).orderBy("features", "label", "before", "skip").collect()


def fit(cells: list, steps: int = 400, rate: float = 0.3, decay: float = 1e-4) -> Field:
    k = len(LABELS)
    prior = [np.zeros((k, N_FEATURES)), np.zeros((k, k)), np.full(k, SKIP_PRIOR)]
    field = Field(*(x.copy() for x in prior))
    if not cells:
        field.w[0, 0] = 30.0
        return field
    a = np.array([[c.features, c.label, c.before, c.skip, c.n] for c in cells], np.int64)
    x = ((a[:, :1] >> np.arange(N_FEATURES)) & 1).astype(float)
    y, weight = np.eye(k)[a[:, 1]], a[:, 4] / a[:, 4].sum()
    before = np.where(a[:, 2:3] >= 0, np.eye(k)[np.maximum(a[:, 2], 0)], 0.0)
    skip = ((a[:, 3:4] >> np.arange(k)) & 1).astype(float)
    params = [field.w, field.chain, field.skip]
    sums = [np.full_like(p, 1e-8) for p in params]
    for _ in range(steps):
        z = x @ field.w.T + before @ field.chain + skip * field.skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (y - p / p.sum(axis=1, keepdims=True)) * weight[:, None]
        for p, s, m, g in zip(params, sums, prior, (d.T @ x, before.T @ d, (skip * d).sum(axis=0)), strict=True):
            g = g - decay * (p - m)
            s += g * g
            p += rate * g / np.sqrt(s)
    return field


#: Tokens or links whose messages are worked out at a time.
BLOCK = 1 << 15


def beliefs(t: Tokens, f: Field, iterations: int = ITERATIONS, tolerance: float = 1e-4) -> np.ndarray:
    """Label beliefs of the tokens by loopy sum-product, damped. Tokens that the patterns found are clamped.

    A token keeps two messages, from its neighbours, and a skip link two, as floats of four bytes; they are renewed in place by blocks.
    """
    n, k = len(t.start), len(LABELS)
    kinds, of = np.unique(np.asarray(t.features, np.int64), return_inverse=True)
    weights = ((kinds[:, None] >> np.arange(N_FEATURES)) & 1).astype(float) @ f.w.T
    label = np.asarray(t.label, np.int64)
    near = np.ones(n, bool) if t.chain is None else np.isin(np.arange(n), [i for i, _ in t.chain])  # linked to the next
    near[-1:] = False
    links = np.asarray(t.skip, np.int64).reshape(-1, 2)
    linked, place = np.unique(links, return_inverse=True)
    place = place.reshape(-1, 2)
    before, after, over = (np.zeros((m, k), np.float32) for m in (n, n, len(links)))  # messages from the one before, the one after, the first of a link
    back = np.zeros_like(over)  # and from the second
    with_links = np.full(n, -1, np.int32)
    with_links[linked] = np.arange(len(linked))
    forth, chain = np.exp(f.chain), np.exp(f.chain.T)
    equal = np.expm1(f.skip)

    def own(at: np.ndarray) -> np.ndarray:
        out = weights[of[at]]
        known = np.flatnonzero(label[at])
        out[known] = CLAMP
        out[known, label[at][known]] = 0.0
        return out

    def total(at: np.ndarray, gathered: np.ndarray) -> np.ndarray:
        out = own(at) + before[at] + after[at]
        here = with_links[at]
        out[here >= 0] += gathered[here[here >= 0]]
        return out

    def gather() -> np.ndarray:
        out = np.zeros((len(linked), k))
        np.add.at(out, place[:, 1], over)
        np.add.at(out, place[:, 0], back)
        return out

    def sent(x: np.ndarray, through: np.ndarray | None) -> np.ndarray:
        """Normalised messages of tokens with the totals x: through the table of the chain, or that of skip links (None)."""
        e = np.exp(x - x.max(axis=1, keepdims=True))
        new = np.log(e @ through if through is not None else e.sum(axis=1, keepdims=True) + e * equal)
        return new - new.max(axis=1, keepdims=True)

    for _ in range(iterations if n else 0):
        change = 0.0
        gathered = gather()
        for a in range(0, n, BLOCK):
            at = np.arange(a, min(a + BLOCK, n))
            x = total(at, gathered)
            for messages, step, table in ((before, 1, forth), (after, -1, chain)):
                ok = near[at] if step == 1 else np.append(near[a - 1] if a else False, near[at[:-1]])
                new = sent((x - (after if step == 1 else before)[at])[ok], table)
                to = at[ok] + step
                change = max(change, float(np.abs(new - messages[to]).max(initial=0)))
                messages[to] = 0.5 * messages[to] + 0.5 * new
        for a in range(0, len(links), BLOCK):
            x, y = links[a : a + BLOCK].T
            part = slice(a, a + BLOCK)
            there, here = sent(total(x, gathered) - back[part], None), sent(total(y, gathered) - over[part], None)
            change = max(change, float(np.abs(there - over[part]).max(initial=0)), float(np.abs(here - back[part]).max(initial=0)))
            over[part], back[part] = 0.5 * over[part] + 0.5 * there, 0.5 * back[part] + 0.5 * here
        if change < tolerance:
            break
    out, gathered = np.zeros((n, k), np.float32), gather()
    for a in range(0, n, BLOCK):
        at = np.arange(a, min(a + BLOCK, n))
        x = total(at, gathered)
        b = np.exp(x - x.max(axis=1, keepdims=True))
        out[at] = b / b.sum(axis=1, keepdims=True)
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], f: Field) -> list[tuple[int, int, int]]:
    t = tokens(text, base)
    if all(t.label):
        return []
    b = beliefs(t, f)
    best = b[:, 1:].argmax(axis=1)
    sure = np.flatnonzero((np.asarray(t.label) == 0) & (b[np.arange(len(b)), best + 1] >= BELIEF))
    return [(int(best[i]), t.start[i], t.end[i]) for i in sure]


_HINT = re.compile(r"[0-9@]")


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Counts and digest of the patterns' spans, all spans, and how many the field added, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in x)
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in (x.as_py() for x in b.column(1)):
                base, more = [], []
                if text and _HINT.search(text):
                    base = base_spans(text)
                    more = added_spans(text, base, field)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(x[0] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(join(base).encode()).hexdigest())
                rows["spans"].append(join(sorted(base + more)))
                rows["n_added"].append(len(more))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | {n: pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in rows.items()})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(train_counts(docs)))
