"""Conversation structure repair: the cheapest edits that make turns alternate, by a fold of built-in functions.

Windows flag a turn's first fault: blank, duplicate (role and text seen earlier), truncated. The sorted turns of a
conversation go through ``aggregate()``, which carries the cheapest (cost, audit) that ends with nothing said (e), a
system turn (s), a user turn (u) and an assistant turn (a); ``least`` keeps the cheapest, then ASCII-least. Candidates
of one cost are never prefixes of each other (every turn has one letter, and each further insertion costs), so the
least beginning stays the least whatever follows.

A long conversation is folded by blocks of ``BLOCK`` turn numbers, each from all four beginnings, and the blocks' four
by four results are chained in a second fold; so no task needs a whole conversation for this. Texts take no part: they
are shuffled once, sorted by conversation and turn, beside their block's edits, and hashed as a stream.

Nulls: a null role or text is one space, a null conv_id is a conversation, a null turn comes first and is in no gap.
Turns with one number are ordered by role, then by the MD5 of the text. Repeated rows are turns of their own. Other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, table, written
from .digests import crc32_ctes

#: Turn numbers that one fold takes.
BLOCK = 256
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What blank texts consist of, and what stands at the end of a whole one.
SPACE, END = " \t\n\x0b\f\r", (".", "!", "?")
FIRST, NULLS = -(1 << 63), -(1 << 63) + 1

_STATES = "esua"
_BEST = "struct<cost: bigint, audit: string>"
_ROW = f"struct<e: {_BEST}, s: {_BEST}, u: {_BEST}, a: {_BEST}>"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: what is left of ``turns`` when CRC(conv_id:turn) mod 20 has dropped, emptied, stripped, repeated and reassigned some."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    x = turns.select("conv_id", "turn", *own, (F.crc32(name) % 20).alias("fate")).where("fate <> 0")
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, h (MD5 of the text), fault (blank, duplicate, truncated or none), block; without texts."""
    end = F.expr("trim(TRAILING ' \\t\\n\\u000b\\f\\r' FROM text)")
    x = turns.select("conv_id", "turn", "role", F.md5("text").alias("h"), end.alias("end")).select("conv_id", "turn", "role", "h", (F.col("end") == "").alias("blank"), F.right("end", F.lit(1)).isin(*END).alias("whole"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), "blank").when(seen > 1, "duplicate").when(~F.col("whole"), "truncated").otherwise("none")
    return x.select("conv_id", "turn", "role", "h", fault.alias("fault"), _block().alias("block"))


def _block():
    return F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(NULLS))


def _more(best: str, cost: str | int, letters: str) -> str:
    return f"if({best} IS NULL, NULL, named_struct('cost', {best}.cost + {cost}, 'audit', concat({best}.audit, '{letters}')))"


def _step() -> str:
    """What four (cost, audit) q become by turn x: insertions first, then one edit of the turn."""
    with_insertions = f"""named_struct('u', least(q.u, {_more("q.e", INSERT, "I")}, {_more("q.s", INSERT, "I")}, {_more("q.a", INSERT, "I")}),
      'a', least(q.a, {_more("q.u", INSERT, "I")}, {_more("q.e", 2 * INSERT, "II")}, {_more("q.s", 2 * INSERT, "II")}))"""
    begins = f"transform(array({with_insertions}), z -> named_struct('u', z.u, 'a', z.a, 'b', least(q.e, q.s, z.a)))"
    said = lambda role, at: f"if(x.gone, NULL, if(x.i = '{role}', {_more(at, 'x.t', 'K')}, {_more(at, f'{REROLE} + x.t', 'R')}))"
    return f"""transform({begins}, z -> named_struct(
      'e', {_more("q.e", DELETE, "D")}, 's', least({_more("q.s", DELETE, "D")}, if(x.gone OR x.i <> 's', NULL, {_more("q.e", "x.t", "K")})),
      'u', least({_more("z.u", DELETE, "D")}, {said("u", "z.b")}), 'a', least({_more("z.a", DELETE, "D")}, {said("a", "z.u")})))[0]"""


def folded(flags: DataFrame) -> DataFrame:
    """A row a conversation of ``flags``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, tail (insertions at the end), edits (array of block, audit)."""
    zero = "named_struct('cost', 0L, 'audit', '')"
    starts = ", ".join("named_struct(" + ", ".join(f"'{t}', {f'cast({zero} AS {_BEST})' if s == t else f'cast(NULL AS {_BEST})'}" for t in _STATES) + ")" for s in _STATES)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "h", F.left("role", F.lit(1)).alias("i"), F.col("fault").isin("blank", "duplicate").alias("gone"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("t"))))
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    blocks = flags.groupBy("conv_id", "block").agg(turns.alias("turns"), F.countDistinct("turn").alias("numbers"), F.min("turn").alias("low"), F.max("turn").alias("high"), *faults)
    illegal = "size(filter(sequence(2, size(turns)), k -> concat(turns[k - 2].i, turns[k - 1].i) NOT IN ('su', 'ua', 'au')))"
    blocks = blocks.select(
        "conv_id", "block", "numbers", "low", "high", "blank", "duplicate", "truncated", F.expr(f"if(size(turns) < 2, 0, {illegal})").alias("illegal"), F.expr("turns[0].i").alias("first"), F.expr("turns[size(turns) - 1].i").alias("last"),
        F.expr(f"aggregate(turns, array({starts}), (m, x) -> transform(m, q -> {_step()}))").alias("m"),
    )
    chain = lambda s, t: f"if(p.{s} IS NULL OR x.m[{_STATES.index(s)}].{t} IS NULL, NULL, named_struct('cost', p.{s}.cost + x.m[{_STATES.index(s)}].{t}.cost, 'audit', concat(p.{s}.audit, x.m[{_STATES.index(s)}].{t}.audit), 'path', concat(p.{s}.path, '{s}')))"
    none = "cast(NULL AS struct<cost: bigint, audit: string, path: string>)"
    begin = "named_struct('e', cast(named_struct('cost', 0L, 'audit', '', 'path', '') AS struct<cost: bigint, audit: string, path: string>), " + ", ".join(f"'{t}', {none}" for t in "sua") + ")"
    into = "named_struct(" + ", ".join(f"'{t}', least(" + ", ".join(chain(s, t) for s in _STATES) + ")" for t in _STATES) + ")"
    last = lambda s, n: f"if(p.{s} IS NULL, NULL, named_struct('cost', p.{s}.cost + {INSERT * n}, 'audit', concat(p.{s}.audit, '{'I' * n}'), 'path', concat(p.{s}.path, '{s}'), 'tail', {n}))"
    summed = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "m", "first", "last"))).alias("b"), (F.max("high") - F.min("low") + 1 - F.sum("numbers")).alias("gaps"), *summed, F.sum("illegal").alias("inside"))
    between = "if(size(b) < 2, 0, size(filter(sequence(2, size(b)), k -> concat(b[k - 2].last, b[k - 1].first) NOT IN ('su', 'ua', 'au'))))"
    whole = whole.withColumn("r", F.expr(f"aggregate(b, {begin}, (p, x) -> {into}, p -> least({last('e', 0)}, {last('s', 2)}, {last('u', 1)}, {last('a', 0)}))"))
    chosen = "element_at(x.m, instr('esua', substr(r.path, k + 1, 1)))"
    edits = f"transform(b, (x, k) -> named_struct('block', x.block, 'audit', CASE substr(r.path, k + 2, 1) WHEN 'e' THEN {chosen}.e.audit WHEN 's' THEN {chosen}.s.audit WHEN 'u' THEN {chosen}.u.audit ELSE {chosen}.a.audit END))"
    return whole.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + F.expr(between)).alias("illegal"), "r.cost", "r.audit", "r.tail", F.expr(edits).alias("edits"))


class Lines:
    """The hash of one conversation's repaired lines, a turn at a time."""

    def __init__(self):
        self.sha, self.user, self.any, self.edits = hashlib.sha256(), False, False, iter("")

    def add(self, role, text) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any, self.user = True, role.startswith("u")
        self.sha.update(role.encode() + b":")
        self.sha.update(text)

    def insert(self, text=b"") -> None:
        self.add("assistant" if self.user else "user", text)

    def turn(self, role, text) -> None:
        for edit in self.edits:
            if edit == "I":
                self.insert()
                continue
            if edit == "K":
                self.add(role, text)
            elif edit == "R":
                self.insert(text)
            return


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation: its facts, then each block's edits before the block's turns. A text is read where it lies."""
    open_, lines = None, None
    names = ("conv_id", *FACTS, "repaired_sha256")

    def closed():
        for _ in range(open_["tail"]):
            lines.insert()
        return [open_["conv_id"], *(open_[f] for f in FACTS), lines.sha.hexdigest()]

    schema = None
    for batch in batches:
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        schema = schema or pa.schema([(n, pa.string() if n == "repaired_sha256" else batch.schema.field(n).type) for n in names])
        done = []
        for i, kind in enumerate(col["kind"].to_pylist()):
            if kind == 0:
                if open_:
                    done.append(closed())
                open_, lines = {n: col[n][i].as_py() for n in ("conv_id", *FACTS, "tail")}, Lines()
            elif kind == 1:
                lines.edits = iter(col["audit"][i].as_py())
            else:
                lines.turn(col["role"][i].as_py(), col["text"][i].as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), schema.types, strict=True)], schema=schema)


def repair(turns: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``turns`` and of ``original``.

    audit: K(eep), R(erole), D(elete), I(nsert) in order. One without turns has zeros, no audit and the hash of nothing.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    whole = written(folded(flagged(turns)), "conversations")
    lone = (original if original is not None else turns).select("conv_id").distinct().alias("o").join(whole.alias("w"), F.col("o.conv_id").eqNullSafe(F.col("w.conv_id")), "left_anti")
    kinds = dict(gaps="bigint", blank="bigint", duplicate="bigint", truncated="bigint", illegal="bigint", cost="bigint", tail="int")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    place = lambda block, kind: [F.lit(block).cast("bigint").alias("block") if isinstance(block, int) else block.alias("block"), F.lit(kind).alias("kind")]
    blank = [F.lit(None).cast("bigint").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "h", "text"))]
    turn = [F.col("turn").cast("bigint"), "role", F.md5("text").alias("h"), "text"]
    rows = whole.select("conv_id", *place(FIRST, 0), *blank, *(F.col(c).cast(t) for c, t in kinds.items()), "audit")
    rows = rows.unionByName(lone.select("conv_id", *place(FIRST, 0), *blank, *(F.lit(0).cast(t).alias(c) for c, t in kinds.items()), F.lit("").alias("audit")))
    rows = rows.unionByName(whole.select("conv_id", F.explode("edits").alias("x")).select("conv_id", *place(F.col("x.block"), 1), *blank, *nothing, "x.audit"))
    rows = rows.unionByName(turns.select("conv_id", *place(_block(), 2), *turn, *nothing, F.lit(None).cast("string").alias("audit")))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", F.asc_nulls_first("turn"), "role", "h")
    id_ = turns.schema["conv_id"].dataType.simpleString()
    return arrow_map(ordered, _hashed, f"conv_id {id_}, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in FACTS) + ", repaired_sha256 string")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op13, over all of ``conversations``."""
    raw = table(spark, sf_dir, "conversations")
    return repair(damaged(raw), raw)


def oracle() -> str:
    """The same rows in DuckDB SQL: a turn of every conversation at each step, first for the edits, then for the lines."""
    def more(x, cost, letters):
        return f"CASE WHEN {x} IS NOT NULL THEN {{'cost': CAST({x}.cost + {cost} AS BIGINT), 'audit': concat({x}.audit, '{letters}')}} END"

    def best(*xs):
        return "list_min([" + ", ".join(xs) + "])"

    said = lambda role, at: f"CASE WHEN NOT t.gone THEN CASE WHEN t.i = '{role}' THEN {more(at, 't.late', 'K')} ELSE {more(at, '3 + t.late', 'R')} END END"
    strip = "rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
names AS (SELECT DISTINCT name FROM raw),
{crc32_ctes("sums", "names", "name", "name")},
fates AS (SELECT raw.*, crc % 20 AS fate FROM raw JOIN sums USING (name)),
dealt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, range(2) c WHERE fate <> 0 AND (c.range = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM dealt),
faults AS (
  SELECT *, CASE WHEN {strip} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN right({strip}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
turns AS (SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS c, n, role, text, left(role, 1) AS i, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM faults),
ways(c, n, e, s, u, a) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'audit': ''}}, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR)), CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR)), CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR)) FROM turns
  UNION ALL
  SELECT c, n, {more("e", 4, "D")}, {best(more("s", 4, "D"), f"CASE WHEN NOT gone AND i = 's' THEN {more('e', 'late', 'K')} END")}, {best(more("u1", 4, "D"), said("u", "b").replace("t.", ""))}, {best(more("a1", 4, "D"), said("a", "u1").replace("t.", ""))}
  FROM (SELECT *, {best("e", "s", "a1")} AS b FROM (
    SELECT w.c, t.n, t.gone, t.i, t.late, e, s, {best("u", more("e", 3, "I"), more("s", 3, "I"), more("a", 3, "I"))} AS u1, {best("a", more("u", 3, "I"), more("e", 6, "II"), more("s", 6, "II"))} AS a1
    FROM ways w JOIN turns t ON t.c = w.c AND t.n = w.n + 1))),
ended AS (SELECT c, {best("e", more("s", 6, "II"), more("u", 3, "I"), "a")} AS r FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC) AS back FROM ways) WHERE back = 1),
letters AS (SELECT c, n, unnest(range(1, length(r.audit) + 1)) AS k, r.audit AS audit FROM ended JOIN (SELECT c, count(*) AS n FROM turns GROUP BY c) USING (c)),
acts AS (SELECT c, k, substr(audit, k, 1) AS act, length(regexp_replace(substr(audit, 1, k), 'I', '', 'g')) AS n FROM letters),
lines(c, k, role, line) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR) FROM acts
  UNION ALL
  SELECT l.c, a.k, CASE WHEN a.act = 'D' THEN l.role WHEN a.act = 'K' THEN t.role WHEN l.role LIKE 'u%' THEN 'assistant' ELSE 'user' END,
    CASE a.act WHEN 'D' THEN NULL WHEN 'K' THEN concat(t.role, ':', t.text) ELSE concat(CASE WHEN l.role LIKE 'u%' THEN 'assistant' ELSE 'user' END, ':', CASE WHEN a.act = 'R' THEN t.text ELSE '' END) END
  FROM lines l JOIN acts a ON a.c = l.c AND a.k = l.k + 1 LEFT JOIN turns t ON t.c = a.c AND t.n = a.n),
texts AS (SELECT c, string_agg(line, chr(10) ORDER BY k) AS repaired FROM lines GROUP BY c),
facts AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND concat(left(before, 1), left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(r.cost, 0) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS c FROM raw) o LEFT JOIN facts USING (c) LEFT JOIN ended USING (c) LEFT JOIN texts USING (c)"""
