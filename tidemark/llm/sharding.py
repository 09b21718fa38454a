"""Consistent-hash ring with virtual nodes and bounded loads: rows that find a shard full continue clockwise.

The ring has ``16 ** CELL_DIGITS`` cells. Every shard has ``nodes`` virtual nodes, a row lies in the cell that its key
(doc_id, size and CRC of the text) hashes to and belongs to the first node at or after it. A shard takes no more rows
than its bound. All rows walk at once, one shard at a time: in each round what an arc has left is offered to the next
other shard clockwise, and a shard takes arcs in ring order until it is full. With ``slack`` 0 the bounds add up to the
number of rows, so counts are at most one apart; with more slack fewer rows leave home and fewer move when a shard is added.

Spark counts rows by cell; the walk itself runs on the ring's arcs, a table whose size is that of the ring whatever the
number of rows, as one fold of built-in functions. Rows then find their place by their cell's running count. Equal rows
(doc_id, size and CRC) are one row with a count until the end, where large counts are split before they are written
out; no task holds more than a cell, and a cell has a 65,536th of the different rows. Built-in functions only.

Nulls: a null text has no bytes (size 16, CRC 0), a null doc_id is a key like any other. Repeated rows are rows of their
own with slots of their own. An empty table gives no rows. Columns beside doc_id and text are not looked at. Equal texts
are not kept together: with counts one apart a group of a third of all rows has to be spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .digests import crc32_ctes

SHARDS, NODES, SEED = 40, 64, "ring-1"
#: Hexadecimal digits of a key that name its cell, and that it has in all.
CELL_DIGITS, KEY_DIGITS = 4, 15
CELLS = 16**CELL_DIGITS
OVERHEAD = 16
#: Equal rows that one task writes out at a time.
PIECE = 1 << 16

_PART = "struct<arc: int, load: bigint, shards: array<int>>"
_TAKEN = "struct<arc: int, shard: int, hops: int, rows: bigint>"
#: One round of the walk, by arc: t is what the shard that is asked takes.
_ROUNDS = f"""
aggregate(sequence(0, {{shards}} - 1), named_struct('left', arcs, 'room', room, 'taken', cast(array() AS array<{_TAKEN}>)), (s, hop) ->
  aggregate(s.left, named_struct('left', cast(array() AS array<{_PART}>), 'room', s.room, 'taken', s.taken), (a, x) ->
    transform(array(least(x.load, a.room[x.shards[hop]])), t -> named_struct(
      'left', if(t < x.load, concat(a.left, array(named_struct('arc', x.arc, 'load', x.load - t, 'shards', x.shards))), a.left),
      'room', if(t > 0, transform(a.room, (free, i) -> if(i = x.shards[hop], free - t, free)), a.room),
      'taken', if(t > 0, concat(a.taken, array(named_struct('arc', x.arc, 'shard', x.shards[hop], 'hops', hop, 'rows', t))), a.taken)))[0])).taken"""


def _key(*parts: Column | str) -> Column:
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, nodes: int, seed: str) -> DataFrame:
    """arc, shard, cell and the cell of the node before (null for the first); a row a virtual node, clockwise."""
    at = F.shiftrightunsigned(_key(F.lit(seed), "shard", "node"), 4 * (KEY_DIGITS - CELL_DIGITS)).cast("int")
    points = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node")).withColumn("cell", at)
    clockwise = Window.orderBy("cell", "shard", "node")  # a row a node
    return points.select((F.row_number().over(clockwise) - 1).alias("arc"), "shard", "cell", F.lag("cell").over(clockwise).alias("before"))


def walked(points: DataFrame, loads: DataFrame, shards: int, slack: float) -> DataFrame:
    """arc, shard, hops, start (of the arc's rows), end, slot (of the first): which rows of an arc a shard takes. loads: arc, load."""
    order = points.agg(F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard"))), lambda x: x["shard"]).alias("order"))
    every = F.concat(F.slice("order", F.col("x.arc") + 1, F.size("order")), F.slice("order", F.lit(1), F.col("x.arc")))
    parts = F.expr("transform(loads, x -> named_struct('arc', x.arc, 'load', x.load, 'shards', array_distinct(concat(slice(`order`, x.arc + 1, size(`order`)), slice(`order`, 1, x.arc)))))")
    each = f"cast(ceil({1 + slack}D * n / {shards}) AS bigint)" if slack else f"n div {shards} + if(s < n % {shards}, 1L, 0L)"
    one = loads.agg(F.array_sort(F.collect_list(F.struct("arc", "load"))).alias("loads"), F.coalesce(F.sum("load"), F.lit(0)).alias("n")).join(F.broadcast(order))  # a row each
    one = one.select(parts.alias("arcs"), F.expr(f"transform(sequence(0, {shards} - 1), s -> {each})").alias("room"))
    taken = one.select(F.inline(F.expr(_ROUNDS.format(shards=shards))))
    end = F.sum("rows").over(Window.partitionBy("arc").orderBy("hops").rowsBetween(Window.unboundedPreceding, 0))
    slot = F.sum("rows").over(Window.partitionBy("shard").orderBy("hops", "arc").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    return taken.select("arc", "shard", "hops", (end - F.col("rows")).alias("start"), end.alias("end"), slot.alias("slot"))


def place(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home (the shard that the ring alone would name) and hops (full shards passed), of every row.

    ``shards * nodes`` should stay well under the number of cells.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    own = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    keys = written(own.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "ring-keys").withColumn("key", _key(F.lit(seed), "doc_id", "size", "text_crc32"))
    keys = keys.withColumn("cell", F.shiftrightunsigned("key", 4 * (KEY_DIGITS - CELL_DIGITS)).cast("int"))

    points = written(ring(spark, shards, nodes, seed), "ring-nodes")
    # What lies beyond the last node belongs to the first, and comes before its other cells.
    last = points.agg(F.max("cell").alias("cell"))
    owned = points.where("before IS NULL OR before < cell").select("arc", F.explode(F.sequence(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("cell"))).alias("cell"), F.lit(1).alias("part"))
    beyond = last.where(F.col("cell") < CELLS - 1).select(F.lit(0).alias("arc"), F.explode(F.sequence(F.col("cell") + 1, F.lit(CELLS - 1))).alias("cell"), F.lit(0).alias("part"))
    counts = keys.groupBy("cell").agg(F.sum("n").alias("load")).join(owned.unionByName(beyond), "cell")
    inside = Window.partitionBy("arc").orderBy("part", "cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = written(counts.withColumn("first", F.sum("load").over(inside) - F.col("load")), "ring-cells")

    taken = walked(points, cells.groupBy("arc").agg(F.sum("load").alias("load")), shards, slack)
    c, t = cells.alias("c"), taken.alias("t")
    over = (F.col("t.arc") == F.col("c.arc")) & (F.col("t.start") < F.col("first") + F.col("load")) & (F.col("t.end") > F.col("first"))
    spans = c.join(t, over).groupBy("c.cell", "c.arc", "first").agg(F.collect_list(F.struct("t.start", "t.end", "t.shard", "t.hops", "t.slot")).alias("spans"))
    spans = spans.join(points.select("arc", F.col("shard").alias("home")), "arc")

    at = F.sum("n").over(Window.partitionBy("cell").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # A row for each cell at most: 16 ** CELL_DIGITS, whatever the number of rows.
    rows = keys.withColumn("at", at).join(F.broadcast(spans), "cell").withColumn("at", F.col("first") + F.col("at"))
    parts = rows.select("doc_id", "size", "text_crc32", "home", F.inline(F.expr(
        "transform(filter(spans, s -> s.start < at + n AND s.end > at), s -> named_struct('shard', s.shard, 'hops', s.hops, 'slot', s.slot + greatest(s.start, at) - s.start, 'm', least(s.end, at + n) - greatest(s.start, at)))")))
    some = parts.where(F.col("m") <= PIECE)
    many = parts.where(F.col("m") > PIECE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    many = many.repartition("doc_id", "shard", "from").select("doc_id", "size", "text_crc32", "home", "shard", "hops", (F.col("slot") + F.col("from")).alias("slot"), F.least(F.lit(PIECE).cast("long"), F.col("m") - F.col("from")).alias("m"))
    out = some.unionByName(many).select("doc_id", "size", "text_crc32", "shard", "slot", "home", "hops", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("i")).alias("slot"), "home", "hops")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11, over all of ``documents``: the law is ``rows``. home and hops follow."""
    x = place(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home", "hops")


def oracle(docs: str = "documents", shards: int = SHARDS, nodes: int = NODES, seed: str = SEED) -> str:
    """The same rows in DuckDB SQL, with slack 0. Equal rows are told apart by their number only."""
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, {KEY_DIGITS}) AS BIGINT)"
    shift = 4 * (KEY_DIGITS - CELL_DIGITS)
    return f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {docs}),
{crc32_ctes("sums", "numbered", "row", "text")},
keyed AS (SELECT doc_id, strlen(text) + {OVERHEAD} AS size, crc FROM numbered JOIN sums USING (row)),
keys AS (SELECT *, {h(f"concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, crc)")} AS key FROM keyed),
points AS (
  SELECT row_number() OVER (ORDER BY cell, shard, node) - 1 AS arc, shard, cell
  FROM (SELECT s.range AS shard, n.range AS node, {h(f"concat_ws(':', '{seed}', s.range, n.range)")} >> {shift} AS cell FROM range({shards}) s, range({nodes}) n)),
firsts AS (SELECT cell, min(arc) AS arc FROM points GROUP BY cell),
owned AS (SELECT c.range AS cell, coalesce(arc, 0) AS arc, CASE WHEN arc IS NULL THEN 0 ELSE 1 END AS part FROM range({CELLS}) c ASOF LEFT JOIN firsts p ON c.range <= p.cell),
rows AS (SELECT k.*, o.arc, row_number() OVER (PARTITION BY o.arc ORDER BY part, key, doc_id, size, crc) - 1 AS pos FROM keys k JOIN owned o ON o.cell = key >> {shift}),
prefs AS (
  SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY far) - 1 AS hop
  FROM (SELECT a.arc, b.shard, min((b.arc - a.arc + {shards * nodes}) % {shards * nodes}) AS far FROM points a, points b GROUP BY a.arc, b.shard)),
total AS (SELECT count(*) AS n FROM keys),
walk(r, kind, id, amount, took, shard) AS (
  SELECT * FROM (SELECT 0, 0, arc, CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM rows GROUP BY arc
    UNION ALL SELECT 0, 1, range, n // {shards} + CASE WHEN range < n % {shards} THEN 1 ELSE 0 END, 0, -1 FROM range({shards}), total)
  UNION ALL
  SELECT * FROM (
    WITH offer AS (
      SELECT w.r, w.id, w.amount, p.shard, s.amount AS room, sum(w.amount) OVER (PARTITION BY p.shard ORDER BY w.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w.amount AS before
      FROM walk w JOIN prefs p ON p.arc = w.id AND p.hop = w.r JOIN walk s ON s.kind = 1 AND s.id = p.shard WHERE w.kind = 0 AND w.amount > 0),
    taken AS (SELECT *, CAST(greatest(0, least(amount, room - before)) AS BIGINT) AS t FROM offer)
    SELECT r + 1, 0, id, amount - t, t, shard FROM taken
    UNION ALL
    SELECT s.r + 1, 1, s.id, CAST(s.amount - coalesce(x.t, 0) AS BIGINT), 0, -1 FROM walk s LEFT JOIN (SELECT shard, sum(t) AS t FROM taken GROUP BY shard) x ON x.shard = s.id
    WHERE s.kind = 1 AND s.r < {shards} AND EXISTS (SELECT 1 FROM taken))),
spans AS (
  SELECT id AS arc, shard, r - 1 AS hops, took, sum(took) OVER (PARTITION BY id ORDER BY r) AS stop, sum(took) OVER (PARTITION BY shard ORDER BY r, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - took AS slot
  FROM walk WHERE kind = 0 AND took > 0)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(s.shard AS INTEGER) AS shard, CAST(slot + pos - (stop - took) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, CAST(p.shard AS INTEGER) AS home, CAST(hops AS INTEGER) AS hops
FROM rows r JOIN spans s ON s.arc = r.arc AND pos >= stop - took AND pos < stop JOIN points p ON p.arc = r.arc"""
