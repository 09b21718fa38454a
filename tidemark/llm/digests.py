"""CRC-32 in DuckDB SQL, for the SQL of queries whose rows carry it: DuckDB has no such function."""

from __future__ import annotations

#: Bytes that one fold takes; folds of a text are joined by the step over as many zero bytes.
BLOCK = 256


def crc32_ctes(name: str, source: str, key: str, text: str) -> str:
    """CTEs, to follow WITH RECURSIVE: ``name``(key, crc) of ``text`` (UTF-8, not null) of each row of ``source``; key is unique there.

    The table of bytes comes from the polynomial. Every block is folded on its own, the first one short and from all
    ones; a value is carried over a block by the same step on zeros, looked up for each of its four bytes.
    """
    step = "xor(c >> 8, t[1 + (xor(c, b) & 255)])"
    return f"""
{name}_bits(n, k, v) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM {name}_bits WHERE k < 8),
{name}_table AS (SELECT list(v ORDER BY n) AS t FROM {name}_bits WHERE k = 8),
{name}_far AS (SELECT list(v ORDER BY n) AS f FROM (
  SELECT n, list_reduce(list_prepend((n & 255) << (8 * (n >> 8)), [CAST(0 AS BIGINT) FOR z IN range({BLOCK})]), lambda c, b: {step}) AS v
  FROM (SELECT CAST(range AS BIGINT) AS n FROM range(1024)), {name}_table)),
{name}_hex AS (SELECT {key}, hex(encode({text})) AS h, strlen({text}) AS n FROM {source}),
{name}_cut AS (SELECT {key}, j, n, substr(h, 1 + 2 * greatest(0, n - (blocks - j) * {BLOCK}), 2 * least({BLOCK}, n - (blocks - j - 1) * {BLOCK})) AS h
  FROM (SELECT *, unnest(range(blocks)) AS j FROM (SELECT *, CAST(ceil(n / {BLOCK}.0) AS BIGINT) AS blocks FROM {name}_hex))),
{name}_fold AS (SELECT {key}, j, list_reduce(list_prepend(CASE WHEN j = 0 THEN 4294967295 ELSE 0 END,
    [CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, length(h) // 2 + 1)]), lambda c, b: {step}) AS v FROM {name}_cut, {name}_table),
{name} AS (SELECT k.{key}, coalesce(xor(4294967295, v), 0) AS crc FROM {name}_hex k LEFT JOIN (
  SELECT {key}, list_reduce(list(v ORDER BY j), lambda c, b: xor(b, xor(xor(f[1 + (c & 255)], f[257 + ((c >> 8) & 255)]), xor(f[513 + ((c >> 16) & 255)], f[769 + (c >> 24)])))) AS v
  FROM {name}_fold, {name}_far GROUP BY {key}, f) x ON x.{key} IS NOT DISTINCT FROM k.{key})"""
