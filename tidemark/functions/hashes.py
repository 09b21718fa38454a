"""Hashes and generators of 32 bits as columns: products are taken in parts, so that nothing overflows 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = (1 << 32) - 1


def _product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits."""
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(WORD) * 65536
    return (high + a * b.bitwiseAND(65535)).bitwiseAND(WORD)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's characters (their codes); null for null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 0x01000193).bitwiseAND(WORD))


def unit(text: Column) -> Column:
    """``fnv1a`` as a number from 0 to under 1."""
    return fnv1a(text) / float(1 << 32)


def mulberry32(seed: Column, place: Column) -> Column:
    """The ``place``-th number (from 0) that the generator gives from a seed, from 0 to under 1: its state grows by a fixed step, so any place is reached at once."""
    s = (seed.cast("bigint").bitwiseAND(WORD) + _product(F.lit(0x6D2B79F5).cast("bigint"), (place.cast("bigint") + 1).bitwiseAND(WORD))).bitwiseAND(WORD)
    t = _product(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))
    t = (t + _product(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(WORD).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / float(1 << 32)
