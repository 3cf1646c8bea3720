"""Keyed hashing, the engine's only source of randomness: the same in every engine, on every run and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 60


def key(*parts: Column | str | int) -> Column:
    """Parts joined by bars; a string is a literal, a Column its text."""
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def h60(text: Column) -> Column:
    """The first 60 bits of the text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(text: Column) -> Column:
    return h60(text) / F.lit(float(TOP))


def md5_mod(text: Column, modulus: int) -> Column:
    """The whole 128-bit MD5 modulo a small number, from its two halves. Null stays null."""
    digest = F.md5(text.cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % modulus
    carry = (1 << 64) % modulus
    return ((half(1) * carry + half(17)) % modulus).cast("int")
