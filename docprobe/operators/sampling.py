"""Reproducible choices from md5 counters: the same on every retry, in any order, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *keys: Column | int | str) -> Column:
    """A BIGINT in [0, 2**32): the first eight hex digits of md5('seed:purpose:key:...')."""
    parts = [F.lit(f"{seed}:{purpose}"), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def below(seed: int, purpose: str, n: Column, *keys: Column | int | str) -> Column:
    """A BIGINT in [0, n); null for n = 0."""
    return F.when(n > 0, draw(seed, purpose, *keys) % n)


def between(seed: int, purpose: str, lo: Column, hi: Column, *keys: Column | int | str) -> Column:
    """An INT in [lo, hi], both included."""
    return (lo + below(seed, purpose, hi - lo + 1, *keys)).cast("int")


def unit(seed: int, purpose: str, *keys: Column | int | str) -> Column:
    """A DOUBLE in [0, 1)."""
    return draw(seed, purpose, *keys) / F.lit(4294967296.0)


def order_key(seed: int, purpose: str, *keys: Column | int | str) -> Column:
    """A text to order by for a shuffle; add a unique column behind it."""
    parts = [F.lit(f"{seed}:{purpose}"), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))
