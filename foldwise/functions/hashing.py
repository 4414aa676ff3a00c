"""Seeded shuffles as column expressions.

A "random" order has to be the same on every retry and on every engine, so it
is the order of ``md5(seed | key | ...)``.  The hexadecimal text sorts like the
number, is uniform for any key, and its leading digits make equal buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Text that stands for a NULL inside a hashed key.
NULL_KEY_TEXT = "\\N"


def key_columns(keys: str | Sequence[str]) -> list[str]:
    names = [keys] if isinstance(keys, str) else list(keys)
    if not names:
        raise ValueError("at least one key column is needed")
    return names


def shuffle_order(keys: str | Sequence[str], seed: int) -> Column:
    """32 hexadecimal digits that order the rows pseudo-randomly by key."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(NULL_KEY_TEXT)) for k in key_columns(keys)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_bucket(order: Column, digits: int = 4) -> Column:
    """Leading digits of a shuffle order: 16**digits equal buckets, in order."""
    return F.substring(order, 1, digits)


def hash_fold(keys: str | Sequence[str], n_splits: int, seed: int) -> Column:
    """Fold number by hash alone: no pass over the data, sizes only near equal."""
    digits = F.substring(shuffle_order(keys, seed), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n_splits)).cast("int")
