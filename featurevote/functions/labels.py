"""Column expressions for labels, path parts, stable row ids and stable batches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurevote.values import LABEL_PATTERN, LABEL_TO_INT


def label_from_path(path: Column, pattern: str = LABEL_PATTERN) -> Column:
    """First group of ``pattern`` in the path, or ``''`` when nothing matches."""
    return F.regexp_extract(path, pattern, 1)


def label_to_int(label: Column, mapping: Mapping[str, int] = LABEL_TO_INT) -> Column:
    """Map a class name to its number; unknown names become NULL."""
    return _lookup(label, mapping)


def int_to_label(number: Column, mapping: Mapping[str, int] = LABEL_TO_INT) -> Column:
    """Inverse of :func:`label_to_int` for the same mapping."""
    return _lookup(number, {v: k for k, v in mapping.items()})


def _lookup(key: Column, mapping: Mapping) -> Column:
    (first, value), *rest = mapping.items()
    return reduce(
        lambda chain, kv: chain.when(key == F.lit(kv[0]), F.lit(kv[1])),
        rest,
        F.when(key == F.lit(first), F.lit(value)),
    )


def constant_label(value: int) -> Column:
    return F.lit(int(value))


def path_segment(path: Column, from_end: int = 1) -> Column:
    """The n-th path segment counted from the end (1 = file name), NULL when absent."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def tag_if_contains(path: Column, text: str, yes: str, no: str) -> Column:
    """``yes`` when the path contains ``text``, else ``no``."""
    return F.when(F.contains(path, F.lit(text)), F.lit(yes)).otherwise(F.lit(no))


def row_identity(*key: Column) -> Column:
    """64-bit row id from the row's natural key.

    Unlike a positional id it does not depend on partition layout, so tables written by
    different jobs can be aligned on it.
    """
    return F.xxhash64(*key)


def key_hash(key: Column) -> Column:
    """Non-negative 32-bit number from the MD5 of the key's text; same in any SQL engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def stable_batch(key: Column, n_batches: int, first: int = 1) -> Column:
    """Batch number ``first .. first+n_batches-1`` that depends on the key alone."""
    return (key_hash(key) % F.lit(n_batches) + F.lit(first)).cast("int")
