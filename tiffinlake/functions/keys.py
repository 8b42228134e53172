"""Deterministic surrogate keys and null-safe value comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_NULL = "-"


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(*cols: Column | str) -> Column:
    """SHA-256 over the values in order, each as its length, a colon and its text, NULL as a dash.

    So no two lists of values share a text: ('x|', 'y') and ('x', '|y') differ, and NULL differs
    from every text. Pass instants as ``instant(c)``; as text they depend on the session's time zone.
    """
    texts = [_as_column(c).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(_NULL)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def packed_key(c: Column | str) -> Column:
    """A surrogate key as bytes for a shuffle: a digest of 64 hexadecimal digits takes 33, other text one more than it has."""
    text = _as_column(c).cast("string")
    digest = text.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(digest, F.concat(F.lit(b"\x00"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x01"), text.cast("binary")))


def unpacked_key(c: Column | str) -> Column:
    """The text that ``packed_key`` was given."""
    packed = _as_column(c)
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def instant(c: Column | str) -> Column:
    """A timestamp as microseconds since 1970 in UTC, whatever the session's time zone."""
    return F.unix_micros(_as_column(c).cast("timestamp"))


def change_hash(tracking_columns: Sequence[str]) -> Column:
    """Digest of the tracked attributes, for storing next to a row."""
    return hash_key(*tracking_columns)


def row_struct(cols: Sequence[str], alias: str | None = None) -> Column:
    """The columns as one struct, optionally taken from an aliased side of a join."""
    prefix = f"{alias}." if alias else ""
    return F.struct(*[F.col(f"{prefix}`{c}`").alias(c) for c in cols])


def same_values(cols: Sequence[str], left: str, right: str) -> Column:
    """True when every column is equal on both aliased sides, NULL equal to NULL."""
    return row_struct(cols, left).eqNullSafe(row_struct(cols, right))


def keys_equal(keys: Sequence[str], left: str, right: str) -> Column:
    """Plain equality on the keys: NULL keys match nothing, as in a merge."""
    condition = None
    for k in keys:
        one = F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`")
        condition = one if condition is None else condition & one
    return condition


def as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def as_timestamp(value) -> Column:
    """A batch timestamp given as a Column, a datetime or text."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("timestamp")
