"""Text to typed values. Tolerant casts give NULL on bad text, strict casts fail the job.

A failed ``try_cast`` or ``try_to_timestamp`` raises and catches an exception inside the JVM, some
ten microseconds per bad value. The tolerant casts therefore test the shape of the text first and
convert only what can succeed; on dirty columns that is an order of magnitude faster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ISO_T = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]"
ISO_SPACE = "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]"
ISO_DATE = "yyyy-MM-dd"
TIMESTAMP_FORMATS = (ISO_T, ISO_SPACE, ISO_DATE)

_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIMESTAMP_SHAPE = (
    rf"^{_DAY}([T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]{{1,9}})?(Z| ?[+-][0-9]{{2}}:[0-9]{{2}})?)?$"
)
_DATE_SHAPE = rf"^{_DAY}$"
_INTEGER_SHAPE = r"^[+-]?[0-9]+$"
_NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRUE_WORDS, _FALSE_WORDS = ["t", "true", "y", "yes", "1"], ["f", "false", "n", "no", "0"]


def cast_text(c: Column, data_type: str, strict: bool = False) -> Column:
    text = F.trim(c)
    if strict:
        return text.cast(data_type)
    if data_type in ("bigint", "int"):
        return F.when(text.rlike(_INTEGER_SHAPE), text.try_cast(data_type))
    if data_type.startswith("decimal") or data_type == "double":
        return F.when(text.rlike(_NUMBER_SHAPE), text.try_cast(data_type))
    if data_type == "boolean":
        word = F.lower(text)
        return F.when(word.isin(_TRUE_WORDS), F.lit(True)).when(word.isin(_FALSE_WORDS), F.lit(False))
    return text.try_cast(data_type)


def parse_timestamp(
    c: Column, formats: Sequence[str] = TIMESTAMP_FORMATS, strict: bool = False
) -> Column:
    """Timestamps in ISO form (``T`` or blank, up to nine decimals, optional offset) or as a date.

    Other ``formats`` are tried in turn and the first that fits wins; strict parsing takes one.
    """
    text = F.trim(c)
    if tuple(formats) == TIMESTAMP_FORMATS:
        if not strict:
            return F.when(text.rlike(_TIMESTAMP_SHAPE), text.try_cast("timestamp"))
        return (
            F.when(text.substr(11, 1) == "T", F.to_timestamp(text, ISO_T))
            .when(F.length(text) > 10, F.to_timestamp(text, ISO_SPACE))
            .otherwise(F.to_timestamp(text, ISO_DATE))
        )
    if strict:
        if len(formats) != 1:
            raise ValueError("strict parsing takes exactly one format")
        return F.to_timestamp(text, formats[0])
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_date(c: Column, fmt: str = ISO_DATE, strict: bool = False) -> Column:
    text = F.trim(c)
    if strict:
        return F.to_date(text, fmt)
    if fmt == ISO_DATE:
        return F.when(text.rlike(_DATE_SHAPE), text.try_cast("date"))
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
