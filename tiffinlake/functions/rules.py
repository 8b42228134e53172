"""Row-level business rules shared by the silver layer and the reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import fixed_values as fv


def yes_no_flag(c: Column) -> Column:
    """Known spellings become Y or N; anything else is kept as it is."""
    word = F.upper(F.trim(c))
    return (
        F.when(word.isin(fv.ACTIVE_WORDS), F.lit("Y"))
        .when(word.isin(fv.INACTIVE_WORDS), F.lit("N"))
        .otherwise(c)
    )


def boolean_flag(
    c: Column,
    true_words: Sequence[str] = tuple(fv.AVAILABLE_WORDS),
    false_words: Sequence[str] = tuple(fv.UNAVAILABLE_WORDS),
    default: bool | None = None,
) -> Column:
    word = F.upper(F.trim(c))
    return (
        F.when(word.isin(list(true_words)), F.lit(True))
        .when(word.isin(list(false_words)), F.lit(False))
        .otherwise(F.lit(default).cast("boolean"))
    )


def fill_missing_text(df: DataFrame, columns: Sequence[str] | None = None, token: str = "N/A") -> DataFrame:
    """NULL text becomes ``token``; columns of other types are left alone."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    subset = [c for c in text if columns is None or c in columns]
    return df.na.fill(token, subset) if subset else df


def category_rule(c: Column, members: Iterable, label: str, otherwise: Column | None = None) -> Column:
    """``label`` where the value is one of ``members``, else ``otherwise`` (default NULL)."""
    fallback = F.lit(None).cast("string") if otherwise is None else otherwise
    return F.when(c.isin(list(members)), F.lit(label)).otherwise(fallback)


def month_label(month: Column) -> Column:
    labels = F.array(*[F.lit(m) for m in fv.MONTH_LABELS])
    return F.try_element_at(labels, month.cast("int"))
