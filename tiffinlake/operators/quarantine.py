"""Separating bad rows from good ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.casting import cast_text

FAILED_RULES = "_failed_rules"


def flag_invalid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds the names of the rules a row breaks, empty for a good row.

    Rules are predicates that are true for a bad row; NULL does not condemn it.
    """
    broken = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return df.withColumn(FAILED_RULES, broken)


def good_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(FAILED_RULES) == "").drop(FAILED_RULES)


def bad_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(FAILED_RULES) != "")


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): two narrow filters over the same scan.

    Writing both reads ``df`` twice; to read a costly source once, store it flagged and filter that.
    """
    flagged = flag_invalid(df, rules)
    return good_rows(flagged), bad_rows(flagged)


def load_rules(keys: Mapping[str, str], malformed: str | None = None) -> dict[str, Column]:
    """What keeps a raw row out of the typed tables: a malformed line, or a key that has no value.

    ``keys`` maps raw key columns to their types.
    """
    rules = {f"no_{k}": cast_text(F.col(f"`{k}`"), kind).isNull() for k, kind in keys.items()}
    return ({"malformed": F.col(malformed).isNotNull()} if malformed else {}) | rules


def bad_key_rules(key: str) -> dict[str, Column]:
    """The two ways a staged file is known to go wrong: another delimiter, junk content."""
    text = F.col(key).cast("string")
    return {"wrong_delimiter": text.contains("|"), "junk": text.contains("junk")}
