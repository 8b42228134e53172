"""Tag-based column masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import MASK_TOKENS


def tags_of(df: DataFrame) -> dict[str, str]:
    """Tags kept in the schema's column metadata."""
    return {f.name: f.metadata["tag"] for f in df.schema if "tag" in f.metadata}


def with_tags(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    for name, tag in tags.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "tag": tag})
    return df


def mask(
    df: DataFrame,
    tags: Mapping[str, str] | None = None,
    tokens: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replaces every value of a tagged column, NULL included, by the constant of its tag.

    Tags default to the schema metadata. A tag without a token (PRICE and SENSITIVE have no policy
    unless one is passed) leaves its columns readable.
    """
    tags = tags_of(df) if tags is None else tags
    tokens = {**MASK_TOKENS, **(tokens or {})}
    masked = {c: F.lit(tokens[t]) for c, t in tags.items() if t in tokens and c in df.columns}
    return df.withColumns(masked) if masked else df
