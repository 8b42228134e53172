"""Bronze text to typed silver rows, driven by the entity specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import casting, geography, rules
from ..functions.keys import as_timestamp
from . import entities as en


def _typed(f: en.Field, raw: Column, strict: bool, availability_default: bool | None) -> Column:
    match f.kind:
        case en.KEY:
            return casting.cast_text(raw, "bigint", strict)
        case en.TEXT:
            return raw
        case en.TRIM:
            return F.trim(raw)
        case en.TS:
            return casting.parse_timestamp(raw, strict=strict)
        case en.DATE:
            return casting.parse_date(raw, strict=strict)
        case en.YES_NO:
            return rules.yes_no_flag(raw)
        case en.BOOL:
            return rules.boolean_flag(raw, default=availability_default)
        case _:
            return casting.cast_text(raw, f.kind, strict)


def to_silver(
    raw: DataFrame,
    entity: en.Entity,
    batch_ts=None,
    strict: bool = False,
    availability_default: bool | None = None,
) -> DataFrame:
    """One narrow projection: typed columns, the audit columns that came along, processing time.

    ``strict`` fails the job on the first value that does not convert; otherwise it becomes NULL.
    Processing time is the batch's own timestamp, so a rerun produces the same rows.
    """
    present = set(raw.columns)

    def source(f: en.Field) -> Column:
        name = f.raw if f.raw in present else entity.raw_aliases.get(f.raw, f.raw)
        return F.col(f"`{name}`")

    # The tag rides along as column metadata, where masking finds it.
    typed = [
        _typed(f, source(f), strict, availability_default).alias(
            f.name, **({"metadata": {"tag": f.tag}} if f.tag else {})
        )
        for f in entity.fields
    ]
    audit = [F.col(c) for c in raw.columns if c.startswith("_")]
    silver = raw.select(*typed, *audit)
    if entity is en.LOCATION:
        silver = geography.enrich_location(silver)
    if batch_ts is not None:
        silver = silver.withColumn("_silver_processed_dt", as_timestamp(batch_ts))
    return silver
