"""Data-quality checks. Each is one aggregation, whatever the number of columns or bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.keys import as_list

EXAMPLES = 5


def _is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN where the type has it."""
    missing = F.col(f"`{c}`").isNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(F.col(f"`{c}`"))
    return missing


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_count) for each column, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count")) for c in columns]
    return counts.select(F.inline(F.array(*pairs)))


def primary_key(df: DataFrame, column: str | Sequence[str]) -> DataFrame:
    """Total, distinct and NULL keys. Unique means every non-NULL key occurs once."""
    columns = as_list(column)
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(f"`{c}`").isNull()
    # count(distinct ...) skips a key with a NULL part, as the check wants.
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(*[F.col(f"`{c}`") for c in columns]).alias("distinct_values"),
        F.count_if(any_null).alias("null_values"),
    ).select(
        F.lit(",".join(columns)).alias("pk_column"),
        "*",
        (F.col("distinct_values") + F.col("null_values") == F.col("total_records")).alias("is_unique"),
    )


def _fk_values(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Distinct values with their row counts and whether the reference has them.

    Both sides are reduced to distinct values first, so a value held by a third of all rows is one
    row by the time it is joined.
    """
    values = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).alias("v")
    known = ref.select(F.col(f"`{ref_column}`").alias("value")).distinct().alias("k")
    return values.join(known, F.col("v.value") == F.col("k.value"), "left").select(
        "v.value", "v.n", F.col("k.value").isNotNull().alias("found")
    )


def foreign_key(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    values = _fk_values(df, column, ref, ref_column)
    present = F.col("value").isNotNull()
    return values.agg(
        F.lit(column).alias("fk_column"),
        F.count_if(present).alias("distinct_values"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).cast("bigint").alias("null_values"),
        F.count_if(present & ~F.col("found")).alias("orphaned_values"),
    )


def orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Distinct values missing from the reference, with the number of rows that carry each."""
    values = _fk_values(df, column, ref, ref_column)
    return values.filter(F.col("value").isNotNull() & ~F.col("found")).select(
        F.col("value").alias(column), F.col("n").alias("row_count")
    )


def orphan_examples(df: DataFrame, column: str, ref: DataFrame, ref_column: str, n: int = EXAMPLES) -> DataFrame:
    return orphans(df, column, ref, ref_column).orderBy(column).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins (bin, bin_min, bin_max, row_count) between min and max, empty ones included.

    Bins are half-open except the last, which includes the maximum. When all values are equal they
    fall in bin 0.
    """
    value = F.col(f"`{column}`").cast("double")
    # One subquery for both ends: one extra pass over one column.
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("ends")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    position = F.when(width > 0, F.floor((value - lo) / width)).otherwise(F.lit(0))
    counts = (
        df.filter(value.isNotNull() & ~F.isnan(value))
        .groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_min"),
        (lo + (F.col("bin") + 1) * width).alias("bin_max"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(
        F.lit(column).alias("column_name"),
        F.count(c).alias("value_count"),
        F.avg(c).alias("mean"),
        F.stddev(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Groups of equal rows that occur more than once, with their counts."""
    columns = list(columns or df.columns)
    counts = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col("copies") > 1)


def duplicate_examples(df: DataFrame, columns: Sequence[str] | None = None, n: int = EXAMPLES) -> DataFrame:
    columns = list(columns or df.columns)
    return duplicates(df, columns).orderBy(*columns).limit(n)


def _report_rows(checks: DataFrame, check: str, target: Column, value: Column, ok: Column) -> DataFrame:
    return checks.select(
        F.lit(check).alias("check_name"),
        target.alias("target"),
        value.cast("bigint").alias("value"),
        ok.alias("ok"),
    )


def quality_report(
    df: DataFrame,
    not_null: Sequence[str] | None = None,
    pk: str | Sequence[str] | None = None,
    fks: Mapping[str, tuple[DataFrame, str]] | None = None,
    duplicate_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per check: (check_name, target, value, ok).

    ``value`` counts the offences: NULLs, surplus or missing keys, orphaned values, duplicate groups.
    """
    none = F.col("value") == 0
    nulls = null_counts(df, not_null).withColumnRenamed("null_count", "value")
    report = _report_rows(nulls, "not_null", F.col("column_name"), F.col("value"), none)
    if pk is not None:
        keys = primary_key(df, pk)
        surplus = F.col("total_records") - F.col("distinct_values") - F.col("null_values")
        report = report.unionByName(
            _report_rows(keys, "primary_key", F.col("pk_column"), surplus, F.col("is_unique"))
        )
    for column, (ref, ref_column) in (fks or {}).items():
        fk = foreign_key(df, column, ref, ref_column).withColumnRenamed("orphaned_values", "value")
        report = report.unionByName(_report_rows(fk, "foreign_key", F.col("fk_column"), F.col("value"), none))
    dup_columns = list(duplicate_columns or df.columns)
    dups = duplicates(df, dup_columns).agg(F.count(F.lit(1)).alias("value"))
    return report.unionByName(
        _report_rows(dups, "duplicates", F.lit(",".join(dup_columns)), F.col("value"), none)
    )


def verdict(report: DataFrame) -> DataFrame:
    """Whether any check of the report failed."""
    return report.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("has_issues"),
    )


def check_constraints(df: DataFrame, entity, refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The constraints an entity declares (NOT NULL, UNIQUE, foreign keys) as a quality report.

    ``refs`` maps entity names to their silver tables; foreign keys without one are skipped.
    """
    refs = refs or {}
    fks = {
        k.column: (refs[k.entity], k.ref_column) for k in entity.foreign_keys if k.entity in refs
    }
    return quality_report(df, entity.required or entity.keys, list(entity.keys), fks, list(entity.keys))


def reconcile(layers: Mapping[str, DataFrame], sums: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Row counts and sums per layer next to those of the first one: (layer, metric, value, expected, ok)."""
    names = list(layers)
    baseline = baseline or names[0]

    def metrics(name: str, df: DataFrame) -> DataFrame:
        totals = df.agg(
            F.count(F.lit(1)).cast("decimal(38,2)").alias("row_count"),
            *[F.coalesce(F.sum(F.col(f"`{c}`").cast("decimal(28,2)")), F.lit(0)).cast("decimal(38,2)").alias(c) for c in sums],
        )
        rows = [
            F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in ["row_count", *sums]
        ]
        return totals.select(F.lit(name).alias("layer"), F.inline(F.array(*rows)))

    per_layer = None
    for name in names:
        one = metrics(name, layers[name])
        per_layer = one if per_layer is None else per_layer.unionByName(one)
    expected = metrics(baseline, layers[baseline]).select("metric", F.col("value").alias("expected"))
    return per_layer.join(expected, "metric").select(
        "layer", "metric", "value", "expected", (F.col("value") == F.col("expected")).alias("ok")
    )


def missing_entities(
    spark: SparkSession, loads: DataFrame, required: Sequence[str], execution_date: str
) -> DataFrame:
    """Required entities with no load for a batch date. Gold may be built when this is empty.

    ``loads`` has one or more rows (entity, _execution_date) per load.
    """
    day = F.lit(execution_date).cast("date")
    names = F.array(*[F.lit(e) for e in required])
    expected = spark.range(1).select(F.explode(names).alias("entity"))
    present = loads.filter(F.to_date("_execution_date") == day).select("entity").distinct()
    return expected.join(present, "entity", "left_anti").withColumn("execution_date", day)


def layer_counts(layers: Mapping[str, DataFrame], batch_column: str = "_execution_date") -> DataFrame:
    """(layer, batch, row_count) for every layer and batch date."""
    result = None
    for name, df in layers.items():
        one = df.groupBy(F.to_date(batch_column).alias("batch_date")).agg(F.count(F.lit(1)).alias("row_count"))
        one = one.select(F.lit(name).alias("layer"), "batch_date", "row_count")
        result = one if result is None else result.unionByName(one)
    return result


def anomalies(kpi: DataFrame, metric: str, z: float = 3.0) -> DataFrame:
    """Every KPI row with its z-score against all rows, flagged beyond ``z`` standard deviations."""
    value = F.col(metric).cast("double")
    stats = kpi.agg(F.struct(F.avg(value).alias("mean"), F.stddev(value).alias("sd")).alias("s")).scalar()
    mean, sd = stats.getField("mean"), stats.getField("sd")
    score = F.when(sd > 0, (value - mean) / sd).otherwise(F.lit(0.0))
    return kpi.withColumn("z_score", score).withColumn("is_anomaly", F.abs("z_score") > z)
