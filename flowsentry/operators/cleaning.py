"""Cleaning, label encoding and column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import FLOAT_TYPES, bad_double, is_numeric


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def inf_to_null(df: DataFrame) -> DataFrame:
    """C1 (+X5): +-Inf and NaN become NULL in float columns (only they can hold them)."""
    fl = set(float_columns(df))
    return df.select(*[F.when(bad_double(c), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in fl else F.col(c) for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    """C1+C2: drop every row with a NULL/NaN/Inf in any column (label included).

    Replacing Inf by NaN and then dropping NaN rows keeps exactly the rows
    with no bad value, so this is one conjunctive filter: no projection, and
    the NOT NULL parts reach the Parquet scan as pushed filters.
    """
    fl = set(float_columns(df))
    cond = None
    for c in df.columns:
        ok = ~bad_double(c) if c in fl else F.col(c).isNotNull()
        cond = ok if cond is None else (cond & ok)
    return df if cond is None else df.where(cond)


def clean_report(df: DataFrame) -> DataFrame:
    """Rows in/out/dropped and per-column bad counts, one pass, long form."""
    fl = set(float_columns(df))
    bad = {c: (bad_double(c) if c in fl else F.col(c).isNull()) for c in df.columns}
    any_bad = None
    for e in bad.values():
        any_bad = e if any_bad is None else (any_bad | e)
    aggs = [F.count(F.lit(1)).alias("rows_in"), F.count_if(any_bad).alias("rows_dropped")]
    aggs += [F.count_if(e).alias(f"bad:{c}") for c, e in bad.items()]
    wide = df.agg(*aggs).withColumn("rows_out", F.col("rows_in") - F.col("rows_dropped"))
    names = ["rows_in", "rows_out", "rows_dropped"] + [f"bad:{c}" for c in df.columns]
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (metric, value)") \
               .select("metric", F.col("value").cast("long").alias("value"))


def encode_label(df: DataFrame, label: str = "Label", normal: str | None = "BENIGN",
                 anomaly: str | None = None, out: str = "y") -> DataFrame:
    """C4: exactly ``normal`` -> 0, anything else -> 1 (or ``anomaly`` -> 1, else 0)."""
    c = F.col(label)
    e = (F.when(c == anomaly, 1).otherwise(0) if anomaly is not None
         else F.when(c == normal, 0).otherwise(1))
    return df.withColumn(out, e.cast("int"))


def class_filter(df: DataFrame, cls: int, y: str = "y") -> DataFrame:
    """Rows of one class."""
    return df.where(F.col(y) == cls)


def column_variances(df: DataFrame, cols: list[str]) -> DataFrame:
    """sample variance per column (ddof 1), one aggregate, long form."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', {i}, `{c}`" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, ordinal, variance)")


def zero_variance_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Columns whose sample variance is exactly 0 (NULL variance is kept)."""
    cols = cols or [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] == 0.0]


def non_numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns that are not numeric (from the schema, no data read)."""
    return [f.name for f in df.schema.fields
            if not is_numeric(f.dataType) and f.name not in set(exclude)]


def select_features(df: DataFrame, keep=("row_id", "y"), drop=()) -> tuple[DataFrame, list[str]]:
    """C5+C6+C7: drop named columns, constant columns and non-numeric columns.

    Returns the projected frame and the selected feature list (an artefact to
    store with the scaler statistics).
    """
    keep = [k for k in keep if k in df.columns]
    cand = [c for c in df.columns if c not in set(keep) | set(drop)]
    numeric = [c for c in cand if c not in set(non_numeric_columns(df))]
    const = set(zero_variance_columns(df, numeric)) if numeric else set()
    feats = [c for c in numeric if c not in const]
    return df.select(*keep, *feats), feats
