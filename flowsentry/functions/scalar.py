"""Small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, default: float = 0.0) -> Column:
    """num / den, ``default`` when den is 0 (zero_division=0 semantics).

    ``try_divide`` keeps ANSI mode from raising on a zero denominator.
    """
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")),
                      F.lit(default))


def r6(c, places: int = 6) -> Column:
    """Round for cross-engine comparison; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def bad_double(c) -> Column:
    """True for NULL, NaN, +Inf and -Inf."""
    c = col(c)
    return (c.isNull() | F.isnan(c)
            | c.isin(F.lit(float("inf")), F.lit(float("-inf"))))


def is_numeric(dtype) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in set(exclude)]
