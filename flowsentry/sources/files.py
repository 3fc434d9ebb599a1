"""Scans and sinks.

* CSV directories are read per *header group*: files whose (trimmed) header
  lines agree are read in one multi-path scan (column match by position is
  safe inside a group); groups are combined with ``unionByName`` so reordered
  or extra columns line up by name, missing ones become NULL. Numbers are parsed
  without the blanks around them; string values keep theirs.
* Splits are one Parquet table partitioned by ``split``; readers get partition
  pruning instead of one file per split.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "positiveInf": "inf",
    "negativeInf": "-inf",
    "nanValue": "NaN",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, suffix: str = ".csv") -> list[str]:
    """Files under ``path`` (a file or a directory) ending in ``suffix``."""
    p, fs = _fs(spark, path)
    if fs.isFile(p):
        return [p.toString()]
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        s = it.next().getPath().toString()
        name = s.rsplit("/", 1)[-1]
        if s.endswith(suffix) and not name.startswith(("_", ".")):
            out.append(s)
    return sorted(out)


def read_header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """First line of a file, parsed as CSV, names trimmed (metadata read)."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, file)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine() or ""
    finally:
        stream.close()
    line = line.lstrip("﻿")
    return tuple(c.strip() for c in next(csv.reader(io.StringIO(line)), []))


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (values are left as they are)."""
    return df.toDF(*[c.strip() for c in df.columns])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """S3: union-all by column name; a column missing in a frame becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_flow_csv(spark: SparkSession, path: str, schema=None, infer: bool = True,
                  sampling_ratio: float = 1.0) -> DataFrame:
    """S1+S2+S3: all CSV files below ``path`` as one table.

    Pass ``schema`` (a StructType over trimmed names) after the first load:
    inference costs a full extra pass over the data.
    """
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no .csv files under {path}")
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault(read_header(spark, f), []).append(f)
    frames = []
    for header, fs in groups.items():
        if schema is not None:
            types = {f.name: f.dataType for f in schema.fields}
        elif infer:
            inferred = trim_columns(spark.read.options(**CSV_OPTIONS).option("inferSchema", "true")
                                    .option("samplingRatio", sampling_ratio).csv(fs))
            types = {f.name: f.dataType for f in inferred.schema.fields}
        else:
            types = {}
        # strings as they are written; the others are cut out of them
        raw = spark.read.schema(T.StructType([T.StructField(h, T.StringType()) for h in header])).csv(
            fs, header=True, enforceSchema=True)
        frames.append(raw.select(*(
            F.col(f"`{h}`") if isinstance(types.get(h, T.StringType()), T.StringType)
            else F.trim(F.col(f"`{h}`")).try_cast(types[h]).alias(h) for h in header)))
    return union_by_name(frames)


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """One table partitioned by split (CSV export with header optional)."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None,
               split_col: str = "split") -> DataFrame:
    """One split through partition pruning (all splits when None)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col(split_col) == split)


def label_column(df: DataFrame, expected: str = "Is_Anomaly", key: str | None = None) -> DataFrame:
    """A label table must have, besides ``key``, a single column or contain ``expected``.
    Returns the key, if any, and the label as ``expected``."""
    cols = [c for c in df.columns if c != key]
    if not (len(cols) == 1 or expected in cols):
        raise ValueError(f"label table must have one column or '{expected}', got {cols}")
    label = expected if expected in cols else cols[0]
    return df.select(*([key] if key else []), F.col(label).alias(expected))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result tables (tuning, sweep, summary, loss history)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str = "Model") -> DataFrame:
    """Replace rows whose key appears in ``new``, append the rest.

    Anti-joins on every key of ``new`` (the reference only checked the first
    new row's key, leaving duplicates for multi-row runs).
    """
    return (existing.join(new.select(key).distinct(), on=key, how="left_anti")
            .unionByName(new, allowMissingColumns=True))
