"""The corpus pipeline: five stages over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all that its
predecessor kept, and is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; other columns of
``docs`` are left out. A null text counts as an empty one, and every stage takes
null ids, repeated rows, one id with different texts, very long texts and an empty
table (which gives an empty result).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import decontam, line_dedup, packing, quality, simhash
from flowsentry.llm.common import materialise, table
from flowsentry.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go. Empty and null texts
    have a score like any other; rows with the same text have the same one."""
    ship_package(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays, with an empty text if nothing
    is left and a null one as null. Rows equal in id and text are one document and keep
    the same lines; ``n_chars`` is that of the text left."""
    ship_package(spark)
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the rows of its smallest id stay, and rows without id. A
    document is told by (doc_id, hash of its text): a repeated id with different texts
    is judged text by text, each in the group of its own."""
    ship_package(spark)
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    key = ["doc_id", "text_key"]
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(*key).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return rows.join(materialise(gone, "near-duplicates"), key, "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; empty and null texts hold none, and
    an item without words is in no document."""
    ship_package(spark)
    return decontam.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of full sequences with their token ids. An empty or null text is the
    end id alone; a repeated row is packed as often as it occurs."""
    import public_tokenizers
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# A fitted classifier, 64-bit fingerprints and a tokenizer are beyond SQL: the
# tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result but the last is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage-" + name.replace(" ", "-"))
    return docs
