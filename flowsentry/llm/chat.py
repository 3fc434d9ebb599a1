"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is in turn the assistant: their turns are
rendered as ``<|assistant|>`` and masked in (trained on), the other speakers
appear as named users, system turns as ``<|system|>``.

A conversation can be as long as the table. Its turns are numbered by a range
sort and two-pass prefix sums (rows of each sorted partition, then offsets of
the partitions), and it is cut into examples of ``max_turns`` turns, so no
task ever holds more than one example; a chunk's example starts afresh.

Defined results: turns are ordered by (turn, role, text), nulls first; equal
rows are separate turns; a null text is empty; a null role is the speaker
``unknown``; a null conversation id is one conversation of its own; a
conversation of system turns only has no participant and no example. Marker
strings inside texts and names are broken with a backslash. Columns other than
the four named ones are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowsentry.llm.common import materialise

MAX_TURNS = 256
SYSTEM = "system"


def number_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``turns`` (conv, turn, role, text) with ``rank``, from 0, in each
    conversation. No window spans more than one conversation's rows of one
    sorted partition."""
    key = ["conv", "turn", "role", "text"]
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(n, *key).sortWithinPartitions(*key)
    # ids grow with the row inside a partition; the upper bits are the partition
    rows = materialise(dealt.withColumn("row", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("row", 33)
    first = (rows.groupBy("conv", part.alias("part"))
             .agg(F.min("row").alias("first"), F.count("*").alias("n")))
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    first = first.withColumnRenamed("conv", "conv_")
    rows = rows.withColumn("part_", part)
    return (rows.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part_") == F.col("part")))
            .withColumn("rank", F.col("row") - F.col("first") + F.col("before"))
            .select(*key, "rank"))


def _safe(col):
    return F.replace(col, F.lit("<|"), F.lit("<\\|"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text", system_role: str = SYSTEM,
           max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, n_target, text, mask: one example
    per conversation, participant and chunk of ``max_turns`` turns. ``mask``
    has the (start, end) code-point spans of ``text`` to train on: what the
    perspective's speaker says, end marker included."""
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = (number_turns(turns).withColumn("chunk", F.floor(F.col("rank") / max_turns))
              .groupBy("conv", "chunk")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("turns")))
    people = (turns.where(F.col("role") != system_role).select("conv", "role").distinct()
              .select(F.col("conv").alias("conv_"), F.col("role").alias("perspective")))
    both = chunks.join(people, F.col("conv").eqNullSafe(F.col("conv_")))

    def render(t):
        mine = t["role"] == F.col("perspective")
        head = (F.when(t["role"] == system_role, F.lit("<|system|>\n"))
                .when(mine, F.lit("<|assistant|>\n"))
                .otherwise(F.concat(F.lit("<|user:"), _safe(t["role"]), F.lit("|>\n"))))
        body = F.concat(_safe(t["text"]), F.lit("<|end|>\n"))
        return F.struct(mine.alias("mine"), head.alias("head"), body.alias("body"))

    def step(acc, s):
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["mine"], F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    zero = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")
    out = both.withColumn("s", F.transform("turns", render))
    return out.select(
        F.col("conv").alias("conv_id"), "perspective", "chunk",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("s", lambda x: x["mine"])).cast("long").alias("n_target"),
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("s", zero, step)["spans"].alias("mask"))
