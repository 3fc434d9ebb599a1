"""Line dedup: repeated runs of lines by a suffix array.

The lines that occur more than once (others can be in no repeated run) form
segments; the suffixes of all segments are sorted by prefix doubling: the rank
of a suffix by its first 2d lines is the rank of the pair (rank by d lines of
the suffix, rank by d lines of the one d lines on), until no class splits any
more. A rank is the row number of a class in a range-partitioned sort, so no
task holds more than its part of the classes. Neighbours in the suffix array
get their longest common prefix from the ranks, by binary descent. Stretches
of the array whose common prefixes stay long enough are the intervals of one
repeated run; all its suffixes but the first in document order are later
copies, and their lines are deleted.

A run counts from ``min_lines`` lines on, or from fewer that have
``min_chars`` characters together. Later copies that overlap or touch make one
maximal deleted run; blank lines inside it go too, other blank lines neither
make nor break runs.

Defined results: documents are ordered by (doc_id, hash of the text), null
ids first; lines by place. Rows equal in both are one document, and each gets
its result. A null text stays null, an empty one empty; a document whose
lines all go gets the empty text. Other columns pass unchanged. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowsentry.llm.common import materialise

MIN_LINES = 2
MIN_CHARS = 50


def _ranked(df: DataFrame, *key: str) -> DataFrame:
    """``df`` in the order of ``key`` with ``row``, increasing and unique; written,
    so that the numbers stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *key).sortWithinPartitions(*key)
    return materialise(dealt.withColumn("row", F.monotonically_increasing_id()), "line-ranks")


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus: none is broadcast."""
    return left.join(right.hint("merge"), on, how)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(g, doc, left, r, chars, line, seq, doc_id, text_key): the lines that occur more than
    once. g grows in document order, and by 1 inside a segment, of which ``left`` lines
    are left; r numbers the different lines."""
    numbered = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
                        F.posexplode(F.filter(numbered, lambda z: z["s"].rlike(r"\S"))).alias("seq", "z"))
    lines = split.select("doc_id", "text_key", "seq", F.col("z.line").alias("line"),
                         # columns are chained: a constant in front seeds the second hash anew
                         F.xxhash64("z.s").alias("h1"), F.xxhash64(F.lit(1), "z.s").alias("h2"),
                         F.length("z.s").alias("chars"))
    lines = materialise(lines, "lines")
    names = _ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where(F.col("c") > 1).drop("c"),
                    "h1", "h2").withColumnRenamed("row", "r")
    again = _join(lines, names, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["doc_id", "text_key", "seq"])
    # a document's lines are in one partition: their numbers are consecutive
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "text_key"]
    again = materialise(again.repartitionByRange(n, *key).sortWithinPartitions(*key, "seq")
                        .withColumn("g", F.monotonically_increasing_id()), "repeated-lines")
    own = Window.partitionBy(*key)
    segment = Window.partitionBy(*key, F.col("g") - F.col("seq"))
    return (again.withColumn("doc", F.min("g").over(own))
            .withColumn("left", F.max("g").over(segment) - F.col("g") + 1))


def suffix_array(suffixes: DataFrame, keep: int = MIN_LINES) -> tuple[DataFrame, list[int]]:
    """``suffixes`` (g, doc, left, r, ...) in the order of the lines that they begin with: the
    array, numbered by ``row`` in order, with r0, r1.., the ranks by 1, 2, 4.. lines up to
    ``keep``, and those depths."""
    now = suffixes.withColumn("r0", F.col("r"))
    depths, depth, classes = [1], 1, -1
    while True:
        ahead = F.lead("r", depth).over(Window.partitionBy("doc").orderBy("g"))
        pairs = now.withColumn("next", F.coalesce(F.when(F.col("left") > depth, ahead), F.lit(-1).cast("long")))
        pairs = materialise(pairs, "suffixes")
        names = _ranked(pairs.select("r", "next").distinct(), "r", "next")
        n = names.count()
        now = _join(pairs, names, ["r", "next"]).drop("r", "next").withColumnRenamed("row", "r")
        depth *= 2
        if depth <= keep:
            now = now.withColumn(f"r{len(depths)}", F.col("r"))
            depths.append(depth)
        if n == classes and depth >= keep:  # longer prefixes split no class any more
            break
        classes = n
    return _ranked(now, "r", "g"), depths


def _neighbours(array: DataFrame, columns: list[str]) -> DataFrame:
    """The array with ``prev``, ``columns`` of the suffix before, and ``part``, its sorted partition."""
    array = array.withColumn("part", F.shiftright("row", 33)).withColumn("own", F.struct(*columns))
    inside = array.withColumn("prev", F.lag("own").over(Window.partitionBy("part").orderBy("row")))
    # the last suffix of each partition: one row a partition
    last = array.groupBy("part").agg(F.max_by("own", "row").alias("own"))
    last = last.select("part", F.lag("own").over(Window.orderBy("part")).alias("carried"))
    return inside.join(last, "part").withColumn("prev", F.coalesce("prev", "carried")).drop("carried", "own")


def common_prefixes(array: DataFrame, depths: list[int], cap: int) -> DataFrame:
    """The array with prev, part and ``lcp``: lines in common with the suffix before, up to ``cap``.

    Descent over the ranks from the deepest. What the first levels compare are
    the two suffixes themselves; only after a match do deeper places count,
    whose ranks are looked up."""
    ranks = [f"r{k}" for k in range(len(depths))]
    out = _neighbours(array, ["g", *ranks]).withColumn("lcp", F.lit(0).cast("long"))
    top = len(depths) - 1
    for k in range(top, -1, -1):
        room = F.col("lcp") + depths[k] <= cap
        if k == top or (k == top - 1 and depths[top] == cap):
            same = room & (F.col(ranks[k]) == F.col(f"prev.{ranks[k]}"))
            out = out.withColumn("lcp", F.col("lcp") + F.when(same, depths[k]).otherwise(0))
            continue
        level = array.select("g", F.col(ranks[k]).alias("rank"))
        ours = level.select(F.col("g").alias("g1"), F.col("rank").alias("rank1"))
        theirs = level.select(F.col("g").alias("g2"), F.col("rank").alias("rank2"))
        none = -1 - F.col("row")  # matches nothing, and deals such rows out evenly
        out = _join(out, ours, F.col("g1") == F.when(room, F.col("g") + F.col("lcp")).otherwise(none), "left")
        out = _join(out, theirs, F.col("g2") == F.when(room & F.col("prev").isNotNull(), F.col("prev.g") + F.col("lcp"))
                    .otherwise(none), "left")
        out = (out.withColumn("lcp", F.col("lcp") + F.when(F.col("rank1") == F.col("rank2"), depths[k]).otherwise(0))
               .drop("g1", "g2", "rank1", "rank2"))
    return out


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(g, need): the suffixes whose first ``need`` lines, a run that counts, stand earlier too."""
    # the shortest prefix that counts; what it is depends on its lines alone
    order = Window.partitionBy("doc").orderBy("g")
    need = F.when(F.col("left") >= min_lines, min_lines)
    chars = F.col("chars").cast("long")
    for q in range(min_lines - 1, 0, -1):
        total = chars
        for d in range(1, q):
            total = total + F.lead("chars", d).over(order)
        need = F.when((F.col("left") >= q) & (total >= min_chars), q).otherwise(need)
    array, depths = suffix_array(lines.select("g", "doc", "left", "r", need.alias("need")), min_lines)
    lcp = materialise(common_prefixes(array, depths, min_lines), "line-lcp")
    # an interval goes from one break to the next
    brk = F.when(F.coalesce(F.col("lcp") < F.col("need"), F.lit(True)) | F.col("prev").isNull(), F.col("row"))
    here = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    before = lcp.groupBy("part").agg(F.max(brk).alias("b")).select(
        "part", F.max("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    runs = lcp.withColumn("head", F.max(brk).over(here)).join(before, "part")
    runs = materialise(runs.select("g", "need", F.coalesce("head", "carried").alias("head")), "line-intervals")
    # written, so that the join below can split a run that very many documents share
    first = materialise(runs.groupBy("head").agg(F.min("g").alias("first")), "line-firsts")
    return _join(runs, first, "head").where((F.col("g") > F.col("first")) & F.col("need").isNotNull()).select("g", "need")


def deleted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, runs): the runs to delete, array of (start, end) line numbers in order."""
    lines = materialise(repeated_lines(docs, id_col, text_col), "repeated-lines")
    copies = later_copies(lines, min_lines, min_chars)
    gone = copies.select(F.explode(F.sequence("g", F.col("g") + F.col("need") - 1)).alias("g")).distinct()
    gone = _join(gone, lines, "g").select("doc_id", "text_key", "line", "seq", "g")
    own = Window.partitionBy("doc_id", "text_key").orderBy("seq")
    island = gone.withColumn("island", F.col("seq") - F.row_number().over(own))
    runs = island.groupBy("doc_id", "text_key", "island").agg(
        F.min("line").alias("start"), (F.max("line") + 1).alias("end"))
    return runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the later copies of repeated line runs, and ``deleted_runs``:
    array of (start, end) line numbers of the text before (it replaces a column of that name)."""
    runs = materialise(deleted_runs(docs, id_col, text_col, min_lines, min_chars), "line-runs")
    runs = runs.withColumnsRenamed({"doc_id": "d_", "text_key": "k_"})
    text = F.col(text_col).cast("string")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), text.alias("text"))
    rows = rows.withColumns({"doc_id": F.col(f"row.`{id_col}`"), "text_key": F.xxhash64("text")})
    out = _join(rows, runs, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("text_key").eqNullSafe(F.col("k_")), "left")
    out = out.withColumn("lines", F.when(F.col("runs").isNotNull(), _lines(F.col("text"))))
    # what lies between the runs
    at = lambda j, f, other: F.when((j >= 0) & (j < F.size("runs")), F.get("runs", j)[f]).otherwise(other)
    between = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda j: F.slice(
        "lines", at(j - 1, "end", F.lit(0)) + 1,
        F.greatest(F.lit(0), at(j, "start", F.size("lines")) - at(j - 1, "end", F.lit(0)))))
    out = out.withColumn("kept", F.when(F.col("runs").isNull(), F.col("text"))
                         .otherwise(F.array_join(F.flatten(between), "\n")))
    return out.select(
        *(F.col("kept" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns if c != "deleted_runs"),
        F.coalesce("runs", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("deleted_runs"))
