"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Terms are counted by length-bucketed packing. A task takes its documents in
chunks, sorted by (lang, source); a term of up to 8 bytes becomes one unsigned
64-bit word, one of up to 16 bytes two, padded with zeros (no term holds one).
A bucket is radix-sorted, 16 bits a pass, and its runs give occurrences and
documents of every (term, group). Longer terms are sorted as bytes, a bucket
for each length. What leaves a task is a row for each (group, term) and chunk;
the rest is Spark SQL, in exact integers.

Each language keeps the V terms that occur in at least ``min_docs`` of its
documents. With N the sum of the kept terms' counts in a group,
``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; two groups differ by
``f = floor((p - q)^2 / (p + q))`` in a term. The sum over all kept terms of a
pair of sources is taken over the terms that either has; all others have the
same f, so their number is enough. A language's terms are dealt over salts, and
a term that every document has is one row a chunk and group.

Defined results: null text, lang and source are empty strings; documents are
rows, so a repeated row counts again; a (lang, source) without terms still has
its ranks; a language without kept terms has pairs of value 0; ties in value
are ranked by item in UTF-8 order; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import batch_bytes, by_bytes
from flowsentry.session import materialise

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
SALTS = 64
CHUNK_BYTES = 8 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_spans(raw: np.ndarray, offsets: np.ndarray):
    """Starts and lengths of the terms of every row, and the row of each."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    letter = _LETTER[raw]
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    end[:-1] &= ~letter[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1


def _words(raw, starts, size, words):
    """The terms as ``words`` big-endian unsigned 64-bit words each, zero-padded."""
    view = np.lib.stride_tricks.sliding_window_view(raw, 8 * words)
    got = view[starts].copy()
    got[np.arange(8 * words) >= size[:, None]] = 0
    return got.view(">u8").astype(np.uint64)


def radix_order(words: np.ndarray) -> np.ndarray:
    """Stable order of the rows of unsigned 64-bit words: a counting sort for
    every 16 bits that differ at all, the last first."""
    order = np.arange(len(words))
    for col in range(words.shape[1] - 1, -1, -1):
        w = words[:, col]
        varies = int(np.bitwise_or.reduce(w ^ w[0])) if len(w) else 0
        for shift in range(0, 64, 16):
            if varies >> shift & 0xFFFF:
                digit = (w >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]  # radix sort for 16 bits
    return order


def _runs(same, order, doc, group):
    """Runs of equal terms (``same``: equal to the term before, in ``order``) within a
    group, the rows being in order of (group, document): the first row of each,
    occurrences and documents."""
    d, g = doc[order], group[order]
    new = np.ones(len(order), bool)
    new[1:] = ~same | (g[1:] != g[:-1])
    fresh = new.copy()
    fresh[1:] |= d[1:] != d[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(fresh, first, dtype=np.int64)


def count_terms(raw, starts, size, doc, group):
    """For every (term, group): a row that has it, occurrences, documents. ``doc`` and
    ``group`` are never falling."""
    out = []
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    for words in (1, 2):
        at = np.flatnonzero((size <= 8 * words) & (size > 8 * words - 8))
        if len(at):
            key = _words(padded, starts[at], size[at], words)
            order = radix_order(key)
            ordered = key[order]
            same = (ordered[1:] == ordered[:-1]).all(axis=1)
            row, n, docs = _runs(same, order, doc[at], group[at])
            out.append((at[row], n, docs))
    long = np.flatnonzero(size > 16)
    long = long[np.argsort(size[long], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(size[long], prepend=0)), len(long))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = long[lo:hi]
        width = int(size[at[0]])
        key = np.frombuffer(raw[(starts[at][:, None] + np.arange(width)).ravel()].tobytes(), dtype=f"S{width}")
        order = np.argsort(key, kind="stable")
        row, n, docs = _runs(key[order][1:] == key[order][:-1], order, doc[at], group[at])
        out.append((at[row], n, docs))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _count_chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch (lang, source, text)."""
    group = np.unique([f"{len(a)}:{a}{b}" for a, b in
                       zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)],
                      return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    batch, group = batch.take(pa.array(order)), group[order]
    raw, offsets = batch_bytes(batch.column(2))
    raw = _LOWER[raw]
    starts, size, doc = term_spans(raw, offsets)
    row, n, docs = count_terms(raw, starts, size, doc, group[doc])
    size, doc = size[row], pa.array(doc[row])
    at = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(starts[row] - at[:-1], size) + np.arange(at[-1])]
    term = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(doc), batch.column(1).take(doc), term.cast(pa.string()), pa.array(n, pa.int64()),
         pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of the term and documents with it, a
    row for every chunk that has it."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            offsets = batch_bytes(batch.column(2))[1]
            for lo, hi in by_bytes(offsets, CHUNK_BYTES):
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                if size >= CHUNK_BYTES:
                    yield _count_chunk(_joined(held))
                    held, size = [], 0
        if held:
            yield _count_chunk(_joined(held))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def _joined(batches):
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _share(n, total, terms):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals wide enough for any count."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) "
                  f"div cast({total} + 2 * {terms} as decimal(20,0))")


def _apart(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). ``pair``: every other source of the
    language by the sum of f against it; ``term``: the ``top`` kept terms that the
    source has and uses more than its language, by f against the language."""
    counted = term_counts(docs).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("has"))
    kept = materialise(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total", "has"), "kept-terms")

    # sizes: of every (lang, source) that occurs, and of every language
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sums = kept.select("lang", F.explode("has").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select(text("lang"), text("source")).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["size"])
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms_kept"), F.sum("total").alias("lang_size"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["terms_kept", "lang_size"])
    groups = materialise(groups, "audit-groups")

    # the terms a source has, with their share there and in the language
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
    sources = groups.groupBy("lang").agg(
        F.first("terms_kept").alias("terms_kept"), F.first("lang_size").alias("lang_size"),
        F.map_from_entries(F.collect_list(F.struct("source", "size"))).alias("sizes"))
    terms = kept.withColumn("salt", salt("term")).join(sources.withColumn("salt", all_salts), ["lang", "salt"])
    own = terms.select("lang", "term", "total", "terms_kept", "lang_size", "has", "sizes", F.explode("has").alias("source", "n"))
    own = own.withColumn("size", F.col("sizes")[F.col("source")]).withColumn("p", _share("n", "size", "terms_kept"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = own.withColumn("q", _share("total", "lang_size", "terms_kept")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

    met = own.select("lang", "source", "terms_kept", "p", "has", F.explode("sizes").alias("item", "item_size"))
    met = met.where(F.col("item") != F.col("source")).withColumn("m", F.coalesce(F.col("has")[F.col("item")], F.lit(0)))
    met = met.withColumn("q", _share("m", "item_size", "terms_kept")).withColumn("f", _apart("p", "q"))
    alone = F.col("m") == 0
    met = materialise(met.groupBy("lang", "source", "item").agg(
        F.sum("f").alias("f"), F.count(F.lit(1)).alias("terms"),
        F.sum(F.when(alone, F.col("f")).otherwise(0)).alias("alone_f"),
        F.sum(alone.cast("long")).alias("alone")), "audit-pairs")
    other = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"))
    swapped = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                         F.col("alone_f").alias("back_f"), F.col("alone").alias("back"))
    pair = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    pair = (pair.join(met.drop("alone_f", "alone"), ["lang", "source", "item"], "left")
            .join(swapped, ["lang", "source", "item"], "left").na.fill(0, ["f", "terms", "back_f", "back"]))
    # terms that neither has: all have the f of count 0
    pair = pair.withColumns({"p": F.when(F.col("terms_kept") > 0, _share("0", "size", "terms_kept")),
                             "q": F.when(F.col("terms_kept") > 0, _share("0", "item_size", "terms_kept"))})
    none = F.when(F.col("terms_kept") > 0, (F.col("terms_kept") - F.col("terms") - F.col("back")) * _apart("p", "q")).otherwise(0)
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item",
                       (F.col("f") + F.col("back_f") + none).cast("long").alias("value"))
    return pair.withColumn("rank", F.row_number().over(w)).union(term)
