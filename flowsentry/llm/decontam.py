"""Benchmark decontamination by a positional inverted index.

The training texts are indexed once: a posting (term, document, position) for
every occurrence of a term of the benchmark, stored as a table. For every
window of a benchmark item the terms are ordered by their corpus frequency.
The posting list of its rarest term gives the candidate alignments (document,
item, offset between them); the lists of the next rarest, moved by their place
in the window, are intersected with them by equi-joins; the alignments left are
compared word by word with the text. A window with a term that the corpus
lacks is dropped before any list is read. Everything is DataFrame expressions.

``phrase_hits`` returns exact phrase matches, ``proximity_matches`` the places
where the rarest terms of an item stand close together in any order, ``hits`` the
first with the number of items met by the second, from the same postings.

Defined results: a null text has no words; a document is told by (id, hash of
its text), nulls equal, so that repeated ids with different texts are kept
apart and repeated rows get the same result each; items are told by id, a
repeated item counts once, items without id are left out; extra columns are
ignored; an empty benchmark hits nothing; an empty corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowsentry.llm.common import ascii_lower, materialise

WINDOW = 10
PROBES = 3
N_TERMS = 3
WITHIN = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of a-z, 0-9 and what is not ASCII."""
    low = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words) of the items with words."""
    got = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    return materialise(got.where(F.size("words") > 0).distinct(), "items")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
                       words(F.col(text_col)).alias("words"))


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, terms): postings (term_id, doc_id, text_key, pos) of the terms of
    ``items`` in ``docs``; terms (term, term_id, freq)."""
    vocab = materialise(items.select(F.explode("words").alias("term")).distinct()
                        .withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    tokens = _documents(docs, id_col, text_col).select(
        "doc_id", "text_key", F.posexplode("words").alias("pos", "term"))
    postings = materialise(tokens.join(vocab, "term").select("term_id", "doc_id", "text_key", "pos"), "postings")
    freq = postings.groupBy("term_id").agg(F.count("*").alias("freq"))
    return postings, materialise(vocab.join(freq, "term_id"), "terms")


def _probes(items: DataFrame, terms: DataFrame, window: int, probes: int) -> DataFrame:
    """One row per different set of rarest places of the windows: item_id, p0.. (the
    places in the item, rarest first) and t0.. (their terms)."""
    at = items.select("item_id", "words", F.posexplode("words").alias("place", "term")).join(terms, "term")
    # an item's own words: bounded by the longest item
    known = at.groupBy("item_id", "words").agg(
        F.sort_array(F.collect_list(F.struct("place", "freq", "term_id"))).alias("known"))
    n = F.least(F.lit(window), F.size("words"))
    windows = known.select("item_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("w"), "known")
    inside = F.filter("known", lambda x: (x["place"] >= F.col("w")) & (x["place"] < F.col("w") + F.col("n")))
    rare = F.array_sort(F.transform(inside, lambda x: F.struct(x["freq"], x["place"], x["term_id"])))
    full = windows.withColumn("r", rare).where(F.size("r") == F.col("n"))  # every term occurs
    pick = lambda i, f: F.element_at("r", F.least(F.lit(i + 1), F.col("n")))[f]
    return materialise(full.select("item_id", *(pick(i, "place").alias(f"p{i}") for i in range(probes)),
                                   *(pick(i, "term_id").alias(f"t{i}") for i in range(probes))).distinct(), "probes")


def alignments(items: DataFrame, postings: DataFrame, terms: DataFrame, window: int = WINDOW,
               probes: int = PROBES) -> DataFrame:
    """(doc_id, text_key, item_id, shift): the document's word ``shift`` + i stands where the
    item's word i does, in some window that its ``probes`` rarest terms leave possible."""
    plan = _probes(items, terms, window, probes)
    key = ["doc_id", "text_key"]
    found = (postings.join(plan, F.col("term_id") == F.col("t0"))
             .withColumn("shift", F.col("pos") - F.col("p0")).drop("term_id", "pos"))
    for i in range(1, probes):
        wanted = plan.select(F.col(f"t{i}").alias("term_id")).distinct()
        lists = (postings.join(wanted, "term_id")
                 .select(F.col("doc_id").alias("d_"), F.col("text_key").alias("k_"),
                         F.col("pos").alias("pos_"), F.col("term_id").alias("t_")))
        found = found.join(lists, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("text_key").eqNullSafe(F.col("k_"))
                           & (F.col("pos_") == F.col("shift") + F.col(f"p{i}")) & (F.col("t_") == F.col(f"t{i}")),
                           "left_semi")
    return found.select(*key, "item_id", "shift").distinct()


def _matching(items, postings, terms, window, probes) -> DataFrame:
    """(d_, k_, found): the alignments of every document that has some, with the items' words."""
    found = alignments(items, postings, terms, window, probes)
    # the alignments of a document: no more than its postings of the rarest terms
    per_doc = (found.join(items.select("item_id", F.col("words").alias("item")), "item_id")
               .groupBy("doc_id", "text_key")
               .agg(F.collect_list(F.struct("item_id", "shift", "item")).alias("found"))
               .withColumnsRenamed({"doc_id": "d_", "text_key": "k_"}))
    return materialise(per_doc, "alignments")


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("text_key").eqNullSafe(F.col("k_"))


def _spans(window: int, all_words: Column) -> Column:
    """(item_id, start, length) of the windows of ``found`` that occur in ``all_words``."""
    def occurring(f, own):
        n = F.least(F.lit(window), F.size(f["item"]))
        same = F.transform(f["item"], lambda w, i: F.coalesce(
            F.when(f["shift"] + i >= 0, F.get(own, f["shift"] + i)) == w, F.lit(False)))
        starts = F.filter(F.sequence(F.lit(0), F.size(f["item"]) - n),
                          lambda s: ~F.array_contains(F.slice(same, s + 1, n), False))
        return F.transform(starts, lambda s: F.struct(
            f["item_id"].cast("string").alias("item_id"), (f["shift"] + s).alias("start"), n.alias("length")))

    none = F.expr("cast(array() as array<struct<item_id:string,start:int,length:int>>)")
    # the words are bound to a variable: split once a row, wherever the optimizer puts this
    bound = F.transform(F.array(all_words), lambda own: F.flatten(F.transform("found", lambda f: occurring(f, own))))
    return F.when(F.col("found").isNull(), none).otherwise(F.get(bound, F.lit(0)))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a
    window), items (sorted ids, as strings, of the items with an occurring window), and
    ``spans`` (item_id, start, length), one for each occurrence of a window."""
    items = benchmark_items(benchmark, item_col)
    index = (items, *build_index(docs, items, id_col, text_col))
    return _phrase_hits(docs, index, id_col, text_col, window, probes).drop("text_key")


def _phrase_hits(docs, index, id_col, text_col, window, probes) -> DataFrame:
    """``phrase_hits`` and text_key, from a stored index."""
    # grows with the corpus, and repeated words make it far larger than its file
    found = _matching(*index, window, probes).hint("merge")
    # texts travel, their words are made afterwards
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).join(found, _same_document(), "left")
    rows = rows.withColumn("words", words(F.col("text")))
    rows = rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), _spans(window, F.col("words")).alias("spans"))
    hit = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return rows.select("doc_id", "text_key", "n_words",
                       F.when(F.size("spans") > 0, F.size(hit)).otherwise(0).cast("long").alias("n_hit"),
                       F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("items"),
                       "spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", window: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    items = benchmark_items(benchmark, item_col)
    per_doc = _matching(items, *build_index(docs, items, id_col, text_col), window, probes)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"doc_id": F.col(f"row.`{id_col}`"), "text_key": F.xxhash64(F.col("text").cast("string"))})
    rows = rows.join(per_doc.hint("merge"), _same_document(), "left")
    return rows.where(F.size(_spans(window, words(F.col("text")))) == 0).select(
        *(F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns))


def _near_items(items: DataFrame, postings: DataFrame, terms: DataFrame, n_terms: int, within: int) -> DataFrame:
    """``proximity_matches`` from a stored index."""
    need = items.select("item_id", "words", F.explode(F.array_distinct("words")).alias("term")).join(terms, "term", "left")
    rare = F.slice(F.array_sort(F.collect_list(F.struct(
        F.coalesce("freq", F.lit(0)).alias("freq"), "term", "term_id"))), 1, n_terms)
    plan = need.groupBy("item_id", "words").agg(rare.alias("r")).where(F.col("r")[0]["freq"] > 0)
    plan = materialise(plan.select("item_id", "r", F.monotonically_increasing_id().alias("plan_id")), "proximity-probes")
    uses = plan.select("item_id", "plan_id", F.size("r").alias("n"), F.posexplode("r").alias("slot", "o")).select(
        "item_id", "plan_id", "n", "slot", F.col("o.term_id").alias("term_id"))
    met = postings.join(uses, "term_id").drop("term_id").distinct()  # repeated rows count once
    # a document's words around a place
    around = Window.partitionBy("doc_id", "text_key", "plan_id").orderBy("pos").rangeBetween(-within, within)
    return (met.withColumn("m", F.size(F.collect_set("slot").over(around)))
            .where((F.col("slot") == 0) & (F.col("m") == F.col("n")))
            .select("doc_id", "text_key", "item_id", "pos").distinct())


def proximity_matches(docs: DataFrame, benchmark: DataFrame, n_terms: int = N_TERMS, within: int = WITHIN,
                      id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, text_key, item_id, pos): places of an item's rarest term with the next
    ``n_terms`` - 1 rarest of its different terms at most ``within`` words away, in any
    order; equally rare terms in their own order. Items with fewer different terms need
    all they have; a term that the corpus lacks makes an item match nowhere."""
    items = benchmark_items(benchmark, item_col)
    return _near_items(items, *build_index(docs, items, id_col, text_col), n_terms, within)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         window: int = WINDOW, probes: int = PROBES, n_terms: int = N_TERMS, within: int = WITHIN) -> DataFrame:
    """``phrase_hits`` and ``n_near``, the number of items with a proximity match in the
    row, both from one index."""
    items = benchmark_items(benchmark, item_col)
    index = (items, *build_index(docs, items, id_col, text_col))
    near = _near_items(*index, n_terms, within).select("doc_id", "text_key", "item_id").distinct()
    near = materialise(near.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_near"))
                       .withColumnsRenamed({"doc_id": "d_", "text_key": "k_"}), "near-items")
    found = _phrase_hits(docs, index, id_col, text_col, window, probes)
    return found.join(near.hint("merge"), _same_document(), "left").drop("d_", "k_", "text_key").withColumn(
        "n_near", F.coalesce("n_near", F.lit(0).cast("long")))
