"""Secret scan: fixed patterns plus character Markov models.

Two first-order Markov models over the 67 symbols of ``ALPHABET``, one of random
strings and one of ordinary identifiers, are counted from labelled samples
and smoothed towards the frequencies of the single symbols (a model without
samples is uniform). A long run of
token characters that no pattern has found is a secret if the mean
log-likelihood ratio of its transitions is above ``threshold``. Everything is
DataFrame expressions; match positions come from the lengths of the pieces
between the matches.

The samples are taken from the texts themselves: what the patterns match is
labelled secret, the other words ordinary; runs as long as those to be judged
have no label and train neither model. The fit reads at most about
``sample_rows`` documents (by a hash of the text); every document is scanned.

Defined results: a null text is empty (no spans); positions are code points,
ends exclusive; rows are independent, so repeated rows, null ids and extra
columns change nothing (a column named like a kind is replaced, and ``__text``, ``__runs``
and ``__`` before a kind are names of this module); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed patterns; failing matches (too short) still consume their text
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"   # whole runs of 24 and more: runs never overlap
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS = 6, 20
RUN_CHARS = 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN_CHARS
WORD = r"[A-Za-z0-9+/_-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
THRESHOLD = 0.5
SMOOTHING = 10.0
SAMPLE_ROWS = 20_000
RUN_OF = 256


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _before(values: Column, plus, zero: Column, kind: str) -> Column:
    """For every element of ``values`` what ``plus`` makes of ``zero`` and those before it.
    In runs of ``RUN_OF``, whose sums are carried on: an array grows by no more than a
    run at a time, so a long text isn't copied for each of its matches."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN_OF).cast("int")),
                       lambda i: F.slice(values, i * RUN_OF + 1, RUN_OF))

    def collect(items, start):
        first = F.struct(start.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(items, first, lambda acc, x: F.struct(
            plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    totals = F.transform(runs, lambda run: F.aggregate(run, zero, plus))
    return F.flatten(F.zip_with(runs, collect(totals, zero), lambda run, start: collect(run, start)))


def _spans(text: Column, pattern: str, hits: Column) -> Column:
    """array<struct<start, end, hit>> of the matches ``hits`` of ``pattern``."""
    parts = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("part"), hits.alias("hit"))
    both = F.transform(pairs, lambda z: F.length(z["part"]) + F.length(z["hit"]))
    # the expressions are bound to variables: computed once a row
    found = F.transform(F.array(F.struct(pairs.alias("pairs"), both.alias("both"))), lambda b: F.zip_with(
        b["pairs"], _before(b["both"], lambda x, y: x + y, F.lit(0), "int"), lambda z, at: F.struct(
            (at + F.length(z["part"])).alias("start"), (at + F.length(z["part"]) + F.length(z["hit"])).alias("end"),
            z["hit"].alias("hit"))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    return F.when(F.size(hits) > 0, F.get(found, F.lit(0))).otherwise(empty)


def _free(runs: Column, base: Column) -> Column:
    """The spans of ``runs`` that touch none of ``base``: one sort, and the largest end before
    and the smallest start after each."""
    tag = lambda spans, own: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["hit"].alias("hit")))
    far = F.lit(2 ** 31 - 1)
    order = F.array_sort(F.concat(tag(base, False), tag(runs, True)))
    ends = lambda x: F.transform(x, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"]))
    starts = lambda x: F.transform(F.reverse(x), lambda s: F.when(s["own"], far).otherwise(s["start"]))
    marked = F.transform(F.array(order), lambda o: F.zip_with(F.arrays_zip(
        o.alias("s"), _before(ends(o), lambda x, y: F.greatest(x, y), F.lit(0), "int").alias("end")),
        F.reverse(_before(starts(o), lambda x, y: F.least(x, y), far, "int")), lambda x, start: F.struct(
            x["s"].alias("s"), ((x["end"] <= x["s"]["start"]) & (start >= x["s"]["end"])).alias("free"))))
    kept = F.filter(F.get(marked, F.lit(0)), lambda x: x["s"]["own"] & x["free"])
    return F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["hit"].alias("hit")))


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``assign``, ``access`` and ``hex``: arrays of (start, end, hit)."""
    df = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({"__assign": _all(F.col("__text"), ASSIGN), "__access": _all(F.col("__text"), ACCESS),
                         "__hex": _all(F.col("__text"), HEX)})
    found = df.withColumns({
        "assign": _spans(F.col("__text"), ASSIGN, F.col("__assign")),
        "__values": F.when(F.size("__assign") > 0, _all(F.col("__text"), ASSIGN, 2)),
        "access": _spans(F.col("__text"), ACCESS, F.col("__access")),
        "hex": _spans(F.col("__text"), HEX, F.col("__hex"))})
    long_enough = F.transform(
        F.filter(F.arrays_zip(F.col("assign").alias("s"), F.col("__values").alias("g")),
                 lambda z: F.length(z["g"]) >= MIN_ASSIGN), lambda z: z["s"])
    return found.withColumns({
        "assign": F.when(F.size("__assign") > 0, long_enough).otherwise(F.col("assign")),
        "access": F.filter("access", lambda s: s["end"] - s["start"] >= MIN_ACCESS),
    }).drop("__assign", "__access", "__hex", "__values")


def labelled_samples(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, secret) from about ``sample_rows`` documents, taken by a hash of the text (a
    share of all 63-bit hashes, so any number of documents leaves as many); equal texts
    count once."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    number = F.shiftrightunsigned(F.xxhash64(text_col), 1)
    df = docs.select(text_col).where(number <= min(int(share * 2 ** 63), 2 ** 63 - 1)).dropDuplicates([text_col])
    df = base_spans(df, text_col)
    hits = F.concat(*(F.transform(k, lambda s: s["hit"]) for k in KINDS[:3]))
    value = F.regexp_extract("token", r"([A-Za-z0-9+/_-]+=*)$", 1)  # an assignment's value
    secret = df.select(F.explode(hits).alias("token")).select(value.alias("token"), F.lit(True).alias("secret"))
    rest = F.col("__text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    plain = df.select(F.explode(_all(rest, WORD)).alias("token"), F.lit(False).alias("secret"))
    return secret.union(plain.where(F.length("token") < RUN_CHARS))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of the transitions, row by
    row of ``ALPHABET``. What is gathered is bounded by the alphabet."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1),
                                 lambda i: F.substr("token", i, F.lit(2))))
    counts = (samples.where(F.length("token") >= 2).select("secret", pair.alias("pair"))
              .where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
              .groupBy("secret", "pair").count().collect())
    n, seen = len(ALPHABET), {True: {}, False: {}}
    for r in counts:
        seen[r.secret][ALPHABET.index(r.pair[0]), ALPHABET.index(r.pair[1])] = r["count"]

    def model(found):
        """log P(next | symbol), smoothed towards the symbols' own frequencies."""
        total, after = [1] * n, [0] * n
        for (a, b), c in found.items():
            total[b] += c
            after[a] += c
        share = [x / sum(total) for x in total]
        return [math.log((found.get((a, b), 0) + SMOOTHING * share[b]) / (after[a] + SMOOTHING))
                for a in range(n) for b in range(n)]

    return [r - o for r, o in zip(model(seen[True]), model(seen[False]), strict=True)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``token``."""
    lookup = F.array(*(F.lit(x) for x in ratios))
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                        lambda acc, i: acc + F.element_at(
                            lookup, (at(i) - 1) * len(ALPHABET) + at(i + 1)))
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex`` and ``markov``, arrays of
    (start, end, hit); a run that touches a pattern's span adds none."""
    df = base_spans(docs, text_col).withColumn("__runs", _all(F.col("__text"), RUN))
    df = df.withColumn("markov", _spans(F.col("__text"), RUN, F.col("__runs")))
    kept = F.filter(_free(F.col("markov"), F.concat("assign", "access", "hex")), lambda m: mean_ratio(m["hit"], ratios) > threshold)
    return df.withColumn("markov", F.when(F.size("markov") > 0, kept).otherwise(F.col("markov"))).drop("__text", "__runs")


def digest(*kinds: str) -> Column:
    """The spans of ``kinds`` as kind:start:end by start, then kind."""
    def ranked(kind):
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    both = F.concat(*map(ranked, kinds))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(both), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
