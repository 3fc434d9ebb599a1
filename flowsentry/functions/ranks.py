"""Ranks, quotas, cumulative sums and exact order statistics without a
single-task window.

A window with no partition (or one partitioned by a two-valued class) sorts
the whole table in one task. Everything here splits the order first:

* hash ranks: bucket = first hex digits of the hash. Bucket counts are tiny
  (groups x 4096 rows), so offsets are computed from them and joined back with
  a size-checked broadcast; ``row_number`` then runs inside (group, bucket).
* quota selection: the (hash, key) pair at each cut is found from the bucket
  counts and the few rows of the bucket that straddles it; the selection is then
  a narrow comparison with literals, without a join, a union or a window. Only
  where a cut falls between rows of the same key are these rows written, numbered
  and cut by themselves.
* value-ordered cumulative sums (AUC, ROC): the distinct values are split into
  ranges by approximate quantile edges (exact order is kept: equal values fall
  into the same range), ranges are cumulated, then each range is windowed on
  its own.
* exact quantiles: histogram passes over all groups and probabilities together
  narrow the ranges that hold the wanted order statistics, until few rows are left.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.hashing import BUCKET_DIGITS, HASH_COL, hash_bucket
from flowsentry.session import materialise

#: rows a lookup table may have before it is joined without a broadcast
BROADCAST_MAX_ROWS = 2_000_000
#: rows that a refinement (of a cut, of quantiles) leaves to be looked at one by one
REFINE_DIRECT_ROWS = 50_000
#: rows that a bucket's window is to sort at most, about, and the hash's hex digits
BUCKET_ROWS = 200_000
HASH_DIGITS = 32


def join_small(big: DataFrame, small: DataFrame, on, n_rows: int, how: str = "inner"):
    """Join a lookup table whose row count ``n_rows`` is known.

    Broadcast only under the checked bound; above it, a plain shuffle join
    (AQE may still pick a broadcast at runtime from real sizes).
    """
    if n_rows <= BROADCAST_MAX_ROWS:
        small = F.broadcast(small)
    return big.join(small, on=on, how=how)


def join_large(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Join two tables that both grow with the rows: by a shuffle at every size, since the
    smaller one would pass through the driver whole as a broadcast."""
    return left.join(right.hint("merge"), on)


def _by_list(by):
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _group_schema(df: DataFrame, by: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType, True) for c in by]


# ---------------------------------------------------------------- quotas

def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes.

    ``continuous = count / total * n_draws`` (float, same order as the
    reference library), floor it, hand out what is left to the largest
    remainders; equal remainders go to the smaller class value first.
    """
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    keys = sorted(counts)
    cont = {k: counts[k] / total * n_draws for k in keys}
    floored = {k: math.floor(cont[k]) for k in keys}
    need = int(n_draws - sum(floored.values()))
    order = sorted(keys, key=lambda k: (-(cont[k] - floored[k]), k))
    for k in order[:max(need, 0)]:
        floored[k] += 1
    return floored


def split_quota(counts: dict, test_size: float) -> dict:
    """Per-class size of the 'test' side of a stratified split.

    n_test = ceil(test_size * n); the train side is allocated first and the
    test side is what remains of each class.
    """
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_test)
    return {k: counts[k] - train[k] for k in counts}


# ------------------------------------------------------------ hash ranks

def bucket_counts(df: DataFrame, by, h: str = HASH_COL, digits: int = BUCKET_DIGITS):
    """Collect (group..., bucket, n). Bounded by #groups x 16**digits rows."""
    by = _by_list(by)
    rows = (df.groupBy(*by, hash_bucket(h, digits).alias("_b"))
              .agg(F.count(F.lit(1)).alias("_n")).collect())
    return [(tuple(r[c] for c in by), r["_b"], int(r["_n"])) for r in rows]


def totals(counts) -> dict:
    """Group sizes from bucket counts (no extra pass over the data)."""
    out: dict = {}
    for g, _, n in counts:
        out[g] = out.get(g, 0) + n
    return out


def bucketed_rank(df: DataFrame, by=None, h: str = HASH_COL, key: str = "row_id",
                  out: str = "rank", digits: int = BUCKET_DIGITS, counts=None) -> DataFrame:
    """``row_number() over (partition by <by> order by h, key)`` for every row.

    Equal to the plain window, but the sort runs per (group, bucket).
    """
    by = _by_list(by)
    spark = df.sparkSession
    counts = list(counts) if counts is not None else bucket_counts(df, by, h, digits)
    counts.sort(key=lambda t: (tuple("" if v is None else v for v in t[0]), t[1]))
    offs, run = [], {}
    for g, b, n in counts:
        o = run.get(g, 0)
        offs.append((*g, b, o))
        run[g] = o + n
    schema = T.StructType(_group_schema(df, by) + [
        T.StructField("_b", T.StringType()), T.StructField("_off", T.LongType())])
    off_df = spark.createDataFrame(offs, schema)
    # longer prefixes, until a bucket is small: the hash deals rows evenly
    largest, deep = max((n for _, _, n in counts), default=0), digits
    while largest > BUCKET_ROWS and deep < HASH_DIGITS:
        largest, deep = -(-largest // 16), deep + 1
    if deep == digits:
        x = join_small(df.withColumn("_b", hash_bucket(h, digits)), off_df, by + ["_b"], len(offs))
    else:
        x = df.withColumn("_d", hash_bucket(h, deep))
        inner = x.groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.substring("_d", 1, digits))
        before = Window.partitionBy(*by, "_b").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        inner = join_small(inner, off_df, by + ["_b"], len(offs)).withColumn(
            "_off", F.col("_off") + F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_b")
        names = [f"_g{i}" for i in range(len(by))]
        inner = inner.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("_d").alias("_b"), "_off")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)],
                      F.col("_d") == F.col("_b"))
        x = x.join(inner, same).drop("_d", *names)
    w = Window.partitionBy(*by, "_b").orderBy(h, key)
    return (x.withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("long"))
             .drop("_b", "_off"))


def cut_keys(df: DataFrame, by, cuts: dict, h: str = HASH_COL, key: str = "row_id",
             digits: int = BUCKET_DIGITS, counts=None) -> dict:
    """{group: [(hash, key) of the row at each cut's rank]}; rank 0 and below gives a
    pair before, a rank past the group one after all rows."""
    return {g: [x[:2] for x in found] for g, found in _cut_places(df, by, cuts, h, key, digits, counts).items()}


def _cut_places(df: DataFrame, by, cuts: dict, h: str, key: str, digits: int, counts) -> dict:
    """{group: [(hash, key, place, n)]}: ``cut_keys`` with the place of the cut among the
    ``n`` rows that share the pair.

    From the bucket counts; a bucket with a cut in it is counted again by longer
    prefixes while it is large, up to the whole hash, then its pairs are looked at.
    """
    by = _by_list(by)
    counts = bucket_counts(df, by, h, digits) if counts is None else counts
    per, out, todo = {}, {}, []
    for g, b, n in counts:
        per.setdefault(g, []).append((b, n))

    def find(g, i, rank, buckets):
        for b, n in sorted(buckets):
            if rank <= n:
                todo.append((g, i, b, rank, n))
                return
            rank -= n
        out[g][i] = ("~", "", 0, 0)

    for g, buckets in per.items():
        out[g] = [("", "", 0, 0)] * len(cuts.get(g, ()))
        for i, c in enumerate(cuts.get(g, ())):
            if c > 0:
                find(g, i, c, buckets)
    inside = lambda g, b: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g)]
                                 + [F.col(h).startswith(b)])

    def some(todo):
        """Rows of the buckets looked for. The prefixes of all groups come first: the hash, often
        still an expression over the row, is made once for the many rows of other buckets."""
        at = {}
        for t in todo:
            at.setdefault(len(t[2]), set()).add(t[2])
        prefix = [F.substring(F.col(h), 1, size).isin(sorted(b)) for size, b in sorted(at.items())]
        exact = [inside(g, b) for g, b in {t[:1] + t[2:3] for t in todo}]
        either = lambda x, y: x | y
        return reduce(either, prefix) & reduce(either, exact)

    size = 0
    while (any(len(t[2]) >= size for t in todo)  # shorter: the whole hash
           and sum(n for *_, n in {(t[0], t[2], t[4]) for t in todo}) > REFINE_DIRECT_ROWS):
        size = max(len(t[2]) for t in todo) + 2
        longer = bucket_counts(df.where(some(todo)), by, h, size)
        old, todo = todo, []
        for g, i, b, rank, _ in old:
            find(g, i, rank, [(p, n) for q, p, n in longer if q == g and p.startswith(b)])
    if todo:
        rows = (df.where(some(todo)).groupBy(*by, F.col(h).alias("_hash"), F.col(key).cast("string").alias("_key"))
                .agg(F.count(F.lit(1)).alias("_n")).collect())
        for g, i, b, rank, _ in todo:
            mine = sorted((r["_hash"], r["_key"], r["_n"]) for r in rows
                          if tuple(r[c] for c in by) == g and r["_hash"].startswith(b))
            for hash_, key_, n in mine:
                if rank <= n:
                    out[g][i] = (hash_, key_, rank, n)
                    break
                rank -= n
    return out


def assign_segments(df: DataFrame, by, cuts: dict, h: str = HASH_COL,
                    key: str = "row_id", out: str = "segment",
                    digits: int = BUCKET_DIGITS, counts=None,
                    default_cuts=()) -> DataFrame:
    """Segment of each row's hash rank within its group.

    ``cuts[group] = [c1, c2, ...]`` (cumulative, ascending): rank <= c1 -> 0,
    c1 < rank <= c2 -> 1, ..., above the last cut -> len(cuts). Groups missing
    from ``cuts`` use ``default_cuts``. A row is compared with the literal
    (hash, key) pairs at the cuts. Where a cut falls between rows that share a key,
    these are ordered by the hash of all their columns (rows equal in all of them are
    interchangeable), so that the sizes are exact.
    """
    by = _by_list(by)
    counts = bucket_counts(df, by, h, digits) if counts is None else counts
    groups = {g for g, _, _ in counts}
    wanted = {g: list(cuts.get(g, default_cuts)) for g in groups}
    found = _cut_places(df, by, wanted, h, key, digits, counts)
    k = F.col(key).cast("string")
    seg, ties = None, []
    for g, pairs in found.items():
        past = [F.when((F.col(h) > ch) | ((F.col(h) == ch) & (k > ck)), 1).otherwise(0) for ch, ck, *_ in pairs]
        n = reduce(lambda x, y: x + y, past, F.lit(0))
        here = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g)], F.lit(True))
        for ch, ck in sorted({x[:2] for x in pairs if x[2] < x[3]}):
            # cuts before the tie are passed by all its rows, cuts after it by none
            before = sum(x[:2] < (ch, ck) for x in pairs)
            inside = [x[2] for x in pairs if x[:2] == (ch, ck)]
            ties.append((F.coalesce(here & (F.col(h) == ch) & (k == ck), F.lit(False)), before, inside))
        seg = F.when(here, n) if seg is None else seg.when(here, n)
    seg = seg.otherwise(F.lit(len(default_cuts))) if seg is not None else F.lit(0)
    done = df
    for tie, _, _ in ties:
        done = done.where(~tie)
    done = done.withColumn(out, seg.cast("int"))
    for tie, before, inside in ties:
        own = assign_segments(_numbered(df.where(tie)), [], {(): inside}, "_place", "_place", "_inside", digits)
        done = done.unionByName(own.withColumn(out, (F.col("_inside") + before).cast("int")).drop("_place", "_inside"))
    return done


def _numbered(rows: DataFrame) -> DataFrame:
    """Written with ``_place``, a text of its own for every row: the hash of its columns, a number."""
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    content = F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
    return materialise(rows.withColumn("_place", F.concat(content, number)), "tied-rows")


def select_quota(df: DataFrame, by, quotas: dict, **kw) -> DataFrame:
    """Rows whose hash rank within their group is <= quotas[group]."""
    seg = assign_segments(df, by, {g: [q] for g, q in quotas.items()}, out="_seg_q",
                          default_cuts=[0], **kw)
    return seg.where(F.col("_seg_q") == 0).drop("_seg_q")


def group_counts(df: DataFrame, by) -> dict:
    """{group tuple: count}; the caller guarantees few groups (classes)."""
    by = _by_list(by)
    return {tuple(r[c] for c in by): int(r["n"])
            for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}


# ------------------------------------------- value-ordered cumulative sums

def cumulative_by_value(df: DataFrame, by, value: str, sums: list[str],
                        descending: bool = False, ranges: int | None = None,
                        inclusive: bool = True, keep_range: bool = False) -> DataFrame:
    """Running sums of ``sums`` over ``value`` order, within each group.

    ``df`` must already hold one row per (group, value). Output adds
    ``cum_<s>`` (inclusive of the current value, or exclusive when
    ``inclusive=False``). Ranges come from approximate quantiles of the
    distinct values; each range is windowed separately and offset by the
    totals of the ranges before it. There are as many ranges as the session has
    shuffle partitions (8 at least), so that they follow the size of the job. With
    ``keep_range`` the number of a row's range, in order, stays as ``_rg``.
    """
    by = _by_list(by)
    ranges = ranges or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if ranges <= 1:
        o = F.col(value).desc() if descending else F.col(value).asc()
        w = Window.partitionBy(*by).orderBy(o).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        out = df
        for s in sums:
            out = out.withColumn(f"cum_{s}", F.coalesce(F.sum(s).over(w), F.lit(0)))
        return out.withColumn("_rg", F.lit(0)) if keep_range else out
    probs = [i / ranges for i in range(1, ranges)]
    edges = df.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx(value, probs, 10000)).alias("_edges"))
    x = df.join(edges, on=by, how="inner") if by else df.crossJoin(edges)
    rng = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    if descending:
        rng = F.size(F.filter("_edges", lambda e: e >= F.col(value)))
    x = x.withColumn("_rg", rng.cast("int")).drop("_edges")
    tot = x.groupBy(*by, "_rg").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wt = Window.partitionBy(*by).orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    for s in sums:
        tot = tot.withColumn(f"_o_{s}", F.coalesce(F.sum(f"_t_{s}").over(wt), F.lit(0)))
    tot = tot.drop(*[f"_t_{s}" for s in sums])
    x = x.join(tot, on=by + ["_rg"], how="inner")  # groups x ranges rows
    o = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*by, "_rg").orderBy(o).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    for s in sums:
        x = x.withColumn(f"cum_{s}",
                         F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(w), F.lit(0)))
    return x.drop(*([] if keep_range else ["_rg"]), *[f"_o_{s}" for s in sums])


# ----------------------------------------------------- exact quantiles

def _order_statistics(df: DataFrame, by: list[str], value: str, wanted: dict, bins: int = 1024) -> dict:
    """{(group, k): the k-th smallest value (0-based)} for ``wanted`` {(group, k): (lo, hi, below,
    cnt)}: the statistic is between lo and hi, ``below`` values of the group are smaller
    than lo and ``cnt`` are in the range. One pass narrows all of them at once."""
    spark = df.sparkSession
    kinds = [T.StructField(c, df.schema[c].dataType, True) for c in by]
    schema = T.StructType([*(T.StructField(f"_g{i}", f.dataType, True) for i, f in enumerate(kinds)),
                           T.StructField("_iv", T.IntegerType()), T.StructField("_lo", T.DoubleType()),
                           T.StructField("_hi", T.DoubleType())])
    v, done = F.col(value).cast("double"), {}
    while True:
        done |= {t: lo for t, (lo, hi, _, _) in wanted.items() if lo == hi}
        wanted = {t: x for t, x in wanted.items() if x[0] != x[1]}
        if not wanted:
            return done
        ranges = sorted({(t[0], x[0], x[1], x[3]) for t, x in wanted.items()}, key=str)
        number = {(g, lo, hi): i for i, (g, lo, hi, _) in enumerate(ranges)}
        table = spark.createDataFrame([(*g, i, lo, hi) for (g, lo, hi), i in number.items()], schema)
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
                       + [v >= F.col("_lo"), v <= F.col("_hi")])
        inside = df.join(F.broadcast(table), match)  # groups x probabilities rows
        if sum(r[3] for r in ranges) <= REFINE_DIRECT_ROWS:
            rows: dict = {}
            for r in inside.select("_iv", v.alias("x")).collect():
                rows.setdefault(r["_iv"], []).append(r["x"])
            rows = {i: sorted(x) for i, x in rows.items()}
            return done | {t: rows[number[t[0], lo, hi]][t[1] - below] for t, (lo, hi, below, _) in wanted.items()}
        width = (F.col("_hi") - F.col("_lo")) / bins
        bucket = F.least(F.floor((v - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
        hist: dict = {}
        for r in (inside.groupBy("_iv", bucket.alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx")).collect()):
            hist.setdefault(r["_iv"], []).append((r["b"], r["n"], float(r["mn"]), float(r["mx"])))
        for t, (lo, hi, below, _) in list(wanted.items()):
            for _, n, mn, mx in sorted(hist[number[t[0], lo, hi]]):
                if below + n > t[1]:
                    wanted[t] = (mn, mx, below, n)
                    break
                below += n


def exact_quantiles(df: DataFrame, value: str, probs, by=None) -> DataFrame:
    """Linear-interpolation percentiles (``numpy.percentile`` default,
    DuckDB ``quantile_cont``) per group, as a DataFrame (group..., p, q).

    NaN and NULL values are ignored; values are finite. The same passes at every
    size: counts and ranges, histograms while many rows are left, the rest.
    """
    by = _by_list(by)
    probs = [float(p) for p in probs]
    # kept while the passes run: sums of doubles may come out differently when computed again
    clean = df.select(*by, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).persist()
    stats = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                   F.min(value).alias("_mn"), F.max(value).alias("_mx")).collect()
    wanted, places = {}, []
    for r in stats:
        g, n = tuple(r[c] for c in by), int(r["_n"])
        for p in probs if n else ():
            pos = p * (n - 1)
            k0 = int(math.floor(pos))
            places.append((g, p, k0, min(k0 + 1, n - 1), pos - k0))
            for k in places[-1][2:4]:
                wanted[g, k] = (float(r["_mn"]), float(r["_mx"]), 0, n)
    got = _order_statistics(clean, by, value, wanted) if wanted else {}
    clean.unpersist()
    out = [(*g, p, got[g, a] + (got[g, b] - got[g, a]) * frac) for g, p, a, b, frac in places]
    schema = T.StructType(_group_schema(df, by) + [
        T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())])
    return df.sparkSession.createDataFrame(out, schema)


def exact_quantile_values(df: DataFrame, value: str, probs, by=None) -> dict:
    """{(group..., p): q} collected; the result has #groups x #probs rows."""
    by = _by_list(by)
    return {(*[r[c] for c in by], r["p"]): r["q"]
            for r in exact_quantiles(df, value, probs, by).collect()}
