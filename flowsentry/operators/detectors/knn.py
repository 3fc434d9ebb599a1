"""Exact k-nearest-neighbour join (J3), Euclidean.

One strategy at every size. Features are centred on the reference mean. The
references lie in cells around pivots, ``CELLS`` times the square root of their
number; a row finds its cell by way of the nearest of the pivots' own
pivots (any cell is right: what counts is the radius that the cell ends up with).
Queries lie in the same cells and go through them together.

Neighbouring cells are a group of queries, ``PARTS_PER_CORE`` groups for every core of
the session (of ``PART_ROWS`` to ``MOST_ROWS`` queries), so that references travel to as
many groups as the cluster can use, not to more as the table grows. First a cell's
queries meet the references of its nearest cells, until these hold ``NEAR_ROWS``, which
bounds each query's k-th distance. Then a group meets the cells that could hold
something as near as the largest bound of some cell of its own, and in each of them only
the queries whose own bound reaches it are compared. A group of more than its share of
queries is cut into parts; the references pass by a part in batches, while
it holds the nearest found so far, so that its memory depends on its queries alone.
References travel in bundles, up to ``BUNDLE_ROWS`` of a cell in a row: each goes to
many parts, and moving single rows took longer than comparing them.

Candidates are picked by the expanded square, with a bound for its rounding
error, and decided by exact differences: every reference within the k-th exact
distance is looked at, then ordered by (distance, key) like
``ORDER BY dist, o_id`` in SQL. Duplicates and large offsets change nothing.
Inside, rows go by numbers in the order of their keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.ranks import join_large
from flowsentry.operators.sampling import random_rows
from flowsentry.session import materialise

#: how many references the nearest cells hold together, times k, before they bound a query
PROBE = 3
#: cells for every row of the square root
CELLS = 3
#: references that the nearest cells hold together before they bound a query, at least
NEAR_ROWS = 2_048
#: queries that travel together, at least and at most, and parts for every core between these
PART_ROWS = 2_048
MOST_ROWS = 16_384
PARTS_PER_CORE = 4
#: references of a cell that travel as one row and are compared at once, and bundles that are unpacked at once
BUNDLE_ROWS = 2_048
BUNDLES = 16
#: distances held at once: what a core's cache holds
TILE = 250_000

KNN_SCHEMA = T.StructType([
    T.StructField("q_id", T.StringType()), T.StructField("o_id", T.StringType()),
    T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def _exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    diff = q - r
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _to_pivots(X: np.ndarray, P: np.ndarray) -> np.ndarray:
    """Exact distances to all pivots."""
    return np.stack([_exact(X, p) for p in P], axis=1)


def _matrix(blobs, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, d)


def within(Q, R, bound, q_ids=None, r_ids=None):
    """(query row, reference row, distance) of all pairs at most ``bound`` (one a query) apart;
    with ids, a row never matches one of its own id."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(R):
        # one product a tile: |q|^2 - limit + |r|^2 - 2 q r is not above zero, the limit with room for rounding
        qn, rn = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", R, R)
        unit = 8.0 * (Q.shape[1] + 4) * np.finfo(np.float64).eps
        limit = bound * bound * (1.0 + unit) + unit * (np.sqrt(qn) + np.sqrt(rn.max())) ** 2
        left = np.column_stack([-2.0 * Q, np.ones(len(Q)), qn - limit])
        right = np.ascontiguousarray(np.column_stack([R, rn, np.ones(len(R))]).T)
    step = max(1, TILE // max(len(R), 1))
    for lo in range(0, len(Q) if len(R) else 0, step):
        row, ref = np.divmod(np.flatnonzero(left[lo:lo + step] @ right <= 0.0), len(R))
        row += lo
        if q_ids is not None:
            other = q_ids[row] != r_ids[ref]
            row, ref = row[other], ref[other]
        for s in range(0, len(row), 100_000):
            i, j = row[s:s + 100_000], ref[s:s + 100_000]
            dist = _exact(Q[i], R[j])
            ok = dist <= bound[i]
            out.append((i[ok], j[ok], dist[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def kth_distance(Q, R, k, q_ids=None, r_ids=None) -> np.ndarray:
    """An upper bound of every query's k-th distance among R, tight but for rounding (infinite
    where R has fewer)."""
    out = np.full(len(Q), np.inf)
    rn = np.einsum("ij,ij->i", R, R)
    right = np.ascontiguousarray(np.column_stack([R, rn]).T)
    unit = 4.0 * (Q.shape[1] + 4) * np.finfo(np.float64).eps
    step = max(1, TILE // max(len(R), 1))
    for lo in range(0, len(Q) if len(R) >= k else 0, step):
        q = Q[lo:lo + step]
        qn = np.einsum("ij,ij->i", q, q)
        d2 = np.column_stack([-2.0 * q, np.ones(len(q))]) @ right  # but for the query's own square
        if q_ids is not None:
            d2[q_ids[lo:lo + step, None] == r_ids[None, :]] = np.inf
        d2.partition(k - 1, axis=1)
        cut = d2[:, k - 1] + qn
        out[lo:lo + step] = np.sqrt(np.maximum(cut, 0.0) + 2.0 * unit * (np.sqrt(qn) + np.sqrt(rn.max())) ** 2)
    return out


def first_k(row, ref, dist, number, k):
    """The k first of every query in the order (distance, number), with their ranks."""
    order = np.lexsort((number[ref], dist, row))
    row, ref, dist = row[order], ref[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = rank <= k
    return row[keep], ref[keep], dist[keep], rank[keep].astype(np.int32)


class Part:
    """The queries of a part, and the ``k`` nearest that have passed by so far."""

    def __init__(self, d: int, k: int, exclude_self: bool):
        self.d, self.k, self.exclude_self, self.asked, self.Q = d, k, exclude_self, [], None

    def ask(self, rows: pd.DataFrame):
        self.asked.append((_matrix(rows["_v"], self.d), rows["_n"].to_numpy(), rows["_kh"].to_numpy(), rows["bound"].to_numpy()))

    def _begin(self):
        self.Q, self.n, self.kh, self.bound = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        self.asked, self.found, self.size = [], [], 0
        self.most = max(200_000, 2 * len(self.Q) * self.k)

    def meet(self, rows: pd.DataFrame, pivots: np.ndarray, radii: dict):
        """References in the order of their cells, as rows or (with ``_ns``) in bundles."""
        if self.Q is None:
            self._begin()
        R, number, kh, cell = _matrix(rows["_v"], self.d), rows["_n"].to_numpy(), rows["_kh"].to_numpy(), rows["_cell"].to_numpy()
        if "_ns" in rows:
            number, kh = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("_ns", "_khs"))
            cell = np.repeat(cell, [len(x) // 8 for x in rows["_ns"]])
        edge = [*np.flatnonzero(np.diff(cell, prepend=-1)).tolist(), len(cell)]
        for first, end in zip(edge[:-1], edge[1:], strict=True):
            c = int(cell[first])
            gap = _exact(self.Q, pivots[c])
            for lo in range(first, end, BUNDLE_ROWS):
                hi = min(end, lo + BUNDLE_ROWS)
                at = np.flatnonzero(gap - radii[c] <= self.bound * (1 + 1e-9) + 1e-9 * (1.0 + gap))
                step = max(1, TILE // (hi - lo))
                for some in (at[i:i + step] for i in range(0, len(at), step)):
                    ids = (self.kh[some], kh[lo:hi]) if self.exclude_self else (None, None)
                    row, ref, dist = within(self.Q[some], R[lo:hi], self.bound[some], *ids)
                    self.found.append((some[row], number[lo:hi][ref], dist))
                    self.size += len(row)
                    if self.size > self.most:
                        self._settle()

    def _settle(self):
        row, number, dist = (np.concatenate(x) for x in zip(*self.found, strict=True))
        row, at, dist, rank = first_k(row, np.arange(len(row)), dist, number, self.k)
        self.found, self.size = [(row, number[at], dist)], len(row)
        last = rank == self.k
        self.bound[row[last]] = np.minimum(self.bound[row[last]], dist[last] * (1 + 1e-12))
        return row, number[at], dist, rank

    def result(self) -> pd.DataFrame:
        row, number, dist, rank = self._settle() if self.Q is not None and self.found else (np.zeros(0, np.int64),) * 4
        q = self.n[row] if len(row) else row
        return pd.DataFrame({"q": q, "o": number, "dist": dist.astype(np.float64), "rank": rank.astype(np.int32)})


@dataclass
class Cells:
    """Pivots, and pivots of them: ``members`` are the pivots nearest to each of ``tops``."""

    pivots: np.ndarray
    tops: np.ndarray
    members: list

    @classmethod
    def around(cls, pivots: np.ndarray) -> Cells:
        some = np.random.default_rng(0).permutation(len(pivots))[:max(1, int(np.ceil(np.sqrt(len(pivots)))))]
        own = _to_pivots(pivots, pivots[some]).argmin(axis=1)
        live = np.unique(own)
        return cls(pivots, pivots[some[live]], [np.flatnonzero(own == i) for i in live])

    def grouped(self, n: int) -> np.ndarray:
        """The group of every cell, of ``n`` at most: that of the nearest of ``n`` pivots."""
        some = np.random.default_rng(1).permutation(len(self.pivots))[:max(1, n)]
        if len(some) == len(self.pivots):
            return np.arange(len(self.pivots))
        near, far = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), np.inf)
        for i, p in enumerate(self.pivots[some]):
            d = _exact(self.pivots, p)
            near[d < far], far = i, np.minimum(d, far)
        return near

    def assign(self, X: np.ndarray):
        """The cell of every row, and its distance to the cell's pivot."""
        cell, dist = np.zeros(len(X), np.int32), np.zeros(len(X))
        top = _to_pivots(X, self.tops).argmin(axis=1) if len(X) else np.zeros(0, np.int64)
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            d = _to_pivots(X[at], self.pivots[self.members[t]])
            cell[at], dist[at] = self.members[t][d.argmin(axis=1)], d.min(axis=1)
        return cell, dist


class KnnIndex:
    """References laid out in cells. ``table``: _key, _n (a number in the order of the keys),
    _kh (hash of the key), _cell, _dp (distance to the pivot), _v (centred vector)."""

    def __init__(self, ref: DataFrame, features: list[str], key: str = "row_id"):
        self.spark, self.features = ref.sparkSession, list(features)
        stats = ref.agg(F.count(F.lit(1)), *[F.avg(F.col(c).cast("double")) for c in features]).first()
        self.n, self.means = stats[0], [x or 0.0 for x in stats[1:]]
        self.cells = self._bundles = None
        if self.n:
            vectors = self._centred(ref, key)
            cols = [f"_v{i}" for i in range(len(features))]
            # grows as the square root of the references
            pivots = random_rows(vectors, min(self.n, int(np.ceil(CELLS * np.sqrt(self.n)))), key="_key").orderBy("_key").toPandas()[cols]
            self.cells = Cells.around(np.unique(pivots.to_numpy(np.float64), axis=0))
            self.table = self.laid_out(ref, key)
            self.stats = self._stats(self.table)

    def _centred(self, df, key):
        return df.select(F.col(key).cast("string").alias("_key"), *[
            (F.col(c).cast("double") - F.lit(m)).alias(f"_v{i}") for i, (c, m) in enumerate(zip(self.features, self.means, strict=True))])

    def laid_out(self, df: DataFrame, key: str = "row_id") -> DataFrame:
        """``df`` (references or queries) as a table like ``table``, written."""
        cols, cells = [f"_v{i}" for i in range(len(self.features))], self.spark.sparkContext.broadcast(self.cells)

        def run(batches):
            for b in batches:
                X = np.ascontiguousarray(b[cols].to_numpy(np.float64))
                cell, dp = cells.value.assign(X)
                yield pd.DataFrame({"_key": b["_key"], "_n": b["_n"], "_kh": b["_kh"], "_cell": cell, "_dp": dp,
                                    "_v": [x.tobytes() for x in X]})

        x = self._centred(df, key).orderBy("_key").withColumns(
            {"_n": F.monotonically_increasing_id(), "_kh": F.xxhash64("_key")})
        return materialise(x.mapInPandas(run, "_key string, _n long, _kh long, _cell int, _dp double, _v binary"), "knn-rows")

    def bundles(self) -> DataFrame:
        """``table`` with up to ``BUNDLE_ROWS`` references of a cell in a row, written: _cell, and the
        bytes of their numbers (_ns), hashes (_khs) and vectors (_v)."""
        def pack(batches):
            for b in batches:
                cell, n, kh, v = (b[c].to_numpy() for c in ("_cell", "_n", "_kh", "_v"))
                edge = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(b)]
                cuts = [(lo, min(end, lo + BUNDLE_ROWS)) for first, end in zip(edge[:-1], edge[1:], strict=True)
                        for lo in range(first, end, BUNDLE_ROWS)]
                yield pd.DataFrame({"_cell": cell[[lo for lo, _ in cuts]], "_ns": [n[lo:hi].tobytes() for lo, hi in cuts],
                                    "_khs": [kh[lo:hi].tobytes() for lo, hi in cuts], "_v": [b"".join(v[lo:hi]) for lo, hi in cuts]})

        if self._bundles is None:
            rows = self.table.select("_cell", "_n", "_kh", "_v").repartition("_cell").sortWithinPartitions("_cell")
            self._bundles = materialise(rows.mapInPandas(pack, "_cell int, _ns binary, _khs binary, _v binary"), "knn-bundles")
        return self._bundles

    def _stats(self, table):
        """Rows and radius of the cells that hold any: as many rows as pivots, at most."""
        got = table.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_dp").alias("r")).toPandas().sort_values("_cell")
        return got["_cell"].to_numpy(), got["n"].to_numpy(), got["r"].to_numpy(np.float64)

    def _plan(self, asked: DataFrame, needed) -> DataFrame:
        """(qc, _cell): the reference cells that ``needed`` (pivot distances, counts, radii, row of
        ``asked``) picks for every query cell."""
        shared = self.spark.sparkContext.broadcast((self.cells.pivots, *self.stats))

        def run(batches):
            pivots, live, n, r = shared.value
            for b in batches:
                for row in b.itertuples(index=False):
                    at = needed(_exact(pivots[live], pivots[row.qc]), n, r, row)
                    yield pd.DataFrame({"qc": np.int32(row.qc), "_cell": live[at].astype(np.int32)})

        return asked.mapInPandas(run, "qc int, _cell int")

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(q, o, dist, rank): the k nearest references of the rows of ``queries`` (laid out),
        both by their numbers. With ``exclude_self`` references of a query's own key are out."""
        d, tasks = len(self.features), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = PROBE * (k + 1)

        # neighbouring cells go together; tables of cells and of their groups, the only ones that are broadcast
        n_q = queries.count()
        share = -(-n_q // (PARTS_PER_CORE * self.spark.sparkContext.defaultParallelism))
        rows = min(MOST_ROWS, max(PART_ROWS, share))
        groups = self.cells.grouped(min(len(self.cells.pivots), -(-n_q // rows)))
        group_of = self.spark.createDataFrame(list(enumerate(groups.tolist())), "qc int, grp int")
        count_of = self.spark.createDataFrame(list(zip(self.stats[0].tolist(), self.stats[1].tolist(), strict=True)), "_cell int, n long")
        q = queries.select(F.col("_cell").alias("qc"), "_n", "_kh", "_dp", "_v").join(F.broadcast(group_of), "qc")
        sizes = q.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
        before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
        sizes = materialise(sizes.withColumn("before", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int")), "knn-query-groups")
        radius = materialise(q.groupBy("qc").agg(F.max("_dp").alias("radius")), "knn-query-cells")
        # a slot is a part of a group; they are dealt evenly to the tasks
        slots = sizes.agg(F.sum("parts")).first()[0] or 1
        tasks = min(tasks, slots)
        dealt = F.pmod(F.col("slot"), F.lit(tasks)).cast("int")
        every_slot = F.explode(F.sequence(F.col("before"), F.col("before") + F.col("parts") - 1)).alias("slot")
        own_slot = (F.col("before") + F.pmod(F.xxhash64("_n"), "parts")).cast("int").alias("slot")
        asked_columns = ["slot", "grp", "qc", "_n", "_kh", "_v"]

        def nearest(dist, n, r, row):
            order = np.argsort(dist, kind="stable")
            return order[:int(np.searchsorted(np.cumsum(n[order]), max(wanted, NEAR_ROWS))) + 1]

        layout = self.spark.sparkContext.broadcast((self.cells.pivots, *self.stats))

        def bound(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            pivots, live, n, r = layout.value
            qp, rp = qp.sort_values("qc", kind="stable"), rp.sort_values("_cell", kind="stable")
            Q, q_kh, qc = _matrix(qp["_v"], d), qp["_kh"].to_numpy(), qp["qc"].to_numpy()
            R, r_kh, cell = _matrix(rp["_v"], d), rp["_kh"].to_numpy(), rp["_cell"].to_numpy()
            far = np.full(len(Q), np.inf)
            edge = [*np.flatnonzero(np.diff(qc, prepend=-1)).tolist(), len(qc)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                near = live[nearest(_exact(pivots[live], pivots[qc[lo]]), n, r, None)]
                at = np.concatenate([np.arange(*np.searchsorted(cell, (c, c + 1))) for c in near])
                ids = (q_kh[lo:hi], r_kh[at]) if exclude_self else (None, None)
                far[lo:hi] = kth_distance(Q[lo:hi], R[at], k, *ids)
            return qp[asked_columns].assign(bound=far)

        # a bound may come from some of the references: of a large cell the first rows will do
        few = self.table.withColumn("_of", F.row_number().over(Window.partitionBy("_cell", F.pmod("_n", F.lit(16))).orderBy("_n")))
        few = few.where(F.col("_of") <= wanted).select("_cell", "_kh", "_v")
        near = self._plan(radius, nearest).join(F.broadcast(group_of), "qc").select("grp", "_cell").distinct().join(F.broadcast(sizes), "grp")
        right = join_large(few, near, "_cell").select(every_slot, "_cell", "_kh", "_v").select(
            F.col("slot").alias("r_slot"), *(F.col(c).alias(c) for c in ("_cell", "_kh", "_v")))  # new columns, whatever both come from
        left = q.join(F.broadcast(sizes), "grp").select(own_slot, "grp", "qc", "_n", "_kh", "_v")
        asked = left.repartition(tasks, "slot").groupBy("slot").cogroup(
            right.repartition(tasks, "r_slot").groupBy("r_slot")).applyInPandas(
            bound, "slot int, grp int, qc int, _n long, _kh long, _v binary, bound double")
        asked = materialise(asked, "knn-bounds")

        def reachable(dist, n, r, row):
            return np.flatnonzero(dist - r - row.radius <= row.bound * (1 + 1e-9) + 1e-9 * (1.0 + dist))

        reach = asked.groupBy("qc").agg(F.max("bound").alias("bound")).join(radius, "qc")
        plan = self._plan(reach, reachable).join(F.broadcast(group_of), "qc").select("grp", "_cell").distinct().join(F.broadcast(count_of), "_cell")
        plan = materialise(plan, "knn-plan")
        none, no_bytes = F.lit(0).cast("long"), F.lit("").cast("binary")  # no nulls: hashes would be made floats for them
        refs = join_large(self.bundles(), plan.join(F.broadcast(sizes), "grp"), "_cell").select(
            every_slot, F.lit(1).alias("role"), "_cell", none.alias("_n"), none.alias("_kh"), "_ns", "_khs", "_v",
            F.lit(None).cast("double").alias("bound"))
        both = asked.select("slot", F.lit(0).alias("role"), F.lit(0).alias("_cell"), "_n", "_kh", no_bytes.alias("_ns"),
                            no_bytes.alias("_khs"), "_v", "bound").unionByName(refs)
        # the queries of a slot first, then its references, cell after cell
        both = both.repartitionById(tasks, dealt).sortWithinPartitions("slot", "role", "_cell")
        radii = dict(zip(self.stats[0].tolist(), self.stats[2].tolist(), strict=True))
        shared = self.spark.sparkContext.broadcast((self.cells.pivots, radii))

        def meet(batches):
            pivots, radii = shared.value
            slot, part = None, None
            for b in batches:
                of, role = b["slot"].to_numpy(), b["role"].to_numpy()
                edge = [0, *(np.flatnonzero(np.diff(of * 2 + role)) + 1).tolist(), len(b)]
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    if lo == hi:
                        continue
                    if of[lo] != slot:
                        if part is not None:
                            yield part.result()
                        slot, part = of[lo], Part(d, k, exclude_self)
                    if role[lo] == 0:
                        part.ask(b.iloc[lo:hi])
                    else:
                        for some in range(lo, hi, BUNDLES):
                            part.meet(b.iloc[some:min(hi, some + BUNDLES)], pivots, radii)
            if part is not None:
                yield part.result()

        return both.mapInPandas(meet, "q long, o long, dist double, rank int")


def knn_join(queries: DataFrame, ref: DataFrame, features: list[str], k: int,
             exclude_self: bool = False, q_key: str = "row_id", r_key: str = "row_id") -> DataFrame:
    """(q_id, o_id, dist, rank) for the k nearest references of every query."""
    index = KnnIndex(ref, features, r_key)
    if index.n == 0 or k <= 0:
        return ref.sparkSession.createDataFrame([], KNN_SCHEMA)
    q = index.laid_out(queries, q_key)
    names = lambda t, n, name: t.select(F.col("_n").alias(n), F.col("_key").alias(name))
    found = materialise(index.search(q, k, exclude_self), "knn-found")
    return join_large(join_large(found, names(q, "q", "q_id"), "q"), names(index.table, "o", "o_id"), "o").select("q_id", "o_id", "dist", "rank")
