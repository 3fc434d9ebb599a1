"""Isolation forest.

Everything random is a hash, so that a forest is the same on any partitioning
and can be rebuilt in SQL:

* samples: the rows in the order of ``md5(seed:round:row_id)`` are dealt out in
  runs of ``psi = min(256, n)``, one run a tree, without replacement; a new
  round begins when the table is used up (only tables of fewer than
  trees x psi rows need more than one).
* a tree's features: the ``max_features`` share with the smallest
  ``md5(seed:tree:f:feature)``.
* a node: of the features that vary in it the one with the smallest
  ``md5(seed:tree:node:feature)``, cut at min + u (max - min), u from
  ``md5(seed:tree:node:t)``; rows up to the cut go left. Depth limit
  ceil(log2 psi). Nodes are numbered like a heap (children 2i+1 and 2i+2).

The node table has at most trees x (2 psi - 1) rows -- bounded by the
parameters, never by the data -- and is broadcast for scoring;
``mapInPandas`` walks all trees level by level with numpy. h(x) = leaf depth +
c(leaf size), score = 2 ** (-mean h / c(psi)) to 12 decimals (so that ties
stay ties whatever the order of the sum), score_samples = -score, decision =
score_samples - offset with offset = -0.5 ("auto") or the exact contamination
percentile of the training score_samples.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.ranks import exact_quantile_values
from flowsentry.operators.metrics import pred_from_decision, score_from_decision
from flowsentry.operators.sampling import random_rows

AUTO_OFFSET = -0.5
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType())])


def average_path_length(n) -> np.ndarray:
    """c(n): 0 for n <= 1, 1 for n = 2, 2 H(n-1) - 2 (n-1)/n above."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _hash(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def tree_features(names: list[str], seed: int, tree: int, n_feat: int) -> np.ndarray:
    """The columns a tree may use."""
    order = sorted(range(len(names)), key=lambda j: _hash(seed, tree, "f", names[j]))
    return np.sort(order[:n_feat])


def build_tree(X: np.ndarray, names: list[str], feats: np.ndarray, max_depth: int, seed: int,
               tree: int) -> list[tuple]:
    """One isolation tree as node tuples (node, feature, thr, left, right, size, depth)."""
    nodes, stack = [], [(0, np.arange(X.shape[0]), 0)]
    while stack:
        nid, idx, depth = stack.pop()
        ok = []
        if len(idx) > 1 and depth < max_depth:
            sub = X[idx][:, feats]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            ok = np.nonzero(hi > lo)[0]
        if not len(ok):
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        j = min(ok, key=lambda i: _hash(seed, tree, nid, names[feats[i]]))
        u = int(_hash(seed, tree, nid, "t")[:13], 16) / 2.0 ** 52
        thr = lo[j] + u * (hi[j] - lo[j])
        if thr >= hi[j]:
            thr = lo[j]
        f = int(feats[j])
        go_left = X[idx, f] <= thr
        nodes.append((nid, f, float(thr), 2 * nid + 1, 2 * nid + 2, len(idx), depth))
        stack.append((2 * nid + 2, idx[~go_left], depth + 1))
        stack.append((2 * nid + 1, idx[go_left], depth + 1))
    return nodes


@dataclass
class IForestModel:
    features: list[str]
    n_trees: int
    psi: int
    offset: float
    nodes: pd.DataFrame          # collected node table (bounded by trees x (2 psi - 1))

    def arrays(self, n_trees: int | None = None):
        """The trees level by level, for ``leaf_heights``: features and thresholds of every level (tree t's
        nodes of level l from place t * 2**l on), and the heights below the last one. A leaf goes on to the last
        level, both ways with its height."""
        nt = n_trees or self.n_trees
        nd = self.nodes[self.nodes["tree"] < nt]
        levels = int(nd["node"].max() + 1).bit_length() - 1
        shape = (nt, 2 ** (levels + 1) - 1)
        feat, thr, height = np.full(shape, -1, np.int64), np.full(shape, np.inf), np.zeros(shape)
        t, n = nd["tree"].to_numpy(), nd["node"].to_numpy()
        inner = nd["feature"].to_numpy() >= 0
        feat[t, n] = nd["feature"].to_numpy()
        thr[t[inner], n[inner]] = nd["threshold"].to_numpy()[inner]
        height[t, n] = nd["depth"].to_numpy() + average_path_length(nd["size"].to_numpy())
        out = []
        for level in range(levels):
            lo, hi = 2 ** level - 1, 2 ** (level + 1) - 1
            leaf = np.repeat(feat[:, lo:hi] < 0, 2, axis=1)
            below = height[:, 2 * lo + 1:2 * hi + 1]
            below[leaf] = np.repeat(height[:, lo:hi], 2, axis=1)[leaf]
            out.append((np.maximum(feat[:, lo:hi], 0).ravel(), thr[:, lo:hi].ravel()))
        return nt, out, height[:, 2 ** levels - 1:].ravel()

    def transform(self, df: DataFrame, keep=("row_id", "y"), n_trees: int | None = None) -> DataFrame:
        """Adds score_samples, decision, score, pred. ``n_trees`` scores with the
        first trees only (one fitted forest serves every smaller forest size)."""
        keep = [c for c in keep if c in df.columns]
        spark = df.sparkSession
        nt = n_trees or self.n_trees
        bc = spark.sparkContext.broadcast(self.arrays(nt))
        cpsi = float(average_path_length([self.psi])[0]) or 1.0
        feats = self.features
        schema = T.StructType([df.schema[c] for c in keep]
                              + [T.StructField("score_samples", T.DoubleType())])

        def run(batches):
            for b in batches:
                out = b[keep].copy()
                h = leaf_heights(bc.value, b[feats].to_numpy(np.float64)).mean(axis=1)
                out["score_samples"] = -np.round(np.power(2.0, -h / cpsi), 12)
                yield out

        cols = keep + [F.col(c).cast("double").alias(c) for c in feats if c not in keep]
        s = df.select(*cols).mapInPandas(run, schema)
        d = F.col("score_samples") - F.lit(self.offset)
        return s.withColumn("decision", d).withColumns({"score": score_from_decision(), "pred": pred_from_decision()})


#: rows that walk together: what they hold fits a core's cache
WALK_ROWS = 512


def leaf_heights(trees, X: np.ndarray) -> np.ndarray:
    """Rows x trees: the height of the leaf that a row reaches, all trees walked at once, a
    level at a time."""
    nt, levels, height = trees
    out = np.empty((len(X), nt))
    d = X.shape[1]
    for lo in range(0, len(X), WALK_ROWS):
        x = np.ascontiguousarray(X[lo:lo + WALK_ROWS])
        flat, row = x.ravel(), np.repeat(np.arange(len(x)) * d, nt)
        place = np.tile(np.arange(nt), len(x))
        for feat, thr in levels:
            right = ~(flat.take(row + feat.take(place)) <= thr.take(place))
            place += place
            place += right
        out[lo:lo + len(x)] = height.take(place).reshape(len(x), nt)
    return out


def score_forests(df: DataFrame, forests: list, sizes=None, fold: str = "fold", train: bool = False) -> DataFrame:
    """Scores of many forests from one walk over ``df``: rows (forest, trees, held, row_id, y,
    score_samples). ``forests``: (number, fold, model), the model fitted without the fold's
    rows; its held-out rows are scored, with ``train`` the others too (held false). ``sizes``: the
    first so many trees of each forest; running means over the trees give them all."""
    feats = forests[0][2].features
    shared = df.sparkSession.sparkContext.broadcast([
        (number, f, m.arrays(), float(average_path_length([m.psi])[0]) or 1.0, sizes or [m.n_trees]) for number, f, m in forests])
    schema = T.StructType([T.StructField("forest", T.IntegerType()), T.StructField("trees", T.IntegerType()),
                           T.StructField("held", T.BooleanType()), df.schema["row_id"], df.schema["y"],
                           T.StructField("score_samples", T.DoubleType())])

    def run(batches):
        for b in batches:
            X, own = b[feats].to_numpy(np.float64), b["_fold"].to_numpy()
            for number, f, trees, cpsi, sizes_ in shared.value:
                at = np.arange(len(b)) if train else np.flatnonzero(own == f)
                for lo in range(0, len(at), 4096):
                    part = at[lo:lo + 4096]
                    h = leaf_heights(trees, X[part])
                    for size in sizes_:
                        mean = h[:, :size].mean(axis=1)
                        yield pd.DataFrame({"forest": np.int32(number), "trees": np.int32(size), "held": own[part] == f,
                                            "row_id": b["row_id"].to_numpy()[part], "y": b["y"].to_numpy()[part],
                                            "score_samples": -np.round(np.power(2.0, -mean / cpsi), 12)})

    return df.select("row_id", "y", F.col(fold).cast("int").alias("_fold"),
                     *(F.col(c).cast("double").alias(c) for c in feats)).mapInPandas(run, schema)


def tree_samples(df: DataFrame, features: list[str], n_trees: int, psi: int, n: int,
                 seed: int, key: str) -> DataFrame:
    """(tree, features): ``psi`` rows for each tree. No more rows are ranked than the
    trees need, or than a table that is smaller than that has."""
    per_round = n // psi
    rounds = -(-n_trees // per_round)
    if rounds == 1:
        df = random_rows(df, n_trees * psi, f"{seed}:0", key)
    x = df.select(F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double") for c in features],
                  F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
    order = Window.partitionBy("_round").orderBy(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("_round"), F.lit(":"), F.col("_key"))), "_key")
    x = x.withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < per_round * psi)
    tree = (F.col("_round") * per_round + F.floor(F.col("_rank") / psi)).cast("int")
    return x.withColumn("tree", tree).where(F.col("tree") < n_trees).drop("_round", "_rank", "_key")


def fit_iforest(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256,
                max_features: float = 1.0, contamination=0.2, seed: int = 42,
                key: str = "row_id") -> IForestModel:
    n = df.count()
    if n == 0:
        raise ValueError("an isolation forest needs at least one training row")
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    n_feat = max(1, int(max_features * len(features)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        feats = tree_features(features, seed, t, n_feat)
        nodes = build_tree(pdf[features].to_numpy(np.float64), features, feats, max_depth, seed, t)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", t)
        return out

    samples = tree_samples(df, features, n_trees, psi, n, seed, key)
    nodes = samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = IForestModel(list(features), n_trees, psi, AUTO_OFFSET, nodes)
    if contamination != "auto":
        sc = model.transform(df, keep=[]).select("score_samples").cache()
        q = exact_quantile_values(sc, "score_samples", [contamination])
        sc.unpersist()
        model.offset = float(next(iter(q.values())))
    return model
