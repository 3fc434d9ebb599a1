"""Reconstruction-error autoencoders.

Topology d -> 32 -> 16 -> 8 -> 16 -> 32 -> d, ReLU between layers, linear
output; MSE loss, Adam (lr 1e-3), minibatch 64, at most 100 epochs, early
stopping on the validation MSE (patience 5, min_delta 1e-6, best weights
restored).

Training is data-parallel over a fixed number of logical shards (a parameter:
neither cores, partitions nor rows decide it, so neither change the result). A
row's shard, and its place in the shard's order, come from the hash of its
key. Rows are laid out once, a shard in order in one partition, as blocks of
numbers, and never move again. An epoch is one Spark job: every shard runs
minibatch Adam over its rows from the epoch's weights, a minibatch at a time; the
weights and moments are summed by rows over a group of ``GROUP`` shards in the
task, then over ``FAN_IN`` groups at a time in a second stage, in the shards' order: the
driver hears one row an epoch, of a length that only the topology decides. The same job scores the
validation rows with the weights it starts from, so an epoch's validation loss
comes with the next epoch's job.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.hashing import hash_order

HIDDEN = (32, 16, 8, 16, 32)
SHARDS = 256
GROUP = 4
FAN_IN = 16
BLOCK = 1024


def layer_dims(d: int) -> list[int]:
    return [d, *HIDDEN, d]


def init_params(d: int, seed: int = 42) -> np.ndarray:
    """Uniform(+-1/sqrt(fan_in)) weights and biases, flattened."""
    rng = np.random.default_rng(seed)
    dims = layer_dims(d)
    parts = []
    for i in range(len(dims) - 1):
        bound = 1.0 / math.sqrt(dims[i])
        parts.append(rng.uniform(-bound, bound, size=dims[i + 1] * dims[i]))
        parts.append(rng.uniform(-bound, bound, size=dims[i + 1]))
    return np.concatenate(parts)


def unpack(theta: np.ndarray, d: int):
    dims = layer_dims(d)
    out, o = [], 0
    for i in range(len(dims) - 1):
        n_in, n_out = dims[i], dims[i + 1]
        W = theta[o:o + n_out * n_in].reshape(n_out, n_in)
        o += n_out * n_in
        b = theta[o:o + n_out]
        o += n_out
        out.append((W, b))
    return out


def forward(theta: np.ndarray, X: np.ndarray):
    layers = unpack(theta, X.shape[1])
    acts, zs = [X], []
    a = X
    for i, (W, b) in enumerate(layers):
        z = a @ W.T + b
        zs.append(z)
        a = z if i == len(layers) - 1 else np.maximum(z, 0.0)
        acts.append(a)
    return a, acts, zs


def row_mse(theta: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Mean squared reconstruction error per row."""
    out, _, _ = forward(theta, X)
    return ((out - X) ** 2).mean(axis=1)


def reconstruction_mse(df: DataFrame, features: list[str], reconstructed: list[str], out: str = "mse") -> DataFrame:
    """D13 for reconstructions that are columns: adds the mean squared error of each row."""
    terms = [(F.col(a).cast("double") - F.col(b).cast("double")) ** 2
             for a, b in zip(features, reconstructed, strict=True)]
    return df.withColumn(out, sum(terms[1:], terms[0]) / len(terms))


def loss_and_grad(theta: np.ndarray, X: np.ndarray) -> tuple[float, np.ndarray]:
    """Batch MSE (mean over rows and features) and its gradient."""
    layers = unpack(theta, X.shape[1])
    out, acts, zs = forward(theta, X)
    diff = out - X
    loss = float((diff ** 2).mean())
    g = 2.0 * diff / diff.size
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        W, _ = layers[i]
        grads.append((g.T @ acts[i], g.sum(axis=0)))
        if i > 0:
            g = (g @ W) * (zs[i - 1] > 0)
    flat = []
    for gw, gb in reversed(grads):
        flat += [gw.ravel(), gb]
    return loss, np.concatenate(flat)


def adam_steps(theta, m, v, t, minibatches, lr=1e-3, b1=0.9, b2=0.999, eps=1e-8):
    """Minibatch Adam over an iterator of matrices; also the rows and the summed loss."""
    rows, loss_sum = 0, 0.0
    for xb in minibatches:
        loss, g = loss_and_grad(theta, xb)
        t += 1
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        mh = m / (1 - b1 ** t)
        vh = v / (1 - b2 ** t)
        theta = theta - lr * mh / (np.sqrt(vh) + eps)
        loss_sum += loss * len(xb)
        rows += len(xb)
    return theta, m, v, t, rows, loss_sum


def _minibatches(blocks, size):
    """Matrices of ``size`` rows from a stream of matrices, the last one shorter."""
    rest = None
    for x in blocks:
        rest = x if rest is None or not len(rest) else np.vstack([rest, x])
        for lo in range(0, len(rest) - size + 1, size):
            yield rest[lo:lo + size]
        rest = rest[len(rest) // size * size:]
    if rest is not None and len(rest):
        yield rest


@dataclass
class AEModel:
    features: list[str]
    theta: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best_epoch: int = 0

    def history_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "Epoch int, Train_Loss double, Val_Loss double")

    def reconstruction_error(self, df: DataFrame, keep=("row_id", "y"), out: str = "mse") -> DataFrame:
        keep = [c for c in keep if c in df.columns]
        bc = df.sparkSession.sparkContext.broadcast(self.theta)
        feats = self.features
        schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

        def run(batches):
            th = bc.value
            for b in batches:
                o = b[keep].copy()
                o[out] = row_mse(th, b[feats].to_numpy(np.float64))
                yield o

        cols = keep + [F.col(c).cast("double").alias(c) for c in feats if c not in keep]
        return df.select(*cols).mapInPandas(run, schema)


def sharded(train: DataFrame, val: DataFrame, features: list[str], shards: int = SHARDS, group: int = GROUP,
            seed: int = 42, key: str = "row_id") -> DataFrame:
    """(shard, role, x): the rows of ``train`` (role 1) and ``val`` (role 0) in blocks of up to
    ``BLOCK``, as bytes. A group of shards is in one partition, shard after shard."""
    order = hash_order(seed, "_key")
    both = None
    for role, df in ((0, val), (1, train)):
        one = df.select(F.lit(role).alias("_role"), F.col(key).cast("string").alias("_key"),
                        *(F.col(c).cast("double").alias(c) for c in features))
        both = one if both is None else both.unionByName(one)
    # digits 1-6 of the hash give the shard, the whole of it the order
    shard = F.pmod(F.conv(F.substring(order, 1, 6), 16, 10).cast("long"), F.lit(shards)).cast("int")
    parts = min(-(-shards // group), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (both.select(shard.alias("_shard"), "_role", order.alias("_h"), "_key", *features)
            .repartitionById(parts, F.pmod(F.floor(F.col("_shard") / group), F.lit(parts)).cast("int"))
            .sortWithinPartitions((F.col("_shard") / group).cast("int"), "_shard", "_role", "_h", "_key"))

    def blocks(batches):
        for b in batches:
            x, of = b[features].to_numpy(np.float64), b["_shard"].to_numpy() * 2 + b["_role"].to_numpy()
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            cut = sorted({p for lo, hi in zip(edge, [*edge[1:], len(of)], strict=True) for p in range(lo, hi, BLOCK)})
            hi = [*cut[1:], len(of)]
            yield pd.DataFrame({"shard": of[cut] // 2, "role": of[cut] % 2,
                                "x": [x[p:q].tobytes() for p, q in zip(cut, hi, strict=True)]})

    return rows.drop("_h", "_key").mapInPandas(blocks, "shard int, role int, x binary")


def _epoch(state, batches, d, group, batch, lr, train):
    """One epoch's sums over the groups of a partition: (group, rows, steps, loss, val_rows,
    val_loss, vectors), the vectors theta, m and v weighted by rows."""
    theta, m, v, t = state

    def parts():
        for b in batches:
            for shard, role, x in zip(b["shard"], b["role"], b["x"], strict=True):
                yield (shard // group, shard, role), np.frombuffer(x, np.float64).reshape(-1, d)

    out = []
    for g, of_group in itertools.groupby(parts(), key=lambda p: p[0][0]):
        rows, steps, loss, val_rows, val_loss, vectors = 0, 0, 0.0, 0, 0.0, np.zeros((3, len(theta)))
        for (_, _, role), stream in itertools.groupby(of_group, key=lambda p: p[0]):
            stream = (x for _, x in stream)
            if role == 0:
                for x in _minibatches(stream, BLOCK):
                    val_rows, val_loss = val_rows + len(x), val_loss + float(row_mse(theta, x).sum())
            elif train:
                th, mm, vv, tt, n, part = adam_steps(theta, m, v, t, _minibatches(stream, batch), lr=lr)
                vectors += n * np.stack([th, mm, vv])
                rows, steps, loss = rows + n, steps + n * (tt - t), loss + part
        out.append((g, rows, steps, loss, val_rows, val_loss, vectors.tobytes()))
    yield pd.DataFrame(out, columns=["group", "rows", "steps", "loss", "val_rows", "val_loss", "vectors"])


def _over_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of the groups of shards as one row, added up ``FAN_IN`` at a time in the groups' order."""
    def add(some):
        total = sum(np.frombuffer(x, np.float64) for x in some["vectors"])
        sums = {c: [sum(some[c].tolist())] for c in ("rows", "steps", "loss", "val_rows", "val_loss")}
        return pd.DataFrame({"group": some["group"].iloc[:1].to_numpy(), **sums, "vectors": [total.tobytes()]})

    pdf = pdf.sort_values("group")
    while len(pdf) > 1:
        pdf = pd.concat([add(some) for _, some in pdf.groupby(np.unique(pdf["group"] // FAN_IN, return_inverse=True)[1])])
        pdf["group"] = pdf["group"] // FAN_IN
    return pdf


def fit_autoencoder(train: DataFrame, val: DataFrame, features: list[str], max_epochs: int = 100,
                    patience: int = 5, min_delta: float = 1e-6, lr: float = 1e-3,
                    batch: int = 64, shards: int = SHARDS, group: int = GROUP, seed: int = 42,
                    key: str = "row_id") -> AEModel:
    """Train on ``train`` rows, early-stop on ``val`` rows (same class)."""
    spark = train.sparkSession
    d = len(features)
    sums = "group int, rows long, steps long, loss double, val_rows long, val_loss double, vectors binary"
    data = sharded(train, val, features, shards, group, seed, key).persist(StorageLevel.MEMORY_AND_DISK)

    def job(state, learn):
        """The validation loss of the state's weights, and the state and training loss after an epoch."""
        bc = spark.sparkContext.broadcast(state)
        got = data.mapInPandas(lambda batches: _epoch(bc.value, batches, d, group, batch, lr, learn), sums)
        got = got.groupBy(F.lit(0).alias("all")).applyInPandas(_over_groups, sums).collect()  # one row
        bc.unpersist()
        n, val_n = sum(r["rows"] for r in got), sum(r["val_rows"] for r in got)
        held = sum(r["val_loss"] for r in got) / val_n if val_n else math.nan
        if not n:
            return held, state, 0.0
        theta, m, v = sum(np.frombuffer(r["vectors"], np.float64).reshape(3, -1) for r in got if r["rows"]) / n
        return held, (theta, m, v, state[3] + round(sum(r["steps"] for r in got) / n)), sum(r["loss"] for r in got) / n

    theta = init_params(d, seed)
    state = (theta, np.zeros_like(theta), np.zeros_like(theta), 0)
    history, rule, best_theta, best_epoch = [], EarlyStop(patience, min_delta), theta, 0
    _, state, loss = job(state, True)
    for epoch in range(1, max_epochs + 1):
        held, after, next_loss = job(state, epoch < max_epochs)
        history.append((epoch, loss, float(held)))
        stop = rule.seen(held)
        if rule.best_epoch == epoch:
            best_theta, best_epoch = state[0], epoch
        if stop:
            break
        state, loss = after, next_loss
    data.unpersist()
    return AEModel(list(features), best_theta, history, best_epoch)


@dataclass
class EarlyStop:
    """Stop after ``patience`` epochs in a row without a loss under the best by ``min_delta``."""

    patience: int = 5
    min_delta: float = 1e-6
    best: float = math.inf
    best_epoch: int = 0
    epoch: int = 0

    def seen(self, loss: float) -> bool:
        self.epoch += 1
        if loss < self.best - self.min_delta:
            self.best, self.best_epoch = loss, self.epoch
        return self.epoch - self.best_epoch >= self.patience


def early_stop_epochs(val_losses, patience: int = 5, min_delta: float = 1e-6) -> tuple[int, int]:
    """D11 on a finished loss list: (epoch where training stops, best epoch)."""
    rule = EarlyStop(patience, min_delta)
    for loss in val_losses:
        if rule.seen(loss):
            break
    return rule.epoch, rule.best_epoch


def early_stops(losses: DataFrame, series: str, epoch: str, loss: str, patience: int = 5,
                min_delta: float = 1e-6) -> DataFrame:
    """D11 on a table of loss histories: (series, stop_epoch, best_epoch), a row a series; a
    history has a row an epoch."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stop, best = early_stop_epochs(pdf.sort_values(epoch)[loss].to_list(), patience, min_delta)
        return pd.DataFrame({series: pdf[series].iloc[:1], "stop_epoch": [stop], "best_epoch": [best]})

    kind = losses.schema[series].dataType.simpleString()
    return losses.select(series, epoch, loss).groupBy(series).applyInPandas(
        run, f"`{series}` {kind}, stop_epoch int, best_epoch int")
