"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, each feature in turn gets a shallow tree
fitted on its bins (Newton steps on the logistic loss, a small learning rate),
added into that feature's lookup table. Then the pairs of features whose
quadrant tables lower the remaining loss most get tables of their own in the
same way. A score is the sum of the looked-up values of a text's bins.

The features come from the whole text alone. The fit takes at most
``SAMPLE_ROWS`` labelled rows (those of the smallest hash); every document is
scored. Defined results: null and empty texts have zero features and get the
score of their bins; repeated rows each get a score; labels that repeat are
averaged, null ones left out; a null id is never labelled nor held out; extra
columns are ignored; without any label the score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import batch_bytes, by_bytes, word_spans

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "mark_end", "no_letter",
            "lines", "distinct", "repeated", "top_line", "space")
SAMPLE_ROWS = 20_000
MAX_BINS = 64
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
LEAVES = 4
THRESHOLD = 0.7

_IS = {name: np.zeros(256, np.uint8) for name in ("upper", "digit", "symbol", "letter", "space", "line")}
_IS["upper"][65:91] = 1
_IS["digit"][48:58] = 1
_IS["letter"][65:91] = _IS["letter"][97:123] = _IS["letter"][128:] = 1
_IS["symbol"][[*range(33, 44), *range(47, 48), *range(60, 65), *range(91, 97), *range(123, 127)]] = 1
_IS["space"][[9, 10, 11, 12, 13, 32]] = 1
_IS["line"][10] = 1
_B = np.uint64(0x9E3779B97F4A7C15)


def _sums(values, offsets):
    """Sums of ``values`` over the rows given by ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hashes(raw, starts, ends):
    """A 64-bit hash of every span: mixed bytes weighted by their place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts, size) + place
    terms = _mix(raw[at].astype(np.uint64) + _B * (place.astype(np.uint64) + np.uint64(1)))
    return np.add.reduceat(terms, np.cumsum(size) - size)


def batch_features(texts) -> np.ndarray:
    """One row of ``FEATURES`` for every text of an Arrow string column."""
    raw, offsets = batch_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    for lo, hi in by_bytes(offsets):
        out[lo:hi] = _features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
    return out


def _features(raw, offsets):
    starts, ends, rows = word_spans(raw, offsets)
    n_bytes, n_words = np.diff(offsets).astype(np.float64), np.diff(rows).astype(np.float64)
    b, w = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    letters = _sums(_IS["letter"][raw], offsets)
    in_words = np.concatenate([[0], np.cumsum(_IS["letter"][raw], dtype=np.int64)])
    bare = in_words[ends] == in_words[starts]
    tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    hashes = _span_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    keyed = _mix(hashes + doc.astype(np.uint64) * _B)
    _, first, count = np.unique(keyed, return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=len(rows) - 1)
    again = np.zeros(len(hashes), np.uint8)
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(len(rows) - 1)
    np.maximum.at(top, doc[first], count)
    lines = _sums(_IS["line"][raw], offsets)
    return np.column_stack([
        np.log1p(n_words), _sums(ends - starts, rows) / w, _sums(_IS["upper"][raw], offsets) / np.maximum(letters, 1),
        _sums(_IS["digit"][raw], offsets) / b, _sums(_IS["symbol"][raw], offsets) / b,
        _sums(_IS["symbol"][tail], rows) / w, _sums(bare, rows) / w, lines / w,
        distinct / w, _sums(again, rows) / w, top / w, _sums(_IS["space"][raw], offsets) / b])


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and ``x``, the feature vector."""
    df = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)

    def run(batches):
        for batch in batches:
            x = batch_features(batch.column(0))
            col = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], col], [*keep, "x"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[1:])
    return df.mapInArrow(run, f"{kept}, x array<double>")


@dataclass
class Model:
    edges: list            # per feature: the upper ends of its bins but the last
    tables: list           # per feature: a value for each bin
    pairs: list            # (i, j, table[bins of i, bins of j])
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left")
                                for f, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out


def _tree(g, h, leaves):
    """Best-first regression tree on ordered bins: a value for each bin."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if len(cut):
                more = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(more.argmax())
                if more[k] > best[0]:
                    best = (more[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _quadrants(g, h):
    """Best split of a grid of bins into quadrants: gain, a value for each bin."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = G[1:-1, 1:-1], H[1:-1, 1:-1]
    quarter = lambda S, s: (s, S[1:-1, -1:] - s, S[-1:, 1:-1] - s,
                            S[-1, -1] - S[1:-1, -1:] - S[-1:, 1:-1] + s)
    qg, qh = quarter(G, gs), quarter(H, hs)
    gain = sum(a ** 2 / (b + 1.0) for a, b in zip(qg, qh, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(qg, qh, strict=True)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1.0)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS,
        pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    """Cyclic boosting on the bins of a bounded sample."""
    if not len(y):
        zero = [np.zeros(1) for _ in FEATURES]
        return Model([np.zeros(0) for _ in FEATURES], zero, [], 0.0)
    grid = np.linspace(0, 1, MAX_BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], math.log(share / (1 - share)))
    b = model.bins(x)
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), LEAVES)
            table += step
            margin += step[b[:, f]]

    def grids(i, j):
        n, m = len(model.tables[i]), len(model.tables[j])
        cell, (g, h) = b[:, i] * m + b[:, j], slopes()
        return np.bincount(cell, g, n * m).reshape(n, m), np.bincount(cell, h, n * m).reshape(n, m)

    ranked = sorted(((_quadrants(*grids(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)),
                    reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*grids(i, j))[1]
            table += step
            margin += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that aren't held out, one of
    each id: of repeated ids the text with the least hash, however many rows there are."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    # a bounded table: sample_rows ids and labels
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("_k")).join(F.broadcast(chosen), "_id")
    one = features(rows, ["_id", "_y", "_k"], "_t").groupBy("_id").agg(F.min_by(F.struct("_y", "x"), "_k").alias("r"))
    pdf = one.select("_id", "r._y", "r.x").orderBy("_id").toPandas()
    x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(FEATURES)))
    return fit(x, pdf["_y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables of fixed size
    df = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch_features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s)], [*keep, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[1:])
    return df.mapInArrow(run, f"{kept}, score double")
