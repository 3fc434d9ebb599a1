"""Near duplicates by SimHash: fingerprints that differ in few bits.

Search by segment popcounts. The 64 bits are cut into 16 segments; the vector
of their bit counts moves by at most the Hamming distance (Manhattan metric),
so it is a lower bound. Vectors are points of an integer grid: two points
within distance 2 have a grid point within distance 1 of both, and every
fingerprint is sent to the points within distance 1 of its own (33 at most).
Fingerprints that meet are compared exactly. Equal fingerprints are one node.

A grid point where more than ``cell_limit`` different fingerprints meet is not
compared pair by pair. Its fingerprints are sent to the 65 bit strings within
one bit of themselves instead: two of them within two bits meet in one of
these, and all that meet in one are within two bits of each other, so linking
them to the smallest is exact, linear, and never gathers more than 65. For one
bit, they are linked to the string itself where it is one of them.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows and ids each keep their row; null ids are skipped
when the smallest id of a component is chosen (null if it has no other);
columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import batch_bytes, by_bytes, materialise, word_spans
from flowsentry.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
CELL_LIMIT = 256
_CHUNK = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POP4 = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def batch_fingerprints(texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of every text of an Arrow string column, as uint64."""
    raw, offsets = batch_bytes(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in by_bytes(offsets):
        out[lo:hi] = _fingerprints(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle, seed)
    return out


def _fingerprints(raw, offsets, shingle, seed):
    import xxhash
    starts, ends, rows = word_spans(raw, offsets)
    n_docs, n_words = len(rows) - 1, len(starts)
    out = np.zeros(n_docs, np.uint64)
    if n_words == 0:
        return out
    # the words of the batch, lower-case, each followed by one space
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    joined[np.arange(len(source)) + np.repeat(np.arange(n_words), size)] = _LOWER[raw[source]]
    flat = joined.tobytes()
    per_doc = np.diff(rows)
    n_sh = np.where(per_doc == 0, 0, np.maximum(per_doc - shingle + 1, 1))
    total = int(n_sh.sum())
    doc = np.repeat(np.arange(n_docs), n_sh)
    first = rows[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    last = np.minimum(first + shingle, rows[1:][doc]) - 1
    s, e = at[first], at[last] + size[last]
    ones = np.zeros((n_docs, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        h = np.array([digest(flat[x:y], seed) for x, y in
                      zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True)], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[lo:hi]
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > n_sh[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp): the hash of the text, the fingerprint as a signed 64-bit integer."""
    def run(batches):
        for batch in batches:
            fp = batch_fingerprints(batch.column(2), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(text), text).mapInArrow(
        run, f"doc_id {kind}, text_key long, fp long")


def _grid_points(batches):
    """(cell, fp): the grid points within distance 1 of the popcount vector,
    numbered in base 5."""
    power = 5 ** np.arange(SEGMENTS, dtype=np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        counts = np.stack([_POP4[((u >> np.uint64(4 * s)) & np.uint64(15)).astype(np.int64)]
                           for s in range(SEGMENTS)], axis=1)
        own = counts @ power
        cells, who = [own], [fp]
        for s in range(SEGMENTS):
            for move, ok in ((power[s], counts[:, s] < 4), (-power[s], counts[:, s] > 0)):
                cells.append(own[ok] + move)
                who.append(fp[ok])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(who))],
                                         ["cell", "fp"])


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= bits


def _linked_runs(cell, fp, bits):
    """Links of fingerprints in the same cell, at most one a row: each row to
    the least row of its cell that it reaches by links within the cell."""
    n = len(cell)
    lab, pairs, d = np.arange(n), [], 1
    while d < n:
        i = np.flatnonzero(cell[:-d] == cell[d:])
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + d], bits)]
        pairs.append((i, i + d))
        d += 1
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            old = lab.copy()
            np.minimum.at(lab, j, lab[i])
            np.minimum.at(lab, i, lab[j])
            lab = lab[lab]
            if (lab == old).all():
                break
    move = np.flatnonzero(lab != np.arange(n))
    return fp[lab[move]], fp[move]


def _meet(limit, bits):
    """Streams rows sorted by (cell, fp). Yields links (a, b), and (fp, null)
    for the fingerprints of cells with more than ``limit`` of them."""
    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def crowd(fp):
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.nulls(len(fp), pa.int64())], ["a", "b"])

    def run(batches):
        cells, fps, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False)
            if hot is not None:                    # still in a crowded cell
                stay = int(np.searchsorted(c, hot, side="right"))
                if stay:
                    yield crowd(f[:stay])
                c, f = c[stay:], f[stay:]
                if not len(c):
                    continue
                hot = None
            cells, fps = np.concatenate([cells, c]), np.concatenate([fps, f])
            cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            yield from settle(cells[:cut], fps[:cut])
            cells, fps = cells[cut:], fps[cut:]    # the last cell may go on
            if len(cells) > limit:
                yield crowd(fps)
                hot, cells, fps = cells[0], cells[:0], fps[:0]
        yield from settle(cells, fps)

    def settle(cells, fps):
        if not len(cells):
            return
        _, inverse, size = np.unique(cells, return_inverse=True, return_counts=True)
        many = size[inverse] > limit
        if many.any():
            yield crowd(fps[many])
        some = ~many & (size[inverse] > 1)
        a, b = _linked_runs(cells[some], fps[some], bits)
        if len(a):
            yield out(a, b)

    return run


def _one_bit_away(batches):
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        mid = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(fp, 65))], ["mid", "fp"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join exactly those at
    ``max_bits`` (2 at most) or fewer differing bits into the same components."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid links fingerprints at up to 2 differing bits")
    met = (fps.select("fp").mapInArrow(_grid_points, "cell long, fp long")
           .repartition("cell").sortWithinPartitions("cell", "fp")
           .mapInArrow(_meet(cell_limit, max_bits), "a long, b long").distinct())
    met = materialise(met, "simhash-met")
    near = met.where(F.col("b").isNotNull())
    if max_bits == 0:  # different fingerprints are never equal
        return near
    crowd = met.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    mids = crowd.mapInArrow(_one_bit_away, "mid long, fp long")
    if max_bits == 1:
        far = mids.where(F.col("mid") < F.col("fp")).join(crowd.withColumnRenamed("fp", "mid"), "mid")
        return near.union(far.select(F.col("mid").alias("a"), F.col("fp").alias("b")))
    least = mids.groupBy("mid").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    least = least.where(F.col("least") != F.col("most")).select("mid", "least")
    far = (mids.join(least, "mid").where(F.col("fp") != F.col("least"))
           .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_bits)
           .select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct())
    return near.union(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                    cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row of ``docs``; component_id is
    the smallest id that links reach, the same for rows equal in doc_id and text_key."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    root = components(links(nodes, max_bits, cell_limit)).withColumnRenamed("node", "fp")
    nodes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = materialise(nodes.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(nodes, "fp").select("doc_id", "text_key", "fp", "component_id")
