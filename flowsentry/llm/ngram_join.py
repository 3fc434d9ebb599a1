"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct word shingles. All sets are ordered the
same way, rare shingles first. With t the similarity, a set of n shingles
shares at least ``T = ceil(t * n)`` of them with any partner, so its first
``n - T + l`` hold at least l that the first ``m - T' + l`` of the partner's m
hold too. Each document picks its own l: longer prefixes cost postings, but ask
for more shared shingles before anything is verified. With d the frequencies,
a prefix meets ``S = sum(d - 1)`` postings and at most ``S / l`` documents l
times, and the document takes the l with the least
``S * (1 + VERIFY_COST * n / l)``. Prefixes are nested, so two documents are
candidates if they share the smaller of their two l. Candidates of a similar
size are verified on their whole sets.

Frequencies: documents go in blocks; a block sends the sorted cells (hash
prefixes, 28 bits within a shard of about ``SHARD_SHINGLES``) of its shingles,
a shard adds up, a range of cells at a time, and answers with the frequency on a log
scale, a byte a cell.
The order is (frequency, hash); cells that collide only overestimate, and any
common order is correct. A shingle of one document takes part in no posting.

Copies and hot groups: equal sets are one class, found by a 128-bit key of the
set. In a large group of near copies every pair is a candidate, so classes are
first compared with a hub: of the most central classes (those whose shingles are
most frequent) in the groups of its prefix shingles and size band, the one that a
class meets most often. This is linear in the postings. A class keeps what it
lacks of its hub's set and what it adds, its delta. For two classes of one hub

    overlap = hub's n - lacked - lacked' + shared delta

and without shared delta both are at least as similar to the hub as to each other.
So pairs of one hub that are in different components share delta shingles, more
than ``W / (100 + percent)`` of them, W = 100 * lacked + percent * added, if the
other is not linked to the hub; they are found by prefixes of the deltas, rarest
first. Only classes of different hubs and components are joined by the prefixes of
their sets; groups of over ``GROUP_ROWS`` classes are dealt over salts. No link
between different components is lost, and links within one change nothing.

Defined results: words are cut at white space, A-Z lower-cased; a text of
fewer words than a shingle is one shingle of all its words; null, empty and
blank texts have no shingles and are linked with nothing; rows that repeat an id
keep their rows, and different texts of one id are judged each for itself; a
component's id is its smallest id (null ids only if it has no other); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import batch_bytes, ranges, word_spans
from flowsentry.llm.components import components
from flowsentry.llm.substring_dedup import block_texts, blocks, text_columns
from flowsentry.session import materialise

SHINGLE = 4
PERCENT = 85
BLOCK_BYTES = 4 << 20
SHARD_SHINGLES = 1 << 22
CELL_BITS = 28
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
VERIFY_COST = 0.2
GROUP_ROWS = 512
#: shingles of a shard that are counted at once, and pairs of sets that are compared at once
RANGE_SHINGLES = 1 << 19
PAIR_ROWS = 512
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw, starts, ends):
    """A 64-bit hash of every word, from its bytes taken eight at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    parts = (size + 7) // 8
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    left = np.minimum(np.repeat(size, parts) - 8 * place, 8).astype(np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    value = view[np.repeat(starts, parts) + 8 * place].copy().view("<u8").ravel()
    value &= _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left)
    value = _mix(value + (place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_sets(texts, shingle: int):
    """The sorted different shingle hashes of every text, one text after the other, and the
    n + 1 offsets of the texts among them."""
    raw, offsets = batch_bytes(texts)
    raw = _LOWER[raw]
    starts, ends, rows = word_spans(raw, offsets)
    word, step = word_hashes(raw, starts, ends), _U(0x5851F42D4C957F2D)
    h = np.zeros(max(len(word) - shingle + 1, 0), np.uint64)
    for j in range(shingle):
        h = h * step + word[j:j + len(h)]
    h = _mix(h)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            own = np.sort(h[lo:hi - shingle + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            whole = np.full(min(hi - lo, 1), hi - lo, np.uint64)  # none without words
            for w in word[lo:hi]:
                whole = whole * step + w
            out.append(_mix(whole))
    sizes = np.array([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def block_cells(h, shard_bits):
    """The sorted different cells of a block's hashes (shard above ``CELL_BITS``), the place of
    every hash among them, and how many documents have each."""
    return np.unique(h >> _U(64 - CELL_BITS - shard_bits), return_inverse=True, return_counts=True)


def by_shard(cells):
    """(shard, slice) of sorted cells, only of shards that are met."""
    shard = (cells >> _U(CELL_BITS)).astype(np.int64)
    cut = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(shard[lo]), slice(lo, hi)


def pack_planes(values):
    """Numbers as their first, second, third and fourth bytes: those that are mostly zero compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_planes(data):
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def frequency_shard(group: pa.Table) -> pa.Table:
    """All blocks' cells of a shard -> for each block its cells' frequencies on a log scale, a range
    of cells at a time."""
    cells = [np.cumsum(unpack_planes(x.as_buffer()), dtype=np.uint32) for x in group.column("cells")]  # of CELL_BITS
    counts = [unpack_planes(x.as_buffer()).astype(np.uint32) for x in group.column("counts")]
    levels = [np.zeros(len(c), np.uint8) for c in cells]
    for parts in ranges(cells, RANGE_SHINGLES):
        one, count = (np.concatenate([x[p] for x, p in zip(of, parts, strict=True)]) for of in (cells, counts))
        different, place = np.unique(one, return_inverse=True)
        total = np.zeros(len(different), np.int64)
        np.add.at(total, place, count)
        level = np.minimum(np.round(4 * np.log2(total)), 255).astype(np.uint8)[place]
        at = 0
        for out, p in zip(levels, parts, strict=True):
            out[p] = level[at:at + p.stop - p.start]
            at += p.stop - p.start
    return group.select(["block", "shard"]).append_column("levels", pa.array([x.tobytes() for x in levels], pa.binary()))


def least_overlap(n, percent):
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def prefixes(h, offsets, level, percent):
    """For every set its l, its mean level, and the hashes of its prefix that other documents
    have too, with their offsets."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, level, doc))
    h, level = h[order], level[order]
    center = np.diff(np.concatenate([[0], np.cumsum(level, dtype=np.int64)])[offsets]) / np.maximum(n, 1)
    meets = np.concatenate([[0.0], np.cumsum(2.0 ** (level / 4.0) - 1)])
    base = n - least_overlap(n, percent)
    best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for m in MATCHES:
        fits = m <= n - base
        s = meets[np.where(fits, offsets[:-1] + base + m, offsets[:-1])] - meets[offsets[:-1]]
        c = np.where(fits, s * (1 + VERIFY_COST * n / m), np.inf)
        best, cost = np.where(c < cost, m, best), np.minimum(c, cost)
    # sets with no possible partner but themselves: neither one shingle less nor one more is near enough
    alone = (100 * (n - 1) < percent * n) & (100 * n < percent * (n + 1))
    used = np.where(alone, 0, base + best)
    keep = (np.arange(len(h)) - offsets[:-1][doc] < used[doc]) & (level > 0)
    return best, center, h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


def _levels(answers, cells):
    out = np.zeros(len(cells), np.uint8)
    told = {a["shard"]: a["levels"] for a in answers or ()}
    for shard, part in by_shard(cells):
        out[part] = np.frombuffer(told[shard], np.uint8)
    return out


def document_prefixes(held: DataFrame, shingle: int, percent: int, shard_shingles: int) -> DataFrame:
    """(doc_id, n, k1, k2, matches, center, tokens, block, pos) of every document in blocks."""
    total = held.agg(F.sum("bytes")).first()[0] or 0
    # a shingle is a word and its space, 6 bytes or so
    shard_bits = max(0, math.ceil(math.log2(max(total // 6 / shard_shingles, 1))))

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, _ = shingle_sets(block_texts(batch, i), shingle)
                cells, _, counts = block_cells(h, shard_bits)
                got = list(by_shard(cells))
                local = (cells & _U((1 << CELL_BITS) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(got), pa.int64()),
                     pa.array([s for s, _ in got], pa.int64()),
                     pa.array([pack_planes(np.diff(local[p], prepend=0)) for _, p in got], pa.binary()),
                     pa.array([pack_planes(counts[p]) for _, p in got], pa.binary())],
                    ["block", "shard", "cells", "counts"])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, offsets = shingle_sets(block_texts(batch, i), shingle)
                cells, place, _ = block_cells(h, shard_bits)
                level = _levels(batch.column("answers")[i].as_py(), cells)[place]
                matches, center, tokens, token_offsets = prefixes(h, offsets, level, percent)
                keys = [np.cumsum(np.append(_U(0), _mix(h ^ _U(x)))) for x in (0x1F3, 0x2A5F)]
                keys = [(k[offsets[1:]] - k[offsets[:-1]]).view(np.int64) for k in keys]
                docs, n = batch.column(1)[i].values, len(matches)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.diff(offsets)), *(pa.array(k) for k in keys), pa.array(matches.astype(np.int32)), pa.array(center),
                     pa.ListArray.from_arrays(pa.array(token_offsets, pa.int32()), pa.array(tokens.view(np.int64))),
                     pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(np.arange(n), pa.int32())],
                    ["doc_id", "n", "k1", "k2", "matches", "center", "tokens", "block", "pos"])

    sent = held.select("block", *text_columns(held)).mapInArrow(send, "block long, shard long, cells binary, counts binary")
    told = sent.groupBy("shard").applyInArrow(frequency_shard, "block long, shard long, levels binary")
    told = materialise(told.groupBy("block").agg(
        F.collect_list(F.struct("shard", "levels")).alias("answers")), "shingle-frequencies")
    return held.join(told.hint("merge"), "block", "left").select("block", "ids", *text_columns(held), "answers").mapInArrow(
        cut, "doc_id long, n long, k1 long, k2 long, matches int, center double, tokens array<long>, block long, pos int")


def compared(pairs: DataFrame, classes: DataFrame, held: DataFrame, shingle: int, percent: int,
             deltas: bool = False) -> DataFrame:
    """``pairs`` (a, b; written) with ``linked``: the sets are similar enough. With ``deltas``
    also n_a, lacked (shingles of a that b lacks), added (of b that a lacks) and both as
    ``delta``, null if the similarity is under a half. Sets are made from the texts again,
    of the classes that are asked for."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = classes.select("node", "block", "pos").join(asked.hint("merge"), "node")
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("pos", "node")).alias("asked"))

    def sets(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ask = batch.column("asked")[i].values
                h, offsets = shingle_sets(block_texts(batch, i).take(ask.field("pos")), shingle)
                data = [h[lo:hi].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ask.field("node"), pa.array(data, pa.binary())], ["node", "set"])

    def check(batches):
        for batch in (b.slice(lo, PAIR_ROWS) for b in batches for lo in range(0, b.num_rows, PAIR_ROWS)):
            linked, n_a, lacked, added, delta = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                n_a.append(len(x))
                lacked.append(len(x) - both)
                added.append(len(y) - both)
                near = deltas and 3 * both >= len(x) + len(y)
                delta.append(np.setxor1d(x, y, assume_unique=True).view(np.int64) if near else None)
            out = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())]
            if deltas:
                out += [pa.array(v, pa.int64()) for v in (n_a, lacked, added)] + [pa.array(delta, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "linked", "n_a", "lacked", "added", "delta"][:len(out)])

    found = held.join(asked.hint("merge"), "block").select(*text_columns(held), "asked").mapInArrow(sets, "node long, set binary")
    found = materialise(found, "shingle-sets")
    left, right = (found.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "set_a", "set_b").mapInArrow(
        check, "a long, b long, linked boolean" + ", n_a long, lacked long, added long, delta array<long>" * deltas)


def hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): for every class its hub, unless that is the class itself."""
    # two bandings: a group of near sizes is whole in one of them
    place = F.log("n") / math.log(100 / percent)
    bands = F.array(*(F.struct(F.lit(k).alias("kind"), F.floor(place + k / 2).alias("band")) for k in (0, 1)))
    rows = postings.select("node", "token", "center", F.explode(bands).alias("z"))
    key = ["token", "z"]
    hub = rows.groupBy(*key).agg(F.max(F.struct("center", F.xxhash64("node").alias("h"), "node")).alias("hub"),
                                 F.count(F.lit(1)).alias("size"))
    hub = hub.where(F.col("size") > 1).select(*key, F.col("hub.center").alias("c"), F.col("hub.node").alias("a"))
    met = rows.select("node", *key).join(hub.hint("merge"), key)
    met = met.groupBy("node", "a").agg(F.count(F.lit(1)).alias("times"), F.first("c").alias("c"))
    best = met.groupBy("node").agg(F.max(F.struct("times", "c", "a")).alias("m"))
    return best.select(F.col("m.a").alias("a"), F.col("node").alias("b")).where(F.col("a") != F.col("b"))


def delta_pairs(hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of one hub, in different components, at least one not linked to
    the hub, that share a delta shingle in the prefix of one of them. ``hubs``: node, hub,
    root, linked, lacked, added, delta."""
    least = F.floor((100 * F.col("lacked") + percent * F.col("added")) / (100 + percent)) + 1
    rows = hubs.select("node", "hub", "root", "linked", (F.size("delta") - least + 1).alias("prefix"),
                       F.explode("delta").alias("token"))
    often = rows.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("freq"))
    rows = rows.join(often.where(F.col("freq") > 1).hint("merge"), ["hub", "token"], "left")
    # shingles of one class come first: they meet nothing but fill the prefix
    order = Window.partitionBy("node").orderBy(F.coalesce("freq", F.lit(1)), "token")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("freq").isNotNull())
    rows = materialise(rows, "delta-postings")
    short = rows.where(F.col("place") <= F.col("prefix")).select("hub", "token", "node", "root")
    far = rows.where(~F.col("linked")).select("hub", "token", F.col("node").alias("u"), F.col("root").alias("u_root"))
    met = short.join(far.hint("merge"), ["hub", "token"]).where(F.col("root") != F.col("u_root"))
    return met.select(F.least("node", "u").alias("a"), F.greatest("node", "u").alias("b")).distinct()


def crossing_pairs(postings: DataFrame, percent: int, group_rows: int) -> DataFrame:
    """(a, b): pairs of classes of different hubs and components (``root``) that are similar in
    size and share as many prefix shingles as the shorter of their prefixes asks for."""
    open_ = postings.groupBy("token").agg((F.min("root") != F.max("root")).alias("roots"), (F.min("hub") != F.max("hub")).alias("hubs"))
    open_ = open_.where(F.col("roots") & F.col("hubs")).select("token")
    rows = materialise(postings.join(open_.hint("merge"), "token", "left_semi"), "open-postings")
    # the larger set of a pair is in the smaller one's band or the next
    large = rows.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    key = ["token", "band"]
    salts = large.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("salts"))
    salts = materialise(salts, "group-salts")
    # dealt by salt as well: a large group is cut, its larger sets copied to every part
    x = rows.join(salts.hint("merge"), key).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    y = large.join(salts.hint("merge"), key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = [*key, "salt"]
    y = y.select(*key, *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "matches", "root", "hub"))).repartition(*key)
    near = (F.col("root") != F.col("root_y")) & (F.col("hub") != F.col("hub_y")) \
        & (F.struct("n", "node") < F.struct("n_y", "node_y")) & (100 * F.col("n") >= percent * F.col("n_y"))
    found = x.repartition(*key).join(y.hint("merge"), key).where(near).select(
        F.col("node").alias("a"), F.col("node_y").alias("b"), F.least("matches", "matches_y").alias("need"))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.first("need").alias("need")).where(
        F.col("times") >= F.col("need")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, shard_shingles: int = SHARD_SHINGLES,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: sets link when
    100 * intersection >= percent * union."""
    held = materialise(blocks(docs, id_col, text_col, block_bytes, packed=True), "join-blocks")
    rows = materialise(document_prefixes(held, shingle, percent, shard_shingles), "prefixes")
    key = ["k1", "k2", "n"]
    classes = rows.where(F.col("n") > 0).groupBy(*key).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("block", "pos")).alias("at"), F.first("matches").alias("matches"),
        F.first("center").alias("center"), F.first("tokens").alias("tokens"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), *key, "least", "at.block", "at.pos",
                                         "matches", "center", "tokens"), "set-classes")
    band = F.floor(F.log("n") / math.log(100 / (percent - 1))).cast("int")  # a little wider than the similarity
    postings = classes.select("node", "n", "matches", "center", band.alias("band"), F.explode("tokens").alias("token"))
    first = materialise(hub_pairs(postings, percent), "hub-pairs")
    first = materialise(compared(first, classes, held, shingle, percent, deltas=True), "hub-deltas")
    # a class linked to its hub is in the hub's component
    hubs = first.where(F.col("delta").isNotNull()).withColumnsRenamed({"a": "hub", "b": "node"})
    hubs = hubs.withColumn("root", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("node")))
    labels = classes.select("node", "n", "matches", band.alias("band"), "tokens").join(
        hubs.select("node", "hub", "root").hint("merge"), "node", "left")
    postings = labels.select("node", "n", "matches", "band", F.coalesce("root", "node").alias("root"),
                             F.coalesce("hub", "node").alias("hub"), F.explode("tokens").alias("token"))
    second = delta_pairs(hubs, percent).union(crossing_pairs(postings, percent, group_rows))
    second = materialise(second, "crossing-pairs")
    more = compared(second, classes, held, shingle, percent).where("linked").select("a", "b")
    root = components(first.where("linked").select("a", "b").union(more))
    named = classes.select("node", *key, "least").join(root.hint("merge"), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(ids.hint("merge"), "root").select(*key, "component_id"), "named-classes")
    return rows.select("doc_id", *key).join(named.hint("merge"), key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
