"""Substring dedup: windows of words that also start in an earlier document.

Pass 1 builds a count-min sketch of all windows. Every block of documents
sends, for each row of the sketch and each shard of its cells, the sorted
cells of its windows (twice if the block has them more than once); a shard
adds up what the blocks sent, and answers with one bit for each cell: counted
at least twice. A window whose cells all are is estimated repeated; the
sketch only overestimates, so no repeated window is lost.

Pass 2 groups exactly the windows estimated repeated: a block sends a 96-bit
hash of each with the smallest document that has it in the block, a shard
finds the smallest over all blocks and answers with one bit: there is an
earlier document in another block. Pass 3 marks the words.

Sketch and exact groups are dealt over shards by hash and grow with the
input, nothing is broadcast. A window that a third of all documents share is
sent once a block. A shard holds about ``shard_windows`` windows, and is decided
a range of hashes at a time. The texts of a block are stored and shuffled compressed.

Defined results: windows are judged on the input; a document is earlier if its
id is smaller (null ids before all others); rows that share an id are one
document to each other, so a repeated row keeps its words; null and empty
texts have no words; texts of fewer words than a window lose none; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import batch_bytes, by_bytes, materialise, ranges, word_spans

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_WINDOWS = 1 << 22
CELLS_PER_WINDOW = 4
DEPTH = 2
#: bytes of words that are hashed at once, and windows of a shard that are decided at once
HASH_BYTES = 1 << 18
RANGE_WINDOWS = 1 << 19
_U = np.uint64
_NULL = np.iinfo(np.int64).min


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw, starts, ends, seeds):
    """For every seed a 64-bit hash of every word: the sum of its mixed bytes, each salted by its
    place. A piece of the words at a time: a byte takes some fifty while it is hashed."""
    size = ends - starts
    out = [np.empty(len(size), np.uint64) for _ in seeds]
    for lo, hi in by_bytes(np.concatenate([[0], np.cumsum(size)]), HASH_BYTES):
        n = size[lo:hi]
        offs = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(offs, n)
        salted = raw[np.repeat(starts[lo:hi], n) + place].astype(np.uint64) + (place.astype(np.uint64) << _U(8))
        for word, seed in zip(out, seeds, strict=True):
            word[lo:hi] = _mix(np.add.reduceat(_mix(salted * _U(2) + _U(seed)), offs) + n.astype(np.uint64) * _U(seed))
    return out


def window_hashes(raw, starts, ends, rows, window):
    """Two 64-bit hashes of every window, and the word each begins at.

    A window's hash is a polynomial in the hashes of its words."""
    per_doc = np.diff(rows)
    n_win = np.maximum(per_doc - window + 1, 0)
    total = int(n_win.sum())
    if not total:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, np.int64)
    first = np.arange(total) + np.repeat(rows[:-1] - (np.cumsum(n_win) - n_win), n_win)
    out = []
    for word in word_hashes(raw, starts, ends, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        h = np.zeros(len(word) - window + 1, np.uint64)
        for j in range(window):
            h = h * _U(0x5851F42D4C957F2D) + word[j:j + len(h)]
        out.append(_mix(h[first]))
    return out[0], out[1], first


def _pack(sorted_values):
    """Sorted integers as bytes: first differences, in 16 bits where they fit."""
    step = np.diff(sorted_values, prepend=sorted_values[:1] * 0)
    wide = len(step) and step.max() > 65535
    return (b"4" if wide else b"2") + step.astype("<u4" if wide else "<u2").tobytes()


def _unpack(data):
    """``_pack`` undone, of an array of bytes."""
    step = np.frombuffer(data, "<u4" if data[0] == ord("4") else "<u2", offset=1)
    return np.cumsum(step, dtype=np.int64)


class Block:
    """The documents of one row of the block table, by id, and their windows."""

    def __init__(self, ids, texts, window):
        key = np.array([_NULL if i is None else i for i in ids], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.ids = [ids[i] for i in order]
        self.raw, offsets = batch_bytes(texts.take(pa.array(order)))
        self.starts, self.ends, self.rows = word_spans(self.raw, offsets)
        self.h, self.h2, self.first = window_hashes(self.raw, self.starts, self.ends, self.rows, window)
        self.doc = np.repeat(key[order], np.maximum(np.diff(self.rows) - window + 1, 0))

    def shard(self, h, shards):
        return ((h >> _U(32)) * _U(shards)) >> _U(32)  # grows with h

    def _row(self, row, shards, shard_cells):
        """The windows' places in the sorted cells of a row of the sketch, and the cells
        that are sent, shard in the upper half: at most two of a kind."""
        cell = _mix(self.h2 + _U(row) * _U(0x9E3779B97F4A7C15)) % _U(shard_cells)
        key = (self.shard(self.h, shards) << _U(32)) | cell
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        sent = new.copy()
        sent[1:] |= new[:-1]
        place = np.maximum.accumulate(np.where(new, np.cumsum(sent) - 1, 0))
        return order, place, key[sent]

    def cells(self, shards, shard_cells, depth):
        """(row, shard, cells) to send."""
        for row in range(depth):
            key = self._row(row, shards, shard_cells)[2]
            for s, part in _by_shard(key >> _U(32)):
                yield row, s, (key[part] & _U(0xFFFFFFFF)).astype(np.int64)

    def candidates(self, answers, shards, shard_cells, depth):
        """Which windows every row of the sketch counts at least twice; ``answers``: bits by
        (row, shard) in the order of the cells sent."""
        yes = np.ones(len(self.h), bool)
        for row in range(depth):
            order, place, key = self._row(row, shards, shard_cells)
            bits = np.zeros(len(key), bool)
            for s, part in _by_shard(key >> _U(32)):
                bits[part] = _bits(answers.get((row, s)), part.stop - part.start)
            yes[order] &= bits[place]
        return yes

    def groups(self, yes):
        """The candidate windows in the order of their hashes, the number of the group of
        equal ones that each is in, and each group's first (its smallest document)."""
        at = np.flatnonzero(yes)
        at = at[np.argsort(self.h[at], kind="stable")]  # documents are in order already
        h, h2 = self.h[at], self.h2[at] >> _U(32)
        new = np.ones(len(at), bool)
        new[1:] = h[1:] != h[:-1]
        if (~new & (h2 != np.roll(h2, 1))).any():       # equal low halves, different windows
            at = at[np.lexsort((self.doc[at], h2, h))]
            h, h2 = self.h[at], self.h2[at] >> _U(32)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        return at, np.cumsum(new) - 1, at[new]

    def claims(self, yes, shards):
        """(shard, low, high, doc) to send: the different candidate windows."""
        one = self.groups(yes)[2]
        for s, part in _by_shard(self.shard(self.h[one], shards)):
            c = one[part]
            yield s, self.h[c], (self.h2[c] >> _U(32)).astype(np.uint32), self.doc[c]

    def repeated(self, yes, answers, shards):
        """The windows that also start in an earlier document."""
        at, group, one = self.groups(yes)
        early = np.zeros(len(one), bool)
        for s, part in _by_shard(self.shard(self.h[one], shards)):
            early[part] = _bits(answers.get(s), part.stop - part.start)
        out = np.zeros(len(self.h), bool)
        out[at] = early[group] | (self.doc[at] > self.doc[one][group])
        return out


def _by_shard(shard):
    """(shard, slice) of a sorted array of shards."""
    at = [*np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1)).tolist(), len(shard)]  # only shards that are met
    return [(int(shard[lo]), slice(lo, hi)) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _bits(data, n):
    if data is None:
        return np.zeros(n, bool)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def unpack_texts(sizes, data) -> pa.Array:
    """The texts of a packed row of the block table, of its scalars ``sizes`` and ``texts``."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<u4"), dtype=np.int64)]).astype(np.int32)
    raw = pa.decompress(data.as_buffer(), int(offsets[-1]), codec="zstd") if offsets[-1] else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), raw)


def text_columns(held: DataFrame) -> list:
    """What of a block table ``block_texts`` reads."""
    return [c for c in ("sizes", "texts") if c in held.columns]


def block_texts(batch, i: int) -> pa.Array:
    """The texts of row ``i`` of an Arrow batch of a block table."""
    texts = batch.column("texts")[i]
    return unpack_texts(batch.column("sizes")[i], texts) if "sizes" in batch.schema.names else texts.values


def blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, packed: bool = False) -> DataFrame:
    """(block, ids, texts, bytes): consecutive documents of a task, about ``block_bytes`` in a row.
    ``packed``: ``texts`` are compressed, of ``sizes`` bytes each, null ones as empty ones."""
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        pieces, held, rows = [], 0, 0

        def row():
            ids, texts = (pa.concat_arrays(x) for x in zip(*pieces, strict=True))
            whole = pa.array([0, len(ids)], pa.int32())
            if packed:
                raw, offsets = batch_bytes(texts)
                texts = [pa.array([np.diff(offsets).astype("<u4").tobytes()], pa.binary()),
                         pa.array([pa.compress(raw.tobytes(), codec="zstd", asbytes=True)], pa.binary())]
            else:
                texts = [pa.ListArray.from_arrays(whole, texts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n], pa.int64()), pa.ListArray.from_arrays(whole, ids), *texts, pa.array([held], pa.int64())],
                ["block", "ids", *["sizes"][:packed], "texts", "bytes"])

        for batch in batches:
            size, lo = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0

            def take(hi):
                # copies, so that no batch is kept for its last documents
                pieces.append(tuple(pa.array(batch.column(c).slice(lo, hi - lo).to_pylist(), t)  # noqa: B023
                                    for c, t in ((0, pa.int64()), (1, pa.string()))))

            for i, length in enumerate(size):
                if rows and held + length > block_bytes:
                    take(i)
                    yield row()
                    n, lo, pieces, held, rows = n + 1, i, [], 0, 0
                held, rows = held + length, rows + 1
            take(len(size))
        if rows:
            yield row()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "block long, ids array<long>, " + "sizes binary, texts binary" * packed + "texts array<string>" * (not packed) + ", bytes long")


def _each(batch, window, names):
    """(block number, Block, the other columns) of every row of an Arrow batch."""
    for i in range(batch.num_rows):
        yield (batch.column("block")[i].as_py(), Block(batch.column("ids")[i].as_py(), block_texts(batch, i), window),
               *(batch.column(c)[i].as_py() for c in names))


def _answers(bits):
    """Struct rows (row?, shard, bits) -> dict."""
    return {(b["row"], b["shard"]) if "row" in b else b["shard"]: b["bits"] for b in bits or ()}


def _views(column, kind):
    """The numbers of every value of a binary column, not copied."""
    return [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]


def _packed(bits):
    return pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())


def counted_twice(group: pa.Table, shard_cells: int) -> pa.Table:
    """All blocks' cells of a row and shard of the sketch -> for each block a bit a cell."""
    count, cells_of = np.zeros(shard_cells, np.uint8), _views(group.column("cells"), np.uint8)
    for data in cells_of:
        cells = _unpack(data)
        twice = np.zeros(len(cells), bool)
        twice[1:] = cells[1:] == cells[:-1]
        one = cells[~twice]
        count[one] = np.minimum(count[one] + 1, 2)
        count[cells[twice]] = 2
    bits = _packed(count[_unpack(data)] > 1 for data in cells_of)
    return group.select(["block", "row", "shard"]).append_column("bits", bits)


def claimed_earlier(group: pa.Table) -> pa.Table:
    """All blocks' claims of a shard -> for each block a bit a claim: another one of the same
    window has a smaller document. A block's claims are sorted by ``low``: ranges of it are
    decided one after the other, so that no more than some of the shard is sorted at once."""
    lows, highs, docs = (_views(group.column(c), t) for c, t in (("low", np.uint64), ("high", np.uint32), ("doc", np.int64)))
    early = [np.zeros(len(x), bool) for x in lows]
    for parts in ranges(lows, RANGE_WINDOWS):
        low, high, doc = (np.concatenate([x[p] for x, p in zip(of, parts, strict=True)]) for of in (lows, highs, docs))
        order = np.lexsort((doc, high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        told = np.empty(len(doc), bool)
        told[order] = first < doc[order]
        at = 0
        for out, p in zip(early, parts, strict=True):
            out[p] = told[at:at + p.stop - p.start]
            at += p.stop - p.start
    return group.select(["block", "shard"]).append_column("bits", _packed(early))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES, shard_windows: int = SHARD_WINDOWS,
         cells_per_window: int = CELLS_PER_WINDOW, depth: int = DEPTH) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_removed, kept (the words kept, joined by
    a space) and removed, array of (start, end) word numbers."""
    held = materialise(blocks(docs, id_col, text_col, block_bytes, packed=True), "blocks")
    total = held.agg(F.sum("bytes")).first()[0] or 0
    # a word and its space take 4 bytes and more in most texts: a bound on the windows, near enough
    shards = max(1, -(-(total // 4) // shard_windows))
    shard_cells = cells_per_window * shard_windows

    def sketch(batches):
        for batch in batches:
            for number, block in _each(batch, window, ()):
                got = list(block.cells(shards, shard_cells, depth))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in got], pa.int32()), pa.array([s for _, s, _ in got], pa.int32()),
                     pa.array([number] * len(got), pa.int64()),
                     pa.array([_pack(c) for _, _, c in got], pa.binary())], ["row", "shard", "block", "cells"])

    def merge(group: pa.Table) -> pa.Table:
        return counted_twice(group, shard_cells)

    held = held.drop("bytes")
    sent = held.mapInArrow(sketch, "row int, shard int, block long, cells binary")
    heard = sent.groupBy("row", "shard").applyInArrow(merge, "block long, row int, shard int, bits binary")
    heard = materialise(heard.groupBy("block").agg(
        F.collect_list(F.struct("row", "shard", "bits")).alias("sketch")), "sketch-answers")
    known = held.join(heard, "block", "left")

    def claim(batches):
        for batch in batches:
            for number, block, bits in _each(batch, window, ["sketch"]):
                yes = block.candidates(_answers(bits), shards, shard_cells, depth)
                got = list(block.claims(yes, shards))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int32()), pa.array([number] * len(got), pa.int64()),
                     *(pa.array([g[i].tobytes() for g in got], pa.binary()) for i in (1, 2, 3))],
                    ["shard", "block", "low", "high", "doc"])

    claims = known.mapInArrow(claim, "shard int, block long, low binary, high binary, doc binary")
    told = claims.groupBy("shard").applyInArrow(claimed_earlier, "block long, shard int, bits binary")
    told = materialise(told.groupBy("block").agg(
        F.collect_list(F.struct("shard", "bits")).alias("early")), "exact-answers")

    def cut(batches):
        for batch in batches:
            for _, block, bits, early in _each(batch, window, ["sketch", "early"]):
                yes = block.candidates(_answers(bits), shards, shard_cells, depth)
                gone = np.zeros(len(block.starts) + 1, np.int64)
                at = block.first[block.repeated(yes, _answers(early), shards)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                yield _rows(block, gone)

    return known.join(told, "block", "left").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")


def _rows(block, gone):
    data, n, kept, spans = block.raw.tobytes(), [], [], []
    for lo, hi in zip(block.rows[:-1].tolist(), block.rows[1:].tolist(), strict=True):
        g = gone[lo:hi]
        n.append((hi - lo, int(g.sum())))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        left = lo + np.flatnonzero(~g)
        kept.append(b" ".join([data[i:j] for i, j in zip(block.starts[left].tolist(), block.ends[left].tolist(), strict=True)]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(block.ids, pa.int64()), pa.array([a for a, _ in n], pa.int64()),
         pa.array([b for _, b in n], pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept]),
         pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept", "removed"])
