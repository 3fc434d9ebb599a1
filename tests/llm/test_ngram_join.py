"""The n-gram Jaccard join against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers as H
from flowsentry.llm import ngram_join


def shingles(text, k=4):
    w = H.SPACE_WORD.findall(H.lower(text))
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_force(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = H.groups(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b))
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(r) if s else d) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind < 2 or not rows:
            w = [word() for _ in range(rng.choice([1, 3, 4, 5, 9, 10, 40, 200]))]
        elif kind == 2:
            w = passage + [word() for _ in range(rng.randrange(30))]
        else:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
        rows.append((i, ("  " if i % 7 == 0 else " ").join(x.upper() if i % 5 == 0 else x for x in w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É é a\x00b"), (n + 4, "É É a\x00b"), (n + 5, "a b c"), (n + 6, "A  b\nC"),
             (3, rows[8][1]), (3, rows[8][1]), (None, rows[9][1]), (n + 7, " ".join(f"v{j}" for j in range(5000)))]
    return rows


@pytest.mark.parametrize("seed, limits", [(1, {}), (3, {"block_bytes": 1, "shard_shingles": 50, "group_rows": 1})])
def test_join_equals_brute_force(spark, seed, limits):
    rows = corpus(seed)
    df = H.docs_frame(spark, rows, extra=("node", "token", "n", "block")).repartition(5)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(df, **limits).select(
        "doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_force(rows)


def near_copies(seed, n, with_base):
    """Copies of one text with 1 to 6 edits: single, or of a small set that many copies share."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    common = [(rng.randrange(120), f"c{k}") for k in range(8)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, n):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            at, word = rng.choice(common) if rng.random() < .5 else (rng.randrange(120), f"x{rng.randrange(10 ** 6)}")
            w[at:at + 1] = [] if rng.random() < .2 else [word]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("with_base", [True, False])
def test_hot_group_of_near_copies(spark, with_base):
    rows = near_copies(5, 250, with_base)
    want = brute_force(rows)
    assert 20 < len({c for _, _, c in want}) < 200
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(H.docs_frame(spark, rows), group_rows=50).collect()), key=str)
    assert got == want


def test_random_edits_make_few_pairs(spark):
    """Copies whose edits differ are compared with their hub, not with each other."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [f"b{j}" for j in range(150)]
        for _ in range(i and rng.randrange(1, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    docs = ngram_join.document_prefixes(ngram_join.blocks(H.docs_frame(spark, rows), "doc_id", "text", 1 << 20), 4, 85, 1 << 20)
    docs = ngram_join.materialise(docs.withColumn("node", F.col("doc_id")), "t")
    postings = docs.select("node", "n", "matches", "center", F.explode("tokens").alias("token"))
    pairs = ngram_join.hub_pairs(postings, 85).collect()
    assert len(pairs) == 399 and {r.a for r in pairs} == {0}
    sets, hub = {i: shingles(t) for i, t in rows}, shingles(rows[0][1])
    data = []
    for i in range(1, 400):
        lacked, added = len(hub - sets[i]), len(sets[i] - hub)
        near = 100 * len(hub & sets[i]) >= 85 * len(hub | sets[i])
        data.append((i, 0, 0 if near else i, near, lacked, added, [hash(s) for s in hub ^ sets[i]]))
    hubs = spark.createDataFrame(data, "node long, hub long, root long, linked boolean, lacked long, added long, delta array<long>")
    got = {frozenset(r) for r in ngram_join.delta_pairs(hubs, 85).collect()}
    assert len(got) < 400  # of 80,000


def test_pairs_of_one_hub_are_complete(spark):
    rows = near_copies(6, 200, True)
    sets, hub = {i: shingles(t) for i, t in rows}, shingles(rows[0][1])
    near = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    data = [(i, 0, 0 if near(hub, sets[i]) else i, near(hub, sets[i]), len(hub - sets[i]), len(sets[i] - hub),
             [hash(s) for s in hub ^ sets[i]]) for i in sets if i and sets[i] != hub]
    hubs = spark.createDataFrame(data, "node long, hub long, root long, linked boolean, lacked long, added long, delta array<long>")
    got = {frozenset(r) for r in ngram_join.delta_pairs(hubs, 85).collect()}
    far = {d[0] for d in data if not d[3]}
    want = {frozenset((x, y)) for x in far for y in sets if y != x and sets[x] != sets[y] and near(sets[x], sets[y])}
    assert len(want) > 5 and want <= got


def test_crossing_pairs_alone_are_complete(spark):
    """Without leaders, every pair of different components comes from the prefixes."""
    rows = corpus(7, 80)
    df = H.docs_frame(spark, rows)
    held = ngram_join.materialise(ngram_join.blocks(df, "doc_id", "text", 5000), "t")
    docs = ngram_join.document_prefixes(held, 4, 85, 100).where("n > 0").dropDuplicates(["k1", "k2", "n"])
    docs = ngram_join.materialise(docs.withColumn("node", F.monotonically_increasing_id()), "t")
    band = F.floor(F.log("n") / np.log(100 / 84)).cast("int")
    postings = docs.select("node", "n", "matches", band.alias("band"), F.explode("tokens").alias("token"), F.col("node").alias("root"), F.col("node").alias("hub"))
    got = {frozenset(r) for r in ngram_join.crossing_pairs(postings, 85, 4).collect()}
    text = {(b, p): t for b, ts in held.select("block", "texts").collect() for p, t in enumerate(ts)}
    sets = {r.node: shingles(text[r.block, r.pos]) for r in docs.collect()}
    want = {frozenset((x, y)) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])}
    assert len(want) > 3 and want <= got


def test_longer_prefixes_ask_for_more(spark):
    """Common shingles in a prefix make it longer; the set's own least overlap never moves."""
    h = np.arange(200, dtype=np.uint64)
    offsets = np.array([0, 100, 200])
    level = np.where(np.arange(200) < 100, 0, 60).astype(np.uint8)
    level[:100:9] = 4
    matches, center, tokens, cut = ngram_join.prefixes(h, offsets, level, 85)
    assert matches[0] < matches[1] and np.diff(cut)[1] == 15 + matches[1]
    assert center[0] < center[1] == 60
    assert ngram_join.least_overlap(np.array([1, 6, 7, 20]), 85).tolist() == [1, 6, 6, 17]


def test_word_hashes_tell_words_apart():
    words = ["a", "a\x00", "b", "abcdefgh", "abcdefghi", "abcdefgh\x00", "hgfedcba", "é", "x" * 100, "x" * 101]
    raw, offsets = ngram_join.batch_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = ngram_join.word_spans(raw, offsets)
    h = ngram_join.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(words) == len(re.findall(r"[^\x20\x09-\x0D]+", " ".join(words)))


def test_empty_table(spark):
    df = H.docs_frame(spark, [(1, "a")]).limit(0)
    assert ngram_join.near_duplicates(df).count() == 0
    only = ngram_join.near_duplicates(H.docs_frame(spark, [(1, None), (1, ""), (2, " ")])).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 1), (1, 0, 1), (2, 0, 2)]


def test_frequencies_by_ranges(monkeypatch):
    """A shard's frequencies are the same in one range and in many, and many take less memory."""
    rng = np.random.default_rng(2)
    cells = [np.unique(rng.integers(0, 1 << ngram_join.CELL_BITS, 100_000)) for _ in range(12)] + [np.arange(3)]
    cells[1] = cells[0]
    counts = [1 + c % 3 for c in cells]
    group = pa.table({"block": range(13), "shard": [4] * 13, "cells": [ngram_join.pack_planes(np.diff(c, prepend=0)) for c in cells],
                      "counts": [ngram_join.pack_planes(c) for c in counts]})
    tracemalloc.start()
    got, peaks = [], []
    for most in (1 << 30, 50_000):
        monkeypatch.setattr(ngram_join, "RANGE_SHINGLES", most)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        got.append(ngram_join.frequency_shard(group).to_pydict())
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
    tracemalloc.stop()
    assert got[0] == got[1] and got[0]["block"] == list(range(13))
    total = Counter()
    for c, n in zip(cells, counts, strict=True):
        total.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
    want = [np.round(4 * np.log2([total[x] for x in c.tolist()])).astype(np.uint8).tobytes() for c in cells]
    assert got[0]["levels"] == want
    assert peaks[1] < 30e6 < peaks[0]
