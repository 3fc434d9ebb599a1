"""Operators over texts against brute force, on small tables with the hard cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import common, decontam, line_dedup, quality, secret_scan, simhash, substring_dedup
from flowsentry.llm.components import components
from flowsentry.session import ship_package
import helpers as H

VOCAB = [f"w{i}" for i in range(40)] + ["Éa", "ß", "don't", "X", "the,"]


def corpus(seed=1, n=60):
    """Unique ids; copies, shared passages, a hot passage, null, empty, blank and long texts."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(VOCAB) for _ in range(k))
    shared = [text(30) for _ in range(4)]
    hot = text(20)
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 40))]
        if i % 3 == 0:
            parts.append(hot)
        if i % 4 == 0:
            parts.append(rng.choice(shared))
        parts.append(text(rng.randint(0, 10)))
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, rows[5][1]), (n + 4, rows[5][1]),
             (n + 5, text(6000) + " " + hot), (-3, rows[7][1]), (n + 6, "one"), (n + 7, "w1 " * 50)]
    return rows


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(spark, small):
    rows = corpus()
    docs = H.docs_frame(spark, rows, extra=("block", "shard")).repartition(5)
    args = dict(block_bytes=2000, shard_windows=300, cells_per_window=1) if small else {}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.mark(docs, **args).collect()}
    assert got == H.repeated_windows(rows)


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(None, text), (1, text), (1, text), (2, text + " b")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in
                 substring_dedup.mark(H.docs_frame(spark, rows)).collect())
    assert got == [(False, 0, 0), (True, 1, 20), (True, 1, 20), (True, 2, 20)]
    assert substring_dedup.mark(H.docs_frame(spark, [])).count() == 0


def test_substring_dedup_memory():
    """A block of 4 MB and a shard of claims take a small multiple of themselves at any moment."""
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(600_000))
    tracemalloc.start()
    block = substring_dedup.Block([1], pa.array([text]), 13)
    assert len(block.h) == 600_000 - 12 and tracemalloc.get_traced_memory()[1] < 100e6
    rng, n = np.random.default_rng(1), 100_000
    low = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2)]
    claims = [(low[i % 2], (low[i % 2] >> np.uint64(20)).astype(np.uint32), np.full(n, 100 - i)) for i in range(10)]
    group = pa.table({"block": range(10), "shard": [0] * 10, **{c: [x[i].tobytes() for x in claims] for i, c in enumerate(("low", "high", "doc"))}})
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    told = substring_dedup.claimed_earlier(group).to_pydict()
    assert tracemalloc.get_traced_memory()[1] - before < 60e6
    tracemalloc.stop()
    # the last of each kind of block has the smallest document
    assert [sum(map(int.bit_count, x)) for x in told["bits"]] == [n] * 8 + [0, 0]


def test_substring_dedup_ranges(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(substring_dedup, "HASH_BYTES", 7)
    text = pa.array(["a bb ccc", "", "dddd " * 5 + "e"])
    some = substring_dedup.Block([3, None, 2], text, 2)
    monkeypatch.undo()
    whole = substring_dedup.Block([3, None, 2], text, 2)
    assert some.h.tolist() == whole.h.tolist() and some.h2.tolist() == whole.h2.tolist()
    held = substring_dedup.blocks(H.docs_frame(spark, [*rows, (None, None), (5, "")]).coalesce(1), "doc_id", "text", 3000, packed=True).collect()
    got = []
    for r in held:
        texts = substring_dedup.unpack_texts(pa.scalar(bytes(r.sizes)), pa.scalar(bytes(r.texts))).to_pylist()
        assert len(texts) == len(r.ids) and sum(len(t.encode()) for t in texts) == r.bytes
        got += zip(r.ids, texts, strict=True)
    assert got == [(i, t or "") for i, t in [*rows, (None, None), (5, "")]] and len(held) > 1
    low = [np.array(x, np.uint64) for x in ([1, 5, 5, 9], [], [5, 8, 1 << 63])]
    parts = list(common.ranges(low, 2))
    assert [sorted({int(v) for x, p in zip(low, cut, strict=True) for v in x[p]}) for cut in parts] == [[1, 5, 8, 9], [], [], [1 << 63]]


ITEMS = [(1, None), (2, ""), (3, "the"), (4, "W1 w2 w3"), (10, "no such words anywhere at all"), (11, "ß")]


def bench(spark, rows, seed=1):
    rng = random.Random(seed)
    texts = [t.split() for _, t in rows if t and len(t.split()) > 30]
    items = list(ITEMS)
    for i in range(8):
        w = rng.choice(texts)
        k = rng.randrange(len(w) - 25)
        items.append((20 + i, " ".join(w[k:k + rng.choice([9, 10, 11, 25])]).upper()))
    items.append((20, items[-1][1]))
    return items, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, words int")


def test_decontamination(spark):
    rows = corpus(2)
    items, table = bench(spark, rows)
    docs = H.docs_frame(spark, rows, extra=("words", "found", "pos"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.phrase_hits(docs, table).collect()}
    want = H.benchmark_hits(rows, items)
    assert got == want
    kept = decontam.without_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[1]}


def test_decontamination_hard_cases(spark):
    _, table = bench(spark, corpus(2))
    rows = [(None, "the"), (5, "the"), (5, "the"), (5, "other"), (6, None)]
    got = decontam.phrase_hits(H.docs_frame(spark, rows), table).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 1, 1), (5, 1, 0), (5, 1, 1), (5, 1, 1), (6, 0, 0)]
    assert decontam.phrase_hits(H.docs_frame(spark, []), table).count() == 0
    none = decontam.phrase_hits(H.docs_frame(spark, rows), table.limit(0)).collect()
    assert [r.n_hit for r in none] == [0] * 5


def test_proximity(spark):
    docs = H.docs_frame(spark, [(1, "rare1 x x x rare2 x"), (2, "rare2 " + "x " * 30 + "rare1"), (3, "rare1 x")])
    table = spark.createDataFrame([(9, "rare1 rare2")], "item_id long, text string")
    got = decontam.proximity_matches(docs, table, n_terms=2, within=5).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 9)}


def near_places(rows, items, n_terms=3, within=20):
    """(doc, item, pos) by brute force; the corpus frequency decides what is rare."""
    texts = [(d, H.TERM.findall(H.lower(t))) for d, t in rows]
    freq = {}
    for _, ws in texts:
        for w in ws:
            freq[w] = freq.get(w, 0) + 1
    out = set()
    for i, t in items:
        terms = sorted((freq.get(w, 0), w) for w in set(H.TERM.findall(H.lower(t))))[:n_terms]
        if not terms or not terms[0][0]:
            continue
        for d, ws in texts:
            for pos, w in enumerate(ws):
                if w == terms[0][1] and {x for _, x in terms} <= set(ws[max(0, pos - within):pos + within + 1]):
                    out.add((d, i, pos))
    return out


@pytest.mark.parametrize("n_terms,within", [(3, 20), (2, 1), (4, 7)])
def test_proximity_equals_brute_force(spark, n_terms, within):
    rows = corpus(2)
    items, table = bench(spark, rows)
    docs = H.docs_frame(spark, rows, extra=("n", "slot", "n_near")).repartition(3)
    want = near_places(rows, items, n_terms, within)
    got = decontam.proximity_matches(docs, table, n_terms=n_terms, within=within).collect()
    assert {(r.doc_id, r.item_id, r.pos) for r in got} == want and len(got) == len(want) > 0


def test_query_counts_near_items(spark):
    from flowsentry.llm import queries
    from flowsentry.session import scratch_path
    rows = corpus(2)
    items, table = bench(spark, rows)
    repeated = rows + [rows[0], rows[0], (None, "the"), (1, "the")]
    sf = scratch_path(spark, "op2-test")
    H.docs_frame(spark, repeated).write.parquet(f"{sf}/documents.parquet")
    table.write.parquet(f"{sf}/benchmark.parquet")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_near) for r in queries.QUERIES["op2_decontam"](spark, sf).collect()))
    # each row by a number of its own
    near = {}
    for d, i, _ in near_places([(k, t) for k, (_, t) in enumerate(repeated)], items):
        near.setdefault(d, set()).add(i)
    assert got == sorted((d is None, d or 0, len(H.TERM.findall(H.lower(t))), len(near.get(k, ()))) for k, (d, t) in enumerate(repeated))


SECRETS = [
    None, "", "nothing here", "password=abc", 'PASSWD : "abcdef"', "token=token:abcdef1", "secret=a token = bcdefgh",
    "apikey=123456 api_key='x.y-z/+_='", "AKIA" + "A1" * 9 + " AKIAAKIA" + "Z" * 20, "x" + "0f" * 12 + "g" + "ab" * 11,
    "é password=ééé token=abcdefé𝔘 deadbeef" + "0" * 20, "key Zx9Qw7Lk2Vb8Nm4Tr6Yp1Hs end", "w" * 70_000 + " token=zzzzzz",
    "password=password=secretsecret", "ſecret=abcdefgh"]
BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         lambda m: len(m.group(2)) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24))


def ascii_assign(text):
    """The assign pattern with ASCII letters in either case."""
    pattern = re.compile(BASE[0][1].pattern.replace("(?i:", "(?ai:"))
    return [m for m in pattern.finditer(text) if BASE[0][2](m)]


def test_secret_patterns(spark):
    rows = list(enumerate(SECRETS))
    docs = H.docs_frame(spark, rows, extra=("assign", "hex"))
    plain = secret_scan.scan(docs.select("doc_id", "text"), [0.0] * len(secret_scan.ALPHABET) ** 2)
    got = {r.doc_id: (r.d, r.markov) for r in plain.select(
        "doc_id", secret_scan.digest("assign", "access", "hex").alias("d"), "markov").collect()}
    for i, t in rows:
        spans = []
        for k, (kind, pattern, ok) in enumerate(BASE):
            hits = ascii_assign(t or "") if not k else [m for m in pattern.finditer(t or "") if ok(m)]
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in hits]
        assert got[i][0] == ",".join(s for _, _, s in sorted(spans)), (i, t)
        assert got[i][1] == []  # a flat ratio finds nothing
    assert secret_scan.scan(docs.limit(0).select("doc_id", "text"), [0.0] * len(secret_scan.ALPHABET) ** 2).count() == 0


def test_secret_models_tell_random_strings(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    part = ["user", "order", "count", "index", "total", "value", "name", "cache", "token", "state"]
    ident = lambda: "_".join(rng.choice(part) for _ in range(5))
    samples = spark.createDataFrame([(key(30), True) for _ in range(300)] + [(ident(), False) for _ in range(300)],
                                    "token string, secret boolean")
    ratios = secret_scan.fit(samples)
    rows = [(i, f"see {key(28) if i % 2 else ident()} there") for i in range(60)]
    got = secret_scan.scan(H.docs_frame(spark, rows).select("doc_id", "text"), ratios).collect()
    assert all((len(r.markov) == 1) == (r.doc_id % 2 == 1) for r in got)
    assert secret_scan.fit(samples.limit(0)) == [0.0] * len(secret_scan.ALPHABET) ** 2


RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")


def base_spans(text):
    """(start, kind number, kind, end) of the fixed patterns, in order."""
    found = []
    for k, (kind, pattern, ok) in enumerate(BASE):
        hits = ascii_assign(text) if not k else [m for m in pattern.finditer(text) if ok(m)]
        found += [(m.start(), k, kind, m.end()) for m in hits]
    return sorted(found)


def test_secret_spans_of_texts_with_very_many_matches(spark):
    rng = random.Random(8)
    words = ["password=abcdef12", "AKIA" + "Q" * 16, "0f" * 14, "user_order_count_index_total_value", "é", "token: xy", "x" * 25 + "=="]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 255, 256, 257, 700])]
    got = {r.doc_id: r for r in secret_scan.scan(H.docs_frame(spark, rows), [1.0] * len(secret_scan.ALPHABET) ** 2).collect()}
    for i, t in rows:
        base = base_spans(t)
        for kind in ("assign", "access", "hex"):
            assert [(s.start, s.end) for s in got[i][kind]] == [(s, e) for s, _, k, e in base if k == kind]
        runs = [(m.start(), m.end()) for m in RUN.finditer(t)]
        assert [(s.start, s.end) for s in got[i].markov] == [r for r in runs if not any(s < r[1] and r[0] < e for s, _, _, e in base)]
    assert sum(len(r.markov) for r in got.values()) > 300


def test_op3_query_finds_planted_secrets(spark, tmp_path):
    """The registered query on a table with random keys that no pattern knows."""
    import hashlib
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    part = ["user", "order", "count", "index", "total", "value", "name", "cache", "state", "report", "Handler", "Manager"]
    rows, planted, ordinary = [], {}, 0
    for i in range(400):
        w = [rng.choice(part) for _ in range(30)]
        if i % 2:
            w.append(f"password={''.join(rng.choice(chars) for _ in range(24))}")
        if i % 5 == 0:
            key = "".join(rng.choice(chars) for _ in range(rng.randrange(24, 40)))
            w.insert(10, key)
            start = len(" ".join(w[:10])) + 1
            planted[i] = (start, start + len(key))
        if i % 3 == 0:
            w.append("_".join(rng.choice(part) for _ in range(6)))
            ordinary += 1
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, "")]
    H.docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    from flowsentry.llm import queries
    got = {r.doc_id: r for r in queries.QUERIES["op3_secrets"](spark, str(tmp_path)).collect()}
    hit = extra = 0
    for i, t in rows:
        base = base_spans(t or "")
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, _, k, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("markov")] == [s for s in text.split(",") if s]
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)
        found = [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("markov")]
        hit += planted.get(i) in found
        extra += len([f for f in found if f != planted.get(i)])
    assert hit >= 0.95 * len(planted)           # recall
    assert extra <= 0.05 * len(planted)         # of 134 ordinary identifiers as long


def test_secret_sample_is_bounded_and_never_empty(spark):
    docs = H.docs_frame(spark, [(i, f"password=abcdef{i % 300:04d}") for i in range(3000)])
    n = secret_scan.labelled_samples(docs, sample_rows=100).where("secret").count()
    assert 0 < n <= 30  # a thirtieth of the 300 different texts
    assert secret_scan.labelled_samples(docs, sample_rows=10 ** 6).where("secret").count() == 300


def line_corpus(seed=3, n=50):
    rng = random.Random(seed)
    pool = [f"line {i} " + "x" * rng.choice([0, 3, 60]) for i in range(30)]
    rows = []
    for i in range(n):
        lines = [rng.choice([rng.choice(pool), f"own {i} {rng.random()}", "", " "]) for _ in range(rng.randint(1, 25))]
        if i % 3 == 0:
            lines[1:1] = ["hot line of a third of all documents", "and the one after it"]
        rows.append((i, "\n".join(lines)))
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, rows[4][1]), (n + 4, "a\n" * 40 + "b"),
             (n + 5, "\n".join(rows[0][1].split("\n") * 3)), (n + 6, "y" * 100_000)]
    return rows


@pytest.mark.parametrize("min_lines,min_chars", [(2, 50), (3, 40), (5, 10_000_000)])
def test_line_dedup(spark, min_lines, min_chars):
    rows = line_corpus()
    docs = H.docs_frame(spark, rows, extra=("line", "seq", "runs", "deleted_runs")).repartition(4)
    out = line_dedup.dedup_lines(docs, min_lines=min_lines, min_chars=min_chars)
    # the input's column of the result's name is replaced
    assert out.columns == [*(c for c in docs.columns if c != "deleted_runs"), "deleted_runs"]
    assert {r.doc_id: r.text for r in out.collect()} == H.line_copies(rows, min_lines, min_chars)


def test_line_dedup_repeated_rows_and_empty(spark):
    text = "\n".join(f"line number {i} of a document that is long enough" for i in range(4))
    rows = [(None, text), (None, text), (2, text), (2, "other")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(H.docs_frame(spark, rows)).collect())
    assert got == [(0, text), (0, text), (2, ""), (2, "other")]
    assert line_dedup.dedup_lines(H.docs_frame(spark, [])).count() == 0


def test_simhash_near_duplicates(spark):
    rows = corpus(4)
    rows += [(1000 + i, rows[9][1] + f" tail{i}") for i in range(12)]
    docs = H.docs_frame(spark, rows, extra=("fp", "cell", "root"))
    fps = [H.fingerprint(t) for _, t in rows]
    root = H.groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    ids = {}
    for (d, _), r in zip(rows, root, strict=True):
        ids[r] = min(ids.get(r, d), d)
    want = {d: (f, ids[r]) for (d, _), f, r in zip(rows, fps, root, strict=True)}
    got = {r.doc_id: (r.fp % 2 ** 64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell_limit", [4, 256])
def test_simhash_links_are_complete(spark, cell_limit):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2 ** 64 - 1}
    for center in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(120):
            x = center
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - 2 ** 64 if v >> 63 else v for v in values]
    root = H.groups(values, lambda a, b: (a ^ b).bit_count() <= 2)
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, cell_limit)
    for r in links.collect():
        assert ((r.a ^ r.b) % 2 ** 64).bit_count() <= 2 or root[signed.index(r.a)] == root[signed.index(r.b)]
    found = {r.node: r.root for r in components(links).collect()}
    parts = lambda key: sorted(sorted(v for v, k in zip(signed, key, strict=True) if k == x) for x in set(key))
    assert parts([found.get(v, v) for v in signed]) == parts(root)


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(200, 260)]}}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(quality.held_out())
    right = scored.select(((F.col("score") >= quality.THRESHOLD).cast("int") == F.col("quality")).alias("ok")).collect()
    assert len(right) > 50 and sum(r.ok for r in right) / len(right) >= 0.95
    assert model.pairs


def test_quality_hard_cases(spark):
    rows = [(None, "some text"), (1, None), (1, ""), (2, "w " * 200_000), (3, "ok")]
    docs = H.docs_frame(spark, rows, extra=("x", "score_"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    bare = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, bare, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), bare, ["doc_id"]).count() == 0


def test_quality_slices_do_not_change_features():
    import numpy as np
    import pyarrow as pa
    texts = ["A b, c!! 12\nx x", "", None, "é é é", "big " * 2_000_000, "end. THE End"]
    whole = quality.batch_features(pa.array(texts))
    alone = np.vstack([quality.batch_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone)


def test_fingerprint_of_long_text():
    import pyarrow as pa
    text = " ".join(f"Word{i}" for i in range(300_000))
    assert int(simhash.batch_fingerprints(pa.array([text, "a b", None]))[0]) == H.fingerprint(text)
    assert int(simhash.batch_fingerprints(pa.array(["a B"]))[0]) == H.fingerprint("a b")


def test_pipeline_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice(VOCAB) for _ in range(60)) for _ in range(3))
    rows = [(3, b), (5, a), (5, b), (5, b), (None, b), (7, c), (9, c), (9, None), (9, a)]
    got = corpus_pipeline.near_duplicate_stage(spark, H.docs_frame(spark, rows), "")
    assert got.columns == corpus_pipeline.COLUMNS
    # of b the least id is 3, of a 5, of c 7, of the null text 9
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == sorted(
        [(3, b), (5, a), (0, b), (7, c), (9, None)], key=str)


def test_quality_sample_is_not_filled_by_one_id(spark):
    from zlib import crc32
    import numpy as np
    ids = [i for i in range(2, 60) if crc32(str(i).encode()) % 4 != 2]
    plain = [(0, "@@ ## 11 22")] + [(i, "good plain words of a text" if i % 2 else "@@ ## 11 22") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in plain], "doc_id long, quality int")
    once = quality.train(H.docs_frame(spark, plain), labels, sample_rows=100)
    hot = quality.train(H.docs_frame(spark, plain + [plain[0]] * 300), labels, sample_rows=100)
    assert once.base == hot.base
    assert all(np.array_equal(x, y) for x, y in zip(once.tables, hot.tables, strict=True))


def colliding_lines(seed=42):
    """Two lines of 16 ASCII characters with the same xxhash64: the second word of the
    other one is solved for."""
    p1, p2, p4, p5, mask = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 2 ** 64 - 1)
    rotl = lambda x, n: (x << n | x >> (64 - n)) & mask
    mix = lambda k: rotl(k * p2 & mask, 31) * p1 & mask
    back = lambda k: rotl(k * pow(p1, -1, 2 ** 64) & mask, 33) * pow(p2, -1, 2 ** 64) & mask
    word = lambda s: int.from_bytes(s, "little")
    after = lambda w: (rotl((seed + p5 + 16 & mask) ^ mix(word(w)), 27) * p1 + p4) & mask
    first, end = b"a line o", b"f text.."
    target = after(first) ^ mix(word(end))
    for i in range(10 ** 6):
        other = b"%08d" % i
        found = back(after(other) ^ target).to_bytes(8, "little")
        if all(0x20 < x < 0x7F for x in found):
            return (first + end).decode(), (other + found).decode()


def test_lines_with_equal_hash_are_told_apart(spark):
    one, other = colliding_lines()
    assert one != other
    import xxhash
    assert xxhash.xxh64_intdigest(one, 42) == xxhash.xxh64_intdigest(other, 42)
    rows = [(1, one), (2, other), (3, one)]
    got = line_dedup.dedup_lines(H.docs_frame(spark, rows), min_chars=10).collect()
    assert {r.doc_id: r.text for r in got} == {1: one, 2: other, 3: ""}


@pytest.mark.parametrize("bits", [0, 1])
def test_simhash_links_of_fewer_bits(spark, bits):
    rng = random.Random(7)
    # x and y are one bit apart, z is two bits from y and the least
    values = {0b1100 << 8, 0b1101 << 8, 0b0001 << 8 | 0b0100 << 8, 0}
    for center in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(80):
            x = center
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - 2 ** 64 if v >> 63 else v for v in values]
    root = H.groups(values, lambda a, b: (a ^ b).bit_count() <= bits)
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, 2)
    found = {r.node: r.root for r in components(links).collect()}
    parts = lambda key: sorted(sorted(v for v, k in zip(signed, key, strict=True) if k == x) for x in set(key))
    assert parts([found.get(v, v) for v in signed]) == parts(root)
