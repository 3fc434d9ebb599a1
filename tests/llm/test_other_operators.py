"""WARC, packing, neighbours and chat on small tables with the hard cases; the
registered queries against their SQL; the pipeline against brute force."""

import glob
import hashlib
import os
import random
import zlib

import helpers as H
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsentry.llm import ann, chat, decontam, packing, queries, quality, warc
from flowsentry.session import scratch_path, ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ----------------------------------------------------------------- WARC

def fake(i, n):
    """A whole record as it could stand in a payload."""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n" + "f" * min(n, 10 ** 6) + "\r\n\r\n"


def pages():
    big = "é" + "copy " * 400
    rows = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "u\r\nEvil: 1", ""), (4, "http://d", big), (5, "e", big),
            (6, "f", big), (7, "g", fake(99, 50)), (8, "h", "a" + fake(98, 3) * 40 + "WARC/1.1\r\n"), (9, "i", "WARC/1.1\r\n"),
            (10, "j", fake(97, 10 ** 6)), (11, "k", "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "l", "short"), (13, "m", "short"),
            *((20 + i, f"q{i}", fake(96, n)[:200]) for i, n in enumerate([0, -1, 99999999999, 2 ** 63 - 1])),
            *((30 + i, f"r{i}", f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\nX-Payload-Length: {n}\r\n\r\nx" * 3)
              for i, n in enumerate(["abc", "1" * 20, "-5", "", "1e3", "99999999999", "7"])),
            (14, "n", "z" * 300_000), (None, "o", "no id"), (15, "p", big[:-1] + "!"), (12, "l", "short")]
    rng = random.Random(2)
    return rows + [(100 + i, f"u{i}", "".join(rng.choice("ab\r\nWARC/1. ") for _ in range(rng.randint(0, 3000))))
                   for i in range(150)]


@pytest.mark.parametrize("split", [2_000, 50_000, 128 << 20])
def test_warc_round_trip(spark, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).repartition(3)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(df, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_warc(spark, path, with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == body and j is not None]
        keep = max(same) if len(body) >= 1000 and same else i
        kind, refers = ("revisit", f"<urn:page:{keep}>") if keep != i else ("response", None)
        want.append((kind, f"<urn:page:{'' if i is None else i}>", refers, len(body), hashlib.sha1(body).hexdigest(),
                     b"" if kind == "revisit" else body))
    have = [(r.type, r.record_id, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    raw = {}
    for name in glob.glob(f"{path}/part*"):
        with open(name, "rb") as f:
            raw[os.path.basename(name)] = f.read()
    for r in got:
        assert raw[os.path.basename(r.file)][r.offset:].startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_of_nothing(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


# -------------------------------------------------------------- packing

def reference_ids(texts):
    t = Tokenizer.from_file(TOKENIZER)  # with its defaults: a special token's string is that token
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, pieces, ids, seq_len):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {d for d, _ in rows}
    for (d, _), want in zip(rows, ids, strict=True):
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            cut = np.array(want[at:at + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(cut)
            at += p.length
        assert at == len(want)
    total = sum(map(len, ids))
    assert sorted(by_seq) == list(range(-(-total // seq_len)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (seq_len if s < total // seq_len else total % seq_len)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "Éa", "x1", "<|endoftext|>", "\n", "日本"]) for _ in range(rng.randint(0, 300))))
            for i in range(40)]
    rows += [(50, None), (51, ""), (52, "word " * 60_000), (53, "x" * 20_000)]
    docs = H.docs_frame(spark, rows, extra=("n", "part", "start")).repartition(6)
    ids = reference_ids([t for _, t in rows])
    pieces = packing.pack(docs, TOKENIZER, seq_len=256, with_ids=True)
    check_pieces(rows, pieces.collect(), ids, 256)
    seqs = packing.sequences(pieces).collect()
    assert sum(len(s.ids) // 4 for s in seqs) == sum(map(len, ids))
    last = max(seqs, key=lambda s: s.sequence_id)
    n = len(last.ids) // 4
    assert last.sequence_length == (n if n & (n - 1) == 0 else 256)


def test_packing_hard_cases(spark):
    rows = [(None, "a"), (1, "b"), (1, "b")]
    got = packing.pack(H.docs_frame(spark, rows), TOKENIZER).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and sorted(r.offset for r in got) == [0, 2, 4]
    assert packing.pack(H.docs_frame(spark, []), TOKENIZER).count() == 0


def test_ids_are_those_of_tokenizers(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    with open(TOKENIZER, "rb") as f:
        enc = packing.load_encoding(f.read())
    texts += ["<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>\n\n<|endoftext|>x", "<|endoftext", "<|<|endoftext|>|>"]
    assert [[*enc.encode(t, allowed_special="all", disallowed_special=()), 1] for t in texts] == reference_ids(texts)


# ----------------------------------------------------------- neighbours

def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(400, 16)) * rng.choice([1e-3, 1, 50], size=(400, 1))
    vecs[100:160] = vecs[100]           # ties
    vecs[200:210] = rng.integers(-2, 3, size=(10, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] * 16),
           (905, [None, *[1.0] * 15]), (None, [1.0] * 16), (906, [1.0] * 8), (907, [2.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    queries_ = df.where((F.col("vec_id") % 7 == 0) | (F.col("vec_id") >= 900))
    got = {}
    for r in ann.nearest(df, queries_, k=5, query_block=20, candidate_block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [i for i in range(400) if i % 7 == 0]:
        score = vecs @ vecs[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        have = sorted(got.pop(q))
        assert np.allclose([s for _, _, s in have], score[order], rtol=1e-12)
        assert [k for k, _, _ in have] == [1, 2, 3, 4, 5]
        exact = [np.einsum("d,d->", vecs[q], vecs[i]) for _, i, _ in have]
        assert np.allclose(exact, [s for _, _, s in have], rtol=1e-12)
        for (_, i, a), (_, j, b) in zip(have, have[1:], strict=False):
            assert a > b or i < j
    assert got == {906: [(1, 907, 16.0)], 907: [(1, 906, 16.0)]}
    assert ann.nearest(df.limit(0), queries_.limit(0)).count() == 0


def test_neighbours_of_a_repeated_id(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)] + [(7, [1.0, 0.0, 0.0, 0.0])] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cand = ann.numbered(ann.valid_vectors(df, "vec_id", "embedding"))
    sizes = [r["count"] for r in ann.deal(cand, ["row"], "c", 5, "r", 1).groupBy("c").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 50  # no block holds all rows of the repeated id
    got = ann.nearest(df, df.where("vec_id in (3, 7)"), k=60, query_block=10, candidate_block=16).collect()
    have = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 3)
    want = sorted(((float(np.cumsum(np.array(v) * rows[3][1])[-1]), i) for i, v in rows if i != 3), key=lambda x: (-x[0], x[1]))
    assert [(i, s) for _, i, s in have] == [(i, s) for s, i in want[:60]]
    assert not [r for r in got if r.query_id == 7 and r.vec_id == 7]


# ----------------------------------------------------------------- chat

def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "who?"),
            (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 1, "ann", "same"), (3, 1, "ann", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(5))
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann")}
    r = got[1, "ann"]
    assert r.text == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|end|><|end|>\n"
                      "<|user:bob|>\n<|end|>\n<|user:unknown|>\nwho?<|end|>\n")
    assert [r.text[s.start:s.end] for s in r.mask] == ["hi <\\|end|><|end|>\n"]
    assert got[3, "ann"].n_target == 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_hot_conversation(spark):
    rows = [(7, i % 3, ["a", "b"][i % 2], f"t{i}") for i in range(500)] + [(i, 0, "a", "x") for i in range(100, 150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = [r for r in chat.rotate(df, max_turns=40).collect() if r.conv_id == 7]
    order = sorted((t, r, x) for c, t, r, x in rows if c == 7)
    for who in "ab":
        mine = sorted((r.chunk, r) for r in out if r.perspective == who)
        assert [c for c, _ in mine] == list(range(13))
        for c, r in mine:
            part = order[c * 40:(c + 1) * 40]
            said = [x + "<|end|>\n" for _, role, x in part if role == who]
            assert [r.text[s.start:s.end] for s in r.mask] == said and r.n_turns == len(part)


# -------------------------------------------------------------- queries

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import sys
    sys.path.insert(0, "scripts")
    import check_oracle
    sf = "/root/testdata/sf0.001"
    ok, _, _, _, msg = check_oracle.compare(spark, check_oracle.duck(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert ok, msg


SF = "/root/testdata/sf0.001"


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1_query(spark):
    want = {d: (n, g, sha(k)) for d, (n, g, k) in H.repeated_windows(texts(spark)).items()}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect()} == want


def test_op2_query(spark):
    rows = texts(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i), sha(",".join(i)), h > 0) for d, (n, h, i) in H.benchmark_hits(rows, items).items()}
    got = queries.QUERIES["op2_decontam"](spark, SF).collect()
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {r.doc_id: tuple(r[c] for c in columns) for r in got} == want
    near = H.near_items(rows, items, decontam.N_TERMS, decontam.WITHIN)
    assert {r.doc_id: r.n_near for r in got} == near and len(set(near.values())) > 1


def test_op5_query(spark):
    rows = texts(spark)
    fps = [H.fingerprint(t) for _, t in rows]
    root = H.groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    want = {d: (f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, root, strict=True)}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op5_simhash"](spark, SF).collect()} == want


def test_op7_query(spark):
    rows = texts(spark)
    check_pieces(rows, queries.QUERIES["op7_packing"](spark, SF).collect(), reference_ids([t for _, t in rows]), 2048)


def test_pipeline_equals_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa
    good = model.score(quality.batch_features(pa.array([t for _, t in rows]))) >= quality.THRESHOLD
    rows = [r for r, ok in zip(rows, good, strict=True) if ok]
    rows = sorted(H.line_copies(rows).items())
    fps = [H.fingerprint(t) for _, t in rows]
    root = H.groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = H.benchmark_hits(rows, items)
    rows = [r for r in rows if not hits[r[0]][1]]
    got = pipeline.run(spark, sf).collect()
    check_pieces(rows, got, reference_ids([t for _, t in rows]), 2048)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_stages_on_hard_rows(spark):
    """Null ids and texts, empty and long texts, repeated rows, an id with two texts, extra columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    prose = lambda n: " ".join(f"word{rng.randrange(200)}" for _ in range(n))
    item = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10][0]
    lines = "a first line of the note\nand a second one here\nthe third"
    rows = [(None, prose(30)), (1, None), (2, ""), (3, prose(40)), (3, prose(50)), (4, prose(60)), (5, prose(60)), (6, lines), (7, lines),
            (8, prose(20) + " " + item), (9, prose(4000))]
    rows += [rows[3], rows[3]]
    docs = H.docs_frame(spark, rows, extra=("row", "doc", "score", "runs", "deleted_runs", "text_key", "found"))
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == pipeline.COLUMNS
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    quality_kept = kept["quality classifier"]
    assert set(quality_kept) <= set(rows) and all(quality_kept.count(x) == rows.count(x) for x in quality_kept)
    copies = [x for x in kept["line dedup"] if x[0] in (6, 7)]
    assert copies == [(6, lines), (7, "")] and len(kept["line dedup"]) == len(rows)
    assert kept["line dedup"].count(rows[3]) == 3
    near = kept["SimHash near-dedup"]
    assert (1, None) in near and (2, "") not in near      # empty texts are one group
    assert (6, lines) in near and (7, lines) not in near and near.count(rows[3]) == 3 and rows[4] in near and rows[0] in near
    assert kept["benchmark decontamination"] == sorted([x for x in rows if x[0] != 8], key=str)
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(p.length for p in pieces) == sum(map(len, reference_ids([t for _, t in rows])))


def test_op8_query(spark):
    """The registered scores are those of the fitted tables on each text, the held-out rows by their crc."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    import pyarrow as pa
    model = quality.train(docs, labels)
    rows = texts(spark)
    score = model.score(quality.batch_features(pa.array([t for _, t in rows])))
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality"](spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = []
    for (d, _), s in zip(rows, score, strict=True):
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert abs(got[d].score - s) < 1e-9 and got[d].predicted == int(got[d].score >= 0.7)
        if got[d].held_out and truth.get(d) is not None:
            right.append(got[d].predicted == truth[d])
    assert len(got) == len(rows) and sum(right) >= 0.9 * len(right)
