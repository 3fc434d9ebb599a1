"""The source divergence audit against exact integer arithmetic in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import helpers as H
from flowsentry.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, min_docs=10, top=10):
    """(lang, source, text) rows -> the rows of the audit."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(H.lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        apart = lambda x, y: (x - y) ** 2 // (x + y)
        p, q = shares(counts[lang, source]), shares(whole)
        pairs = []
        for s in sources:
            if s != source:
                other = shares(counts[lang, s])
                pairs.append((sum(apart(p[t], other[t]) for t in kept), s))
        terms = [(apart(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)
                    if part == "pair" or rank <= top]
    return sorted(out)


def corpus(n=400):
    rng = random.Random(3)
    vocab = ["a", "Ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 4, "é" * 5, "ß", "z" * 40, "z" * 41,
             *(f"word{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        lang = "de" if rng.random() < .6 else rng.choice(["en", "fr", None])
        source = "hot" if rng.random() < .4 else rng.choice(["s1", "S2", "é", None, ""])
        words = [rng.choice(vocab[:8 + len(source or "") * 7]) for _ in range(rng.randrange(12))]
        rows.append((lang, source, rng.choice([" ", ", ", "1"]).join(words)))
    return rows + [("xx", "none", None), ("xx", "few", "seldom"), ("xx", "few", ""), ("de", "silent", "1 2 3"), ("de", "hot", "zebra " * 3000),
                   *[("en", "s1", "rare Rare")] * 10]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, g, s, 0) for i, (g, s, t) in enumerate(rows)], H.DOCS)
    from pyspark.sql import functions as F
    df = df.withColumns({c: F.lit(1) for c in ("term", "n", "size", "item", "rank")})
    want = brute_force(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("xx", "few", "pair", "none", 0, 1) in want
    for parts in (1, 7):
        assert sorted(map(tuple, source_audit.audit(df.repartition(parts)).collect())) == want
    monkeypatch.setattr(source_audit, "CHUNK_BYTES", 300)
    assert sorted(map(tuple, source_audit.audit(df, salts=1).collect())) == want
    assert source_audit.audit(df.limit(0)).count() == 0
    assert sorted(map(tuple, source_audit.audit(df, min_docs=1, top=3).collect())) == brute_force(rows, 1, 3)


def test_counts_beyond_64_bits(spark):
    """1e9 * count leaves 64 bits; the share doesn't."""
    df = spark.createDataFrame([(4 * 10 ** 11, 10 ** 12, 7)], "n long, size long, kept long")
    n, size, kept = df.first()
    assert df.select(source_audit._share("n", "size", "kept")).first()[0] == 1 + 10 ** 9 * (n + 2) // (size + 2 * kept)


def test_terms_of_all_lengths():
    text = "a B abcdefgh ABCDEFGHI abcdefghijklmnop abcdefghijklmnopq é日本語テキスト x1y " + "q" * 300 + " " + "q" * 300
    raw, offsets = source_audit.batch_bytes(pa.array([text, None, "tail", "a"]))
    raw = source_audit._LOWER[raw]
    starts, size, doc = source_audit.term_spans(raw, offsets)
    row, n, docs = source_audit.count_terms(raw, starts, size, doc, np.zeros(len(doc), np.int64))
    got = {bytes(raw[starts[r]:starts[r] + size[r]]).decode(): (int(a), int(b)) for r, a, b in zip(row, n, docs, strict=True)}
    want = Counter(TERM.findall(H.lower(text)) + ["tail", "a"])
    assert {k: a for k, (a, _) in got.items()} == want and got["a"] == (2, 2) and got["q" * 300] == (2, 1)


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, size=(500, 2)).astype(np.uint64) << rng.integers(0, 4, size=2).astype(np.uint64) * np.uint64(16)
    order = source_audit.radix_order(words)
    assert order.tolist() == sorted(range(500), key=lambda i: (*words[i].tolist(), i))
    assert source_audit.radix_order(words[:0]).tolist() == []
