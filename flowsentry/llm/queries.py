"""The registered queries of the operators, and their DuckDB twins.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.llm import (
    ann,
    chat,
    decontam,
    line_dedup,
    ngram_join,
    packing,
    quality,
    secret_scan,
    simhash,
    source_audit,
    substring_dedup,
    token_alignment,
    warc,
)
from flowsentry.llm.common import table
from flowsentry.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w),
n AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM s),
f AS (SELECT run, min(doc_id) AS first FROM n GROUP BY run),
g AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM n JOIN f ON n.run = f.run AND first < doc_id),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""")
def op1_substring_dedup(spark, sf_dir):
    found = substring_dedup.mark(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_decontam")
def op2_decontam(spark, sf_dir):
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratios = secret_scan.fit(secret_scan.labelled_samples(docs))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return secret_scan.scan(docs.select("doc_id", "text"), ratios).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.digest("assign", "access", "hex"), 256).alias("base_sha256"),
        secret_scan.digest(*secret_scan.KINDS).alias("spans"), count("markov"))


@query("op4_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM l WHERE regexp_matches(s, '\\S')),
w AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY seq) AS s2,
    CASE WHEN length(s) >= 50 THEN 1 ELSE 2 END AS need FROM b),
k AS (SELECT *, CASE WHEN need = 1 THEN s ELSE s || chr(10) || s2 END AS run FROM w WHERE need = 1 OR s2 IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY need, run ORDER BY doc_id, seq) AS copy FROM k),
g AS (SELECT DISTINCT doc_id, seq + unnest(range(need)) AS seq FROM c WHERE copy > 1),
i AS (SELECT g.doc_id, b.line, g.seq - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.seq) AS isl
  FROM g JOIN b ON g.doc_id = b.doc_id AND g.seq = b.seq),
r AS (SELECT doc_id, isl, min(line) AS lo, max(line) AS hi FROM i GROUP BY doc_id, isl),
d AS (SELECT l.doc_id, count(*) AS n_lines, count(r.lo) AS n_deleted, count(DISTINCT r.lo) AS n_runs,
    coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (r.lo IS NULL), '') AS kept
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line BETWEEN r.lo AND r.hi GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_deleted, n_runs, sha256(kept) AS kept_sha256 FROM d""")
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", n))
    deleted = F.aggregate("deleted_runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_lines", deleted.cast("long").alias("n_deleted"),
                      F.size("deleted_runs").cast("long").alias("n_runs"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query("op6_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM m""")
def op6_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).try_cast("long"))
    return warc.read_warc(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_nearest", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) WHERE rank <= 20""")
def op9_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query("op10_chat", """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, role, text) - 1 AS rk FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT r.conv_id, p.perspective, r.rk // 256 AS chunk, r.rk, r.role = p.perspective AS mine,
  CASE WHEN r.role = 'system' THEN '<|system|>' || chr(10)
       WHEN r.role = p.perspective THEN '<|assistant|>' || chr(10)
       ELSE '<|user:' || replace(r.role, '<|', '<\\|') || '|>' || chr(10) END AS head,
  replace(r.text, '<|', '<\\|') || '<|end|>' || chr(10) AS body
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk
  ORDER BY rk) AS e FROM s)
SELECT conv_id, perspective, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_turns,
  CAST(count(*) FILTER (mine) AS BIGINT) AS n_target,
  string_agg(head || body, '' ORDER BY rk) AS text,
  coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY rk) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, perspective, chunk""")
def op10_chat(spark, sf_dir):
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return out.withColumn("mask", F.array_join(spans, ","))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op11_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS found FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.found = l.a)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(found) AS component_id
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""")
def op11_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_source_audit", r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, source, o.term, CAST(count(*) AS HUGEINT) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term
  GROUP BY o.lang, source, o.term),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, total, coalesce(c, 0) AS c,
    1 + (1000000000 * (coalesce(c, 0) + 2)) // (coalesce(s.n, 0) + 2 * v) AS p,
    1 + (1000000000 * (total + 2)) // (v.n + 2 * v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
    LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
    LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10""")
def op13_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))
