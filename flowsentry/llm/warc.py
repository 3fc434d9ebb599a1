"""WARC archives: writing with payload de-duplication, and reading back with
boundary-chain verification.

Writing is one text table: a record per row, ended by the separator CR LF CR
LF. Of equal payloads of ``min_revisit`` bytes and more one is stored, the
others become ``revisit`` records without a body.

Reading splits the files at the magic ``WARC/1.1``; it may also stand inside
payloads, so every piece with a record's header is only a candidate. A
candidate's header gives its successor's offset. Inside a split the chains are
contracted to (candidate, first offset outside the split); across splits,
pointer jumping from offset 0 of each file doubles the length of the jumps
until no new split is reached. Only candidates on the chain are records. A
record with magic in its payload is put together from its pieces in a second
read of the files concerned.

Defined results: a null payload is empty and shorter than any limit; a null
url is empty; line breaks in urls are percent-encoded; a repeated page row is
a record each; a null page id stays null, and never stands for others. Other
columns are ignored. An empty table gives an empty archive and no records.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowsentry.llm.common import materialise

MAGIC = "WARC/1.1\r\n"
STOP = "\r\n\r\n"
MIN_REVISIT = 1000
URN = "<urn:page:"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_revisit: int = MIN_REVISIT,
               date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per row to files below ``path``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"),
                     F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                     payload.alias("payload"), F.octet_length(payload).alias("n"),
                     F.sha1(payload.cast("binary")).alias("digest"))
    # only what is stored more than once; written, so that its true size is known
    kept = materialise(p.where(F.col("n") >= min_revisit).groupBy("digest")
                       .agg(F.max("key").alias("kept"), F.count("*").alias("c"))
                       .where((F.col("c") > 1) & F.col("kept").isNotNull()).drop("c"), "payloads")
    p = p.join(kept, "digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("key"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n"), F.lit(STOP))
    head = [F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: " + URN), F.coalesce("id", F.lit("")),
            F.lit(">\r\nWARC-Target-URI: "), url,
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.lit("\r\nX-Payload-Length: "), F.col("n")]
    body = F.when(revisit, F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
              "\r\nWARC-Refers-To: " + URN), F.col("kept").cast("string"),
        F.lit(">\r\nContent-Length: 0" + STOP))).otherwise(F.concat(
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length(http) + F.col("n"), F.lit(STOP), http, F.col("payload")))
    p.select(F.concat(*head, body).alias("value")).write.option("lineSep", STOP).text(path)


def _offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``rel``: bytes of the piece's split before it. The pieces of a split
    arrive in file order."""
    schema = pieces.schema.simpleString()[7:-1]

    def run(batches):
        at, pos = None, 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rel = []
            for key, n in zip(keys, batch.column(2).to_pylist(), strict=True):
                if key != at:
                    at, pos = key, 0
                rel.append(pos)
                pos += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())],
                                             [*batch.schema.names, "rel"])

    return pieces.mapInArrow(run, schema.replace(",", ", ") + ", rel bigint")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """What lies between two magics: file, block (start of the split), n, value."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.octet_length("value").cast("long").alias("n"), "value",
                    F.col("_metadata.file_size").alias("file_size")))


def _join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A join of tables of records: both grow with the archive, none is broadcast."""
    return left.join(right.hint("merge"), on)


def _field(head, name):
    got = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def _exits(batches):
    """For each candidate of a split, where its chain leaves the split."""
    for pdf in batches:
        out = []
        for rel, succ in zip(pdf["rel"], pdf["succ"], strict=True):
            rel, succ = np.asarray(rel, np.int64), np.asarray(succ, np.int64)
            nxt = np.searchsorted(rel, succ)
            hit = (nxt < len(rel)) & (rel[np.minimum(nxt, len(rel) - 1)] == succ) if len(rel) else nxt
            end = succ.copy()
            for i in range(len(rel) - 1, -1, -1):
                if hit[i]:
                    end[i] = end[nxt[i]]
            out.append(end)
        yield pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "exits": out})


def _on_chain(rel, succ, entry):
    """Marks the candidates of a split on the chain from offset ``entry``."""
    at = {r: i for i, r in enumerate(rel)}
    keep, x = [False] * len(rel), entry
    while x in at:
        i = at[x]
        keep[i] = True
        x = succ[i]
    return keep


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records: file, offset, type, record_id, refers_to, url, payload_bytes,
    payload_digest (SHA-1, lower-case hex; a revisit's are those it declares)
    and payload if asked for."""
    pieces = _pieces(spark, path)
    head = F.substring_index("value", STOP, 1)
    cl = _field(head, "Content-Length").try_cast("long")  # null: no number, or beyond 64 bits
    body_at = F.octet_length(head) + 4
    block = F.expr("substring(cast(value as binary), body_at + 1, cast(least(cl, n) as int))")
    http_head = F.octet_length(F.substring_index(F.col("body").cast("string"), STOP, 1)) + 4
    parsed = (pieces.withColumn("head", head).withColumn("cl", cl).withColumn("body_at", body_at)
              .withColumn("type", _field(F.col("head"), "WARC-Type"))
              # not a header: the piece belongs to the payload before it
              .withColumn("ok", F.coalesce(F.col("cl").between(0, F.col("file_size")), F.lit(False))
                          & F.col("type").isNotNull() & (F.col("n") >= F.col("body_at")))
              .withColumn("body", F.when(F.col("ok"), block))
              .withColumn("http", F.coalesce(_field(F.col("head"), "Content-Type"), F.lit(""))
                          .startswith("application/http"))
              .withColumn("payload", F.when(F.col("http"), F.substring(
                  F.col("body"), http_head + 1, F.length("body"))).otherwise(F.col("body"))))
    fields = parsed.select(
        "file", "block", "n", "ok", F.when(F.col("ok"), F.col("body_at") + F.col("cl") + 4).alias("size"),
        F.when(F.col("ok"), F.col("n") >= F.col("body_at") + F.col("cl")).alias("whole"), "type",
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("declared"),
        _field(F.col("head"), "X-Payload-Length").try_cast("long").alias("declared_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    rows = materialise(_offsets(fields), "warc-candidates")

    # one row per split: its size and its candidates, in order; bounded by the split
    magic = F.lit(len(MAGIC)).cast("long")
    cand = F.struct((F.col("rel") - magic).alias("rel"), (F.col("rel") + F.col("size")).alias("succ"))
    first = (F.col("block") == 0) & (F.col("rel") == 0)  # what stands before the first magic
    splits = rows.groupBy("file", "block").agg(
        F.sum(F.col("n") + magic).alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("ok") & ~first, cand))).alias("cands"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0).cast("long")))
    splits = materialise(splits.select("file", "block", "base", F.col("cands.rel").alias("rel"),
                                       F.col("cands.succ").alias("succ")), "warc-splits")
    exits = splits.select("file", "block", "rel", "succ").mapInPandas(
        _exits, "file string, block long, exits array<long>")
    jump = (_join(splits, exits, ["file", "block"])
            .select("file", "block", "base", F.explode(F.arrays_zip("rel", "exits")).alias("z"))
            .select("file", "block", "base", (F.col("base") + F.col("z.rel")).alias("off"),
                    (F.col("base") + F.col("z.exits")).alias("to")))
    jump = materialise(jump, "warc-jumps")
    reached = materialise(splits.select("file", F.lit(0).cast("long").alias("off")).distinct(), "warc-reached")
    hop, n = jump.select("file", "off", "to"), reached.count()
    while True:
        step = _join(reached, hop, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = materialise(reached.union(step).distinct(), "warc-reached")
        if (now := reached.count()) == n:
            break
        n = now
        far = hop.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        hop = materialise(_join(hop, far, ["file", "to"]).select("file", "off", F.col("far").alias("to")),
                          "warc-hops")

    # the chain enters a split at one offset at most
    entry = _join(reached, jump, ["file", "off"]).select(
        "file", "block", (F.col("off") - F.col("base")).alias("entry"))

    def walk(batches):
        for pdf in batches:
            got = [(f, b, base, r, s) for f, b, base, rel, succ, e in
                   pdf[["file", "block", "base", "rel", "succ", "entry"]].itertuples(index=False)
                   for r, s, k in zip(rel, succ, _on_chain(rel, succ, e), strict=True) if k]
            yield pd.DataFrame(got, columns=["file", "block", "base", "at", "succ"])

    chain = _join(splits, entry, ["file", "block"]).mapInPandas(
        walk, "file string, block long, base long, at long, succ long")
    chain = chain.select("file", "block", (F.col("at") + magic).alias("rel"),
                         (F.col("base") + F.col("at")).alias("offset"),
                         (F.col("base") + F.col("succ")).alias("succ"))
    records = materialise(_join(rows, chain, ["file", "block", "rel"]), "warc-records")
    records = _stitched(spark, path, rows, records, splits, with_payload)
    if with_payload:
        content = _offsets(parsed.select("file", "block", "n", "payload")).select(
            "file", "block", "rel", F.col("payload").alias("own_payload"))
        records = (records.join(content, ["file", "block", "rel"])
                   .withColumn("payload", F.coalesce("payload", "own_payload")))
    digest = F.regexp_replace("declared", "^sha1:", "")
    revisit = F.col("type") == "revisit"
    out = records.select(
        "file", "offset", "type", "record_id", "refers_to", "url",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, digest).otherwise(F.col("digest")).alias("payload_digest"),
        *(["payload"] if with_payload else []))
    return out


def _stitched(spark, path, rows: DataFrame, records: DataFrame, splits: DataFrame, with_payload: bool) -> DataFrame:
    """Digest and length of records whose payload holds magic, from all their
    pieces. A piece belongs to the last record that starts at or before it: in its split, or
    carried over from the splits before. The archive is read again only if there are any."""
    if records.where(~F.col("whole")).isEmpty():
        return records.withColumn("payload", F.lit(None).cast("binary"))
    key = ["file", "block", "rel"]
    starts = records.select(*key, F.struct("offset", "succ", "whole").alias("record"))
    last = starts.groupBy("file", "block").agg(F.max("record").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    carried = splits.select("file", "block", "base").join(last.hint("merge"), ["file", "block"], "left")
    carried = carried.select("file", "block", "base", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("file", "block").orderBy("rel")  # the pieces of a split
    owned = rows.select(*key).join(starts.hint("merge"), key, "left")
    owned = owned.withColumn("record", F.last("record", ignorenulls=True).over(inside))
    owned = owned.join(carried.hint("merge"), ["file", "block"]).withColumn("record", F.coalesce("record", "carried"))
    at = F.col("base") + F.col("rel") - len(MAGIC)
    owned = owned.where(~F.col("record.whole") & (at < F.col("record.succ"))).select(
        *key, at.alias("at"), "record.offset", "record.succ")
    owned = materialise(owned, "warc-broken")
    parts = _offsets(_pieces(spark, path).withColumn("value", F.col("value").cast("binary")))
    owned = parts.select(*key, "value").join(owned, key)

    def glue(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        raw = MAGIC.encode().join(pdf["value"])
        head, _, rest = raw.partition(STOP.encode())
        body = rest[:int(pdf["succ"].iloc[0] - pdf["offset"].iloc[0]) - len(MAGIC) - len(head) - 8]
        if b"\r\ncontent-type: application/http" in b"\r\n" + head.lower():
            body = body.partition(STOP.encode())[2]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "offset": [pdf["offset"].iloc[0]],
                             "n2": [len(body)], "d2": [hashlib.sha1(body).hexdigest()],
                             "payload": [body if with_payload else None]})

    fixed = owned.groupBy("file", "offset").applyInPandas(
        glue, "file string, offset long, n2 long, d2 string, payload binary")
    return (records.join(fixed, ["file", "offset"], "left")
            .withColumn("payload_bytes", F.coalesce("n2", "payload_bytes"))
            .withColumn("digest", F.coalesce("d2", "digest")).drop("n2", "d2"))
