"""Packing: concatenate and cut.

Two passes of prefix sums. The first tokenises each document once and stores
its ids with the number of tokens before it in its task; the totals of the
tasks, summed in task order, give every task a global offset. The second pass
cuts the stream at fixed windows: a document that crosses a window becomes
several pieces (boundary records). Nothing is shuffled, and the only thing
gathered is one total per task.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as often as they occur; a null ``doc_id`` stays null; an empty table
gives no pieces. Other columns are ignored. Sequences are filled to
``seq_len``; only the last one can be short, and it is padded unless its
length is a power of two.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import materialise

END_ID = 1
SEQ_LEN = 2048


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(blob: bytes):
    """An encoder giving the ids of the byte-level BPE file ``blob``.

    The ids are those of the ``tokenizers`` library (tested); its merges are
    in id order, so that the ids are the ranks that tiktoken takes. The file's
    added tokens are the encoder's special tokens.
    """
    import public_tokenizers
    import tiktoken
    read = json.loads(blob)
    model, added = read["model"], {t["content"]: t["id"] for t in read["added_tokens"]}
    back = _byte_of_char()
    ranks = {bytes(back[c] for c in tok): i for tok, i in model["vocab"].items()
             if all(c in back for c in tok) and tok not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens=added)


_ENCODING: dict[int, object] = {}


def _encoding(blob):
    key = zlib.crc32(blob)
    if key not in _ENCODING:
        _ENCODING[key] = load_encoding(blob)
    return _ENCODING[key]


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
             text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, local_start, doc_id, n, ids): one row per document, with the
    tokens before it in its task; ids as little-endian unsigned 32-bit or, for
    vocabularies of up to 65,536 ids, 16-bit values."""
    with open(tokenizer_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, 2 MB
    doc_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = _encoding(blob.value)
        part, total = TaskContext.get().partitionId(), 0
        kind = "<u2" if enc.max_token_value < 65536 and end_id < 65536 else "<u4"
        for batch in batches:
            n, ids, start = [], [], []
            for text in batch.column(1):
                # the strings of added tokens are cut out first, like the library does by default
                tokens = enc.encode(text.as_py() or "", allowed_special="all", disallowed_special=())
                tokens.append(end_id)
                ids.append(np.array(tokens, dtype=kind).tobytes())
                n.append(len(tokens))
                start.append(total)
                total += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array(start, pa.int64()),
                 batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "local_start", "doc_id", "n", "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"part int, local_start long, doc_id {doc_type}, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_length (and ids, little-endian unsigned
    32-bit, if ``with_ids``)."""
    spark = docs.sparkSession
    stored = materialise(tokenise(docs, tokenizer_path, id_col, text_col, end_id), "tokens")
    # one total per task of the first pass
    totals = sorted((r.part, r.n) for r in
                    stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in totals:
        base[part] = total
        total += n
    last = total % seq_len
    short = last if last & (last - 1) == 0 and last else seq_len
    base = spark.sparkContext.broadcast(base)

    def cut(batches):
        for batch in batches:
            cols = {k: [] for k in ("row", "start", "length", "crc", "n", "seq", "off", "ids")}
            parts, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (part, local, n, raw) in enumerate(zip(
                    parts, starts, batch.column(3).to_pylist(), batch.column(4).to_pylist(),
                    strict=True)):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                g, at = base.value[part] + local, 0
                while at < n:
                    size = min(n - at, seq_len - (g + at) % seq_len)
                    piece = ids[at:at + size].tobytes()
                    for k, v in (("row", row), ("start", at), ("length", size),
                                 ("crc", zlib.crc32(piece)), ("n", n),
                                 ("seq", (g + at) // seq_len), ("off", (g + at) % seq_len),
                                 ("ids", piece if with_ids else None)):
                        cols[k].append(v)
                    at += size
            out = [batch.column(2).take(pa.array(cols["row"], pa.int64())),
                   *(pa.array(cols[k], pa.int64()) for k in ("start", "length", "crc", "n", "seq", "off")),
                   pa.array([short if s == total // seq_len else seq_len for s in cols["seq"]],
                            pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                     "offset", "sequence_length"]
            if with_ids:
                out.append(pa.array(cols["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long, sequence_length int" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, ids
    (concatenated), lengths of the pieces in order. A group holds at most
    ``seq_len`` tokens."""
    got = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id", "sequence_length").agg(got.alias("p")).select(
        "sequence_id", "sequence_length",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("lengths"))
