"""Small tables and brute-force versions for the operators' tests."""

import re
from collections import Counter

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_frame(spark, rows, extra=()):
    """(doc_id, text) pairs as a documents table, with columns of clashing names."""
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(7) for c in extra})


def repeated_windows(rows, n=13):
    """doc_id -> (words, removed) with windows judged on the input."""
    texts = [(d, SPACE_WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k:k + n])] < d:
                gone[k:k + n] = [True] * n
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def benchmark_hits(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = TERM.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = TERM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k:k + n])):
                    found |= got
                    hit.update(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def near_items(rows, items, n_terms, within):
    """doc_id -> number of items whose rarest terms stand close together."""
    words = {d: TERM.findall(lower(t)) for d, t in rows}
    freq = Counter(w for ws in words.values() for w in ws)
    wanted = [sorted(set(TERM.findall(lower(t))), key=lambda w: (freq[w], w))[:n_terms] for _, t in items]
    out = {}
    for d, ws in words.items():
        at = {}
        for i, w in enumerate(ws):
            at.setdefault(w, []).append(i)
        out[d] = sum(any(all(any(abs(p - q) <= within for q in at.get(w, ())) for w in rare) for p in at.get(rare[0], ()))
                     for rare in wanted if rare)
    return out


def fingerprint(text):
    w = SPACE_WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def groups(values, near):
    """For each value's index the smallest index that links reach."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def line_copies(rows, min_lines=2, min_chars=50):
    """doc_id -> text without later copies of repeated line runs (unique ids, in order)."""
    seen, out = set(), {}
    for d, t in rows:
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if re.search(r"\S", x, re.ASCII)]
        gone = set()
        for k in range(len(full)):
            need = next((q for q in range(1, min_lines) if k + q <= len(full)
                         and sum(len(lines[i]) for i in full[k:k + q]) >= min_chars), min_lines)
            run = tuple(lines[i] for i in full[k:k + need])
            if len(run) < need:
                continue
            if run in seen:
                gone.update(range(k, k + need))
            seen.add(run)
        for k in sorted(gone):
            first, last = full[k], full[k + 1] if k + 1 in gone else full[k] + 1
            for i in range(first, last):
                lines[i] = None
        out[d] = None if t is None else "\n".join(x for x in lines if x is not None)
    return out
