import hashlib
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
import xxhash

from loadwarden.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def h64(*parts):
    """Spark's xxhash64 of several values: each hash seeds the next."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & MASK).to_bytes(8, "little") if p is not True else b""
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def h64_int(seed_value, occurrence):
    first = xxhash.xxh64_intdigest((seed_value & MASK).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest((occurrence & 0xFFFFFFFF).to_bytes(4, "little"), first)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    """Order MinHash written out: number the k-mers, take the two smallest of each part, put them in text order, hash."""
    words = re.split("[ \t-\r]+", text.strip(" \t\n\x0b\x0c\r"))
    seen, numbered = Counter(), []
    for i in range(max(1, len(words) - 2)):
        kmer = signed(h64(*words[i:i + 3])) >> 31
        numbered.append((signed(h64_int(kmer, seen[kmer])) >> 31, i))
        seen[kmer] += 1
    parts = defaultdict(list)
    for key, i in sorted(numbered):
        parts[(key >> 27) & 63].append((i, key))
    out = []
    for b in range(64):
        chosen = [key for _, key in sorted(parts[b][:2])]
        out.append(f"{h64(*chosen) & 0xFFFF:04x}" if chosen else "----")
    return "".join(out)


def like(a, b):
    pa, pb = ([x[i:i + 4] for i in range(0, 256, 4)] for x in (a, b))
    some = sum(x != "----" or y != "----" for x, y in zip(pa, pb))
    j = (sum(x == y != "----" for x, y in zip(pa, pb)) / some) ** 0.5
    return 2 * j / (1 + j)


def want(rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (d, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        a, b = brute(t), brute(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, brute(following)), 9)))
    return Counter(out)


def got(df):
    return Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op9_fingerprints"](spark, SF)) == want(rows)


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (9, " \n\t "), (-3, "one"), (8, "one two"), (7, "a b c a b c a b c a b c " * 500), (6, "é ß 😀 x" * 50), (2, "p q r s t"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, rng int").repartition(4)
    assert got(fp.compare_edits(docs)) == want(rows)
    one = docs.filter("doc_id = 2")
    assert got(fp.compare_edits(one)) == want([(2, "p q r s t")])
    assert fp.compare_edits(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 3 + [(2, "e f g h")] * 2 + [(None, "z")] * 2, "doc_id long, text string")
    rows = fp.compare_edits(docs).collect()
    assert len(rows) == 7 and len({(r.doc_id, r.fingerprint) for r in rows}) == 3
    assert sorted(r.near_next for r in rows if r.doc_id == 1) == [0.0, 1.0, 1.0]


def test_order_matters_and_edits_grade(spark):
    words = [f"w{i}" for i in range(600)]
    texts = {"same": words, "moved": words[300:] + words[:300], "shuffled": [w for p in zip(words[::2], words[1::2]) for w in reversed(p)],
             "tenth": words[:540] + [f"v{i}" for i in range(60)], "half": words[:300] + [f"v{i}" for i in range(300)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, t string")
    prints = {r.k: r.f for r in fp.with_fingerprint(df, "t", "f").collect()}
    near = {k: like(prints["same"], v) for k, v in prints.items()}
    assert near["same"] == 1 and 0.75 < near["tenth"] < 1 and 0.25 < near["half"] < 0.75 and near["moved"] < near["tenth"] and near["shuffled"] < 0.3
