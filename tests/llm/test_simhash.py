import re

import numpy as np
import pytest
import xxhash

from loadwarden.llm import simhash
from loadwarden.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=3):
    fps = [f for _, f in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [low[find(i)] for i in range(len(rows))]


def test_fingerprint_of_edges():
    for text in ("", " \t\n", "One", "one two", "One TWO three", "a b c d e a b c d e", "é É ß \x85 x\x0by", "x " * 50_000):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_groups_cover_every_five_positions():
    from itertools import combinations
    assert len(simhash.GROUPS) == 14
    assert all(any(set(g) <= set(five) for g in simhash.GROUPS) for five in combinations(range(8), 5))


@pytest.mark.parametrize("list_rows", [4096, 3])
def test_components_against_all_pairs(spark, list_rows):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    rows = [(i, f) for i, f in enumerate(sorted(fps))] + [(1000 + i, f) for i, f in enumerate(base)]
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    prints = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in prints.join(simhash.components_of(prints, list_rows), "fp").collect()}
    assert got == dict(zip((d for d, _ in rows), brute_components(rows)))


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want_fp = [(d, brute_fingerprint(t)) for d, t in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(want_fp, brute_components(want_fp))}
    assert {tuple(r) for r in QUERIES["op7_simhash"](spark, SF).collect()} == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, " \n", "y"), (None, "a b c d", "z"), (9, "a b c d", "z"), (None, "q r s t u v", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert sorted([(d, c) for d, _, c in got], key=repr) == [(1, 1), (2, 1), (2, 1), (3, 1), (9, 9), (None, 9), (None, None)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == [(1, None, "x"), (9, "a b c d", "z"), (None, "q r s t u v", "z")]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(7, 3), (5, 5), (100, 101), (101, 100)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
