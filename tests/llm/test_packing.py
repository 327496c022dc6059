import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import packing
from loadwarden.llm.tokens import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, length, end_id, encode):
    """Every piece right, every sequence gapless and within the length; the number of sequences."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    want = Counter()
    for d, t in docs:
        ids = [*encode(t or ""), end_id]
        for k, at in enumerate(range(0, len(ids), length)):
            cut = np.array(ids[at:at + length], dtype="<u4")
            want[(d, k, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by_seq)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_cached_words_give_the_ids_of_whole_texts(texts):
    encoder, full = WordEncoder(tokenizer_path(), cache_bytes=20_000), library()
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_the_given_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> a", "It's Straße. ÉCOLE, don't 12.5!!  x́ ẞ İ K ſ", "a\x1cb\x85c d"]
    encoder, full = WordEncoder(tokenizer_path(), cache_bytes=20_000), library()
    got = [x for i in range(0, len(texts), 100) for x in encoder.encode(texts[i:i + 100])]
    assert all(a.tolist() == full.encode(t, add_special_tokens=False).ids for a, t in zip(got, texts))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.integers(1, 40))
def test_plan_places_every_rank(sizes, groups):
    counts = Counter(sizes)
    plan = packing.Plan(dict(counts), 64, groups)
    ordered = sorted(sizes, reverse=True)
    at = plan.sequence_of(np.arange(len(ordered)))
    filled = np.bincount(at, weights=ordered, minlength=plan.sequences)
    assert filled.max() <= 64 and (filled > 0).all() and len(filled) == plan.sequences
    assert groups < len(sizes) or plan.sequences <= 1.7 * sum(sizes) / 64 + 1


def test_plan_is_close_to_the_least_number():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(6.4, 1.1, 200_000).astype(int), 1, 4096)
    plan = packing.Plan(dict(Counter(sizes.tolist())))
    assert plan.sequences <= 1.003 * np.ceil(sizes.sum() / 4096)


def best_fit_decreasing(sizes, length):
    rooms, n = Counter(), 0
    for s in sorted(sizes, reverse=True):
        room = min((r for r, k in rooms.items() if k and r >= s), default=None)
        if room is None:
            room, n = length, n + 1
        else:
            rooms[room] -= 1
        rooms[room - s] += 1
    return n


@pytest.mark.parametrize("low, high", [(900, 2200), (1000, 2100), (600, 1400), (100, 3000)])
def test_no_more_sequences_than_best_fit(low, high):
    sizes = np.random.default_rng(4).integers(low, high + 1, 6000).tolist()
    plan = packing.best_plan(dict(Counter(sizes)))
    filled = np.bincount(plan.sequence_of(np.arange(len(sizes))), weights=sorted(sizes, reverse=True), minlength=plan.sequences)
    assert filled.max() <= 4096 and (filled > 0).all()
    assert plan.sequences <= best_fit_decreasing(sizes, 4096)


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    full = library()
    rows = QUERIES["op3_packing"](spark, SF).collect()
    n = check(rows, docs, 4096, 1, lambda t: full.encode(t, add_special_tokens=False).ids)
    assert n <= 1.05 * np.ceil(sum(r.length for r in rows) / 4096) + 1


@pytest.mark.parametrize("length", [5, 64])
def test_edge_rows(spark, length):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "One two three", 0), (7, "long words here " * 3000, 0), *((100 + i, "x y " * i, 0) for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(5)
    full = library()
    packed = packing.pack(docs, length, with_ids=True)
    got = packed.collect()
    check(got, [(d, t) for d, t, _ in rows], length, 1, lambda t: full.encode(t, add_special_tokens=False).ids)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in got:
        assert seqs[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert packing.pack(docs.limit(0)).count() == 0
