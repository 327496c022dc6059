import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import token_files, warc
from loadwarden.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=400))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(ids)) == ids).all()


def test_blocks_are_small_and_indexed():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1000, 3 * token_files.BLOCK + 17, dtype=np.uint32)
    ids[::100] = 49_000
    out = io.BytesIO()
    writer = token_files.TokenWriter(out)
    writer.add(7, ids[:5])
    writer.add(None, ids[5:5])
    writer.add(9, ids[5:])
    writer.close()
    assert len(out.getvalue()) < 1.6 * len(ids)
    out.size = lambda: len(out.getvalue())
    reader = token_files.TokenReader(out)
    assert len(reader.blocks) == 5 and (reader.block(2) == ids[2 * token_files.BLOCK:3 * token_files.BLOCK]).all()
    got = list(reader.documents())
    assert [d for d, _ in got] == [7, None, 9] and (np.concatenate([x for _, x in got]) == ids).all()


def want_tokens(docs):
    from tokenizers import Tokenizer
    full, at, out = Tokenizer.from_file(tokenizer_path()), 0, Counter()
    for d, t in docs:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out[(d, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    return out


def test_token_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert Counter(tuple(r) for r in QUERIES["op8_token_files"](spark, SF).collect()) == want_tokens(docs)


def test_token_edge_rows(spark):
    rows = [(None, "no id", 1), (3, None, 1), (4, "", 1), (5, "twice", 1), (5, "twice", 1), (6, "many words " * 20_000, 1), (-2, "below", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    ordered = sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(tuple(r) for r in token_files.round_trip(docs).collect()) == want_tokens(ordered)
    assert token_files.round_trip(docs.limit(0)).count() == 0


def want_pages(rows, least=0):
    best, out, used = {}, [], set()
    data = [(p, (h or "").encode()) for p, h in rows]
    for p, b in data:
        if b not in best or (p is not None and (best[b] is None or p > best[b])):
            best[b] = p
    for p, b in data:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = len(b) < least or (p == best[b] and (p, b) not in used)
        used.add((p, b))
        out.append((p, len(b), digest, "response" if first else "revisit", None if first else best[b]))
    return Counter(out)


def test_warc_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op4_warc"](spark, SF).collect()) == want_pages(pages)


def test_warc_edge_rows(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 40_000
    rows = [(1, "u", None), (2, "u", ""), (3, "a\r\nb", long), (4, None, long), (4, None, long), (4, None, long), (None, "x", "one"), (None, "x", "one"),
            (8, "x", "one"), (None, "y", "alone"), (9, "z", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    for least in (0, 4):
        got = Counter(tuple(r) for r in warc.round_trip(pages, least).collect())
        assert got == want_pages([(p, h) for p, _, h in rows], least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_gzip_members():
    one = warc.record_bytes(5, "http://a", "D" * 32, 3, "response", 0, None, None, b"abc", "2024-01-01T00:00:00Z")
    two = warc.record_bytes(6, "http://b", "D" * 32, 3, "revisit", 0, 5, "http://a", None, "2024-01-01T00:00:00Z")
    data = gzip.compress(one) + gzip.compress(two)
    assert gzip.decompress(data) == one + two
    (f1, h1, b1), (f2, h2, b2) = warc.parse(io.BytesIO(data))
    assert (b1, b2) == (b"abc", b"") and h2["content-length"] == "3" and f2["warc-refers-to"] == f1["warc-record-id"]
