import time
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import sentencepieces
from loadwarden.llm.tokens import tokenizer_path

PATH = tokenizer_path(sentencepieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.PieceEncoder(PATH, cache_bytes=20_000)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.text("abcdeinrst ▁é", max_size=80)), max_size=6))
def test_ids_and_text_are_the_library_s(encoder, texts):
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [LIBRARY.encode(t) for t in texts]
    assert [encoder.decode(np.array(x, dtype=np.int64)) for x in got] == [LIBRARY.decode(x) for x in got]


@pytest.mark.parametrize("text", ["", " ", "  a", "a    b ", "x" + " " * 37 + "y ", "a▁b", "漢字テスト 😀\n\tdef", "aaaaaaaa" * 40, "ab" * 300, "don't  stop",
                                  "antidisestablishmentarianism" * 9, "漢字" * 500, "\x00\x01 ﻿"])
def test_edge_texts(encoder, text):
    assert encoder.encode([text])[0].tolist() == LIBRARY.encode(text)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x5E00))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
                                     "aé漢 ,x"])
def test_a_long_text_without_spaces_takes_seconds(encoder, letters):
    text = "".join(np.random.default_rng(2).choice(list(letters), 300_000))
    start = time.process_time()
    got = encoder.encode([text])[0].tolist()
    assert time.process_time() - start < 15
    assert got == LIBRARY.encode(text)


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(LIBRARY.encode(texts[r.doc_id]), dtype="<u4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and r.same_text


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "no id", 0), (5, "long text " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    encoded = sentencepieces.encode(docs)
    assert sorted((r.doc_id or -1, r.text) for r in sentencepieces.decode(encoded).collect()) == [
        (-1, "no id"), (1, ""), (2, ""), (2, ""), (5, "long text " * 50_000)]
    assert all(r.ids == LIBRARY.encode(dict((d, t) for d, t, _ in rows)[r.doc_id] or "") for r in encoded.collect())
    assert sentencepieces.round_trip(docs).filter("same_text").count() == 5
    assert sentencepieces.round_trip(docs.limit(0)).count() == 0
