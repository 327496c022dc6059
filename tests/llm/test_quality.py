import base64
import random
import re
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import quality

SF = "/root/testdata/sf0.001"
PRESS = zstandard.ZstdCompressor(level=3)


def brute(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\t", "c d", "\x85"]), max_size=60).map(" ".join))
def test_base_counts(text):
    assert quality.judge(text, PRESS)[:6] == brute(text)


def prose(n, seed=1):
    r = random.Random(seed)
    syllables = "an the ing er ti on or ed es re in at nd ou ea ha".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)) + "."


@pytest.mark.parametrize("n", [20, 100, 1000, 6000])
def test_bands(n):
    good = prose(n)
    assert quality.judge(good, PRESS)[-1]
    noise = base64.b64encode(random.Random(2).randbytes(n * 5)).decode()
    assert not quality.judge(" ".join(noise[i:i + 60] for i in range(0, len(noise), 60)) + " x" * 0 + " a b c d e f g h i j", PRESS)[-1] or n < 100
    assert not quality.in_bands(("ab " * n * 2).encode(), PRESS)


def test_bad_stretch_in_a_long_text():
    good = prose(6000)
    r = random.Random(5)
    stretch = "".join(r.choice("xy") for _ in range(len(good) // 2))
    assert quality.in_bands(good.encode(), PRESS) and not quality.in_bands((good + " " + stretch).encode(), PRESS)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
@pytest.mark.parametrize("n", [6000, 200_000])
def test_share_of_bad_bytes_does_not_pass(n, share):
    good, r = prose(n), random.Random(7)
    size, at = int(len(good) * share), len(good) // 2
    for stretch in (base64.b64encode(r.randbytes(size)).decode()[:size], "".join(r.choices("xy", k=size))):
        assert quality.in_bands(good.encode(), PRESS) and not quality.in_bands((good[:at] + stretch + good[at:]).encode(), PRESS)
    scattered = "".join(good[i:i + 3000] + base64.b64encode(r.randbytes(1200)).decode() for i in range(0, len(good), 20_000))
    assert not quality.in_bands(scattered.encode(), PRESS)


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    rows = QUERIES["op10_quality"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        low = not r.base_failed and quality.in_bands(texts[r.doc_id].encode(), PRESS)
        assert r.kept == low
    kept = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(kept) >= 0.98 * len(kept)


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, prose(30), 1), (5, prose(200_000), 1), (6, "\n\n \n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = Counter((r.doc_id, r.n_words, r.base_failed) for r in quality.apply(docs).collect())
    assert got == Counter([(1, 0, True), (2, 0, True), (2, 0, True), (None, 30, False), (5, 200_000, False), (6, 0, True)])
    assert quality.apply(docs.limit(0)).count() == 0
