import hashlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import bpe
from loadwarden.llm.tokens import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


ENCODER = bpe.PrefixEncoder(tokenizer_path(), cache_bytes=200_000)
DECODER = bpe.Decoder(tokenizer_path())


def test_automaton_knows_all_words_that_end_at_a_place():
    rng = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))})
        a = bpe.SuffixAutomaton()
        for k, w in enumerate(words):
            a.add([ord(c) for c in w], k)
        a.finish()
        text = "".join(rng.choices("ab", k=30))
        state = matched = 0
        for i, c in enumerate(text, 1):
            while state and a.go.get(state * 512 + ord(c)) is None:
                state = a.link[state]
                matched = a.length[state]
            to = a.go.get(state * 512 + ord(c))
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            found = [] if not state else a.words[state] if matched == a.length[state] else a.words[a.link[state]]
            want = [w for w in words if text[:i].endswith(w)]
            assert [words[t] for t, _ in found] == sorted(want, key=len, reverse=True)


def merges_one_by_one(word, ranks):
    parts = [*word[:-1], word[-1] + "</w>"]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: (ranks.get((parts[k], parts[k + 1]), 10**9), k))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


def test_last_tokens_are_those_of_the_merges():
    import json
    spec = json.load(open(tokenizer_path()))["model"]
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["merges"])}
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinrsthl", k=rng.randint(1, 14))) for _ in range(300)] + ["aaaaaaaaa", "hahahahaha", "www"]
    for w, ids in zip(words, ENCODER.words_ids([w.encode() for w in words])):
        assert [ENCODER.text_of[i] for i in ids] == merges_one_by_one(w, ranks)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text_as_the_library(texts):
    full = library()
    for _ in range(2):
        for t, ids in zip(texts, ENCODER.encode(texts)):
            want = full.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert DECODER.decode(ids) == full.decode(want, skip_special_tokens=False)


def test_unbroken_text_takes_time_in_proportion():
    rng = random.Random(1)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ([chr(c) for c in range(0x4E00, 0x9F00)], 300_000)):
        text = "".join(rng.choices(letters, k=n))
        start = time.time()
        ids = ENCODER.encode([text])[0]
        assert time.time() - start < 30
        assert ids.tolist() == library().encode(text, add_special_tokens=False).ids


def test_long_parts_are_not_kept():
    for cls in (bpe.PrefixEncoder, WordEncoder):
        e = cls(tokenizer_path(), cache_bytes=1 << 20)
        rng = random.Random(2)
        for _ in range(20):
            e.encode(["".join(rng.choices("abcdefgh", k=20_000)) + " word"])
        assert e.held < 1 << 20 and all(len(p) <= 64 for p in e.index) and e.used < 1000


def want(docs):
    full, out = library(), []
    for d, t in docs:
        ids = full.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_bpe"](spark, SF).collect()), key=repr) == want(docs)


def test_edge_rows(spark):
    rows = [(None, "no id", 1), (3, None, 2), (4, "", 3), (5, "twice twice", 4), (5, "twice twice", 4), (6, "many Wörds, " * 40_000, 5),
            (7, "<|endoftext|>a<|startoftext|> '’s İ x́ 3.5", 6), (8, "語" * 9000, 7), (9, " \t\n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    coded = bpe.encode(docs)
    full = library()
    got = sorted(((r.doc_id, r.ids, r.text) for r in bpe.decode(coded).collect()), key=repr)
    ids = [(d, full.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows]
    assert got == sorted(((d, i, full.decode(i, skip_special_tokens=False)) for d, i in ids), key=repr)
    assert sorted(((r.doc_id, r.ids, r.text) for r in bpe.round_trip(docs).collect()), key=repr) == got
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == bpe.round_trip(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nothing).first().text == ""
    assert DECODER.decode(np.array([49407, 60000])) == "<|endoftext|>"
