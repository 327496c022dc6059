import zlib

import numpy as np
import pytest

from loadwarden.llm import language, toxicity
from loadwarden.llm.catalog import QUERIES
from loadwarden.llm.common import training_sample

SF = "/root/testdata/sf0.1"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.99 * len(held) and sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_texts_of_a_language_left_out_are_rejected(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL AND length(text) <= 20000").select("doc_id", "text", "lang").collect()
    learn = {x: [(r.text, x) for r in rows if r.lang == x and fold(r.doc_id, 4) != 2][:500] for x in ("de", "en", "es", "fr")}
    held = [(r.text, r.lang) for r in rows if fold(r.doc_id, 4) == 2]
    for out in ("de", "es", "fr"):
        model = language.fit([s for x in learn if x != out for s in learn[x]])
        strangers, known = ([model.accepts(*model.predict(t)) for t, x in held if (x == out) == wanted] for wanted in (True, False))
        assert len(strangers) > 100 and sum(strangers) <= 0.1 * len(strangers) and sum(known) >= 0.99 * len(known), out
        shuffled = [language._shuffled(t, np.random.default_rng(1)) for t, x in held[:200] if x != out]
        assert sum(model.accepts(*model.predict(t)) for t in shuffled) <= 0.1 * len(shuffled)


def test_threshold_where_strangers_overlap(spark):
    # both languages use the same words, so nothing is strange: recognised documents are kept
    samples = [("the and of " * (i + 1), "en" if i % 2 else "de") for i in range(80)]
    model = language.fit(samples)
    assert all(model.predict(t)[2] >= model.strange_below for t, _ in samples)
    one = language.fit([("the and of " * (i + 1), "en") for i in range(20)])
    assert one.accepts(*one.predict("the and of the")) and not one.accepts(*one.predict("12 34"))
    assert language.LanguageModel.accepts(one, "en", 0.2, 1.0) is False


def test_long_texts_take_no_place_in_the_draw(spark):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 2 else 10)) for i in range(100)] + [(200, None)], "doc_id long, text string")
    labelled = docs.select("doc_id", (docs.doc_id % 4 > 1).cast("int").alias("y"))
    got = training_sample(docs, labelled, "y", 20, 20)
    assert len(got) == 40 and sum(y for _, y in got) == 20 and all(len(t) == 10 for t, _ in got)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (2, "", "en", 0), (None, "12 34 !!", None, 1), (5, "the and of " * 200_000, "en", 0), (6, "a" * 300_000, "en", 0)]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, toxic int, score double")


def test_edge_rows(spark, edge):
    samples = [("stupid clown " + "the and " * i, 1) for i in range(60)] + [("of that with " + "the and " * i, 0) for i in range(60)]
    model = toxicity.fit(samples, 0.1)
    got = toxicity.score(edge, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(edge, None).filter("predicted = 0 and score = 0").count() == 6
    assert toxicity.train(edge, edge.limit(0)) is None and toxicity.fit([("x", 1)], 0.5) is None
    assert toxicity.score(edge.limit(0), model).count() == 0
    lang = language.fit([("the and of " * (i + 1), "en") for i in range(40)] + [("der die das " * (i + 1), "de") for i in range(40)])
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(edge, lang).collect()}
    assert found[1] == found[2] == found[None] == ("und", True) and found[5] == ("en", False)
    assert language.train(edge.limit(0)) is None and language.predict(edge, None).filter("lang_pred = 'und'").count() == 6
    assert language.keep_recognised(edge, lang).columns == edge.columns
