import zlib

import numpy as np
import pytest

import corpus_pipeline
from loadwarden.llm import language, secrets, toxicity
from loadwarden.llm.common import table
from test_packing import check, library
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near duplicates", "secrets", "packing"]
    assert all(a.columns == b.columns for a, b in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    docs, kept = stages[0]
    model = toxicity.train(docs, table(spark, SF, "labels"), toxicity.learning_fold())
    want = docs.join(toxicity.score(docs, model).filter("predicted = 0").select("doc_id"), "doc_id").select(*docs.columns)
    assert rows(kept) == rows(want)


def test_unrecognised_documents_go(stages):
    docs, kept = stages[1]
    model = language.train(docs, language.learning_fold())
    want = [r for r in rows(docs) if model.accepts(*model.predict(r[1] or ""))]
    assert rows(kept) == want and len(want) >= 0.98 * docs.count()


def test_one_of_each_group_stays(stages):
    docs, kept = stages[2]
    found = [(r[0], brute_fingerprint(r[1])) for r in rows(docs)]
    names = brute_components(found)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(names))


def test_secrets_are_replaced(stages):
    docs, kept = stages[3]
    want = {r.doc_id: secrets.redacted(r.text) for r in docs.collect()}
    got = kept.collect()
    assert len(got) == len(want) and all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert not any(secrets.scan(r.text) for r in got)


def test_all_that_is_left_is_packed(stages):
    docs, packed = stages[4]
    full = library()
    got = packed.collect()
    n = check(got, [(r.doc_id, r.text) for r in docs.collect()], 4096, 1, lambda t: full.encode(t, add_special_tokens=False).ids)
    assert n <= 1.03 * np.ceil(sum(r.length for r in got) / 4096) + 1


def test_run_gives_the_same_pieces(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, SF).select(*columns)) == rows(stages[4][1].select(*columns))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, "the and of", None, "s", 10, "x"), (2, "", "en", "s", 0, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).count()
