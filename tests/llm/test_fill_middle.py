import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loadwarden.llm import fill_middle

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_the_rule(doc_id, text, changed=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= changed:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM é語\t\x0b\x85 ", max_size=40), st.integers(-5, 500), st.sampled_from([0, 50, 100]))
def test_form_and_way_back(text, doc_id, spm):
    got = fill_middle.rearrange(text.encode(), doc_id, 42, 100, spm)
    want = by_the_rule(doc_id, text, 100, spm)
    assert (doc_id, *got[:4], got[4].decode()) == want
    assert fill_middle.restored(got[4], got[1]).decode() == text


def test_rotation_is_an_exchange():
    for a, b, c in ((0, 3, 10), (2, 2, 5), (4, 10, 10), (1, 5, 9)):
        buffer = bytearray(b"0123456789")
        fill_middle.rotate(buffer, a, b, c)
        x = b"0123456789"
        assert buffer == x[:a] + x[b:c] + x[a:b] + x[c:]


def test_edge_rows(spark):
    rows = [(None, "a b c", "x"), (1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (7, "twice é", "x"), (7, "twice é", "x"), (8, "long wörd " * 200_000, "x"),
            *((k, f"<{'PSM'[k % 3]}> own {k}", "x") for k in range(10, 20)), *((k, f"words {k}\tand  more\n", "x") for k in range(20, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    for changed in (50, 100):
        made = fill_middle.restore(fill_middle.transform(docs, changed_percent=changed))
        got = sorted((tuple(r) for r in made.collect()), key=repr)
        assert got == sorted(((*by_the_rule(d, t, changed), t or "") for d, t, _ in rows), key=repr)
    assert fill_middle.restore(fill_middle.transform(docs.limit(0))).count() == 0


def test_query_and_sql(spark):
    import duckdb

    from loadwarden.llm.catalog import ORACLES, QUERIES
    got = sorted(tuple(r) for r in QUERIES["op12_fill_middle"](spark, SF).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == sorted((*by_the_rule(d, t)[:5], sha(by_the_rule(d, t)[5]), sha(t or "")) for d, t in docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(ORACLES["op12_fill_middle"]).fetchall()) == got
