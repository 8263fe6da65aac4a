import duckdb
import pandas as pd
import pytest

from deltaweave.llm import mixing


def water(budget, kids):
    """{name: share} by repeated rounds over [(name, weight, cap)]."""
    out, kids = {}, list(kids)
    while kids:
        total = sum(w for _, w, _ in kids)
        full = [k for k in kids if k[2] * total <= budget * k[1]]
        if not full:
            return out | {n: budget * w // total for n, w, _ in kids}
        for k in full:
            out[k[0]] = k[2]
        budget -= sum(k[2] for k in full)
        kids = [k for k in kids if k not in full]
    return out


@pytest.mark.parametrize("percent,epochs", [(30, 1), (90, 2), (100, 1), (250, 3), (400, 3), (0, 2)])
def test_budgets_equal_rounds(spark, percent, epochs):
    leaves = [("d0", "en", "a", 1000), ("d0", "en", "b", 10), ("d0", "de", "a", 5), ("d1", "en", "c", 300), ("d1", "fr", "c", 0), ("d2", "es", "x", 7), ("d2", "es", "y", 7)]
    w = {"domain": {"d0": 1, "d1": 5}, "lang": {"en": 3}, "source": {"b": 9}}
    got = {r[:3]: r.got for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), percent, epochs, w).collect()}
    cap = lambda f: sum(x[3] * epochs for x in leaves if f(x))
    want = {}
    top = water(sum(x[3] for x in leaves) * percent // 100, [(d, w["domain"].get(d, 1), cap(lambda x, d=d: x[0] == d)) for d in sorted({x[0] for x in leaves})])
    for d, b in top.items():
        mid = water(b, [(k, w["lang"].get(k, 1), cap(lambda x, k=k: x[:2] == (d, k))) for k in sorted({x[1] for x in leaves if x[0] == d})])
        for k, c in mid.items():
            low = water(c, [(x[2], w["source"].get(x[2], 1), x[3] * epochs) for x in leaves if x[:2] == (d, k)])
            want |= {(d, k, s): v for s, v in low.items()}
    assert got == want


def test_equals_sql_with_odd_rows(spark):
    rows = [(i % 9 if i % 7 else None, None if i % 11 == 0 else "w " * (i % 13), [None, "en", "de", ""][i % 4], [None, "", "src0", "src1", "x7"][i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    con.execute("create view documents as select doc_id::bigint as doc_id, text, lang, source from t")
    for percent in (5, 60, 150, 290):
        want = sorted(map(repr, con.execute(mixing.oracle(percent=percent)).fetchall()))
        cols = [c[0] for c in con.description]
        assert sorted(repr(tuple(r)) for r in mixing.mixed_ids(df, percent=percent).select(*cols).collect()) == want


def test_a_full_epoch_is_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mixed_rows(docs, percent=100, epochs=1)
    assert rows.columns == docs.columns and sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in docs.collect())
