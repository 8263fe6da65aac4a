import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.llm import line_dedup as L
from deltaweave.llm import textops as X


def brute(docs, k):
    """[(doc_id, text)] by the definition."""
    have = {}
    for d, t in docs:
        if d is not None and t is not None:
            for line in {x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")}:
                have.setdefault(line, []).append(d)
    out = []
    for d, t in docs:
        if d is None or t is None:
            out.append((d, t))
        else:
            out.append((d, "\n".join(x for x in t.split("\n") if not (len(have.get(x, [])) >= k and min(have[x]) != d))))
    return out


def keys_of(rng, n):
    return np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)


def test_perfect_hash_numbers_every_key_once():
    keys = keys_of(np.random.default_rng(2), 50_000)
    keys[:100, 0] = keys[0, 0]  # the second word tells keys apart as well
    f = L.MinimalPerfectHash.build(keys)
    assert np.array_equal(np.sort(f(keys)), np.arange(len(keys)))
    assert f.size() < len(keys)  # below eight bits a key
    assert L.MinimalPerfectHash.build(keys[:0])(keys[:5]).tolist() == [-1] * 5


def test_shard_tells_strangers():
    rng = np.random.default_rng(3)
    keys = keys_of(rng, 3000)
    shard = L.Shard(keys, np.arange(len(keys)), np.arange(len(keys)) * 7)
    docs, owners = shard.probe(keys)
    assert docs.tolist() == list(range(len(keys))) and owners.tolist() == [i * 7 for i in range(len(keys))]
    assert shard.probe(rng.integers(1 << 63, (1 << 64) - 1, (3000, 2), dtype=np.uint64))[0].sum() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n é", max_size=12), min_size=1, max_size=6), st.randoms())
def test_rewrite_is_split_and_join(texts, rng):
    data, off = X.strings(pa.array(texts))
    starts, ends, h, bounds = L.lines(data, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [x for t in texts for x in t.split("\n")]
    drop = np.array([rng.random() < 0.5 for _ in starts])
    out, new = L.rewrite(data, off, starts, bounds, drop)
    want = ["\n".join(x for x, d in zip(t.split("\n"), drop[bounds[i] : bounds[i + 1]]) if not d) for i, t in enumerate(texts)]
    assert [out[a:b].tobytes().decode() for a, b in zip(new[:-1], new[1:])] == want


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(40)] + ["", "  ", "é ü"]
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", "x"] + ["\n".join(rng.choices(pool, k=rng.randint(1, 9)))] * 9)) for _ in range(90)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    want = sorted(map(repr, brute(docs, 4)))
    for shard_lines in (1 << 20, 10):
        got = L.dedup_lines(df, min_docs=4, shard_lines=shard_lines).select("doc_id", "text").collect()
        assert sorted(repr(tuple(r)) for r in got) == want


def test_sql_agrees_on_repeated_ids(spark):
    import duckdb
    import pandas as pd

    from deltaweave.llm.queries import LINE_DEDUP

    docs = [(i % 4, "same\nother %d" % (i % 3)) for i in range(9)] + [(7, "same\nsame"), (8, None), (None, "same"), (9, "")]
    con = duckdb.connect()
    con.register("t", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.execute("create view documents as select doc_id::bigint as doc_id, text from t")
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(LINE_DEDUP).fetchall()))


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_structured_lines_do_not_collide(spark):
    """Polynomials modulo a power of two can't tell these apart."""
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    docs = [(i, x) for i in range(7)] + [(100, y), (101, y + "\n" + x)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {0: x, **{i: "" for i in range(1, 7)}, 100: y, 101: y}
    data, off = X.strings(pa.array([x, y]))
    assert len(set(X.span_hash(X.prefix_hash(data), off[:-1], off[1:]).tolist())) == 2


def test_stored_rows_are_read_by_batch(spark, tmp_path, monkeypatch):
    from deltaweave.llm import batches

    rng = random.Random(5)
    pool = [f"line {i}" for i in range(300)]
    docs = [(i, "\n".join(rng.choices(pool, k=6))) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    few = batches.numbered(df.toDF("_c0", "_c1"), 100)
    assert few.select("_batch").distinct().count() == 20 and few.count() == 2000
    monkeypatch.setattr(batches.numbered, "__defaults__", (100,))
    got = L.dedup_lines(df).select("doc_id", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute(docs, 6)))


def test_emptied_documents_go(spark):
    df = spark.createDataFrame([(1, "a\nb", 3), (2, "a", 1), (3, "a\nc", 3), (4, "", 0)], "doc_id bigint, text string, n_chars bigint")
    got = {tuple(r) for r in L.strip_repeated_lines(df, min_docs=2).collect()}
    assert got == {(1, "a\nb", 3), (3, "c", 1), (4, "", 0)}
