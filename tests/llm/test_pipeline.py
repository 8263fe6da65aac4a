import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from deltaweave.llm import line_dedup, minhash, mixing, pieces, quality_rules


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], data).cache())
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "sentencepiece"] and P.ORACLE_SQL is None
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_every_decision_takes_effect(spark, data, steps):
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    docs, good, lines, single, mixed, encoded = steps
    assert ids(good) == ids(quality_rules.kept_with_distance(docs)) and set(ids(good)) < set(ids(docs))
    new = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(good).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t for d, (t, n) in new.items() if t or not n}
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0
    groups = {r.doc_id: r.copies for r in minhash.near_duplicates(lines).collect()}
    assert ids(single) == sorted(groups) and set(ids(lines)) - set(ids(single)) == {c for g in groups.values() for c in g}
    assert ids(mixed) == ids(mixing.mixed_ids(single))
    assert ids(encoded) == ids(mixed) and encoded.where("not round_trip").count() == 0
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == text


def test_run_is_the_stages_in_turn(spark, data, steps):
    assert sorted(map(str, P.run(spark, data).select("doc_id", "ids").collect())) == sorted(map(str, steps[-1].select("doc_id", "ids").collect()))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_odd_rows(spark, tmp_path):
    """Nulls, repeats, blank and long texts, ties and further columns with the operators' own names: every stage has a result."""
    text = "one two three four five six seven eight\nanother line of words"
    rows = [(i, f"{text}\nnumber {i} of some more words " + " ".join(f"w{(i * 7 + k) % 90}" for k in range(40)), "en", "src1", 1) for i in range(60)]
    rows += [(1, rows[1][1], "en", "src1", 1)] * 3 + [(100, text, None, None, None), (None, text, "en", None, 1), (101, None, "en", "src1", 0), (None, None, None, None, None), (102, "", "", "", 0), (103, " \n ", "de", "s", 3), (104, " ".join(f"w{i % 91}" for i in range(60_000)), "en", "src1", 9)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(n) for n in ("h", "sig", "bands", "epoch", "n_tokens", "keep", "s0", "_batch", "shard", "n_lines", "distance2", "level")])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    got = out.collect()
    assert got and out.columns == ["doc_id", "ids", "begins", "ends", "round_trip"] and all(r.round_trip for r in got)
    assert {r.doc_id for r in got} <= {*range(60), 100, 104, None}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == df.columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} & {101, 102, 103} == set()
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == sorted(map(str, (r.doc_id for r in got)))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
