"""What every operator over documents must bear: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from deltaweave.llm import classifier, line_dedup, minhash, mixing, pieces, quality_rules, secret_scan, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven\nsame line here", "en", "s1", 10),
    (1, "one two three four five six seven\nsame line here", "en", "s1", 10),
    (2, "one two three four five six seven\nsame line here", None, "s1", None),
    (3, "", "en", None, 0),
    (4, None, "en", "s1", 0),
    (None, "one two three four five six seven\nsame line here", "en", "s1", 5),
    (None, None, None, None, None),
    (5, LONG, "de", "s2", len(LONG)),
    (6, "   \n \t\n", "de", "s2", 6),
    (7, "äöü ß ▁ 😀 \u0000 x\r\n\n", "", "", 9),
]
OPERATORS = {
    "minhash": minhash.near_duplicates,
    "minhash rows": minhash.deduplicate,
    "mixing": mixing.mixed_ids,
    "mixing rows": mixing.mixed_rows,
    "lines": lambda d: line_dedup.dedup_lines(d, min_docs=2),
    "lines rows": lambda d: line_dedup.strip_repeated_lines(d, min_docs=2),
    "rules": quality_rules.kept_with_distance,
    "rules rows": lambda d: quality_rules.keep_good(d, least=3),
    "pieces": pieces.encode,
    "secrets": secret_scan.find_secrets,
    "passages": substring_dedup.repeated_passages,
    "passages cut": substring_dedup.without_repeats,
    "classifier": lambda d: classifier.classify(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")),
}


def clash(df):
    """df with columns that have the names that operators might use themselves, once more in capitals."""
    names = ["h", "key", "sig", "bands", "digest", "lead", "a", "b", "kept", "copies", "shard", "docs", "owner", "domain", "epoch", "n_tokens", "level", "mean", "inv", "s0", "distance2", "keep", "ids", "_c0", "_id", "_drop", "bucket", "value"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)], F.lit("x").alias("TEXT"))


@pytest.mark.parametrize("name", OPERATORS)
def test_any_rows(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plain = sorted(map(str, OPERATORS[name](df).select("doc_id").collect()))
    assert sorted(map(str, OPERATORS[name](clash(df)).select("doc_id").collect())) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0
    assert OPERATORS[name](spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).count() <= 1
