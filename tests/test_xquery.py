import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.functions import xquery as X

REC = [("X-Record-ID", "rec_1"), ("X-Tag", "sensor_data"), ("X-Tag", "telemetry"), ("X-Timestamp", "1786528800")]
CASES = [
    (REC, 'X-Tag == "telemetry"', True),
    (REC, "x-TAG == 'telemetry'", True),
    (REC, 'X-Tag == "other"', False),
    (REC, 'X-Tag != "telemetry"', False),
    (REC, 'X-Tag != "other"', True),
    (REC, "X-Timestamp >= 1786528800 AND X-Timestamp < 1786528801", True),
    (REC, 'X-Tag == "telemetry" AND X-Device-ID == "d"', False),
    (REC, 'X-Device-ID != "d"', True),
    (REC, 'X-Device-ID >= "d"', False),
    (REC, 'X-Tag > "a"', False),
    ([("N", "007")], "N == 7.0", True),
    ([("N", "7.0000000001")], "N == 7", True),
    ([("N", "7.1")], "N != 7", True),
    ([("N", "1d")], "N >= 0", False),
    ([("N", "1d")], "N == 1", False),
    ([("N", "inf")], "N == inf", False),
    ([("N", "inf")], "N != inf", True),
    ([("N", "nan")], "N == nan", False),
    ([("N", "inf")], "N > 1e300", True),
    ([("N", "nan")], "N >= 1", False),
    ([("N", "5")], "N >= nan", False),
    ([("N", " 5 ")], "N == 5", True),
    ([("N", "1"), ("N", "10")], "N > 5 AND N < 5", True),
    ([("Subject", "Retro Arcade")], 'Subject == "arc"', True),
    ([("Subject", "Retro Arcade")], 'Subject != "ARC"', True),
    ([("Subject", "Retro Arcade")], "Subject >= zzz", False),
    ([], 'Subject != "x"', False),
    ([("T", "a")], "NOT T == a", False),
    ([("T", "a")], "NOT T == b", True),
    ([("T", "a")], "T == b OR T == a", True),
    ([("T", "a")], "NOT T == a OR T == a", True),
    ([("T", "a")], "T == a AND NOT T == b", False),  # the field is "not t"
    ([("T", "a")], "T == a AND NOT T != b", True),
    ([("T", "a b"), ("T", "x")], "T == a and b", False),
    ([("T", "a and b")], "T == a and b", True),
]
BAD = ["", "  ", "T", "== a", "T ==", 'T == ""', "T == a OR ", "NOT ", "T == 'a AND b'", " AND "]


@pytest.mark.parametrize("headers,query,want", CASES)
def test_rules(headers, query, want):
    assert X.matches(headers, query) is want


@pytest.mark.parametrize("query", BAD)
def test_malformed(query):
    with pytest.raises(X.QueryError):
        X.parse(query)


def test_compiled_equals_plain(spark):
    rows = [(i, [{"k": k, "v": v} for k, v in h]) for i, (h, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, headers array<struct<k:string,v:string>>")
    for q in sorted({q for _, q, _ in CASES}):
        from pyspark.sql import functions as F

        got = {r.i: r.hit for r in df.select("i", X.compile_query(q, F.col("headers")).alias("hit")).collect()}
        assert got == {i: X.matches(h, q) for i, (h, _, _) in enumerate(CASES)}, q


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.eE+-infaINFty \t", max_size=8))
def test_numbers(s):
    got = X.number(s)
    t = s.strip()
    try:
        want = float(t) if t else None
    except ValueError:
        want = None
    assert got == want or got != got and want != want


def test_columns_of_their_own_reach_the_scan(spark, data):
    from deltaweave.plans import adapters as A

    hits = A.records(spark, data).where(X.compile_query('X-Tag == "click" AND X-Device-ID == 7', fields=A.RECORD_FIELDS))
    plan = hits.select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "EqualTo(user_id,7)" in plan and "props" not in plan


def test_store_rule():
    with pytest.raises(X.QueryError):
        X.compile_store_query("OR")


def test_numbers_in_columns_compare_like_those_in_headers(spark):
    import math

    from pyspark.sql import functions as F

    from deltaweave.functions.xquery import Field, compile_query, matches

    values = [7.0, 7.0000000001, 7.1, -7.5, 0.0, math.nan, math.inf, -math.inf, None, 2.0**60]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    whole = spark.createDataFrame([(i, v) for i, v in enumerate([7, 8, -7, 0, None, 2**53 + 1, 2**62])], "i int, v bigint")
    for kind, t in (("float", df), ("number", whole)):
        for op in ("==", "!=", ">=", "<=", ">", "<"):
            for y in ("7", "7.0000000001", "7.5", "-7", "inf", "-inf", "nan", "text", "9007199254740993", "1e300"):
                q = f"X-V {op} {y}"
                got = {r.i for r in t.where(compile_query(q, fields={"x-v": Field("v", kind)})).collect()}
                want = {r.i for r in t.collect() if matches([] if r.v is None else [("X-V", repr(r.v))], q)}
                assert got == want, (kind, q)
