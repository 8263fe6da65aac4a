import itertools
import json
import random

import pytest

from deltaweave import documents as D
from deltaweave.operators import linediff, replay
from deltaweave.sources import wire

LOG = "entity string, writer string, seq bigint, arrival int, op string, tbl string, key string, value string, ts bigint, id string, after string, hash string, prev_hash string"


def log(spark, rows):
    """rows: (writer, op, key, value, ts, id, after), in order of arrival."""
    seq, out = {}, []
    for i, (w, op, key, value, ts, *more) in enumerate(rows):
        seq[w] = seq.get(w, 0) + 1
        out.append(("e", w, seq[w], i, op, "state", key, json.dumps(value), ts, *(more + [None, None])[:2], f"{w}{seq[w]}", f"{w}{seq[w] - 1}"))
    return spark.createDataFrame(out, LOG)


def value(spark, rows, base=None):
    b = None if base is None else spark.createDataFrame([("e", "state", k, json.dumps(v)) for k, v in base.items()], replay.STATE)
    return {r.key: json.loads(r.value) for r in replay.materialise(log(spark, rows), b).collect()}


def test_order_and_deletion(spark):
    assert value(spark, [("a", "set", "n", 1, 1), ("a", "set", "n", 2, 2), ("a", "set", "n", 3, 3), ("a", "del", "n", None, 4)], {"k": 1}) == {"k": 1}
    assert value(spark, [("a", "set", "n", 1, 5), ("a", "set", "n", None, 5)], {"n": 0}) == {"n": None}


def test_later_time_wins_then_writer(spark):
    assert value(spark, [("A", "set", "x", "fromA", 100), ("B", "set", "x", "fromB", 200)]) == {"x": "fromB"}
    assert value(spark, [("B", "set", "x", "fromB", 200), ("A", "set", "x", "fromA", 300)]) == {"x": "fromA"}
    assert value(spark, [("B", "set", "x", "fromB", 7), ("A", "set", "x", "fromA", 7)]) == {"x": "fromB"}


def test_lists(spark):
    vs = lambda s: [e["v"] for e in s["l"]]
    assert vs(value(spark, [("A", "add", "l", 1, 1, "A#1"), ("A", "add", "l", 3, 2, "A#2"), ("A", "add", "l", 2, 3, "A#3", "A#1")])) == [1, 2, 3]
    got = value(spark, [("A", "add", "l", 1, 1, "A#1"), ("A", "add", "l", 2, 2, "A#2"), ("A", "list-set", "l", 10, 3, "A#1"), ("B", "list-set", "l", 20, 4, "A#1"), ("B", "list-del", "l", None, 5, "A#2")])
    assert vs(got) == [20]
    assert value(spark, [("A", "add", "l", 1, 1, "A#1"), ("A", "del", "l", None, 2), ("A", "add", "l", 2, 3, "A#3", "gone")]) == {"l": [{"id": "A#3", "v": 2}]}
    assert value(spark, [("A", "list-set", "l", 5, 1, "nobody")], {"l": [{"id": "x", "v": 1}]}) == {"l": [{"id": "x", "v": 1}]}


def test_bad_changes(spark):
    from pyspark.errors import PythonException

    for rows in ([("A", "list-set", "l", 1, 1, "x")], [("A", "set", "l", 1, 1), ("A", "add", "l", 1, 2, "x")], [("A", "grow", "l", 1, 1)]):
        with pytest.raises(PythonException):
            replay.materialise(log(spark, rows)).collect()
        r = replay.materialise(log(spark, [*rows, ("A", "set", "ok", 1, 9)]), strict=False).collect()
        assert {x.key: x.error is None for x in r} == {"l": False, "ok": True}


def test_state_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AB"), rng.choice(["set", "del", "set"]), rng.choice("xyz"), i, rng.randint(0, 5)) for i in range(60)]
    rows += [(rng.choice("AB"), "add", "l", i, rng.randint(0, 9), f"i{i}", rng.choice([None, "i3", "i5"])) for i in range(12)]
    df = log(spark, rows)
    plain = sorted(map(str, replay.materialise(df).collect()))
    assert sorted(map(str, replay.materialise(df.repartition(7, "value")).collect())) == plain
    want: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.writer, r.arrival)):
        v = replay.fold(want.pop(r.key, replay._GONE), [{"op": r.op, "value": json.loads(r.value), "id": r.id, "after": r.after}])
        if v is not replay._GONE:
            want[r.key] = v
    assert {r.key: json.loads(r.value) for r in replay.materialise(df).collect()} == want
    half = replay.compact(df)
    assert sorted(map(str, replay.materialise(df.limit(0), half).collect())) == plain


def test_heads_missing_and_rollback(spark):
    df = log(spark, [("A", "set", "x", 1, 1), ("A", "set", "x", 2, 2), ("B", "set", "y", 9, 3)])
    assert sorted(tuple(r) for r in replay.heads(df).collect()) == [("e", "A", 2, "A2"), ("e", "B", 1, "B1")]
    known = spark.createDataFrame([("e", "A", 1)], "entity string, writer string, last_seq bigint")
    assert sorted(r.hash for r in replay.missing(df, known).collect()) == ["A2", "B1"]
    assert [r.seq for r in replay.export_since(df, "A", 1).collect()] == [2]
    assert replay.rollback(df, 2).count() == 1 and replay.rollback(df, 9).count() == 0


def test_blocks_out_of_order(spark):
    have = log(spark, [("A", "set", "x", 1, 1)])
    base = spark.createDataFrame([("e", "B0")], "entity string, base_hash string")
    new = log(spark, [("A", "set", "x", i, i) for i in range(1, 6)] + [("B", "set", "x", i, i) for i in range(1, 4)]).where("not (writer = 'A' and seq = 4)")
    got = {(r.writer, r.seq): r.status for r in replay.applicable(new, have, base).collect()}
    assert got == {("A", 1): "applied", ("A", 2): "ready", ("A", 3): "ready", ("A", 5): "pending", ("B", 1): "ready", ("B", 2): "ready", ("B", 3): "ready"}


def test_edits_make_the_new_text():
    rng = random.Random(4)
    for _ in range(200):
        old = [(f"a#{i}", rng.choice("abcd")) for i in range(rng.randint(0, 7))]
        new = [rng.choice("abcd") for _ in range(rng.randint(0, 7))]
        ops = linediff.edits(old, new)
        kept = linediff.common([t for _, t in old], new)
        brute = max((len(c) for n in range(len(old) + 1) for c in itertools.combinations(range(len(old)), n) if _sub([old[i][1] for i in c], new)), default=0)
        assert len(kept) == brute and [old[i][1] for i, _ in kept] == [new[j] for _, j in kept]
        value = [{"id": i, "v": t} for i, t in old]
        value = replay.fold(value, linediff.to_deltas(ops, "w", 1, 0))
        if not ops or ops[0]["op"] != "add" or ops[0]["after"] is not None or not kept:
            assert [e["v"] for e in value] == new
    assert linediff.edits([("a#1", "1"), ("a#2", "3")], ["1", "2", "3"]) == [{"op": "add", "id": None, "after": "a#1", "text": "2"}]


def _sub(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_document_files(spark, tmp_path):
    p = str(tmp_path / "d.eml")
    D.init(p)
    for t in ("one", "three"):
        D.add(p, t)
    D.add(p, "two", after="local#1")
    text = lambda: [r.v for r in D.lines(spark, p).collect()]
    assert text() == ["one", "two", "three"]
    D.set_line(p, "local#3", "TWO")
    D.delete(p, "local#2")
    assert text() == ["one", "TWO"]
    assert D.edit(spark, p, "one\nTWO\nend\n", "w2") == 1 and text() == ["one", "TWO", "end"]
    assert [r.shown for r in D.log(spark, p).collect()][0] == "one"
    assert D.revert(p, 2) == (4, 2) and text() == ["one", "TWO", "three"]
    out = str(tmp_path / "c.eml")
    assert D.compact(spark, p, out) == (1, 4)
    assert [r.v for r in D.lines(spark, out).collect()] == ["one", "TWO", "three"] and wire.read(open(out, "rb").read()).tail == []
    D.put(p, "extra", "n", 9)
    assert D.compact(spark, p, out)[0] == 2 and dict(wire.read(open(out, "rb").read()).headers)["X-EML-Type"] == "Application/Unified"


def test_line_edits_as_tables(spark):
    old = spark.createDataFrame([("d", 0, "a#1", "x"), ("d", 1, "a#2", "y")], "doc string, place int, id string, text string")
    new = spark.createDataFrame([("d", 0, "x"), ("d", 1, "z"), ("n", 0, "q")], "doc string, place int, text string")
    assert sorted((r.doc, r.op, r.id, r.after, r.text) for r in linediff.line_edits(old, new).collect() if r.doc == "d") == [("d", "add", None, "a#1", "z"), ("d", "del", "a#2", None, None)]
    assert sorted(tuple(r) for r in linediff.line_sets(old, new).collect()) == [("d", "y", "removed"), ("d", "z", "added"), ("n", "q", "added")]
