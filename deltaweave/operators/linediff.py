"""Line edits between two versions of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An added line follows the one added just before it.
NEXT = "__next__"


def common(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of several, the one that drops old lines first."""
    n, m = len(old), len(new)
    # lengths of the common subsequence of the rests; equal ends need no table
    a = 0
    while a < min(n, m) and old[a] == new[a]:
        a += 1
    best = [[0] * (m - a + 1) for _ in range(n - a + 1)]
    for i in range(n - a - 1, -1, -1):
        row, below, x = best[i], best[i + 1], old[a + i]
        for j in range(m - a - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == new[a + j] else max(below[j], row[j + 1])
    out, i, j = [(k, k) for k in range(a)], 0, 0
    while i < n - a and j < m - a:
        if old[a + i] == new[a + j]:
            out.append((a + i, a + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def edits(old: list[tuple[str, str]], new: list[str]) -> list[dict]:
    """Operations {op, id, after, text} that turn the lines (id, text) into the new texts: adds in order, then deletions."""
    pairs = common([t for _, t in old], new)
    kept = {j: i for i, j in pairs}
    out, anchor, adding = [], None, False
    for j, text in enumerate(new):
        if j in kept:
            anchor, adding = old[kept[j]][0], False
        else:
            out.append({"op": "add", "id": None, "after": NEXT if adding else anchor, "text": text})
            adding = True
    gone = set(range(len(old))) - {i for i, _ in pairs}
    return out + [{"op": "del", "id": old[i][0], "after": None, "text": None} for i in sorted(gone)]


def to_deltas(ops: list[dict], writer: str, next_seq: int, ts: int, tbl: str = "doc", key: str = "lines") -> list[dict]:
    """Changes of the log for edits; ids are writer#number."""
    out, last = [], None
    for n, o in enumerate(ops):
        seq = next_seq + n
        if o["op"] == "add":
            after = last if o["after"] == NEXT else o["after"]
            last = f"{writer}#{seq}"
            out.append({"op": "add", "table": tbl, "key": key, "value": o["text"], "ts": ts, "id": last, "after": after})
        else:
            out.append({"op": "list-del", "table": tbl, "key": key, "value": None, "ts": ts, "id": o["id"], "after": None})
            last = None
    return out


def line_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, step, op, id, after, text) from old (doc, place, id, text) to new (doc, place, text)."""

    def f(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("place"), b.sort_values("place")
        got = edits(list(zip(a["id"], a["text"], strict=True)), b["text"].tolist())
        return pd.DataFrame([(key[0], i, o["op"], o["id"], o["after"], o["text"]) for i, o in enumerate(got)], columns=["doc", "step", "op", "id", "after", "text"])

    return old.groupBy("doc").cogroup(new.groupBy("doc")).applyInPandas(f, "doc string, step int, op string, id string, after string, text string")


def line_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, text, change): lines that only one version has, whatever their order, as often as it has them more."""
    cols = [F.col("doc"), F.col("text")]
    a, b = old.select(*cols), new.select(*cols)
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))
