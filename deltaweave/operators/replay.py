"""Change logs: state by replay, writers' heads, compaction, rollback, documents.

Changes are replayed in the order (ts, writer, arrival). Where a key was only
set and deleted, its state is that of its last change, one aggregation without
any sort of the log; only keys with list operations are folded in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import day_time

LIST_OPS = ("add", "list-set", "list-del")
OPS = ("set", "del", *LIST_OPS)
KEY = ["entity", "tbl", "key"]
STATE = "entity string, tbl string, key string, value string"


class ReplayError(ValueError):
    """A change that can't be applied."""


def fold(value, changes: list[dict]):
    """A key's value after changes in order; the marker _GONE for none."""
    for c in changes:
        op = c["op"]
        if op == "set":
            value = c["value"]
        elif op == "del":
            value = _GONE
        elif op == "add":
            if value is _GONE:
                value = []
            if not isinstance(value, list):
                raise ReplayError("not a list")
            at = next((i + 1 for i, e in enumerate(value) if isinstance(e, dict) and c["after"] is not None and e.get("id") == c["after"]), len(value))
            value = [*value[:at], {"id": c["id"] or "", "v": c["value"]}, *value[at:]]
        elif op in ("list-set", "list-del"):
            if not isinstance(value, list):
                raise ReplayError("not a list")
            mine = lambda e: isinstance(e, dict) and e.get("id") is not None and e.get("id") == (c["id"] if op == "list-set" else c["id"] or "")  # noqa: B023, E731
            if op == "list-del":
                value = [e for e in value if not mine(e)]
            else:
                k = next((i for i, e in enumerate(value) if mine(e)), None)
                value = value if k is None else [*value[:k], value[k] | {"v": c["value"]}, *value[k + 1 :]]
        else:
            raise ReplayError(f"unknown operation: {op}")
    return value


class _GONE:
    """Stands for no value; a class, as workers then have the same one."""


def _json(v) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _fold_sorted(strict: bool):
    """Values of rows sorted by key and then in order, base first; a partition streams through, one key at a time."""

    def closed(key: tuple, base, rows: list[dict]) -> tuple | None:
        try:
            v = fold(_GONE if base is None else json.loads(base), rows)
        except ReplayError as e:
            if strict:
                raise ReplayError(f"{'/'.join(map(str, key))}: {e}") from e
            return (*key, None, str(e))
        return None if v is _GONE else (*key, _json(v), None)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, rows = None, None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                now = (r["entity"], r["tbl"], r["key"])
                if now != key:
                    if key is not None and (got := closed(key, base, rows)):
                        out.append(got)
                    key, base, rows = now, None, []
                if r["op"] == "base":
                    base = r["value"]
                else:
                    rows.append({"op": r["op"], "value": None if r["value"] is None else json.loads(r["value"]), "id": r["id"], "after": r["after"]})
            yield _state_batch(out)
        if key is not None and (got := closed(key, base, rows)):
            yield _state_batch([got])

    return f


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["entity", "tbl", "key", "value", "error"])


def materialise(deltas: DataFrame, base: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(entity, tbl, key, value) after all changes, value as JSON text; with strict off, also error.

    base has the state before. A bad change fails the query, or, with strict
    off, gives its key an error and no value.
    """
    cols = ["entity", "tbl", "key", "op", "value", "ts", "writer", "arrival", "id", "after"]
    rows = deltas.select(*cols)
    if base is not None:
        first = base.select("entity", "tbl", "key", F.lit("base").alias("op"), "value", F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("string").alias("writer"), F.lit(None).cast("int").alias("arrival"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("after"))
        rows = first.unionByName(rows)
    simple = F.col("op").isin("set", "del", "base")
    order = F.struct("ts", "writer", "arrival")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), order).alias("last"), F.bool_and(simple).alias("simple"))
    fast = last.where("simple and last.op <> 'del'").select(*KEY, F.col("last.value").alias("value"), F.lit(None).cast("string").alias("error"))
    lists = rows.join(last.where("not simple").select(*KEY), KEY, "left_semi").select(*[F.col(k).cast("string") for k in KEY], "op", "value", "id", "after", (F.col("op") != "base").alias("_later"), "ts", "writer", "arrival")
    # by a hash of the key: an exchange by the key itself counts as redundant above the union, whose partitions adaptive execution then merges differently
    lists = lists.repartition(F.xxhash64(*KEY)).sortWithinPartitions(*KEY, "_later", "ts", "writer", "arrival")
    slow = lists.select(*KEY, "op", "value", "id", "after").mapInArrow(_fold_sorted(strict), STATE + ", error string")
    out = fast.unionByName(slow)
    return out.drop("error") if strict else out


def lookup(state: DataFrame, tbl: str, key: str) -> DataFrame:
    return state.where((F.col("tbl") == tbl) & (F.col("key") == key))


def list_values(state: DataFrame) -> DataFrame:
    """State of list keys as one row an element: (entity, tbl, key, place, id, v), v as JSON text; elements without v as they are."""
    items = state.select("entity", "tbl", "key", F.posexplode(F.from_json("value", "array<string>")).alias("place", "item"))
    v = F.get_json_object("item", "$.v")
    has = F.coalesce(F.array_contains(F.json_object_keys("item"), "v"), F.lit(False))
    return items.select("entity", "tbl", "key", "place", F.get_json_object("item", "$.id").alias("id"), F.when(has, v).otherwise(F.col("item")).alias("v"))


# --- writers


def heads(deltas: DataFrame) -> DataFrame:
    """(entity, writer, seq, hash): every writer's last block."""
    return deltas.groupBy("entity", "writer").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def manifest(deltas: DataFrame) -> DataFrame:
    return heads(deltas).select("entity", "writer", F.col("seq").alias("last_seq"))


def export_since(deltas: DataFrame, writer: str, since: int = 0) -> DataFrame:
    return deltas.where((F.col("writer") == writer) & (F.col("seq") > since))


def missing(deltas: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks beyond what a peer knows, by its manifest (entity, writer, last_seq)."""
    return deltas.join(known.select("entity", "writer", "last_seq"), ["entity", "writer"], "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def new_blocks(blocks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Blocks whose (writer, seq) isn't in the log yet."""
    return blocks.join(deltas.select("entity", "writer", "seq"), ["entity", "writer", "seq"], "left_anti")


def applicable(blocks: DataFrame, deltas: DataFrame, base_hash: DataFrame) -> DataFrame:
    """blocks (entity, writer, seq, prev_hash, hash, ...) with status: applied (already there), ready or pending.

    A block is ready if it and all between the writer's head and it are there,
    each following the one before by number and hash. base_hash (entity,
    base_hash) is what a writer's first block follows.
    """
    once = blocks.dropDuplicates(["entity", "writer", "seq"])
    own = heads(deltas).withColumnsRenamed({"seq": "head_seq", "hash": "head_hash"})
    known = deltas.select("entity", "writer", "seq", F.lit(True).alias("known"))
    rows = once.join(own, ["entity", "writer"], "left").join(known, ["entity", "writer", "seq"], "left").join(base_hash.select("entity", "base_hash"), "entity", "left")
    rows = rows.withColumn("known", F.coalesce("known", F.lit(False)))
    by = Window.partitionBy("entity", "writer", "known").orderBy("seq")
    place = F.row_number().over(by)
    prev = F.lag("hash").over(by)
    follows = F.when(place == 1, F.col("prev_hash") == F.coalesce("head_hash", "base_hash")).otherwise(F.col("prev_hash") == prev)
    good = (F.col("seq") - F.coalesce("head_seq", F.lit(0)) == place) & F.coalesce(follows, F.lit(False))
    rows = rows.withColumn("_good", good.cast("int"))
    unbroken = F.min("_good").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    status = F.when(F.col("known"), "applied").when(unbroken, "ready").otherwise("pending")
    return rows.withColumn("status", status).drop("known", "_good", "head_seq", "head_hash", "base_hash")


def numbered(changes: DataFrame, deltas: DataFrame, order: list[str]) -> DataFrame:
    """New changes (entity, writer, ...) with the numbers that follow the log's, and prev_hash for the first of each writer."""
    own = heads(deltas).withColumnsRenamed({"seq": "head_seq", "hash": "head_hash"})
    by = Window.partitionBy("entity", "writer").orderBy(*order)
    n = F.row_number().over(by)
    out = changes.join(own, ["entity", "writer"], "left").withColumn("_n", n)
    return out.withColumns({"seq": F.coalesce("head_seq", F.lit(0)) + F.col("_n"), "prev_hash": F.when(F.col("_n") == 1, F.col("head_hash"))}).drop("_n", "head_seq", "head_hash")


# --- compaction and rollback


def compact(deltas: DataFrame, base: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The state as a new base; the log that it stands for is then empty."""
    return materialise(deltas, base, strict)


def tables(deltas: DataFrame) -> DataFrame:
    return deltas.select("entity", "tbl").distinct()


def rollback(deltas: DataFrame, n: int) -> DataFrame:
    """The log without each entity's last n blocks."""
    # the last n by entity are found with n rows at most for each of a task's entities, as the rank is limited before the exchange
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("arrival")))
    last = deltas.select("entity", "arrival").withColumn("_place", place).where(F.col("_place") <= n)
    edge = last.groupBy("entity").agg(F.min("arrival").alias("_edge"))
    return deltas.join(edge, "entity", "left").where((F.col("_edge").isNull()) | (F.col("arrival") < F.col("_edge"))).drop("_edge") if n > 0 else deltas


# --- documents

DOC, LINES = "doc", "lines"


def doc_lines(deltas: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(entity, place, id, v): a document's lines in order."""
    return list_values(lookup(materialise(deltas, base), DOC, LINES)).select("entity", "place", "id", "v")


def doc_log(deltas: DataFrame) -> DataFrame:
    """(entity, arrival, writer, seq, time, tbl, key, shown): a readable history, values cut after 40 characters."""
    text = F.coalesce(F.get_json_object(F.concat(F.lit("["), F.col("value"), F.lit("]")), "$[0]"), F.lit("null"))
    shown = F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 40), F.lit("..."))).otherwise(text)
    return deltas.select("entity", "arrival", "writer", "seq", day_time(F.col("ts")).alias("time"), "tbl", "key", shown.alias("shown"))
