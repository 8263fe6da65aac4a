"""Documents of lines in container files: init, add, set, delete, list, edit, log, revert."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .operators import linediff, replay
from .sources import wire
from .sources.readers import containers


def init(path: str, entity: str = "doc@system.local") -> None:
    wire.write_file(path, wire.build(entity, replay.DOC, [wire.Section.table(replay.DOC, {replay.LINES: []})]))


def change(path: str, delta: dict, writer: str = wire.LOCAL) -> int:
    """Appends one change to a container; its number."""
    with open(path, "rb") as f:
        raw = f.read()
    seq = wire.head(wire.read(raw), writer)[0] + 1
    if delta["op"] == "add" and delta.get("id") is None:
        delta = delta | {"id": f"{writer}#{seq}"}
    wire.write_file(path, wire.append_delta(raw, {"ts": int(time.time())} | delta, writer))
    return seq


def _line(op: str, **fields) -> dict:
    return {"op": op, "table": replay.DOC, "key": replay.LINES, **fields}


def add(path: str, text: str, writer: str = wire.LOCAL, after: str | None = None) -> int:
    return change(path, _line("add", value=text, after=after), writer)


def set_line(path: str, id: str, text: str, writer: str = wire.LOCAL) -> int:
    return change(path, _line("list-set", value=text, id=id), writer)


def delete(path: str, id: str, writer: str = wire.LOCAL) -> int:
    return change(path, _line("list-del", value=None, id=id), writer)


def put(path: str, table: str, key: str, value, writer: str = wire.LOCAL) -> int:
    return change(path, {"op": "set", "table": table, "key": key, "value": value}, writer)


def remove(path: str, table: str, key: str, writer: str = wire.LOCAL) -> int:
    return change(path, {"op": "del", "table": table, "key": key, "value": None}, writer)


def base_state(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """(entity, tbl, key, value) of the JSON sections of a container or a folder of them."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    from .functions import codec

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, i, enc, raw in zip(pdf["entity"], pdf["id"], pdf["enc"], pdf["payload"], strict=True):
                table = json.loads(codec.decode(enc, bytes(raw), key))
                if isinstance(table, dict):
                    out += [(e, i, k, wire.dump(v).decode()) for k, v in table.items()]
            yield pd.DataFrame(out, columns=["entity", "tbl", "key", "value"])

    sections = containers(spark, path, "sections").where("ct like '%json%'").select("entity", "id", "enc", "payload")
    return sections.mapInPandas(f, replay.STATE)


def state(spark: SparkSession, path: str, strict: bool = True, **key: str) -> DataFrame:
    """The state of a container, or of a folder of them, after all changes; key or passphrase opens encrypted ones."""
    from .functions.codec import key_from

    opened = key_from(key.get("key"), key.get("passphrase"))
    return replay.materialise(containers(spark, path, "deltas", **key).where("op is not null"), base_state(spark, path, opened), strict)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return replay.list_values(replay.lookup(state(spark, path), replay.DOC, replay.LINES)).select("entity", "place", "id", "v").orderBy("entity", "place")


def edit(spark: SparkSession, path: str, text: str, writer: str = wire.LOCAL) -> int:
    """Turns a document into a new text by changes; their number."""
    old = [(r.id or "", r.v or "") for r in lines(spark, path).collect()]
    with open(path, "rb") as f:
        raw = f.read()
    first = wire.head(wire.read(raw), writer)[0] + 1
    got = linediff.to_deltas(linediff.edits(old, text.splitlines()), writer, first, int(time.time()))
    for d in got:
        raw = wire.append_delta(raw, d, writer)
    wire.write_file(path, raw)
    return len(got)


def log(spark: SparkSession, path: str) -> DataFrame:
    return replay.doc_log(containers(spark, path, "deltas")).orderBy("entity", "arrival")


def revert(path: str, n: int) -> tuple[int, int]:
    """Takes the last n blocks off a container; blocks left and taken off."""
    with open(path, "rb") as f:
        raw = f.read()
    total = len(wire.read(raw).tail)
    keep = max(0, total - n)
    if total:
        wire.write_file(path, wire.repair(raw, keep)[0])
    return keep, total - keep


def compact(spark: SparkSession, path: str, out: str, key: bytes | None = None) -> tuple[int, int]:
    """Writes a container with the changes worked into its sections; sections and blocks that there were."""
    import json

    with open(path, "rb") as f:
        c = wire.read(f.read())
    options = {"key": key.hex()} if key else {}
    tables: dict[str, dict] = {}
    for r in state(spark, path, **options).collect():  # one container's state
        tables.setdefault(r.tbl, {})[r.key] = json.loads(r.value)
    changed = {r.tbl for r in replay.tables(containers(spark, path, "deltas", **options)).collect() if r.tbl is not None}
    sections = []
    for s in c.sections:
        whole = "json" in s["ct"] or s["id"] in changed
        data = c.section(s["id"], key)
        if whole and (not data.strip() or isinstance(json.loads(data), dict)):
            data = wire.dump(tables.get(s["id"], {}))
        sections.append(wire.Section(s["id"], s["ct"], s.get("name", ""), data, s.get("enc", "raw")))
    sections += [wire.Section(t, "application/json", f"{t}.json", wire.dump(tables.get(t, {}))) for t in sorted(changed - {s["id"] for s in c.sections})]
    technical = {"X-Index-Offset", "X-Index-Length", "X-EML-Version", "X-Entity-ID"}
    extra = [(k, v) for k, v in c.headers if k.startswith("X-") and k not in technical]
    subject = next((v for k, v in c.headers if k.lower() == "subject"), "")
    wire.write_file(out, wire.build(c.entity or "", subject, sections, extra, key, c.product))
    return len(sections), len(c.tail)
