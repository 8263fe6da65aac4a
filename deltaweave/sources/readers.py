"""Python data sources, and tables of wire files.

    spark.dataSource.register(RecordSource)
    spark.read.format("weave_records").load(folder)

Records are read up to their first 4096 bytes only, and in partitions of many
files. A filter on path opens that file only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import find_blank, header, mime, parse_headers
from . import wire

HEADERS = "array<struct<k:string,v:string>>"
RECORDS = f"path string, record_id string, tags array<string>, device string, ts bigint, headers {HEADERS}, size bigint, corrupt boolean"
FILES_A_TASK = 256


@dataclass
class Files(InputPartition):
    paths: list[str]


def _eml(folder: str) -> list[str]:
    return sorted(e.path for e in os.scandir(folder) if e.name.endswith(".eml") and e.is_file())


def _batches(paths: list[str], n: int) -> list[Files]:
    return [Files(paths[i : i + n]) for i in range(0, len(paths), n)] or [Files([])]


def record_row(path: str, limit: int = wire.RECORD_LIMIT) -> tuple:
    """A row of RECORDS from a file's first bytes."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        raw = f.read(limit)
    blank = find_blank(raw)
    if blank is None:
        return path, None, [], None, None, [], size, True
    h = parse_headers(raw[: blank[0]])
    ts = header(h, "X-Timestamp")
    return path, header(h, "X-Record-ID"), [v for k, v in h if k.lower() == "x-tag"], header(h, "X-Device-ID"), int(ts) if ts and ts.lstrip("-").isdigit() else None, h, size, False


class _RecordReader(DataSourceReader):
    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task, self.only = folder, per_task, None

    def partitions(self) -> list[Files]:
        return _batches([p for p in _eml(self.folder) if self.only in (None, p)], self.per_task)

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            yield record_row(p)


class _PushingReader(_RecordReader):
    """Opens one file only where the path is given; for sessions that push filters down to Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            yield f  # checked again by Spark


class _RecordWriter(DataSourceWriter):
    def __init__(self, folder: str, product: str):
        self.folder, self.product = folder, product

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import json

        for r in rows:
            d = r.asDict()
            wire.insert_record(self.folder, d["record_id"], list(d.get("tags") or []), d.get("device") or "", int(d.get("ts") or 0), json.loads(d.get("body") or "{}"), self.product)
        return WriterCommitMessage()


class RecordSource(DataSource):
    """A flat folder of records; writing inserts one file a row, the last of an id winning."""

    @classmethod
    def name(cls) -> str:
        return "weave_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown", "false") == "true" else _RecordReader
        return kind(self.options["path"], int(self.options.get("filesPerTask", FILES_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options["path"], self.options.get("product", wire.PRODUCT))


CONTAINERS = f"path string, entity string, eml_type string, subject string, size bigint, headers {HEADERS}, base_hash string, base_end bigint, tail_seq bigint, tail_hash string, tail_off bigint, error string"
SECTIONS = "path string, entity string, section_no int, id string, ct string, name string, off bigint, len bigint, enc string, payload binary"
DELTAS = "path string, entity string, writer string, seq bigint, arrival int, prev_hash string, hash string, op string, tbl string, key string, value string, ts bigint, id string, after string, enc string, pubkey string, sig string, header_writer string, raw binary"


def _container_rows(path: str, part: str, key: bytes | None) -> Iterator[tuple]:
    with open(path, "rb") as f:
        raw = f.read()
    try:
        c = wire.read(raw)
    except (ValueError, KeyError, TypeError) as e:
        if part == "containers":
            yield path, None, None, None, len(raw), [], None, None, None, None, None, str(e)
        return
    if part == "containers":
        get = lambda n: header(c.headers, n)
        yield path, c.entity, get("X-EML-Type") or "", get("Subject") or "", len(raw), c.headers, c.base_hash, c.base_end, c.tail_seq, c.tail_hash, c.tail_off, None
    elif part == "sections":
        for i, s in enumerate(c.sections):
            yield path, c.entity, i, s["id"], s.get("ct"), s.get("name", ""), s["off"], s["len"], s.get("enc", "raw"), raw[s["off"] : s["off"] + s["len"]]
    else:
        for i, e in enumerate(c.tail):
            yield (path, c.entity, e["writer"], e["seq"], i, *_delta_columns(c.block(e), e["hash"], key))


def _delta_columns(block: bytes, hash: str, key: bytes | None) -> tuple:
    get = lambda n: wire.block_header(block, n)
    enc = get("X-Encoding") or "raw"
    try:
        d = wire.parse_delta(block, key) or {}
    except ValueError:
        d = {}
    value = wire.dump(d["value"]).decode() if "value" in d else None
    return get("X-Prev-Hash"), hash, d.get("op"), d.get("table"), d.get("key"), value, d.get("ts"), d.get("id"), d.get("after"), enc, get("X-Writer-Key"), get("X-Signature"), get("X-Writer-ID"), block


class _ContainerReader(DataSourceReader):
    def __init__(self, folder: str, part: str, per_task: int, key: bytes | None):
        self.folder, self.part, self.per_task, self.key = folder, part, per_task, key

    def partitions(self) -> list[Files]:
        return _batches([self.folder] if os.path.isfile(self.folder) else _eml(self.folder), self.per_task)

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            yield from _container_rows(p, self.part, self.key)


class ContainerSource(DataSource):
    """A container or a flat folder of them, as table: containers (the default), sections or deltas."""

    @classmethod
    def name(cls) -> str:
        return "weave_containers"

    def schema(self) -> str:
        return {"containers": CONTAINERS, "sections": SECTIONS, "deltas": DELTAS}[self.options.get("table", "containers")]

    def reader(self, schema: StructType) -> DataSourceReader:
        from ..functions.codec import key_from

        return _ContainerReader(self.options["path"], self.options.get("table", "containers"), int(self.options.get("filesPerTask", FILES_A_TASK)), key_from(self.options.get("key"), self.options.get("passphrase")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
    spark.dataSource.register(ContainerSource)


def records(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("weave_records").option("pushdown", push).load(folder)


def containers(spark: SparkSession, path: str, table: str = "containers", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("weave_containers").options(table=table, **options).load(path)


# --- directories, letters, messages


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, ct, payload) of all files below it."""
    root = "file:" + os.path.abspath(folder) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(root), F.lit(""))
    return files.select(rel.alias("id"), mime(rel).alias("ct"), F.col("content").alias("payload"))


def pack(folder: str, entity: str, subject: str = "pack", product: str = wire.PRODUCT) -> bytes:
    """A container with a section for each file below a folder."""
    from ..functions.text import mime_of

    sections = []
    for at, dirs, names in os.walk(folder):
        dirs.sort()
        for n in sorted(names):
            path = os.path.join(at, n)
            with open(path, "rb") as f:
                sections.append(wire.Section(os.path.relpath(path, folder).replace(os.sep, "/"), mime_of(n), n, f.read()))
    if not sections:
        raise wire.WireError("nothing to pack")
    return wire.build(entity, subject, sections, product=product)


def unpack(raw: bytes, folder: str, key: bytes | None = None) -> int:
    """Writes a container's sections as files below a folder; no file if any section's name leads out of it."""
    c = wire.read(raw)
    for s in c.sections:
        if os.path.isabs(s["id"]) or ".." in s["id"].replace("\\", "/").split("/") or not s["id"]:
            raise wire.WireError(f"unsafe path: {s['id']}")
    for s in c.sections:
        path = os.path.join(folder, s["id"])
        os.makedirs(os.path.dirname(path) or folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(c.section(s["id"], key))
    return len(c.sections)


BLOCKS = "path string, recipient string, writer string, seq bigint, block binary"


def letter_blocks(files: DataFrame) -> DataFrame:
    """BLOCKS of files (path, content) that are letters or sync messages; nothing of others. Letters have no recipient."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(raw)
                try:
                    if b"multipart/" in raw[: (find_blank(raw) or (0, 0))[0]]:
                        out += [(path, None, w, s, b) for w, s, b in wire.open_letter(raw)]
                    elif (got := wire.open_sync(raw)) is not None:
                        out.append((path, *got))
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["path", "recipient", "writer", "seq", "block"])

    return files.select("path", "content").mapInPandas(f, BLOCKS)


MESSAGES = "path string, sender string, recipient string, event string, body string"


def messages(files: DataFrame) -> DataFrame:
    """MESSAGES of files (path, content); a body that isn't JSON counts as {}."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    m = wire.parse_message(bytes(raw))
                except ValueError:
                    continue
                out.append((path, m["sender"], m["to"], m["event"], wire.dump(m["body"]).decode()))
            yield pd.DataFrame(out, columns=["path", "sender", "recipient", "event", "body"])

    return files.select("path", "content").mapInPandas(f, MESSAGES)


def pending(spark: SparkSession, bus: str) -> DataFrame:
    """Messages of a bus that aren't done, in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.msg.eml").load(bus)
    return messages(files).orderBy("path")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, title, ts, tags, body) of a folder of posts, newest first. Tags are those of the first tag header, set off by commas."""
    from ..functions.codec import decoded
    from ..functions.text import header_column

    c = containers(spark, folder).where("error is null")
    name = F.regexp_extract("path", r"([^/]+)\.eml$", 1)
    body = containers(spark, folder, "sections").where("id = 'body'").groupBy("path").agg(F.min_by(F.struct("enc", "payload"), "section_no").alias("b")).select("path", F.decode(decoded(F.col("b.enc"), F.col("b.payload")), "UTF-8").alias("body"))
    ts = F.trim(header_column(F.col("headers"), "X-Timestamp")).try_cast("bigint")
    tags = F.transform(F.split(header_column(F.col("headers"), "X-Tag"), ","), lambda t: F.trim(t))
    rows = c.select("path", name.alias("name"), F.coalesce(header_column(F.col("headers"), "Subject"), name).alias("title"), F.coalesce(ts, F.lit(0)).cast("bigint").alias("ts"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    return rows.join(body, "path", "left").select("name", "title", "ts", "tags", F.coalesce("body", F.lit("")).alias("body")).orderBy(F.desc("ts"), "name")
