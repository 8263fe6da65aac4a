"""Scans of binary files: printable strings, entropy regions, runs of code pointers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, LEAST_STRING, LEAST_RUN = 4096, 6, 3
PLAIN, CODE = 4.5, 7.5
#: Blocks of a task that sorts them; a file's blocks stay together.
TASK_BLOCKS = 500_000
#: Strings, and their characters, of a batch that is handed on.
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 22
_PRINTABLE = re.compile(rb"[\x20-\x7e]{%d,}" % LEAST_STRING)


def string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """strings of batches of (path, content), in batches of BATCH_ROWS strings or, but for the last one, BATCH_CHARS characters; one file at a time is looked through."""
    schema = pa.schema([("path", pa.string()), ("off", pa.int64()), ("len", pa.int64()), ("text", pa.string())])
    out: list[list] = [[], [], [], []]
    chars = 0

    def taken() -> pa.RecordBatch:
        nonlocal out, chars
        got, out, chars = out, [[], [], [], []], 0
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, schema, strict=True)], schema=schema)

    for batch in batches:
        for p, raw in zip(batch.column(0), batch.column(1), strict=True):
            path = p.as_py()
            for m in _PRINTABLE.finditer(raw.as_buffer() or b""):
                text = m[0].decode()
                for column, x in zip(out, (path, m.start(), len(text), text), strict=True):
                    column.append(x)
                chars += len(text) + len(path or "")
                if len(out[0]) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield taken()
    if out[0]:
        yield taken()


def strings(files: DataFrame) -> DataFrame:
    """(path, off, len, text): runs of printable ASCII."""
    return files.select("path", "content").mapInArrow(string_batches, "path string, off bigint, len bigint, text string")


def entropy(block: bytes) -> float:
    n = np.bincount(np.frombuffer(block, np.uint8), minlength=256)
    p = n[n > 0] / len(block)
    return float(-(p * np.log2(p)).sum())


def block_entropy(files: DataFrame) -> DataFrame:
    """(path, block, begin, end, entropy) for each 4096 bytes."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(raw)
                out += [(p, i // BLOCK, i, min(i + BLOCK, len(raw)), entropy(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)]
            yield pd.DataFrame(out, columns=["path", "block", "begin", "end", "entropy"])

    return files.select("path", "content").mapInPandas(f, "path string, block bigint, begin bigint, end bigint, entropy double")


def spread(blocks: DataFrame, rows: int) -> DataFrame:
    """blocks by path over as many tasks as hold TASK_BLOCKS each, whatever the session's number of partitions; windows by path move nothing after that."""
    return blocks.repartition(max(-(-rows // TASK_BLOCKS), blocks.sparkSession.sparkContext.defaultParallelism), "path")


def regions(blocks: DataFrame) -> DataFrame:
    """(path, begin, end, entropy, class): neighbouring blocks of one class as one region; its value is halved with each next block's."""
    kind = F.when(F.col("entropy") < PLAIN, "plain").when(F.col("entropy") < CODE, "code").otherwise("compressed")
    by = Window.partitionBy("path").orderBy("block")
    rows = blocks.withColumn("class", kind).withColumn("_new", (~F.lag("class").over(by).eqNullSafe(F.col("class"))).cast("int")).withColumn("_run", F.sum("_new").over(by))
    # the n-th last block of a region counts 2**-n, its first one as much as the second
    back = F.row_number().over(Window.partitionBy("path", "_run").orderBy(F.desc("block")))
    weight = F.pow(F.lit(2.0), F.when(F.col("_new") == 1, F.lit(1) - back).otherwise(-back))
    rows = rows.withColumn("_part", F.col("entropy") * weight)
    return rows.groupBy("path", "_run", "class").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("_part").alias("entropy")).select("path", "begin", "end", "entropy", "class")


def pointer_runs(files: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, vaddr, n, pointers): at least three neighbouring 8-byte words of data sections that point into code.

    sections has (path, name, vaddr, off, size); code and data are told by name.
    """
    code, data = F.col("name").rlike(r"^\.(text|init|fini)"), F.col("name").rlike(r"^\.(rodata|data)") & ((F.col("name") != ".data") | (F.col("size") > 0))
    lists = sections.groupBy("path").agg(F.collect_list(F.when(code, F.struct("vaddr", "size"))).alias("code"), F.collect_list(F.when(data, F.struct("vaddr", "off", "size"))).alias("data"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, raw, text, parts in zip(pdf["path"], pdf["content"], pdf["code"], pdf["data"], strict=True):
                raw = bytes(raw)
                for s in parts:
                    n = max(0, min(s["size"], len(raw) - s["off"])) // 8
                    w = np.frombuffer(raw, "<u8", n, s["off"]) if n else np.zeros(0, "<u8")
                    hit = np.zeros(n, bool)
                    for t in text:
                        hit |= (w >= t["vaddr"]) & (w < t["vaddr"] + t["size"])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    out += [(p, int(s["vaddr"] + 8 * a), int(b - a), [int(x) for x in w[a:b].astype(np.int64)]) for a, b in edge.reshape(-1, 2) if b - a >= LEAST_RUN]
            yield pd.DataFrame(out, columns=["path", "vaddr", "n", "pointers"])

    joined = files.select("path", "content").join(lists, "path")
    return joined.mapInPandas(f, "path string, vaddr bigint, n int, pointers array<bigint>")


def shown(rows: DataFrame, order: list, limit: int, each: int | None = None, lists: str | None = None) -> DataFrame:
    """The first rows in an order, with at most `each` elements of a list column."""
    out = rows.orderBy(*order).limit(limit)
    return out if lists is None else out.withColumn(lists, F.slice(lists, 1, each))


#: Runs that are shown, and pointers of each.
TOP_RUNS, TOP_POINTERS = 10, 4


def top_pointer_runs(runs: DataFrame) -> DataFrame:
    """The longest runs with their first pointers."""
    return shown(runs, [F.desc("n"), "path", "vaddr"], TOP_RUNS, TOP_POINTERS, "pointers")
