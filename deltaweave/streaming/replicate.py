"""Blocks from peers, in any order, into an ordered log.

State by entity and writer: the head of the chain and the blocks that wait for
one before them. A block that follows the head leaves with all that follow it;
one whose number is applied already counts as applied and goes; any other waits,
without limit of time.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import letter_blocks
from ..sources.wire import block_header, is_delta, sha

OUT = "entity string, writer string, seq bigint, hash string, status string, block binary"


def advance(head: tuple[int, str | None], waiting: dict[int, bytes], base_hash: str | None) -> tuple[tuple[int, str | None], list[tuple[int, str, bytes]], int]:
    """Blocks that follow the head, the new head, and the number that were there already. Takes them out of waiting."""
    out, known = [], 0
    for seq in sorted(k for k in waiting if k <= head[0]):
        waiting.pop(seq)
        known += 1
    while (block := waiting.get(head[0] + 1)) is not None:
        want = head[1] if head[0] else base_hash
        if not is_delta(block) or want is not None and block_header(block, "X-Prev-Hash") != want:
            break
        waiting.pop(head[0] + 1)
        head = (head[0] + 1, sha(block))
        out.append((head[0], head[1], block))
    return head, out, known


def addressed(rows: DataFrame, entity: str, recipient: str = "recipient") -> DataFrame:
    """The rows that are for an entity: those to it, to all, or to nobody in particular."""
    return rows.where(F.col(recipient).isNull() | F.col(recipient).isin(entity, "*"))


def pull(blocks: DataFrame, entity: str, base_hash: str | None = None) -> DataFrame:
    """OUT rows of a stream of blocks (recipient, writer, seq, block) for an entity: applied once each, in order; duplicates as known.

    Blocks for others are left out. base_hash is what a writer's first block
    must follow; None doesn't check that.
    """
    mine = addressed(blocks, entity).select(F.lit(entity).alias("entity"), "writer", "seq", "block")

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, head, held = state.get if state.exists else (0, None, "{}")
        waiting = {int(k): base64.b64decode(v) for k, v in json.loads(held).items()}
        out = []
        for pdf in batches:
            for n, b in zip(pdf["seq"], pdf["block"], strict=True):
                n = int(n)
                if n <= seq or n in waiting:
                    out.append((*key, n, None, "known", None))
                else:
                    waiting[n] = bytes(b)
        (seq, head), ready, _ = advance((seq, head), waiting, base_hash)
        out += [(*key, n, h, "applied", b) for n, h, b in ready]
        state.update((seq, head, json.dumps({k: base64.b64encode(v).decode() for k, v in waiting.items()})))
        yield pd.DataFrame(out, columns=["entity", "writer", "seq", "hash", "status", "block"])

    return mine.groupBy("entity", "writer").applyInPandasWithState(f, OUT, "seq bigint, head string, waiting string", "append", GroupStateTimeout.NoTimeout)


def bus_blocks(spark: SparkSession, bus: str, pattern: str = "*.msg.eml") -> DataFrame:
    """The stream of blocks that a bus's messages carry."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(bus)
    return letter_blocks(files)


def mail_blocks(spark: SparkSession, maildir: str) -> DataFrame:
    """The stream of blocks in a mail folder's letters, new and read; the checkpoint remembers those that are done."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(f"{maildir}/{{new,cur}}")
    return letter_blocks(files)


def append_to(path: str):
    """A foreachBatch function that appends applied blocks to a container file in order; those it has already are skipped."""

    def f(batch: DataFrame, _: int) -> None:
        from ..sources import wire

        rows = batch.where("status = 'applied'").orderBy("writer", "seq").toLocalIterator()
        with open(path, "rb") as file:
            raw = file.read()
        # read once for each batch; the blocks are appended together
        held = wire.read(raw)
        heads: dict[str, int] = {}
        new = []
        for r in rows:
            if r.seq > heads.setdefault(r.writer, wire.head(held, r.writer)[0]):
                heads[r.writer] = r.seq
                new.append((bytes(r.block), r.writer))
        wire.write_file(path, wire.append_all(raw, new))

    return f


def push(spark: SparkSession, path: str, writer: str, bus: str, to: str = "*", since: int = 0) -> int:
    """Writes a writer's blocks beyond a number to a bus, one message each; their number."""
    import os

    from ..sources import wire

    with open(path, "rb") as f:
        c = wire.read(f.read())
    os.makedirs(bus, exist_ok=True)
    mine = sorted((e for e in c.tail if e["writer"] == writer and e["seq"] > since), key=lambda e: e["seq"])
    for e in mine:
        wire.write_file(os.path.join(bus, f"sync_{writer}_{e['seq']:012}_{e['hash'][:8]}.msg.eml"), wire.sync_message(c.entity or "", to, writer, c.block(e), c.product), sync=False)
    return len(mine)


def exchange(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each of two logs lacks of the other: (for a, for b)."""
    from ..operators.replay import manifest, missing

    return missing(b, manifest(a)), missing(a, manifest(b))


def converge(logs: list[DataFrame]) -> DataFrame:
    """The log that peers agree on once each has what any of them has: every (entity, writer, seq) once."""
    from functools import reduce

    return reduce(DataFrame.unionByName, logs).dropDuplicates(["entity", "writer", "seq"])


def converge_every(stream: DataFrame, path: str, checkpoint: str, seconds: int = 10):
    """Keeps pulling a stream of applied blocks into a container file; gives the running query."""
    return stream.writeStream.foreachBatch(append_to(path)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
