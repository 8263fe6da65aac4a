"""Events of a bus handled by registered Python functions with state by entity.

A function takes (state, event) and returns changes [{op, table, key, value}],
op being set or del, and messages [{to, event, data}]. It is registered by the
program; code that stands in data files is never run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import wire
from ..sources.readers import messages

Handler = Callable[[dict, dict], tuple[list[dict], list[dict]]]
OUT = "entity string, path string, kind string, op string, tbl string, key string, value string, recipient string, event string"


class HandlerError(ValueError):
    """A handler gave something else than changes and messages."""


def handle(handler: Handler, state: dict, event: str, body) -> tuple[dict, list[dict], list[dict]]:
    """State after one event, with its changes and messages."""
    ops, sent = handler(dict(state), {"event": event} | (body if isinstance(body, dict) else {"data": body}))
    for o in ops:
        if o.get("op") == "set":
            state = state | {o["key"]: o.get("value")} if o.get("table", "state") == "state" else state
        elif o.get("op") == "del":
            state = {k: v for k, v in state.items() if k != o["key"]} if o.get("table", "state") == "state" else state
        else:
            raise HandlerError(f"unknown operation: {o.get('op')}")
    return state, ops, sent


def run(events: DataFrame, handlers: dict[str, Handler], initial: dict[str, dict] | None = None) -> DataFrame:
    """OUT rows of a stream of messages (path, recipient, event, body): changes (kind op) and messages (kind emit).

    Messages for an entity that has a handler are handled in the order of their
    paths; those to * go to every handler; all others are left out.
    """
    initial = initial or {}
    names = sorted(handlers)
    to = F.when(F.col("recipient") == "*", F.array(*[F.lit(n) for n in names])).otherwise(F.array("recipient"))
    mine = events.select("path", F.explode(to).alias("entity"), "event", "body").where(F.col("entity").isin(names))

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else initial.get(key[0], {})
        out = []
        for r in pd.concat(list(batches)).sort_values("path").itertuples():
            now, ops, sent = handle(handlers[key[0]], now, r.event, json.loads(r.body))
            out += [(key[0], r.path, "op", o["op"], o.get("table", "state"), o["key"], None if o["op"] == "del" else wire.dump(o.get("value")).decode(), None, None) for o in ops]
            out += [(key[0], r.path, "emit", None, None, None, wire.dump(m.get("data", {})).decode(), m["to"].strip("<> "), m["event"]) for m in sent]
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["entity", "path", "kind", "op", "tbl", "key", "value", "recipient", "event"])

    return mine.groupBy("entity").applyInPandasWithState(f, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def bus(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of a bus's messages; the query's checkpoint remembers which are done."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.msg.eml").load(folder)
    return messages(files)


def deliver(folder: str):
    """A foreachBatch function that sends the emitted messages to a bus."""

    def f(batch: DataFrame, epoch: int) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        sent = batch.where("kind = 'emit'").orderBy("entity", "path").toLocalIterator()
        for i, r in enumerate(sent):
            # the name depends on the epoch, so that a batch that runs again sends nothing twice
            wire.write_file(os.path.join(folder, f"emit_{epoch:012}_{i:08}.{r.event.translate(str.maketrans(' /:', '___'))}.msg.eml"), wire.message(r.entity, r.recipient, r.event, json.loads(r.value)), sync=False)

    return f
