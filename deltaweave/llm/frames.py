"""Columns by position, shared files and size-checked joins, for all operators."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, shared_dir, stored

__all__ = ["column", "drop_ids", "open_shared", "pick", "positional", "release", "shared_dir", "stored"]

#: Most rows of ids that are sent to every executor; more are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns _c0, _c1, ... so that no name clashes, and the names it had."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def column(names: list[str], name: str) -> str:
    """The positional name of a column: the first of just this name, else the first that differs in case."""
    for match in (lambda x: x == name, lambda x: x.lower() == name.lower()):
        for i, x in enumerate(names):
            if match(x):
                return f"_c{i}"
    raise ValueError(f"no column {name} among {names}")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types."""
    pos, names = positional(df)
    return pos.select(*[F.col(column(names, k)).cast(t).alias(k) for k, t in types.items()])


def open_shared(path: str):
    """(file system, path) for pyarrow, for whatever file system the cluster shares."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + os.path.abspath(path))


def drop_ids(docs: DataFrame, key: str, ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows whose key is in ids (one long column, stored). Rows with a null key stay.

    Up to limit ids are sent to every executor; more are joined as Spark sees fit.
    """
    small = ids.limit(limit + 1).count() <= limit
    right = ids.toDF("_drop")
    return docs.join(F.broadcast(right) if small else right, F.col(key) == F.col("_drop"), "left_anti")
