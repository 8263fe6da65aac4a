"""Records, the store's index and virtual directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address, header_column
from ..functions.xquery import Field, QueryError, compile_query, compile_store_query

RECORD_FIELDS = {"x-tag": Field("tags", "strings"), "x-device-id": Field("device", "string"), "x-timestamp": Field("ts", "number"), "x-record-id": Field("record_id", "string")}


def query_records(records: DataFrame, query: str, fields: dict[str, Field] | None = None) -> DataFrame:
    """The records that match; hot fields are columns, all others are looked up in headers if there are any. Corrupt ones never match."""
    head = F.col("headers") if "headers" in records.columns else None
    found = compile_query(query, head, RECORD_FIELDS if fields is None else fields)
    return records.where(found & ~F.coalesce(F.col("corrupt"), F.lit(False))) if "corrupt" in records.columns else records.where(found)


def record_stats(records: DataFrame, cap: int = 512) -> DataFrame:
    """(n, bytes, corrupt): readable records, their bytes with each file counted up to cap, and the others."""
    bad = F.coalesce(F.col("corrupt"), F.lit(False)) if "corrupt" in records.columns else F.lit(False)
    return records.agg(F.count_if(~bad).alias("n"), F.coalesce(F.sum(F.when(~bad, F.least("size", F.lit(cap)))), F.lit(0)).alias("bytes"), F.count_if(bad).alias("corrupt"))


def dynamic_tags(state: DataFrame) -> DataFrame:
    """(entity, tags) from the materialised table `tags`: every key whose value isn't null."""
    return state.where("tbl = 'tags' and value is not null and value <> 'null'").groupBy("entity").agg(F.collect_set("key").alias("dynamic"))


def store_index(containers: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(path, entity, eml_type, subject, size, tags, headers), with the tags of the change log as further X-Tag headers."""
    static = F.transform(F.filter("headers", lambda h: F.lower(h["k"]) == "x-tag"), lambda h: F.trim(h["v"]))
    rows = containers.where("error is null") if "error" in containers.columns else containers
    rows = rows.withColumn("_static", static)
    rows = rows.join(dynamic_tags(state), "entity", "left") if state is not None else rows.withColumn("dynamic", F.lit(None).cast("array<string>"))
    more = F.array_except(F.coalesce("dynamic", F.array().cast("array<string>")), F.col("_static"))
    rows = rows.withColumn("_more", F.array_sort(more))
    tags = F.array_sort(F.concat("_static", "_more"))
    extra = F.transform("_more", lambda t: F.struct(F.lit("X-Tag").alias("k"), t.alias("v")))
    return rows.select("path", "entity", "eml_type", "subject", "size", tags.alias("tags"), F.concat("headers", extra).alias("headers"))


def query_store(index: DataFrame, query: str) -> DataFrame:
    return index.where(compile_store_query(query, F.col("headers")))


def directories(index: DataFrame) -> DataFrame:
    """(name, queries, contains) of the directory containers of an index."""
    pick = lambda name: F.transform(F.filter("headers", lambda h: F.lower(h["k"]) == name), lambda h: h["v"])
    return index.where("eml_type = 'System/Directory'").select("entity", pick("x-query").alias("queries"), F.transform(pick("x-contains-id"), address).alias("contains"))


def resolve(index: DataFrame, dirs: DataFrame) -> DataFrame:
    """(directory, entity, place): members of each directory, those named first, then those its queries find, by entity; none twice.

    Queries are data, so the directories are read by the driver; each distinct
    query is then one filter, and all of them share a single scan.
    """
    named = dirs.select(F.col("entity").alias("directory"), F.posexplode("contains").alias("pos", "entity")).join(index.select("entity").distinct(), "entity").select("directory", "entity", F.lit(0).alias("source"), "pos")
    found = []
    for row in dirs.select("entity", "queries").collect():  # one row a directory
        for i, q in enumerate(row.queries or []):
            try:
                found.append((row.entity, i, compile_store_query(q, F.col("headers"))))
            except QueryError:
                continue  # a malformed query finds nothing
    parts = [named]
    if found:
        hits = F.array(*[F.when(c, F.struct(F.lit(d).alias("directory"), F.lit(1 + i).alias("source"))) for d, i, c in found])
        parts.append(index.select("entity", F.explode(F.array_compact(hits)).alias("h")).select("h.directory", "entity", "h.source", F.lit(0).alias("pos")))
    every = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("directory", "entity").orderBy("source", "pos")
    order = Window.partitionBy("directory").orderBy("source", "pos", "entity")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("place", F.row_number().over(order)).select("directory", "entity", "place")


def tag_delta(tag: str, ts: int) -> dict:
    """The change that tags an entity."""
    return {"op": "set", "table": "tags", "key": tag, "value": True, "ts": ts}


def make_directory(name: str, query: str | None = None, contains: list[str] | None = None) -> bytes:
    """A directory container."""
    from ..sources.wire import build

    extra = [("X-EML-Type", "System/Directory"), *([("X-Query", query)] if query else []), *[("X-Contains-ID", f"<{c}>") for c in contains or []]]
    return build(f"{name}@system.local", f"dir: {name}", [], extra)


def tag_members(posts: DataFrame) -> DataFrame:
    """(tag, names) of posts (name, tags, ts), newest first."""
    each = posts.select(F.explode("tags").alias("tag"), F.struct(F.negative("ts").alias("t"), F.col("name")).alias("p"))
    return each.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["name"]).alias("names"))


def first_header(df: DataFrame, name: str, alias: str) -> DataFrame:
    return df.withColumn(alias, header_column(F.col("headers"), name))
