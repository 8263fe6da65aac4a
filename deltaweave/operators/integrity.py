"""Checks of containers and their block chains; each gives rows (path, entity, issue)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import signature_ok

_OUT = ["path", "entity", "issue"]


def section_issues(sections: DataFrame, containers: DataFrame) -> DataFrame:
    """Sections that overlap the one before, or lie outside the file."""
    by = Window.partitionBy("path").orderBy("section_no")
    rows = sections.select("path", "entity", "section_no", "id", "off", "len").join(containers.select("path", "size"), "path")
    rows = rows.withColumn("_end", F.coalesce(F.lag(F.col("off") + F.col("len")).over(by), F.lit(0)))
    name = F.concat(F.lit("section '"), "id", F.lit("' "))
    issues = F.array_compact(F.array(F.when(F.col("off") < F.col("_end"), F.concat(name, F.lit("overlaps the one before"))), F.when(F.col("off") + F.col("len") > F.col("size"), F.concat(name, F.lit("is out of bounds"))), F.when(F.col("off") < 1, F.concat(name, F.lit("begins too early")))))
    return rows.select("path", "entity", F.explode(issues).alias("issue"))


def base_issues(containers: DataFrame, files: DataFrame) -> DataFrame:
    """Containers whose base isn't what its hash says; files has (path, content)."""
    got = F.sha2(F.expr("substring(content, 1, cast(base_end as int))"), 256)
    rows = containers.join(files.select("path", "content"), "path")
    return rows.where(got != F.col("base_hash")).select("path", "entity", F.concat(F.lit("base hash mismatch: got "), got, F.lit(", expected "), "base_hash").alias("issue"))


def chain_issues(deltas: DataFrame, containers: DataFrame) -> DataFrame:
    """Blocks that aren't what their entry says, don't follow the writer's block before, or name another writer."""
    rows = deltas.select("path", "entity", "writer", "seq", "prev_hash", "hash", "header_writer", F.sha2("raw", 256).alias("_own")).join(containers.select("path", "base_hash"), "path")
    by = Window.partitionBy("path", "writer").orderBy("seq")
    want = F.coalesce(F.lag("_own").over(by), F.col("base_hash"))
    rows = rows.withColumn("_want", want)
    name = F.concat(F.lit("delta "), "writer", F.lit("#"), F.col("seq").cast("string"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("_own") != F.col("hash"), F.concat(name, F.lit(" hash mismatch"))),
            F.when(F.col("prev_hash").isNull(), F.concat(name, F.lit(" names no predecessor"))).when(F.col("prev_hash") != F.col("_want"), F.concat(name, F.lit(" chain break"))),
            F.when(F.col("header_writer").isNull() & (F.col("writer") != "local"), F.concat(name, F.lit(" names no writer"))).when(F.col("header_writer") != F.col("writer"), F.concat(name, F.lit(" names another writer"))),
        )
    )
    return rows.select("path", "entity", F.explode(issues).alias("issue"))


def signature_issues(deltas: DataFrame) -> DataFrame:
    """Blocks with a key and a signature that isn't that key's."""
    text = F.decode("raw", "ISO-8859-1")
    crlf, lf = F.instr(text, "\r\n\r\n"), F.instr(text, "\n\n")
    at = F.when(crlf > 0, crlf + 4).when(lf > 0, lf + 2).otherwise(F.length("raw") + 1)
    body = F.substring("raw", at, F.length("raw"))
    signed = deltas.where("pubkey is not null and sig is not null")
    return signed.where(~signature_ok("pubkey", "sig", body)).select("path", "entity", F.concat(F.lit("delta "), "writer", F.lit("#"), F.col("seq").cast("string"), F.lit(" bad signature")).alias("issue"))


def trailer_issues(containers: DataFrame, deltas: DataFrame) -> DataFrame:
    """Trailers that disagree with the blocks."""
    own = deltas.groupBy("path").agg(F.count("*").alias("_n"), F.max_by("hash", "arrival").alias("_last"))
    rows = containers.where("error is null").join(own, "path", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    issues = F.array_compact(F.array(F.when(F.col("tail_seq") != F.col("_n"), F.format_string("trailer says %d blocks of %d", "tail_seq", "_n")), F.when((F.col("_n") > 0) & (F.col("tail_hash") != "") & (F.col("tail_hash") != F.col("_last")), F.lit("trailer hash is not the last block's"))))
    return rows.select("path", "entity", F.explode(issues).alias("issue"))


def verify(containers: DataFrame, sections: DataFrame, deltas: DataFrame, files: DataFrame) -> DataFrame:
    """All issues; none for sound containers."""
    parts = [section_issues(sections, containers), base_issues(containers, files), chain_issues(deltas, containers), signature_issues(deltas), trailer_issues(containers, deltas)]
    return reduce(DataFrame.unionByName, [p.select(*_OUT) for p in parts])


def verify_path(spark, path: str) -> DataFrame:
    """All issues of a container file or a folder of them."""
    from ..sources.readers import containers

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return verify(containers(spark, path), containers(spark, path, "sections"), containers(spark, path, "deltas"), files)
