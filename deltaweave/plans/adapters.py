"""Records, change logs, graphs and documents from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.xquery import Field


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(col: str = "ts"):
    return F.unix_seconds(F.col(col).cast("timestamp"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: one tag, a device, a time, a JSON body."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("record_id"), F.col("event_type").alias("tag"), F.col("user_id").alias("device"), epoch().alias("ts"), "value", F.col("props").alias("body"))


#: Where the predicate language finds a record's headers.
RECORD_FIELDS = {"x-tag": Field("tag", "string"), "x-device-id": Field("device", "number"), "x-timestamp": Field("ts", "number"), "x-record-id": Field("record_id", "number"), "x-value": Field("value", "float")}


def with_headers(rec: DataFrame) -> DataFrame:
    """Records with all headers in one list, as files have them."""
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    return rec.withColumn("headers", F.array(pair("X-Record-ID", F.col("record_id")), pair("X-Tag", F.col("tag")), pair("X-Device-ID", F.col("device")), pair("X-Timestamp", F.col("ts"))))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: ten entities, users as writers, event types as keys; error deletes, all else sets."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("entity", "writer").orderBy("ts", "event_id")
    rows = e.select((F.col("user_id") % 10).cast("string").alias("entity"), F.col("user_id").cast("string").alias("writer"), F.lit("state").alias("tbl"), F.col("event_type").alias("key"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), F.col("value").cast("string").alias("value"), epoch().alias("ts"), F.col("event_id").alias("arrival"), "event_id", F.sha2("props", 256).alias("hash"))
    rows = rows.withColumn("seq", F.row_number().over(by).cast("bigint"))
    prev = F.lag("hash", 1, "base").over(Window.partitionBy("entity", "writer").orderBy("seq"))
    return rows.withColumns({"prev_hash": prev, "id": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as containers: subject, tags, headers."""
    d = table(spark, sf_dir, "documents")
    subject = F.substring_index("text", "\n", 1)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("entity"), subject.alias("subject"), F.array("lang", "source").alias("tags"), "text", "n_chars", F.array(pair("Subject", subject), pair("X-Tag", F.col("lang")), pair("X-Tag", F.col("source")), pair("X-Size", F.col("n_chars").cast("string"))).alias("headers"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts that they deliver, as a graph of calls."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee")).distinct().withColumn("pos", F.lit(0))
