"""Pages of a site and files of a static-site generator from posts (name, title, ts, tags, body)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import civil_date, civil_time, escape, markdown_html
from .store import tag_members

_STYLE = "body{max-width:44rem;margin:auto;font-family:sans-serif}pre{overflow-x:auto}"


def _page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{_STYLE}</style></head><body>"), body, F.lit("</body></html>"))


def _tag_links(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit('<a href="../tags.html">#'), escape(t), F.lit("</a>"))), " ")


def pages(posts: DataFrame) -> DataFrame:
    """(file, html) of the index, the page of tags and every post."""
    date = F.when(F.col("ts") > 0, civil_time(F.col("ts"))).otherwise(F.lit("?"))
    link = F.concat(F.lit('<a href="post/'), "name", F.lit('.html">'), escape(F.col("title")), F.lit("</a>"))
    items = posts.select(F.struct(F.negative("ts").alias("t"), "name", F.concat(F.lit("<li>"), link, F.lit(" <small>("), date, F.lit(")</small> "), _tag_links(F.col("tags")), F.lit("</li>")).alias("li")).alias("i"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["li"]), "")
    index = items.agg(listed.alias("_l")).select(F.lit("index.html").alias("file"), _page(F.lit("Index"), F.concat(F.lit("<h1>Posts</h1><ul>"), "_l", F.lit("</ul>"))).alias("html"))
    members = tag_members(posts).select("tag", F.posexplode("names").alias("pos", "name")).join(posts.select("name", "title"), "name")
    line = F.concat(F.lit('<li><a href="post/'), escape(F.col("name")), F.lit('.html">'), escape(F.col("title")), F.lit("</a></li>"))
    by_tag = members.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("li")))), lambda x: x["li"]), "").alias("_l"))
    part = F.concat(F.lit('<h2 id="'), escape(F.col("tag")), F.lit('">'), escape(F.col("tag")), F.lit("</h2><ul>"), "_l", F.lit("</ul>"))
    tags = by_tag.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", part.alias("h")))), lambda x: x["h"]), "").alias("_l")).select(F.lit("tags.html").alias("file"), _page(F.lit("Tags"), F.col("_l")).alias("html"))
    body = F.concat(F.lit("<h1>"), escape(F.col("title")), F.lit("</h1><p><small>"), civil_time(F.col("ts")), F.lit(" "), _tag_links(F.col("tags")), F.lit("</small></p>"), markdown_html("body"), F.lit('<p><a href="../index.html">index</a></p>'))
    single = posts.select(F.concat(F.lit("post/"), "name", F.lit(".html")).alias("file"), _page(F.col("title"), body).alias("html"))
    return index.unionByName(tags).unionByName(single)


def front_matter(posts: DataFrame) -> DataFrame:
    """(file, text): posts as markdown with title, date and tags in front."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("    - "), quote(t))), "\n")
    text = F.concat(F.lit("---\ntitle: "), quote(F.col("title")), F.lit("\ndate: "), civil_date(F.greatest("ts", F.lit(0))), F.lit("\ntags:\n"), tags, F.lit("\n---\n\n"), "body")
    return posts.select(F.concat(F.lit("posts/"), "name", F.lit(".md")).alias("file"), F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n"))).alias("text"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (file, text) rows below a folder that all executors share; the number of rows."""
    name = rows.columns[1]

    def f(part) -> None:
        for r in part:
            path = os.path.normpath(os.path.join(folder, r["file"]))
            if not path.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError(f"unsafe path: {r['file']}")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as out:
                out.write(r[name])

    n = rows.count()
    rows.foreachPartition(f)
    return n
