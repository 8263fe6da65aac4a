"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.xquery import compile_query
from ..operators import binary, graph, integrity, linediff, replay, store
from . import adapters as A
from . import rows

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = 'X-Tag == "purchase" AND X-Timestamp >= 1704067200'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by device: the predicate language over records, then a count."""
    hits = A.records(spark, sf_dir).where(compile_query(FLAGSHIP, fields=A.RECORD_FIELDS))
    return hits.groupBy("device").agg(F.count("*").alias("n"))


def _xq(query: str) -> Query:
    return lambda s, d: A.records(s, d).where(compile_query(query, fields=A.RECORD_FIELDS)).select("record_id")


def _xq_headers(query: str) -> Query:
    return lambda s, d: A.documents(s, d).where(compile_query(query, F.col("headers"))).select("doc_id")


def _state(s: SparkSession, d: str) -> DataFrame:
    return replay.materialise(A.deltas(s, d)).select("entity", "key", "value")


def _heads(s: SparkSession, d: str) -> DataFrame:
    return replay.heads(A.deltas(s, d)).select("entity", "writer", "seq", "hash")


def _missing(s: SparkSession, d: str) -> DataFrame:
    log = A.deltas(s, d)
    known = replay.manifest(log).where("cast(writer as int) % 3 <> 0").withColumn("last_seq", F.floor(F.col("last_seq") / 2))
    return replay.missing(log, known).select("event_id")


def _rollback(s: SparkSession, d: str) -> DataFrame:
    return replay.rollback(A.deltas(s, d), 10).select("event_id")


def _compact(s: SparkSession, d: str) -> DataFrame:
    log = A.deltas(s, d)
    half = replay.compact(log.where("ts < 1705276800"))
    return replay.materialise(log.where("ts >= 1705276800"), half).select("entity", "key", "value")


def _chain_issues(s: SparkSession, d: str) -> DataFrame:
    """The chain check over a log in which every 97th event names a wrong predecessor."""
    log = A.deltas(s, d)
    raw = A.table(s, d, "events").select("event_id", F.col("props").cast("binary").alias("raw"))
    named = F.when(F.col("event_id") % 97 == 0, F.lit("bad")).otherwise(F.col("prev_hash"))
    rows = log.join(raw, "event_id").select(F.col("entity").alias("path"), "entity", "writer", "seq", named.alias("prev_hash"), "hash", F.col("writer").alias("header_writer"), "raw")
    base = log.select(F.col("entity").alias("path")).distinct().withColumn("base_hash", F.lit("base"))
    return integrity.chain_issues(rows, base).select("entity", "issue")


def _version_diff(s: SparkSession, d: str) -> DataFrame:
    a = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("listing"))
    old = a.where("cast(name as bigint) % 7 <> 0")
    new = a.where("cast(name as bigint) % 5 <> 0").withColumn("listing", F.when(F.col("name").cast("bigint") % 11 == 0, F.concat("listing", F.lit(" more"))).otherwise(F.col("listing")))
    return graph.version_diff(old, new)


def _callers(s: SparkSession, d: str) -> DataFrame:
    return graph.callers(A.supply_edges(s, d)).select("callee", F.array_join("callers", ",").alias("callers"))


def _reach(s: SparkSession, d: str) -> DataFrame:
    n = A.table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("callee"))
    c = A.table(s, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("callee"))
    return graph.reach(n.unionByName(c), "s7", 2)


def _wave(s: SparkSession, d: str) -> DataFrame:
    """A wave over orders that customers pass on: customer -> order -> part, by key."""
    o = A.table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("caller"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("callee"))
    p = A.table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee"))
    e = o.unionByName(p)
    nodes = e.select(F.col("caller").alias("name")).union(e.select("callee"))
    passed = e.select("caller", "callee", F.lit(0).alias("callee_arg"), F.lit(0).alias("caller_arg"))
    return graph.wave(nodes, passed, "p42", 0, 2).select("func", "depth")


def _cluster(s: SparkSession, d: str) -> DataFrame:
    return graph.cluster(A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("listing")), "LICENSE")


def _dir_union(s: SparkSession, d: str) -> DataFrame:
    docs = A.documents(s, d).select("entity", "headers")
    dirs = s.createDataFrame([("german", ['X-Tag == "de"'], ["3", "1", "none"]), ("large", ["X-Size >= 9000", 'X-Tag == "src3" AND X-Size > 5000'], []), ("broken", ["X-Tag"], ["5", "5"])], "entity string, queries array<string>, contains array<string>")
    return store.resolve(docs, dirs).select("directory", "entity")


def _tag_stats(s: SparkSession, d: str) -> DataFrame:
    return store.record_stats(A.table(s, d, "documents").select(F.col("n_chars").alias("size")))


def _json(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    return e.groupBy(F.get_json_object(T.json_or_empty(F.col("props")), "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


def _doc_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents as lists of lines that were added one after the other, replayed."""
    none = F.lit(None).cast("string")
    lines = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    log = lines.select("entity", F.lit("doc").alias("tbl"), F.lit("lines").alias("key"), F.lit("add").alias("op"), F.to_json(F.struct("line")).alias("value"), F.col("n").cast("bigint").alias("ts"), F.lit("w").alias("writer"), F.lit(1).alias("arrival"), F.col("n").cast("string").alias("id"), none.alias("after"))
    return replay.doc_lines(log).select(F.col("entity").cast("bigint").alias("doc_id"), "place", F.get_json_object("v", "$.line").alias("line"))


def _line_sets(s: SparkSession, d: str) -> DataFrame:
    lines = A.table(s, d, "documents").where("doc_id < 300").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("text"))
    return linediff.line_sets(lines.where("length(text) % 5 <> 0"), lines.where("length(text) % 3 <> 0"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    return e.select("event_id", T.civil_time(A.epoch()).alias("time"), T.day_time(A.epoch()).alias("day"), A.epoch().alias("seconds"))


def _escape(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select("page_id", T.escape(F.col("html")).alias("escaped"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select("page_id", T.event_name(F.col("url")).alias("event"), T.file_name(F.col("url")).alias("file"), T.address(F.concat(F.lit(" <"), F.col("url"), F.lit("> "))).alias("address"), T.safe_id(F.col("url")).alias("safe"))


def _block_entropy(s: SparkSession, d: str) -> DataFrame:
    """Byte entropy of each document's blocks of 4096 bytes."""
    files = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return binary.block_entropy(files).select("path", "block", "begin", "end", F.round("entropy", 5).alias("entropy"))


def _strings(s: SparkSession, d: str) -> DataFrame:
    files = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return binary.strings(files).groupBy("path").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def _signatures(s: SparkSession, d: str) -> DataFrame:
    types = A.table(s, d, "lineitem").where("l_linenumber <= 3").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("@b")).alias("func"), F.col("l_linenumber").alias("arg"), F.col("l_returnflag").alias("type"))
    return graph.signatures(types)


def _next_seq(s: SparkSession, d: str) -> DataFrame:
    log = A.deltas(s, d)
    new = log.where("event_id % 10 = 0").select("entity", "writer", "event_id", "ts")
    return replay.numbered(new, log.where("event_id % 10 <> 0"), ["ts", "event_id"]).select("event_id", "seq", "prev_hash")


def _ready(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the second half of a log from which every 50th is missing: applied, ready or waiting."""
    log = A.deltas(s, d)
    have, rest = log.where("ts < 1705276800"), log.where("ts >= 1704844800 and event_id % 50 <> 0")
    base = log.select("entity").distinct().withColumn("base_hash", F.lit("base"))
    return replay.applicable(rest.select("entity", "writer", "seq", "prev_hash", "hash", "event_id"), have, base).select("event_id", "status")


def _post_tags(s: SparkSession, d: str) -> DataFrame:
    docs = A.documents(s, d)
    posts = docs.select(F.col("entity").alias("name"), F.col("doc_id").alias("ts"), "tags")
    return store.tag_members(posts).select("tag", F.array_join("names", ",").alias("names"))


def _list_replay(s: SparkSession, d: str) -> DataFrame:
    """Conversations as lists to which every role adds its turns: replayed in order, one row an element."""
    c = A.table(s, d, "conversations")
    none = F.lit(None).cast("string")
    log = c.select(F.col("conv_id").cast("string").alias("entity"), F.lit("doc").alias("tbl"), F.lit("lines").alias("key"), F.lit("add").alias("op"), F.to_json(F.struct("text")).alias("value"), F.col("turn").alias("ts"), F.col("role").alias("writer"), F.col("turn").cast("int").alias("arrival"), F.concat("role", F.lit("#"), F.col("turn").cast("string")).alias("id"), none.alias("after"))
    return replay.list_values(replay.materialise(log)).select(F.col("entity").cast("bigint").alias("conv_id"), "place", "id", F.get_json_object("v", "$.text").alias("text"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select("page_id", T.is_text(F.concat("html", F.when(F.col("page_id") % 5 == 0, F.lit("\x01")).otherwise(""))).alias("is_text"))


def _canonical(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "events").select("event_id", F.get_json_object(T.json_or_empty(F.concat(F.when(F.col("event_id") % 4 == 0, "!").otherwise(""), F.col("props"))), "$.k").cast("bigint").alias("k"))


def queries() -> dict[str, Query]:
    return rows.queries() | {
        "flagship_purchases": flagship,
        "xq_and": _xq('X-Tag == "click" AND X-Value > 50'),
        "xq_or": _xq('X-Tag == "error" OR X-Tag == "signup" AND X-Device-ID <= 20'),
        "xq_not": _xq('NOT X-Tag == "view" AND X-Value >= 10'),
        "xq_range": _xq("X-Timestamp >= 1704500000 AND X-Timestamp < 1705000000"),
        "xq_numeric_eq": _xq("X-Device-ID == 007.0"),
        "xq_absent": _xq('X-Missing != "a" AND X-Tag == "view"'),
        "xq_absent_false": _xq('X-Missing == "a" OR X-Tag == "signup"'),
        "xq_ne_multi": _xq_headers('X-Tag != "en" AND X-Tag != "src1"'),
        "xq_multi_and": _xq_headers('X-Tag == "de" AND X-Tag == "src4"'),
        "xq_order_on_text": _xq_headers('X-Tag > "a" OR X-Size > 10000'),
        "subject_substring": _xq_headers('Subject >= "THe"'),
        "kv_state": _state,
        "compact_state": _compact,
        "writer_heads": _heads,
        "missing_blocks": _missing,
        "rollback_n": _rollback,
        "next_seq": _next_seq,
        "blocks_ready": _ready,
        "verify_bad_links": _chain_issues,
        "version_diff": _version_diff,
        "callers": _callers,
        "bounded_reach": _reach,
        "type_wave": _wave,
        "type_signatures": _signatures,
        "cluster_search": _cluster,
        "dir_union": _dir_union,
        "tag_members": _post_tags,
        "tag_stats": _tag_stats,
        "json_field_count": _json,
        "json_canonical": _canonical,
        "doc_lines": _doc_lines,
        "line_sets": _line_sets,
        "list_replay": _list_replay,
        "text_test": _shown,
        "civil_time": _dates,
        "html_escape": _escape,
        "safe_names": _names,
        "entropy_blocks": _block_entropy,
        "printable_strings": _strings,
    }


_D = """d as (select (user_id % 10)::varchar as entity, user_id::varchar as writer, event_type as key, case when event_type = 'error' then 'del' else 'set' end as op, value, floor(epoch(ts))::bigint as ts, event_id, sha256(props) as hash, props,
  row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as seq from events)"""
_TEXT = "case when {0} is null then null when {0} = trunc({0}) and abs({0}) < 1e7 then {0}::decimal(20,1)::varchar else {0}::varchar end"


def oracle_sql() -> dict[str, str]:
    rec = "select event_id as record_id from events where "
    secs = "floor(epoch(ts))::bigint"
    last = "select entity, key, op, value from (select *, row_number() over (partition by entity, key order by ts desc, writer desc, event_id desc) as n from d) where n = 1"
    state = f"with {_D} select entity, key, {_TEXT.format('value')} as value from ({last}) where op <> 'del'"
    esc = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    dirs = """with subj as (select doc_id::varchar as entity, lang, source, n_chars from documents)
select 'german' as directory, entity from subj where lang = 'de' or entity in ('1', '3') union all select 'large', entity from subj where n_chars >= 9000 or (source = 'src3' and n_chars > 5000) union all select 'broken', entity from subj where entity = '5'"""
    return rows.oracle_sql(_D) | {
        "flagship_purchases": f"select user_id as device, count(*) as n from events where event_type = 'purchase' and {secs} >= 1704067200 group by user_id",
        "xq_and": rec + "event_type = 'click' and value > 50",
        "xq_or": rec + "event_type = 'error' or (event_type = 'signup' and user_id <= 20)",
        "xq_not": rec + "not (event_type = 'view' and coalesce(value >= 10, false))",
        "xq_range": rec + f"{secs} >= 1704500000 and {secs} < 1705000000",
        "xq_numeric_eq": rec + "user_id = 7",
        "xq_absent": rec + "event_type = 'view'",
        "xq_absent_false": rec + "event_type = 'signup'",
        "xq_ne_multi": "select doc_id from documents where lang <> 'en' and source <> 'src1'",
        "xq_multi_and": "select doc_id from documents where lang = 'de' and source = 'src4'",
        "xq_order_on_text": "select doc_id from documents where n_chars > 10000",
        "subject_substring": "select doc_id from documents where contains(lower(split_part(text, chr(10), 1)), 'the')",
        "kv_state": state,
        "compact_state": state,
        "writer_heads": f"with {_D} select entity, writer, max(seq) as seq, arg_max(hash, seq) as hash from d group by all",
        "missing_blocks": f"with {_D}, k as (select writer, max(seq) // 2 as last_seq from d where writer::int % 3 <> 0 group by writer) select event_id from d left join k using (writer) where seq > coalesce(last_seq, 0)",
        "rollback_n": f"with {_D} select event_id from (select event_id, row_number() over (partition by entity order by event_id desc) as n from d) where n > 10",
        "next_seq": f"with {_D}, h as (select writer, max(seq) as seq, arg_max(hash, seq) as hash from d where event_id % 10 <> 0 group by writer) select event_id, coalesce(h.seq, 0) + row_number() over (partition by d.writer order by ts, event_id) as seq, case when row_number() over (partition by d.writer order by ts, event_id) = 1 then h.hash end as prev_hash from d left join h using (writer) where event_id % 10 = 0",
        "blocks_ready": f"""with {_D}, have as (select * from d where ts < 1705276800), h as (select writer, max(seq) as head from have group by writer),
b as (select d.*, coalesce(h.head, 0) as head from d left join h using (writer) where ts >= 1704844800 and event_id % 50 <> 0),
r as (select *, seq <= head as known, seq - head = row_number() over (partition by writer, seq <= head order by seq) as good from b)
select event_id, case when known then 'applied' when bool_and(good) over (partition by writer, known order by seq rows unbounded preceding) then 'ready' else 'pending' end as status from r""",
        "verify_bad_links": f"with {_D} select entity, 'delta ' || writer || '#' || seq::varchar || ' chain break' as issue from d where event_id % 97 = 0",
        "version_diff": "select doc_id::varchar as name, case when doc_id % 7 = 0 then 'added' when doc_id % 5 = 0 then 'removed' else 'changed' end as change from documents where (doc_id % 7 = 0 and doc_id % 5 <> 0) or (doc_id % 7 <> 0 and doc_id % 5 = 0) or (doc_id % 11 = 0 and doc_id % 7 <> 0 and doc_id % 5 <> 0)",
        "callers": "select 'p' || l_partkey as callee, array_to_string(list_sort(list(distinct 's' || l_suppkey)), ',') as callers from lineitem group by l_partkey",
        "bounded_reach": "select 's7' as name, 0 as depth union all select 'n' || s_nationkey, 1 from supplier where s_suppkey = 7 union all select 'r' || n_regionkey, 2 from supplier join nation on s_nationkey = n_nationkey where s_suppkey = 7",
        "type_wave": "with o as (select distinct l_orderkey from lineitem where l_partkey = 42) select 'p42' as func, 0 as depth where exists (select 1 from o) union all select 'o' || l_orderkey, 1 from o union all select distinct 'c' || o_custkey, 2 from orders where o_orderkey in (select l_orderkey from o)",
        "type_signatures": "select 'f' || l_orderkey || '(' || string_agg(l_returnflag || ' arg' || l_linenumber, ', ' order by l_linenumber, l_returnflag) || ')' as signature, 'f' || l_orderkey || '@b' as func from lineitem where l_linenumber <= 3 group by l_orderkey",
        "cluster_search": "select doc_id::varchar as name from documents where contains(lower(doc_id::varchar || ' ' || text), 'license')",
        "dir_union": dirs,
        "tag_members": "select tag, array_to_string(list(doc_id order by doc_id desc), ',') as names from (select unnest([lang, source]) as tag, doc_id from documents) group by tag",
        "tag_stats": "select count(*) as n, sum(least(n_chars, 512))::bigint as bytes, 0::bigint as corrupt from documents",
        "json_field_count": "select json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by 1",
        "json_canonical": "select event_id, case when event_id % 4 = 0 then null else json_extract_string(props, '$.k')::bigint end as k from events",
        "doc_lines": "select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as place, unnest(string_split(text, chr(10))) as line from documents",
        "line_sets": """with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as text from documents where doc_id < 300), a as (select * from l where length(text) % 5 <> 0), b as (select * from l where length(text) % 3 <> 0)
select *, 'added' as change from (select * from b except all select * from a) union all select *, 'removed' from (select * from a except all select * from b)""",
        "list_replay": "select conv_id, (row_number() over (partition by conv_id order by turn, role) - 1)::int as place, role || '#' || turn as id, text from conversations",
        "text_test": "select page_id, page_id % 5 <> 0 as is_text from pages",
        "entropy_blocks": """with b as (select doc_id, hex(encode(text)) as h from documents where length(text) > 0), y as (select doc_id, length(h) // 2 as n, h, unnest(range(length(h) // 2)) as i from b),
c as (select doc_id, n, i // 4096 as block, substr(h, 2 * i + 1, 2) as byte, count(*) as k from y group by all), t as (select *, sum(k) over (partition by doc_id, block) as total from c)
select doc_id::varchar as path, block, block * 4096 as "begin", least((block + 1) * 4096, any_value(n)) as "end", round(-sum(k / total * log2(k / total)), 5) as entropy from t group by doc_id, block""",
        "printable_strings": "select doc_id::varchar as path, count(*) as n, sum(length(s))::bigint as bytes from (select doc_id, unnest(regexp_extract_all(text, '[ -~]{6,}')) as s from documents) group by doc_id",
        "civil_time": f"select event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' as time, {secs} as seconds, 'd' || ({secs} // 86400) || strftime(ts, ' %H:%M') as day from events",
        "html_escape": f"select page_id, {esc} as escaped from pages",
        "safe_names": "select page_id, translate(url, ' /:', '___') as event, translate(url, '/\\', '__') as file, trim(' <' || url || '> ', '<> ') as address, false as safe from pages",
    }
