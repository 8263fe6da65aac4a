"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree of domains, languages and sources. At every
node it is split among the children by weight, no child getting more than its
subtree can give (its tokens times the most epochs): what a child can't give
goes to its siblings, and only what none of them can give stays with the
ancestors' other children. Each leaf then passes whole epochs of its documents
and, for what is left, the longest prefix that fits of one more epoch, in that
epoch's seeded order.

All splits are integer arithmetic in window functions over the tree's nodes. A
prefix doesn't sort its leaf: tokens are counted by 4096 ranges of the order's
hash, whole ranges before the border are taken, and only the documents of the
border's range are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import column, positional, stored

#: The domain of a source; ANSI SQL, so that other engines can check it.
DOMAIN = "case when source is null or source = '' then 'other' else 'd' || cast(ascii(right(source, 1)) % 4 as varchar(12)) end"
#: Integer weights by name for each level; 1 for other names.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
#: The budget as a percentage of all tokens, the most times that a document is used, the seed of the orders.
PERCENT, EPOCHS, SEED = 70, 3, 7


def _weight(level: str, names: dict[str, int]) -> F.Column:
    out = F.lit(1)
    for name, w in names.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def _order(epoch: F.Column, seed: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))


def _split(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, int]) -> DataFrame:
    """nodes (parent columns, level, cap, budget of the parent) with got, each node's share."""
    w = nodes.withColumn("_w", _weight(level, weights)).withColumn("_r", F.col("cap").cast("double") / F.col("_w"))
    all_ = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = all_.orderBy("_r", level)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = lambda x, n: x.cast(f"decimal({n},0)")
    w = w.withColumns({"_before": F.sum("cap").over(upto) - F.col("cap"), "_left": F.sum("_w").over(all_) - F.sum("_w").over(upto) + F.col("_w")})
    full = big(F.col("cap"), 20) * big(F.col("_left"), 12) <= big(F.col("budget") - F.col("_before"), 20) * big(F.col("_w"), 12)
    w = w.withColumn("_full", full)
    w = w.withColumns({"_spent": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(all_), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_)})
    w = w.withColumns({"_num": big(F.col("_w"), 12) * big(F.col("budget") - F.col("_spent"), 20)})
    return w.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("_num div _open"))).drop("_w", "_r", "_before", "_left", "_full", "_spent", "_open", "_num")


def budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(domain, lang, source, tokens, got): each leaf's budget, from its tokens."""
    weights = WEIGHTS if weights is None else weights
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.expr(f"sum(tokens) * {percent} div 100").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = _split(domains.join(F.broadcast(total)), [], "domain", weights.get("domain", {}))
    mid = _split(langs.join(top.select("domain", F.col("got").alias("budget")), "domain"), ["domain"], "lang", weights.get("lang", {}))
    low = leaves.join(mid.select("domain", "lang", F.col("got").alias("budget")), ["domain", "lang"])
    return _split(low, ["domain", "lang"], "source", weights.get("source", {})).select("domain", "lang", "source", "tokens", "got")


def mix(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] | None = None, domain: str = DOMAIN) -> tuple[DataFrame, list[str]]:
    """The chosen rows of docs by position, one for each epoch, with domain, lang, source, n_tokens and epoch; the columns' names.

    Tokens are words set off by white space. Null languages and sources are
    empty strings; a null text has no tokens. Documents without tokens fit
    wherever their place in the order is still within the budget, and a leaf
    without tokens passes all its documents once. Rows that repeat a doc_id, or
    have none, share a place in the order and go or stay together. A very long
    text is one document of that many tokens, and fits only where they do. An
    empty table gives an empty one.
    """
    pos, names = positional(docs)
    text = F.col(column(names, "text")).cast("string")
    leafed = pos.select(
        *pos.columns,
        F.col(column(names, "doc_id")).alias("_id"),
        F.coalesce(F.col(column(names, "lang")).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(column(names, "source")).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit("[^ \t\r\n]+")), F.lit(0)).alias("n_tokens"),
    ).withColumn("domain", F.expr(domain))
    leaf = ["domain", "lang", "source"]
    slim = stored(leafed.select("_id", *leaf, "n_tokens"))
    leaves = slim.groupBy(*leaf).agg(F.sum("n_tokens").cast("bigint").alias("tokens"))
    plan = budgets(leaves, percent, epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("got div tokens")).otherwise(F.lit(0))
    plan = stored(plan.withColumn("whole", whole).withColumn("rest", F.col("got") - F.col("whole") * F.col("tokens")))
    # the range of the order's hash that holds each leaf's border
    ranged = slim.join(plan, leaf).withColumn("range", F.substring(_order(F.col("whole") + 1, seed), 1, 3))
    ranges = ranged.groupBy(*leaf, "range", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = ranges.withColumn("upto", F.sum("t").over(upto)).where("upto > rest").groupBy(*leaf).agg(F.min("range").alias("border"), F.min_by(F.col("upto") - F.col("t"), "range").alias("before"))
    plan = stored(plan.join(border, leaf, "left").select(*leaf, "whole", "rest", F.coalesce("border", F.lit("~")).alias("border"), F.coalesce("before", F.lit(0)).alias("before")))
    placed = leafed.join(plan, leaf).withColumn("_order", _order(F.col("whole") + 1, seed)).withColumn("_range", F.substring("_order", 1, 3))
    cols = [*pos.columns, *leaf, "n_tokens", "epoch"]
    last = F.when(F.col("_range") < F.col("border"), F.col("whole") + 1).otherwise(F.col("whole"))
    sure = placed.withColumn("_last", last).where("_last > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last")))).select(*cols)
    run = Window.partitionBy(*leaf).orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.where("_range = border").withColumn("_upto", F.sum("n_tokens").over(run) + F.col("before")).where("_upto <= rest").withColumn("epoch", F.col("whole") + 1).select(*cols)
    return sure.unionByName(near), names


def mixed_ids(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch) of `mix`."""
    rows, names = mix(docs, **params)
    return rows.select(F.col(column(names, "doc_id")).alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that `mix` chooses, same columns, once for each epoch."""
    rows, names = mix(docs, **params)
    return rows.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def oracle(percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] | None = None, domain: str = DOMAIN) -> str:
    """DuckDB SQL for mixed_ids over the table documents."""
    weights = WEIGHTS if weights is None else weights

    def case(level: str) -> str:
        got = weights.get(level, {})
        return "case " + level + "".join(f" when '{k}' then {v}" for k, v in got.items()) + " else 1 end" if got else "1"

    def split(name: str, nodes: str, parent: str, level: str) -> str:
        part = f"partition by {parent}" if parent else ""
        return f"""{name}_w as (select *, {case(level)} as w from ({nodes})),
{name}_o as (select *, sum(cap) over ({part} order by cap::double / w, {level} rows unbounded preceding) - cap as before_,
  sum(w) over ({part}) - sum(w) over ({part} order by cap::double / w, {level} rows unbounded preceding) + w as left_ from {name}_w),
{name}_f as (select *, cap::hugeint * left_ <= (budget - before_)::hugeint * w as full_ from {name}_o),
{name} as (select * exclude (w, before_, left_, full_), case when full_ then cap else (w::hugeint * (budget - coalesce(sum(cap) filter (full_) over ({part}), 0))) // (sum(w) filter (not full_) over ({part})) end as got from {name}_f)"""

    return f"""with docs as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) as n_tokens from documents),
d as (select *, {domain} as domain from docs),
leaves as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {epochs} as cap from d group by all),
total as (select (sum(tokens) * {percent}) // 100 as budget from leaves),
{split("top", "select domain, sum(cap) as cap, any_value(budget) as budget from leaves, total group by domain", "", "domain")},
{split("mid", "select l.domain, l.lang, sum(l.cap) as cap, any_value(t.got) as budget from leaves l join top t using (domain) group by l.domain, l.lang", "domain", "lang")},
{split("low", "select l.*, m.got as budget from leaves l join mid m using (domain, lang)", "domain, lang", "source")},
plan as (select domain, lang, source, tokens, got, case when tokens > 0 then got // tokens else 0 end as whole from low),
ordered as (select d.*, p.whole, p.got - p.whole * p.tokens as rest, md5('{seed}:' || (p.whole + 1)::bigint::varchar || ':' || coalesce(doc_id::varchar, '')) as o from d join plan p using (domain, lang, source)),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by o range between unbounded preceding and current row) as upto from ordered)
select doc_id, domain, lang, source, n_tokens::int as n_tokens, e::bigint as epoch
from (select *, unnest(range(1, (whole + case when upto <= rest then 1 else 0 end + 1)::bigint)) as e from run)"""
