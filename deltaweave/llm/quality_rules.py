"""Quality rules as robust multivariate outliers.

Each document gives a vector of transformed statistics. For every language and
source a minimum-covariance-determinant estimate of location and scatter is
found by concentration steps, and documents far from it by Mahalanobis distance
are rejected (Rousseeuw and Van Driessen, "A Fast Algorithm for the Minimum
Covariance Determinant Estimator", 1999). The steps start three times, from
medians with deviations alone, with correlations of the statistics' hyperbolic
tangents, and with the spatial sign covariance (Hubert, Rousseeuw and Verdonck,
"A Deterministic Algorithm for Robust Location and Scatter", 2012). After two
steps each, a group goes on from the start of the least determinant until its
determinant settles, and the least determinant seen gives the estimate.

A concentration step is one aggregation: the rows of a group are counted, with
their first and second moments, by buckets of their distance, and the buckets
are then summed up from the nearest outwards until they hold the wanted share
of the group. So a group may be of any size; no group is collected, sorted or
sampled. Statistics are fixed-point integers, whose sums are exact in any
order, so a run always gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import column, positional, stored

#: Statistics, each with the least standard deviation that documents are judged by; measured in these, no direction has a lesser one than 1.
STATS = {"words": 1.0, "word_length": 0.06, "symbols": 0.25, "upper": 0.25, "digits": 0.6, "variety": 0.08}
NAMES, FLOORS = list(STATS), np.array(list(STATS.values()))
P = len(NAMES)
#: Fixed-point unit of the statistics.
UNIT = 1024
#: Share of each group that the estimate rests on, buckets of squared distance to a doubling, least rows of a group that has its own estimate.
SHARE, BUCKETS, LEAST = 0.7, 16, 100
#: Starts; steps from each; steps in all, if the logarithm of the determinant still falls by SETTLED.
STARTS, FIRST, STEPS, SETTLED = 3, 2, 20, 1e-3
#: The same for the search itself, as a share of those floors: only so much that determinants exist where a statistic is constant.
RIDGE = 0.1
#: Fixed-point unit of tangents and signs.
SIGN = 512
#: Upper tail of the chi-squared distribution beyond which a document is rejected.
TAIL = 1e-4

_SYMBOL = X.byte_table(lambda b: chr(b) in "#$%&*@^~|<>{}[]\\=+_`!" if b < 128 else False)
_UPPER = X.byte_table(lambda b: 65 <= b <= 90)
_DIGIT = X.byte_table(lambda b: 48 <= b <= 57)
_START = X.byte_table(lambda b: b < 128 or b >= 192)  # the first byte of a character


def chi2_above(p: int, x: float) -> float:
    """Probability that a chi-squared variable of even p degrees exceeds x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(p: int, tail: float) -> float:
    """What a chi-squared variable of even p degrees exceeds with probability tail, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_above(p, mid) > tail else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """What the scatter of the nearest share of normal vectors is multiplied by, to be that of all."""
    return share / (1 - chi2_above(P + 2, chi2_quantile(P, 1 - share)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of P fixed-point statistics for each text."""
    inside = np.take(X.NOT_SPACE, data)
    starts, ends, bounds = X.spans(inside, offsets)
    words = np.diff(bounds).astype(float)
    h = X.span_hash(X.prefix_hash(data), starts, ends)
    first = X.sort_segments(h, bounds)
    distinct = X.segment_sum(first.astype(np.int64), bounds).astype(float)
    head = np.take(_START, data)
    chars = X.counts(head, offsets).astype(float)
    visible = X.counts(head & inside, offsets).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        return np.log(X.counts(np.take(table, data), offsets) / (chars + 100) + 0.02)

    out = np.stack(
        [
            np.log(words + 20),
            np.log((visible + 50) / (words + 10)),
            share(_SYMBOL),
            share(_UPPER),
            share(_DIGIT),
            # distinct words against their expected growth with the length
            np.log(distinct + 20) - 0.9 * np.log(words + 20),
        ],
        axis=1,
    )
    return np.rint(out * UNIT).astype(np.int32)


def _stats(batches: Iterator[pa.RecordBatch], at: int, drop: bool = False) -> Iterator[pa.RecordBatch]:
    """The columns, without the text itself if it is to be dropped, and the statistics."""
    for batch in batches:
        data, offsets = X.strings(batch.column(at))
        got = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in X.pieces(offsets)]
        x = np.concatenate(got) if got else np.zeros((0, P), np.int32)
        held = [i for i in range(batch.num_columns) if not drop or i != at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in held], *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(P)]], names=[*[batch.schema.names[i] for i in held], *[f"s{i}" for i in range(P)]])


# --- estimates


def floored(cov: np.ndarray, share: float = 1.0) -> np.ndarray:
    """cov with at least the variance of the share of the floors in any direction."""
    w, v = np.linalg.eigh(cov / np.outer(FLOORS, FLOORS))
    return (v * np.maximum(w, share**2)) @ v.T * np.outer(FLOORS, FLOORS)


def solved(mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the determinant, mean and inverse scatter."""
    cov = floored(cov, RIDGE)
    return float(np.linalg.slogdet(cov)[1]), mean, np.linalg.inv(cov)


def concentrate(buckets: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The estimate from the nearest buckets (rows, ascending) that hold the share of all rows."""
    order = np.argsort(buckets)
    upto = np.searchsorted(np.cumsum(n[order]), math.ceil(share * n.sum()))
    take = order[: upto + 1]
    total = n[take].sum()
    mean = s[take].sum(axis=0) / total / UNIT
    return solved(mean, (q[take].sum(axis=0) / total / UNIT**2 - np.outer(mean, mean)) * consistency(share))


def first_scatters(n: float, scale: np.ndarray, t: np.ndarray, tt: np.ndarray, uu: np.ndarray) -> list[np.ndarray]:
    """Scatters to start from: deviations alone, with the tangents' correlations, with the spatial signs' covariance."""
    cov = tt / n - np.outer(t, t) / n**2
    d = np.sqrt(np.maximum(np.diag(cov), 1.0))
    corr = cov / np.outer(d, d)
    np.fill_diagonal(corr, 1.0)
    return [np.outer(scale, scale) * m for m in (np.eye(P), corr, uu / n / SIGN**2 * P)]


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_KEYS = ["level", "g1", "g2"]


def _d2(mean: str = "mean", inv: str = "inv") -> str:
    """SQL for the squared Mahalanobis distance of s0.. from the arrays mean and inv (upper triangle)."""
    z = [f"(s{i} / {float(UNIT)}D - {mean}[{i}])" for i in range(P)]
    return " + ".join(f"{inv}[{k}] * {z[i]} * {z[j]} * {1.0 if i == j else 2.0}D" for k, (i, j) in enumerate(_PAIRS))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, dict[str, np.ndarray]]]:
    """Each group's key and columns, of a partition sorted by keys, whose rows are few."""
    t = pa.Table.from_batches([b for b in batches]).combine_chunks()
    if not len(t):
        return
    rows = list(zip(*[t.column(c).to_pylist() for c in keys], strict=True))
    cols = {}
    for c in t.column_names[len(keys) :]:
        x = t.column(c).combine_chunks()
        cols[c] = x.flatten().to_numpy().astype(float).reshape(len(t), -1) if pa.types.is_list(x.type) else x.to_numpy()
    at = [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]]
    for i, j in zip(at, [*at[1:], len(rows)], strict=True):
        yield list(rows[i]), {c: x[i:j] for c, x in cols.items()}


def _square(x: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper triangles."""
    q = np.zeros((*x.shape[:-1], P, P))
    for k, (i, j) in enumerate(_PAIRS):
        q[..., i, j] = q[..., j, i] = x[..., k]
    return q


def _rows(out: list[list]) -> pa.RecordBatch:
    floats = pa.list_(pa.float64())
    types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), floats, floats)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[*_KEYS, "start", "n", "logdet", "mean", "inv"])


def _estimate(share: float):
    """For each group and start, from its buckets' moments, the next estimate."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, t in _groups(batches, [*_KEYS, "start"]):
            n = t["n"].astype(float)
            logdet, mean, inv = concentrate(t["bucket"], n, t["m"], _square(t["q"]), share)
            out.append([*key, int(n.sum()), logdet, mean.tolist(), [inv[i, j] for i, j in _PAIRS]])
        yield _rows(out)

    return f


def middle(x: np.ndarray, count: np.ndarray) -> float:
    """The lower median of values x that stand count times each."""
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(count[order]), count.sum() / 2)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, from its statistics' values and their counts, the medians, and as inv the scales of their absolute deviations."""
    out = []
    for key, t in _groups(batches, _KEYS):
        mean, scale = [], []
        for i in range(P):
            m = t["stat"] == i
            x, count = t["x"][m], t["count"][m]
            mean.append(middle(x, count) / UNIT)
            scale.append(max(1.4826 * middle(np.abs(x / UNIT - mean[-1]), count), RIDGE * FLOORS[i]))
        out.append([*key, 0, int(t["count"][t["stat"] == 0].sum()), 0.0, mean, scale])
    yield _rows(out)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, from its medians, scales and the moments of tangents and signs, the estimates to start from."""
    out = []
    for key, t in _groups(batches, _KEYS):
        n, scale = float(t["n"][0]), t["inv"][0]
        for k, cov in enumerate(first_scatters(n, scale, t["t"][0], _square(t["tt"][0]), _square(t["uu"][0]))):
            logdet, mean, inv = solved(t["mean"][0], cov)
            out.append([*key, k, int(n), logdet, mean.tolist(), [inv[i, j] for i, j in _PAIRS]])
    yield _rows(out)


def _judges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimates with the inverse of the scatter that documents are judged by, whose floors are whole."""
    for b in batches:
        inv = [np.linalg.inv(floored(np.linalg.inv(_square(np.array(x))))) for x in b.column(7).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array([[float(m[i, j]) for i, j in _PAIRS] for m in inv], pa.list_(pa.float64()))], names=b.schema.names)


def _by_group(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *more)


_PARAMS = "level int, g1 string, g2 string, start int, n bigint, logdet double, mean array<double>, inv array<double>"


def _step(rows: DataFrame, now: DataFrame, share: float, buckets: int) -> DataFrame:
    """The estimates of a concentration step from those of now: n, first and second moments by group, start and bucket, then the nearest buckets'."""
    near = rows.join(now.select(*_KEYS, "start", "mean", "inv"), _KEYS).withColumn("bucket", F.expr(f"floor(log2({_d2()} + {2.0**-20!r}D) * {buckets})"))
    keys = [*_KEYS, "start", "bucket"]
    product = [f"bigint(s{i}) * s{j}" for i, j in _PAIRS]
    sums = near.groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(f"sum(s{i})").alias(f"m{i}") for i in range(P)], *[F.expr(f"sum({x})").alias(f"q{k}") for k, x in enumerate(product)])
    lists = sums.select(*keys, "n", F.array(*[f"m{i}" for i in range(P)]).alias("m"), F.array(*[f"q{k}" for k in range(len(_PAIRS))]).alias("q"))
    return _by_group(lists, "start").mapInArrow(_estimate(share), _PARAMS)


def estimates(stats: DataFrame, share: float = SHARE, steps: int = STEPS, buckets: int = BUCKETS) -> DataFrame:
    """(level, g1, g2, start, n, logdet, mean, inv): level 2 for each language and source, 1 for each language, 0 for all; stored.

    stats has lang, source and s0...
    """
    s = [f"s{i}" for i in range(P)]
    group = F.explode(F.array(F.struct(F.lit(2).alias("level"), F.col("lang").alias("g1"), F.col("source").alias("g2")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("g1"), F.lit("").alias("g2")), F.struct(F.lit(0).alias("level"), F.lit("").alias("g1"), F.lit("").alias("g2"))))
    rows = stats.select(group.alias("g"), *s).select("g.*", *s)
    # medians by histogram: exact counts of each statistic's values
    values = rows.select(*_KEYS, F.posexplode(F.array(*s)).alias("stat", "x")).groupBy(*_KEYS, "stat", "x").count()
    medians = stored(_by_group(values).mapInArrow(_medians, _PARAMS))
    z = [(F.col(f"s{i}") / float(UNIT) - F.col("mean")[i]) / F.col("inv")[i] for i in range(P)]
    length = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    fixed = lambda c: F.rint(c * float(SIGN)).cast("bigint")
    signs = rows.join(medians, _KEYS).select(*_KEYS, "n", "mean", "inv", *[fixed(F.tanh(c)).alias(f"t{i}") for i, c in enumerate(z)], *[fixed(F.coalesce(c / F.nullif(length, F.lit(0.0)), F.lit(0.0))).alias(f"u{i}") for i, c in enumerate(z)])
    product = lambda c: [F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")) for i, j in _PAIRS]
    moments = signs.groupBy(*_KEYS).agg(F.any_value("n").alias("n"), F.any_value("mean").alias("mean"), F.any_value("inv").alias("inv"), F.array(*[F.sum(f"t{i}") for i in range(P)]).alias("t"), F.array(*product("t")).alias("tt"), F.array(*product("u")).alias("uu"))
    now = stored(_by_group(moments).mapInArrow(_starts, _PARAMS))
    for _ in range(FIRST):
        now = stored(_step(rows, now, share, buckets))
    # a group goes on from its best start
    cols = ["start", "n", "logdet", "mean", "inv"]
    best = F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("b")
    now, done = stored(now.groupBy(*_KEYS).agg(best).select(*_KEYS, "b.*")), None
    for _ in range(steps - FIRST):
        new = _step(rows, now, share, buckets).select(*_KEYS, F.struct(*cols).alias("b"))
        less = F.when(F.col("b.logdet") < F.col("logdet"), F.col("b")).otherwise(F.struct(*cols))
        both = stored(now.join(new, _KEYS).select(*_KEYS, less.alias("c"), (F.col("b.logdet") < F.col("logdet") - SETTLED).alias("open")).select(*_KEYS, "c.*", "open"))
        over, now = both.where("not open").drop("open"), both.where("open").drop("open")
        done = over if done is None else done.unionByName(over)
        if now.isEmpty():
            break
    return stored((now if done is None else done.unionByName(now)).mapInArrow(_judges, _PARAMS))


def judged(docs: DataFrame, share: float = SHARE, steps: int = STEPS, buckets: int = BUCKETS, least: int = LEAST, tail: float = TAIL) -> tuple[DataFrame, list[str]]:
    """docs by position with distance2 and keep, and the columns' names.

    distance2 is the squared Mahalanobis distance from the robust estimate of
    the document's language and source. A group of fewer than `least` documents
    is judged by its language's estimate, and a language of fewer by that of
    all; where all are fewer, distance2 is null and the document kept. A
    document is rejected if it lies beyond the chi-squared quantile of `tail`,
    or has no word at all (a null, empty or blank text). A null language or
    source forms a group of its own. Repeated rows count as often as they are
    there, and equal rows get equal results. A very long text is measured whole.
    An empty table gives an empty one.
    """
    pos, names = positional(docs)
    text = column(names, "text")
    at = pos.columns.index(text)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pos.schema], *[f"s{i} int" for i in range(P)]])
    lang, source = (F.coalesce(F.col(column(names, c)).cast("string"), F.lit("\u0001")) for c in ("lang", "source"))
    group = {"lang": lang, "source": source}
    words = F.col(text).cast("string").rlike(r"[^ \t\n\r\x0B\f]")
    only = pos.where(words).select(F.col(text).cast("string").alias("_text"), lang.alias("lang"), source.alias("source"))
    stats = stored(only.mapInArrow(lambda it: X.tidy(_stats(it, 0, drop=True)), "lang string, source string, " + ", ".join(f"s{i} int" for i in range(P))))
    est = estimates(stats, share, steps, buckets)
    one = est.where("level = 1").select(F.col("g1").alias("lang"), F.col("n").alias("n1"), F.struct("mean", "inv").alias("e1"))
    top = est.where("level = 0").select(F.col("n").alias("n0"), F.struct("mean", "inv").alias("e0"))
    own = est.where("level = 2").select(F.col("g1").alias("lang"), F.col("g2").alias("source"), F.col("n").alias("n2"), F.struct("mean", "inv").alias("e2"))
    pickd = F.when(F.col("n2") >= least, F.col("e2")).when(F.col("n1") >= least, F.col("e1")).when(F.col("n0") >= least, F.col("e0"))
    judge = stored(own.join(one, "lang").join(F.broadcast(top)).select("lang", "source", pickd.alias("e")).select("lang", "source", "e.mean", "e.inv"))
    measured = pos.mapInArrow(lambda it: X.tidy(_stats(it, at)), schema).withColumns(group)
    near = measured.join(judge, ["lang", "source"], "left").withColumn("distance2", F.when(words, F.expr(_d2())))
    keep = F.coalesce(words, F.lit(False)) & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi2_quantile(P, tail))
    return near.withColumn("keep", keep), names


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, that `judged` keeps."""
    rows, names = judged(docs, **params)
    return rows.where("keep").select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def kept_with_distance(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, lang, source, distance2) of the documents that `judged` keeps."""
    rows, names = judged(docs, **params)
    return rows.where("keep").select(*[F.col(column(names, c)).alias(c) for c in ("doc_id", "lang", "source")], "distance2")
