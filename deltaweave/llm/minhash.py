"""Near duplicates by ProbMinHash.

Every document is the multiset of its word shingles, weighted by their counts.
Each shingle emits a Poisson process of arrivals whose rate is its weight, and
every arrival falls on a random register; a register keeps the shingle of its
first arrival. Two signatures agree in a register with a probability that is
the documents' probability Jaccard similarity (Ertl, "ProbMinHash - A Class of
Locality-Sensitive Hash Algorithms for the (Probability) Jaccard Similarity",
2020). A shingle stops as soon as its next arrival comes after the latest
first arrival of all registers, since nothing later can count.

Equal registers in any band of `rows` make two documents candidates; they are
verified over all registers. A band that many unlike documents share, as
boilerplate makes them do, is split by further registers (`_split`, and within
a task `link`), so that no bucket is compared all with all, on one task or in
all. Groups are the connected components of verified pairs, and of each the
document with the least doc_id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .frames import column, drop_ids, pick, positional, stored

U64 = X.U64
SHINGLE, REGISTERS, BANDS, ROWS, THRESHOLD = 3, 128, 24, 3, 0.5


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts and the bounds of each text. A text of fewer than k words is one shingle."""
    data = np.take(X.LOWER, data)
    starts, ends, bounds = X.spans(np.take(X.IN_WORD, data), offsets)
    words = X.span_hash(X.prefix_hash(data), starts, ends)
    n = len(words)
    size = np.diff(bounds)
    place = np.arange(n) - np.repeat(bounds[:-1], size)
    left = np.repeat(size, size) - place
    h = words.copy()
    for j in range(1, k):
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[: max(0, n - j)] = words[j:]
        nxt[left <= j] = 0
        h = X.mix(h * U64(0x9FB21C651E98DF25) + nxt)
    keep = (left >= k) | ((place == 0) & (left < k))
    h = h[keep]
    per = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(per)))
    first = X.sort_segments(h, bounds)
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, bounds)


def signatures(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """One row of m registers for each text; zeros for a text without shingles."""
    texts = len(bounds) - 1
    of = np.repeat(np.arange(texts), np.diff(bounds))
    best = np.full(texts * m, np.inf)
    sig = np.zeros(texts * m, dtype=np.uint32)
    rate = 1.0 / weight
    now = np.zeros(len(h))
    # values of 0 would look like registers of an empty text
    mark = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
    step = 0
    while len(h):
        # a few elements left: many arrivals each at once
        many = max(1, min(256, 32768 // len(h)))
        times, marks, regs, last = [], [], [], now
        for j in range(many):
            u = X.mix(h ^ X.seed_of(step + j))
            last = last - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
            times.append(last)
            regs.append(of * m + (u % U64(m)).astype(np.int64))
        step += many
        t, r = np.concatenate(times), np.concatenate(regs)
        marks = np.tile(mark, many) if many > 1 else mark
        ok = np.flatnonzero(t < best[r])
        t, r, marks = t[ok], r[ok], marks[ok]
        np.minimum.at(best, r, t)
        won = best[r] == t
        sig[r[won]] = marks[won]
        go = last < best.reshape(texts, m).max(axis=1)[of]
        h, of, rate, now, mark = h[go], of[go], rate[go], last[go], mark[go]
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), X.seed_of(b), dtype=np.uint64)
        for x in range(rows):
            h = X.mix(h * U64(0x9FB21C651E98DF25) + sig[:, (b * rows + x) % sig.shape[1]].astype(np.uint64))
        keys[:, b] = h
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int, m: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.strings(batch.column(1))
        for i, j in X.pieces(offsets):
            h, weight, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
            sig = signatures(h, weight, bounds, m)
            keys = band_keys(sig, bands, rows)
            some = np.diff(bounds) > 0
            # a copy of the signature's digest leads exact copies to one another
            digest = np.full(len(sig), X.seed_of(77), dtype=np.uint64)
            for x in range(m):
                digest = X.mix(digest * U64(0x9FB21C651E98DF25) + sig[:, x].astype(np.uint64))
            ids = batch.column(0).slice(i, j - i).filter(pa.array(some))
            sig, keys = np.ascontiguousarray(sig[some]), np.ascontiguousarray(keys[some])
            n = len(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(digest[some].view(np.int64)),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                ],
                names=["doc_id", "digest", "sig", "bands"],
            )


def _keys(sig: np.ndarray, group: int) -> np.ndarray:
    """Hashes of the group-th three registers."""
    h = np.full(len(sig), X.seed_of(88, group), dtype=np.uint64)
    for x in range(3 * group, 3 * group + 3):
        h = X.mix(h * U64(0x9FB21C651E98DF25) + sig[:, x].astype(np.uint64))
    return h


class _Sets:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The set of each of the rows."""
        r = self.root[rows]
        while (n := self.root[r]).tolist() != r.tolist():
            r = n
        self.root[rows] = r
        return r


#: Rows that are compared all with all; more are split by further registers.
FEW = 256


def link(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows which verified pairs connect, without comparing what is connected already.

    Of more rows than FEW, those are compared that agree in three more
    registers, any of 42 triples: alike ones of a similarity of 0.5 do with a
    probability of 0.996, unlike ones seldom. What is connected to the first
    row of a bucket directly goes first, so that copies cost one comparison.
    """
    least = int(np.ceil(threshold * sig.shape[1] - 1e-9))
    groups = sig.shape[1] // 3
    sets, out = _Sets(len(sig)), []

    def join(a: int, rows: np.ndarray) -> None:
        for x in rows.tolist():
            r, q = sets.find(a), sets.find(x)
            if r != q:
                out.append((a, x))
                sets.root[max(r, q)] = min(r, q)

    def all_pairs(rows: np.ndarray) -> None:
        part = sig[rows]
        for i in range(len(rows) - 1):
            mine = sets.of(rows[i:])
            other = np.flatnonzero(mine[1:] != mine[0])
            if not len(other):
                if (mine == mine[0]).all():
                    return
                continue
            other = other + i + 1
            join(int(rows[i]), rows[other[(part[other] == part[i]).sum(axis=1) >= least]])

    def lead(rows: np.ndarray) -> None:
        """Joins to the first row all that are like it."""
        mine = sets.of(rows)
        other = np.flatnonzero(mine != mine[0])
        for i in range(0, len(other), 65536):
            o = other[i : i + 65536]
            join(int(rows[0]), rows[o[(sig[rows[o]] == sig[rows[0]]).sum(axis=1) >= least]])

    def split(rows: np.ndarray, start: int) -> None:
        if len(rows) > FEW:
            lead(rows)
            if (m := sets.of(rows)).min() == m.max():
                return
        if len(rows) <= FEW or start == groups:
            all_pairs(rows)
            return
        for g in range(start, groups):
            h = _keys(sig[rows], g)
            order = np.argsort(h, kind="stable")
            cut = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            size = np.diff(np.append(cut, len(rows)))
            for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                split(np.sort(rows[order[a : a + n]]), g + 1)

    split(np.arange(len(sig)), 0)
    return out


def _verify(threshold: float, m: int):
    """Of rows (key, doc_id, sig) sorted by key, the pairs that link makes of each key's documents."""

    def pairs(keys: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(at, len(keys)))
        two = at[size == 2]
        ok = (sig[two] == sig[two + 1]).sum(axis=1) >= int(np.ceil(threshold * m - 1e-9))
        a, b = [ids[two[ok]]], [ids[two[ok] + 1]]
        for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            got = np.array(link(sig[s : s + n], threshold), dtype=np.int64).reshape(-1, 2) + s
            a.append(ids[got[:, 0]])
            b.append(ids[got[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, m), np.uint32)
        for batch in batches:
            if not len(batch):
                continue
            keys = np.append(keys, batch.column(0).to_numpy())
            ids = np.append(ids, batch.column(1).to_numpy())
            sig = np.concatenate([sig, _registers(batch.column(2), m)])
            last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
            if last:
                yield pairs(keys[:last], ids[:last], sig[:last])
                keys, ids, sig = keys[last:], ids[last:], sig[last:]
        if len(keys):
            yield pairs(keys, ids, sig)

    return f


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, old, at, doc_id) sorted by key and old, those (key, at, doc_id) whose key has two documents at least and one that isn't old."""
    held, told = None, False
    for batch in batches:
        if not len(batch):
            continue
        key, old, at, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        same = np.zeros(len(key) + 1, dtype=bool)  # same[i]: row i has the key of row i-1
        same[1:-1] = key[1:] == key[:-1]
        same[0] = held is not None and key[0] == held[0]
        first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(key))))
        aged = old[first]
        if same[0]:
            aged[: int(np.argmin(np.append(same[:-1], False)))] = held[3]
        keep = (same[:-1] | same[1:]) & ~aged
        cols = [key[keep], at[keep], ids[keep]]
        if same[0] and not told and not held[3]:
            cols = [np.append(c, h) for c, h in zip(cols, held, strict=False)]
        held, told = (key[-1], at[-1], ids[-1], aged[-1]), bool(keep[-1])
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "at", "doc_id"])


def _crowd(keyed: DataFrame) -> DataFrame:
    rows = keyed.select("key", "old", "at", "doc_id").repartition("key").sortWithinPartitions("key", "old")
    return stored(rows.mapInArrow(_crowded, "key bigint, at int, doc_id bigint"))


def _registers(col: pa.Array, m: int) -> np.ndarray:
    raw, _ = X.strings(col.cast(pa.large_binary()).view(pa.large_string()))
    return raw.copy().view(np.uint32).reshape(-1, m)


def _sub_keys(threshold: float, m: int):
    """Of rows (key, at, doc_id, sig, lead, lead_sig), (key, old, at, doc_id, lead): first whether a row is like its bucket's lead, at being -1; then its keys by each further three registers."""
    least = int(np.ceil(threshold * m - 1e-9))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig = _registers(b.column(3), m)
            old = (sig == _registers(b.column(5), m)).sum(axis=1) >= least
            key, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = [(np.full(len(b), -1, np.int32), key, np.arange(len(b)))]
            for g in range(int(at.min()), m // 3):
                r = np.flatnonzero(at <= g)
                rows.append((np.full(len(r), g + 1, np.int32), X.mix(_keys(sig[r], g) ^ key[r].view(np.uint64)).view(np.int64), r))
            for nth, k, r in rows:
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(old[r]), pa.array(nth), b.column(2).take(take), b.column(4).take(take)], names=["key", "old", "at", "doc_id", "lead"])

    return f


#: Documents of a bucket that one task compares; a larger one is split by further registers first.
HOT = 20_000


def _split(sig: DataFrame, crowded: DataFrame, threshold: float, m: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets (key, doc_id), of at most hot documents unless no register is left, and the edges found on the way.

    Each round compares the documents of the larger buckets with the first one
    of theirs, then keys all by further registers; buckets of nothing but
    documents like their first one are settled.
    """
    done, edges = None, None
    both = lambda x, y: y if x is None else x.unionByName(y)
    while True:
        big = stored(crowded.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("at")).where((F.col("n") > hot) & (F.col("at") < m // 3)).select("key"))
        if big.isEmpty():
            return both(done, crowded.select("key", "doc_id")), edges
        done = both(done, drop_ids(crowded, "key", big).select("key", "doc_id"))
        rows = crowded.join(big, "key").join(sig.select("doc_id", "sig"), "doc_id")
        lead = rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("l")).select("key", F.col("l.doc_id").alias("lead"), F.col("l.sig").alias("lead_sig"))
        keyed = stored(rows.join(lead, "key").select("key", "at", "doc_id", "sig", "lead", "lead_sig").mapInArrow(_sub_keys(threshold, m), "key bigint, old boolean, at int, doc_id bigint, lead bigint"))
        edges = both(edges, keyed.where("at = -1 and old and lead <> doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
        crowded = _crowd(keyed.where("at > 0"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, registers: int = REGISTERS, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id of all documents with words, (doc_id, kept) of every document that isn't the least of its group); both stored.

    Documents with a null doc_id take no part. Texts that are null, empty or
    without a word are never alike. Rows that repeat a doc_id are one document.
    A very long text is signed whole.
    """
    spark = docs.sparkSession
    src = pick(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")
    sign = lambda it: X.tidy(_sign(it, shingle, registers, bands, rows))
    sig = stored(src.mapInArrow(sign, "doc_id bigint, digest bigint, sig binary, bands array<bigint>"))
    # copies with one signature: the least stands for all in the bands
    lead = sig.select("digest", "doc_id").groupBy("digest").agg(F.min("doc_id").alias("lead"))
    same = stored(sig.select("digest", "doc_id").join(lead, "digest").where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct())
    alone = drop_ids(sig.select("doc_id", "sig", "bands"), "doc_id", same.select("b"))
    crowded = _crowd(alone.select(F.explode("bands").alias("key"), F.lit(False).alias("old"), F.lit(0).alias("at"), "doc_id"))
    crowded, found = _split(sig, crowded, threshold, registers, hot)
    held = alone.select("doc_id", "sig").join(crowded, "doc_id").select("key", "doc_id", "sig").repartition("key").sortWithinPartitions("key", "doc_id")
    near = held.mapInArrow(_verify(threshold, registers), "a bigint, b bigint").where("a <> b")
    near = near.distinct().unionByName(same)
    edges = stored(near if found is None else near.unionByName(found))
    return sig.select("doc_id"), components(spark, edges)


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, copies array<bigint>): each document that stays, with the sorted doc_ids of its group that go.

    A document unlike all others has an empty list. Rows with a null doc_id
    stay, each with an empty list, and so do documents without words. Rows
    that repeat a doc_id give one row. An empty table gives an empty one; other
    columns than doc_id and text don't matter.
    """
    _, gone = near_groups(docs, **params)
    ids = pick(docs, doc_id="bigint")
    lists = gone.groupBy(F.col("kept")).agg(F.array_sort(F.collect_set("doc_id")).alias("copies"))
    stay = drop_ids(ids, "doc_id", gone.select("doc_id"))
    known = stay.where("doc_id is not null").distinct().join(lists, F.col("doc_id") == F.col("kept"), "left").select("doc_id", "copies")
    out = known.unionByName(stay.where("doc_id is null").select("doc_id", F.lit(None).cast("array<bigint>").alias("copies")))
    return out.select("doc_id", F.coalesce("copies", F.array().cast("array<bigint>")).alias("copies"))


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """docs, all columns, without the documents of which a near copy with a lesser doc_id stays.

    Rows with a null doc_id and documents without words stay; rows that repeat
    a doc_id stay or go together. An empty table gives an empty one.
    """
    _, gone = near_groups(docs, **params)
    pos, names = positional(docs)
    return drop_ids(pos, column(names, "doc_id"), gone.select("doc_id")).toDF(*names)
