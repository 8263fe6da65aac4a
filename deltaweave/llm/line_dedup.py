"""Line dedup through a sharded minimal perfect hash.

The distinct lines of every batch of documents are hashed to 128 bits and sent
to shards. Each shard is a minimal perfect hash (a cascade of bit arrays with
ranks, after Limasset, Rizk, Chikhi and Peterlongo, "Fast and Scalable Minimal
Perfect Hashing for Massive Key Sets", 2017) that numbers its lines without
holding them, and three arrays by number: a 32-bit fingerprint, the number of
documents with the line, and the least doc_id that has it. The batches' lines
probe these arrays where the shard is; only the lines to drop go back, by
batch, and the documents are rewritten where they are. No text is moved or
joined, and the way is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .batches import Answers, numbered, runs
from .frames import column, positional, stored

U64 = X.U64
#: Documents with a line from which on it stays in the first of them only.
MIN_DOCS = 6
#: Lines that are routed to a shard, about.
SHARD_LINES = 250_000
GAMMA = 2.0


# --- minimal perfect hash


class MinimalPerfectHash:
    """Numbers n distinct 128-bit keys, rows of two words, from 0 to n-1 in about four bits a key."""

    def __init__(self, bits: list[np.ndarray], sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.ranks, self.base, at = [], [], 0
        for b in bits:
            rank = np.concatenate(([0], np.cumsum(np.bitwise_count(b).astype(np.int64))))
            self.ranks.append(rank)
            self.base.append(at)
            at += int(rank[-1])

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = X.mix(X.mix(keys[:, 0] ^ X.seed_of(501, level)) + keys[:, 1])
        return ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        bits, sizes = [], []
        while len(keys):
            if len(bits) == 1000:
                raise ValueError("keys repeat")
            size = max(64, int(len(keys) * GAMMA + 63) // 64 * 64)
            at = cls.slot(keys, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(bits, sizes)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for a key that isn't held."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (b, size) in enumerate(zip(self.bits, self.sizes, strict=True)):
            if not len(open_):
                break
            at = self.slot(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            w = b[word]
            hit = (w >> bit) & U64(1) == 1
            below = np.bitwise_count(w[hit] & ((U64(1) << bit[hit]) - U64(1))).astype(np.int64)
            out[open_[hit]] = self.base[level] + self.ranks[level][word[hit]] + below
            open_ = open_[~hit]
        return out

    def size(self) -> int:
        """Bytes of the bit arrays."""
        return sum(b.nbytes for b in self.bits)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (X.mix(keys[:, 1] ^ X.seed_of(502)) >> U64(32)).astype(np.uint32)


class Shard:
    """The arrays of one shard, probed by line hash."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, owners: np.ndarray):
        self.index = MinimalPerfectHash.build(keys)
        at = self.index(keys)
        self.prints, self.docs, self.owners = (np.empty(len(keys), t) for t in (np.uint32, np.uint32, np.int64))
        self.prints[at], self.docs[at], self.owners[at] = fingerprint(keys), np.minimum(docs, 2**32 - 1), owners

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and owner of each line; 0 documents if the fingerprint says that the line isn't held."""
        at = self.index(keys)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == fingerprint(keys[ok])
        docs, owners = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        docs[ok], owners[ok] = self.docs[at[ok]], self.owners[at[ok]]
        return docs, owners


# --- lines


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
    """Starts, ends and hashes of all lines, and the bounds of each text. Every text has a line at least; a blank line has no hash."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
    owner_of_cut = np.searchsorted(offsets, cut, side="right") - 1
    per = np.bincount(owner_of_cut, minlength=len(offsets) - 1) + 1
    bounds = np.concatenate(([0], np.cumsum(per)))
    # an empty text's start equals its successor's, and a final newline's the next text's: sort keeps both, in order
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = offsets[1:]
    visible = np.concatenate(([0], np.cumsum(np.take(X.NOT_SPACE, data))))
    shown = visible[ends] > visible[starts]
    raw = memoryview(np.ascontiguousarray(data))
    h = [blake2b(raw[a:b], digest_size=16).digest() if s else None for a, b, s in zip(starts.tolist(), ends.tolist(), shown.tolist(), strict=True)]
    return starts, ends, h, bounds


def rewrite(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, bounds: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without the dropped lines and the newlines that set them off."""
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))
    begin = starts - (place > 0)  # each line with the newline before it
    mask = np.repeat(~drop, np.diff(np.append(begin, len(data))))
    kept = np.flatnonzero(~drop)
    text = np.searchsorted(bounds, kept, side="right") - 1
    lead = np.append(True, text[1:] != text[:-1]) if len(kept) else np.zeros(0, bool)
    lead &= place[kept] > 0
    mask[begin[kept[lead]]] = False
    total = np.concatenate(([0], np.cumsum(mask)))
    return data[mask], total[offsets]


def words(h: list[bytes]) -> np.ndarray:
    """Hashes as rows of two words."""
    return np.frombuffer(b"".join(h), np.uint64).reshape(-1, 2)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text, batch), (h1, h2, batch, n, owner): each batch's distinct lines, the rows that have them and the least doc_id of these."""
    for rb in batches:
        for a, b, batch in runs(rb.column(2).to_numpy()):
            part = rb.slice(a, b - a)
            ids = part.column(0).to_numpy().tolist()
            data, offsets = X.strings(part.column(1))
            n: dict[bytes, int] = {}
            own: dict[bytes, int] = {}
            for i, j in X.pieces(offsets):
                _, _, h, bounds = lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, d in enumerate(ids[i:j]):
                    for x in set(h[bounds[k] : bounds[k + 1]]):
                        n[x] = n.get(x, 0) + 1
                        if d <= own.get(x, d):
                            own[x] = d
            n.pop(None, None)
            h2 = words(list(n)).view(np.int64)
            cols = (h2[:, 0], h2[:, 1], np.full(len(h2), batch), np.fromiter(n.values(), np.int64, len(n)), np.fromiter((own[x] for x in n), np.int64, len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h1", "h2", "batch", "n", "owner"])


def _probed(min_docs: int):
    """Of rows (shard, h1, h2, batch, n, owner) sorted by these, (batch, h1, h2, owner): the lines of each batch that min_docs rows have in all."""

    def answers(t: pa.Table) -> pa.RecordBatch:
        keys = np.stack([t.column(c).to_numpy() for c in ("h1", "h2")], axis=1).view(np.uint64)
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        shard = Shard(keys[at], np.add.reduceat(t.column("n").to_numpy(), at), np.minimum.reduceat(t.column("owner").to_numpy(), at))
        docs, owners = shard.probe(keys)
        ok = docs >= min_docs
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[ok])) for x in (t.column("batch").to_numpy(), keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), owners)], names=["batch", "h1", "h2", "owner"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for x, y, shard in runs(b.column(0).to_numpy()):
                if held and held[-1].column(0)[0].as_py() != shard:
                    yield answers(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield answers(pa.Table.from_batches(held))

    return f


def _rewrite(batches: Iterator[pa.RecordBatch], at_id: int, at_text: int, found: Answers) -> Iterator[pa.RecordBatch]:
    batch, owners = None, {}
    for rb in batches:
        for a, b, now in runs(rb.column(rb.num_columns - 1).to_numpy()):
            if now != batch:
                h1, h2, own = found.of(now)
                raw = np.stack([h1, h2], axis=1).tobytes()
                batch, owners = now, {raw[16 * i : 16 * i + 16]: o for i, o in enumerate(own.tolist())}
            rows = rb.slice(a, b - a)
            _, sizes = X.strings(rows.column(at_text))
            for i, j in X.pieces(sizes):
                part = rows.slice(i, j - i)
                ids = part.column(at_id).cast(pa.int64()).to_pylist()
                null_text = part.column(at_text).is_null().to_numpy(zero_copy_only=False)
                data, offsets = X.strings(part.column(at_text))
                starts, _, h, bounds = lines(data, offsets)
                size = np.diff(bounds)
                drop = np.zeros(len(h), bool)
                for k, (x, y, d) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), ids, strict=True)):
                    if d is not None and not null_text[k]:
                        drop[x:y] = [owners.get(z, d) != d for z in h[x:y]]
                out, new = rewrite(data, offsets, starts, bounds, drop)
                cols = list(part.columns[:-1])
                cols[at_text] = X.to_strings(out, new, null_text)
                dropped = X.segment_sum(drop.astype(np.int64), bounds).astype(np.int32)
                total = np.where(null_text, 0, size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(dropped)], names=[*part.schema.names[:-1], "n_lines", "n_dropped"])


def repeated_lines(rows: DataFrame, min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES) -> Answers:
    """For each batch of rows (doc_id bigint, text, batch bigint; no nulls) the lines that min_docs rows have, with the least doc_id."""
    asked = stored(rows.mapInArrow(lambda it: X.tidy(_asked(it)), "h1 bigint, h2 bigint, batch bigint, n bigint, owner bigint"))
    n, batches = asked.agg(F.count("*"), F.approx_count_distinct("batch")).first()
    shards = max(1, -(-n // shard_lines))
    shard = F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int").alias("shard")
    routed = asked.select(shard, "*").repartition(shards, "shard").sortWithinPartitions("shard", "h1", "h2")
    return Answers.write(routed.mapInArrow(_probed(min_docs), "batch bigint, h1 bigint, h2 bigint, owner bigint"), ["h1", "h2", "owner"], batches)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES) -> DataFrame:
    """docs, all columns, with text rewritten and two more columns, n_lines and n_dropped (int).

    A line that min_docs rows or more have stays only where the doc_id is the
    least of theirs, there as often as it was; elsewhere it goes, with the
    newline that set it off. Lines are compared byte for byte, by 128-bit
    digests; blank lines never go. A document that loses all lines has an empty
    text. Rows with a null doc_id are neither counted nor changed. A null text
    stays null and has 0 lines; an empty one has 1. Rows that repeat a doc_id
    count each, and keep or lose the same lines. A very long text is handled
    whole, in one task. An empty table gives an empty one.
    """
    pos, names = positional(docs)
    key, text = column(names, "doc_id"), column(names, "text")
    at_id, at_text = pos.columns.index(key), pos.columns.index(text)
    rows = numbered(pos)
    slim = rows.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col("_batch").alias("batch")).where("doc_id is not null and text is not null")
    found = repeated_lines(slim, min_docs, shard_lines)
    out = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pos.schema], "n_lines int", "n_dropped int"])
    return rows.mapInArrow(lambda it: X.tidy(_rewrite(it, at_id, at_text, found)), out).toDF(*names, "n_lines", "n_dropped")


def strip_repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """docs, same columns, after dedup_lines; n_chars, where there is one, counts the new text's characters.

    A document that loses every line goes, as all of it stands in others.
    """
    done = dedup_lines(docs, **params)
    pos, names = positional(done)
    text = F.col(column(names, "text"))
    left = (F.col(pos.columns[-1]) == 0) | (F.length(text) > 0)
    cols = [F.length(text).cast("bigint").alias(c) if n == "n_chars" else F.col(c) for c, n in zip(pos.columns[:-2], names, strict=False)]
    return pos.where(left).select(*cols).toDF(*docs.columns)
