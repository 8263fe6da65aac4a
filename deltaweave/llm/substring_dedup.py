"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text, and a chunk ends where chosen
bits of the hash are zero. The bits depend on the last WINDOW bytes only, so
borders move along with the text when something is inserted before them, and a
passage yields the same chunks in whatever document it stands (gear hashing
after Xia et al., "FastCDC", 2016). From each chunk on, as many chunks as hold
LEAST_WORDS words are digested together, and what another document with a
lesser doc_id has of these is a repeated passage: each of them stands there
whole, so chance agreements of single chunks don't add up to a passage however
large the corpus is.

Digests travel, documents don't: every batch of documents asks for its distinct
digests, and gets back those that an earlier document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .batches import Answers, numbered, runs
from .frames import column, positional

#: A border every 2**BITS bytes on average, from the highest of the hash's WINDOW lowest bits. Short chunks find short passages.
BITS, WINDOW = 5, 24
#: Bytes after which a chunk is cut in any case, as in text that only repeats a word and may have no border.
LONGEST = 256
#: Least words of the chunks that are digested together. A passage loses up to WINDOW bytes and two part chunks at its edges, so a third of the 50 words that make one.
LEAST_WORDS = 16

GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of GEAR of the last 32 bytes, each shifted by its age."""
    h = np.take(GEAR, data)
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks, and the bounds of each text. They cover every byte."""
    mask = np.uint32(((1 << BITS) - 1) << (WINDOW - BITS))
    last = np.flatnonzero(gear(data) & mask == 0)  # a chunk's last byte
    of = np.searchsorted(offsets, last, side="right") - 1
    # the hash of a text's first bytes still holds the text before
    last = last[last - offsets[of] >= WINDOW - 1]
    full = offsets[1:] > offsets[:-1]
    ends = np.union1d(last + 1, offsets[1:][full])
    starts = np.concatenate((offsets[:1], ends[:-1])) if len(ends) else ends
    more = np.maximum(ends - starts - 1, 0) // LONGEST
    if more.any():
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate((ends, np.repeat(starts, more) + nth * LONGEST)))
        starts = np.concatenate((offsets[:1], ends[:-1]))
    return starts, ends, np.searchsorted(starts, offsets)


def windows(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the chunks digested together, from each chunk of which enough words follow; the bounds of each text."""
    starts, ends, bounds = chunks(data, offsets)
    begun, _, _ = X.spans(np.take(X.NOT_SPACE, data), offsets)
    before = np.searchsorted(begun, starts)
    # the first chunk by whose end the words are there, if it is of the same text
    upto = np.append(before[1:], len(begun)) if len(starts) else before
    last = np.maximum(np.searchsorted(upto, before + least), np.arange(len(starts)))
    ok = last < np.repeat(bounds[1:], np.diff(bounds))
    s, e = starts[ok], ends[last[ok]]
    total = np.concatenate(([0], np.cumsum(ok)))
    return s, e, X.span_hash(X.prefix_hash(data), s, e).view(np.int64), total[bounds]


def _asked(least: int):
    """Of rows (doc_id, text, batch), (digest, batch, owner, several): the distinct digests of each batch, the least doc_id and if more documents of it have them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, batch in runs(rb.column(2).to_numpy()):
                part = rb.slice(a, b - a)
                ids = part.column(0).to_numpy()
                data, offsets = X.strings(part.column(1))
                h, of = [], []
                for i, j in X.pieces(offsets):
                    _, _, d, bounds = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                    h.append(d)
                    of.append(np.repeat(ids[i:j], np.diff(bounds)))
                d, of = np.concatenate(h), np.concatenate(of)
                order = np.lexsort((of, d))
                d, of = d[order], of[order]
                at = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)])
                top = np.maximum.reduceat(of, at) if len(at) else of
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(np.full(len(at), batch)), pa.array(of[at]), pa.array(top > of[at])], names=["digest", "batch", "owner", "several"])

    return f


def _passages(rows: pa.RecordBatch, at_id: int, at_text: int, found: Answers, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, begin, end, words, first) of the passages of rows, whose last column is the batch."""
    for a, b, batch in runs(rows.column(rows.num_columns - 1).to_numpy()):
        known, owners = found.of(batch)
        part = rows.slice(a, b - a)
        ids, texts = part.column(at_id).cast(pa.int64()), part.column(at_text)
        fine = (ids.is_valid().to_numpy(zero_copy_only=False)) & (texts.is_valid().to_numpy(zero_copy_only=False))
        ids = ids.fill_null(0).to_numpy()
        data, offsets = X.strings(texts)
        for i, j in X.pieces(offsets):
            raw, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            s, e, d, bounds = windows(raw, off, least)
            of = np.repeat(np.arange(i, j), np.diff(bounds))
            k = np.minimum(np.searchsorted(known, d), max(0, len(known) - 1))
            hit = np.flatnonzero((known[k] == d) & (owners[k] < ids[of]) & fine[of]) if len(known) and len(d) else np.zeros(0, np.int64)
            if not len(hit):
                continue
            s, e, of, first = s[hit], e[hit], of[hit], owners[k[hit]]
            # windows that touch are one passage; later windows of a text never end before earlier ones
            new = np.append(True, (of[1:] != of[:-1]) | (s[1:] > e[:-1]))
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            end = e[np.append(at[1:], len(e)) - 1]
            # the document that was first with most of the passage's windows
            order = np.lexsort((first, run))
            r, f = run[order], first[order]
            cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (f[1:] != f[:-1])))
            times = np.diff(np.append(cut, len(r)))
            best = np.lexsort((f[cut], -times, r[cut]))
            lead = best[np.append(True, r[cut][best][1:] != r[cut][best][:-1])]
            begun, _, _ = X.spans(np.take(X.NOT_SPACE, raw), off)
            n = np.searchsorted(begun, end) - np.searchsorted(begun, s[at])
            base = off[of[at] - i]
            yield a + of[at], s[at] - base, end - base, n, f[cut][lead]


def earlier(rows: DataFrame, key: str, text: str, least_words: int) -> Answers:
    """For each batch of rows (numbered) the digests that a document with a lesser doc_id than some of the batch's has, with the least such id."""
    slim = rows.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col("_batch").alias("batch")).where("doc_id is not null and text is not null")
    asked = slim.mapInArrow(lambda it: X.tidy(_asked(least_words)(it)), "digest bigint, batch bigint, owner bigint, several boolean")
    lead = asked.withColumn("lead", F.min("owner").over(Window.partitionBy("digest")))
    # the batch of the least holder has no use for it, unless others of that batch have it too
    batches = rows.agg(F.approx_count_distinct("_batch")).first()[0]
    return Answers.write(lead.where("several or lead < owner"), ["digest", "lead"], batches)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, begin, end, n_words int, first_doc_id): every passage of docs that a document with a lesser doc_id has.

    begin and end are bytes of the text's UTF-8. A passage is covered by
    windows of whole chunks with at least `least_words` words, each of which an
    earlier document has whole; first_doc_id is the one that is first with most
    of them. What repeats within one document only doesn't count. Rows with a
    null doc_id or text take no part; texts that are empty or of fewer words
    have no passages, very long ones are handled whole; rows that repeat a
    doc_id are one document, whose passages are given once. An empty table
    gives an empty one.
    """
    pos, names = positional(docs)
    key, text = column(names, "doc_id"), column(names, "text")
    rows = numbered(pos.select(F.col(key).cast("bigint").alias("_c0"), F.col(text).cast("string").alias("_c1")))
    found = earlier(rows, "_c0", "_c1", least_words)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row, begin, end, n, first in _passages(rb, 0, 1, found, least_words):
                ints = [pa.array(x.astype(np.int32)) for x in (begin, end, n)]
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(row)), *ints, pa.array(first)], names=["doc_id", "begin", "end", "n_words", "first_doc_id"])

    return rows.mapInArrow(lambda it: X.tidy(f(it)), "doc_id bigint, begin int, end int, n_words int, first_doc_id bigint").distinct()


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, all columns, with the passages of repeated_passages cut out of text; characters that a border splits go whole.

    Null texts, and texts of a null doc_id, stay as they are; empty ones have
    nothing to cut, and a text that is one passage becomes empty. Rows that
    repeat a doc_id are cut each in the same way. A very long text is handled
    whole. An empty table gives an empty one.
    """
    pos, names = positional(docs)
    key, text = column(names, "doc_id"), column(names, "text")
    rows = numbered(pos)
    found = earlier(rows, key, text, least_words)
    at_id, at_text = pos.columns.index(key), pos.columns.index(text)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cuts: dict[int, list[tuple[int, int]]] = {}
            for row, begin, end, *_ in _passages(rb, at_id, at_text, found, least_words):
                for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
                    cuts.setdefault(r, []).append((a, b))
            out = rb.column(at_text).to_pylist()
            for r, spans in cuts.items():
                raw, kept, at = out[r].encode(), [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                out[r] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            cols = list(rb.columns[:-1])
            cols[at_text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names[:-1])

    return rows.mapInArrow(lambda it: X.tidy(f(it)), pos.schema).toDF(*names)
