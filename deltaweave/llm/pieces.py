"""SentencePiece encoding and decoding that keeps every piece's place in the source.

The normaliser goes through the model's compiled character map: at each place
the longest prefix that the map's double-array trie holds is replaced, any other
character copied, and each byte of the normalised text records the source bytes
that it came from. Pieces are then projected through that record to byte spans
of the original text, and decoding gives the normalised text back.

Pieces never reach across the border between a character and a following
space mark (the model says whether that holds; if it doesn't, texts are encoded
whole). So a text is cut into words with their leading marks, every distinct
word is encoded once by the sentencepiece library, and the pieces of all texts
are gathered by array operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import column, positional

#: The model file; read by each worker, so it must be at this place on all of them.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose pieces a worker remembers; beyond, it starts to remember anew.
REMEMBER = 100_000
MARK = "▁"


class CharsMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]
        self._starts = self._pairs() if blob else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] that the map holds."""
        units, node, found, size = self.units, 0, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                size, found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return size, self.pool[found : self.pool.index(b"\0", found)]

    def _step(self, node: int, byte: int) -> tuple[int, bool] | None:
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6)), bool(unit >> 8 & 1)

    def _pairs(self) -> np.ndarray:
        """Whether a prefix of the map may begin with these two bytes; column 256: with the first alone."""
        out = np.zeros((256, 257), dtype=bool)
        unit = self.units[0]
        root = (unit >> 10) << ((unit & 512) >> 6)
        for a in range(1, 256):
            if one := self._step(root, a):
                out[a, :] = one[1]
                for b in range(1, 256):
                    out[a, b] |= self._step(one[0], b) is not None
        return out

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where a replacement may begin."""
        nxt = np.full(len(data), 256, dtype=np.int64)
        nxt[:-1] = data[1:]
        nxt[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = 256
        return np.flatnonzero(self._starts[data, nxt])


class Spec:
    """What the model's file says about normalising."""

    def __init__(self, charsmap: bytes = b"", dummy: bool = True, squeeze: bool = False, escape: bool = True):
        self.map = CharsMap(charsmap) if charsmap else None
        self.dummy, self.squeeze, self.escape = dummy, squeeze, escape


def normalise(data: np.ndarray, offsets: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets, and for each byte the start and end of its source."""
    out, begin, end, off = data, np.arange(len(data)), np.arange(1, len(data) + 1), offsets
    if spec.map is not None:
        out, begin, end, off = _replace(data, offsets, spec.map)
    if spec.squeeze:
        space = out == 32
        lead = np.zeros(len(out), bool)
        lead[1:] = space[:-1]
        lead[off[:-1][off[:-1] < len(out)]] = True
        keep = ~(space & lead)
        total = np.concatenate(([0], np.cumsum(keep)))
        out, begin, end, off = out[keep], begin[keep], end[keep], total[off]
        tail = off[1:] - 1
        ends_in_space = (off[1:] > off[:-1]) & (out[np.maximum(tail, 0)] == 32 if len(out) else False)
        keep = np.ones(len(out), bool)
        keep[tail[ends_in_space]] = False
        total = np.concatenate(([0], np.cumsum(keep)))
        out, begin, end, off = out[keep], begin[keep], end[keep], total[off]
    if spec.dummy:
        full = np.flatnonzero(off[1:] > off[:-1])
        at = off[:-1][full]
        src = begin[at] if len(at) else at
        out, begin, end = np.insert(out, at, 32), np.insert(begin, at, src), np.insert(end, at, src)
        grown = np.zeros(len(off), np.int64)
        grown[full + 1] = 1
        off = off + np.cumsum(grown)
    if spec.escape:
        space = out == 32
        times = np.where(space, 3, 1)
        where = np.cumsum(times) - times
        off = np.append(where, times.sum())[off]
        res = np.repeat(out, times)
        s = where[space]
        res[s], res[s + 1], res[s + 2] = 0xE2, 0x96, 0x81
        out, begin, end = res, np.repeat(begin, times), np.repeat(end, times)
    return out, off, begin, end


def _replace(data: np.ndarray, offsets: np.ndarray, chars: CharsMap) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = data.tobytes()
    parts, begins, ends, lens = [], [], [], []
    cand = chars.candidates(data, offsets)
    first = np.searchsorted(cand, offsets)
    for k in range(len(offsets) - 1):
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        at, size = lo, 0
        text = raw[lo:hi]
        for c in cand[first[k] : first[k + 1]].tolist():
            if c < at or (hit := chars.longest(text, c - lo)) is None:
                continue
            n, new = hit
            parts += [data[at:c], np.frombuffer(new, np.uint8)]
            begins += [np.arange(at, c), np.full(len(new), c)]
            ends += [np.arange(at + 1, c + 1), np.full(len(new), c + n)]
            size += c - at + len(new)
            at = c + n
        parts.append(data[at:hi])
        begins.append(np.arange(at, hi))
        ends.append(np.arange(at + 1, hi + 1))
        lens.append(size + hi - at)
    off = np.concatenate(([0], np.cumsum(np.array(lens, dtype=np.int64))))
    if not parts:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), off
    return np.concatenate(parts), np.concatenate(begins), np.concatenate(ends), off


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each of the distinct spans, and for each span the number of its like; spans follow one another without gaps.

    Hashes bring like spans together, and bytes are compared.
    """
    _, first, inverse = np.unique(X.span_hash(X.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    like = first[inverse]
    if len(starts) and (size == size[like]).all():
        at = np.arange(starts[0], ends[-1])
        if np.array_equal(data[at], data[at + np.repeat(starts[like] - starts, size)]):
            return first, inverse
    known: dict[bytes, int] = {}
    raw, heads = data.tobytes(), []
    inverse = np.empty(len(starts), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        k = inverse[i] = known.setdefault(raw[a:b], len(known))
        if k == len(heads):
            heads.append(i)
    return np.array(heads, dtype=np.int64), inverse


class Model:
    """A model file, its normaliser and the words whose pieces are known."""

    _held: dict[tuple[str, bytes | None], Model] = {}

    def __init__(self, path: str, charsmap: bytes | None = None):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        self.spec = Spec(n.precompiled_charsmap if charsmap is None else charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that set the space mark behind words aren't supported")
        surface = []
        for p in proto.pieces:
            surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.encode())
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.surface = surface
        self.size = np.array([len(s) for s in surface], dtype=np.int32)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.whole = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (1, 4))
        # the library only merges: the text that it gets is normalised already
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, False
        n.name = "identity"
        self.sp = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.forget()

    @classmethod
    def of(cls, path: str, charsmap: bytes | None = None) -> Model:
        if (path, charsmap) not in cls._held:
            cls._held = {(path, charsmap): cls(path, charsmap)}
        return cls._held[path, charsmap]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.bounds = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(REMEMBER + 2, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        got = self.sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        k = len(self.known)
        if k + len(words) + 1 > len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros(k + len(words) + 1, np.int64))
        sizes = np.array([len(x) for x in got], dtype=np.int64)
        at = int(self.bounds[k])
        self.bounds[k + 1 : k + 1 + len(words)] = at + np.cumsum(sizes)
        need = int(self.bounds[k + len(words)])
        if need > len(self.ids):
            for name in ("ids", "ends"):
                setattr(self, name, np.append(getattr(self, name), np.zeros(max(need, 2 * len(self.ids)) - len(self.ids), np.int32)))
        flat = np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))
        size = self.size[flat].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(flat == self.unknown), side="right") - 1).tolist():
            # unknown pieces cover what the library says
            surf = [len(p.surface.encode()) for p in self.sp.encode(words[i].decode("utf-8", "replace"), return_type="proto").pieces]
            size[bounds[i] : bounds[i + 1]] = surf
        total = np.concatenate(([0], np.cumsum(size)))
        self.ids[at:need] = flat
        self.ends[at:need] = total[1:] - np.repeat(total[bounds[:-1]], sizes)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts with begins and ends in the source (from each text's start), the bounds of each text; the normalised bytes and offsets."""
        norm, off, begin, end = normalise(data, offsets, self.spec)
        if self.whole:
            starts = off[:-1][off[1:] > off[:-1]]
        else:
            mark = np.zeros(len(norm) + 1, bool)  # first byte of a mark
            if len(norm) > 2:
                mark[:-3] = (norm[:-2] == 0xE2) & (norm[1:-1] == 0x96) & (norm[2:] == 0x81)
            tail = np.zeros(len(norm) + 1, bool)  # the place behind a mark
            tail[3:] = mark[:-3]
            cut = mark & ~tail
            cut[off[:-1]] = True
            cut[len(norm)] = False
            starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(norm)) if len(starts) else starts
        first, inverse = distinct(norm, starts, ends)
        if len(self.known) + len(first) > REMEMBER:
            self.forget()
        raw = norm.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        word = np.array([self.known[w] for w in words], dtype=np.int64)[inverse]
        size = self.bounds[word + 1] - self.bounds[word]
        total = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(total[-1]) + np.repeat(self.bounds[word] - total[:-1], size)
        ids = self.ids[take]
        piece_end = self.ends[take] + np.repeat(starts, size)
        piece_begin = np.empty_like(piece_end)
        piece_begin[1:] = piece_end[:-1]
        if len(piece_begin):
            piece_begin[0] = 0
        bounds = total[np.searchsorted(starts, off)]
        base = np.repeat(offsets[:-1], np.diff(bounds))
        b, e = (begin[piece_begin] - base, end[piece_end - 1] - base) if len(ids) else (piece_begin, piece_end)
        return ids, b.astype(np.int32), e.astype(np.int32), bounds, norm, off

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of pieces, with spaces for marks and without the space set before them; an unknown piece gives U+2047 in spaces."""
        size = self.size[ids].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.bytes[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], size)]
        off = total[bounds]
        # a byte piece may be part of what looks like a mark, but is one then too
        return unescape(out, off, self.spec)


def unescape(data: np.ndarray, off: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    if not spec.escape:
        return data, off
    keep = np.ones(len(data), bool)
    if len(data) > 2:
        m = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        data = data.copy()
        data[m] = 32
        keep[m + 1] = keep[m + 2] = False
    if spec.dummy:
        full = off[:-1][off[1:] > off[:-1]]
        keep[full[data[full] == 32]] = False
    total = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], total[off]


def _encode(batches: Iterator[pa.RecordBatch], path: str, charsmap: bytes | None) -> Iterator[pa.RecordBatch]:
    model = Model.of(path, charsmap)
    for batch in batches:
        data, offsets = X.strings(batch.column(1))
        for i, j in X.pieces(offsets, 1 << 18):
            ids, b, e, bounds, norm, off = model.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            got, got_off = model.decode(ids, bounds)
            want, want_off = unescape(norm, off, model.spec)
            same = got_off[1:] - got_off[:-1] == want_off[1:] - want_off[:-1]
            if same.all():
                same &= X.counts(got != want, got_off) == 0
            else:
                same &= np.array([got[p:q].tobytes() == want[r:s].tobytes() for p, q, r, s in zip(got_off[:-1], got_off[1:], want_off[:-1], want_off[1:], strict=True)])
            none = pa.array(batch.column(1).slice(i, j - i).is_null())
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x), mask=none) for x in (ids, b, e)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists, pa.array(same, mask=none.to_numpy(zero_copy_only=False))], names=["doc_id", "ids", "begins", "ends", "round_trip"])


def encode(docs: DataFrame, model: str = MODEL, charsmap: bytes | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends array<int>, round_trip boolean) for each row of docs.

    Piece i covers the bytes begins[i] to ends[i] of the text's UTF-8; the mark
    that the model sets before a text covers none. round_trip says that decoding
    the ids gives the normalised text. An empty text has empty lists, a null
    text has nulls; doc_id may be null or repeat, as each row stands alone. A
    very long text is encoded whole. An empty table gives an empty one.
    charsmap takes another compiled character map than the model's.
    """
    pos, names = positional(docs)
    src = pos.select(F.col(column(names, "doc_id")).cast("bigint").alias("doc_id"), F.col(column(names, "text")).cast("string").alias("text"))
    return src.mapInArrow(lambda it: X.tidy(_encode(it, model, charsmap)), "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, round_trip boolean")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = Model.of(path)
    for batch in batches:
        col = batch.column(1)
        none = col.is_null().to_numpy(zero_copy_only=False)
        lens = np.array([0 if n else len(x) for n, x in zip(none, col, strict=True)], dtype=np.int64)
        ids = col.drop_null().flatten().to_numpy(zero_copy_only=False) if len(col) else np.zeros(0, np.int64)
        out, off = model.decode(ids.astype(np.int64), np.concatenate(([0], np.cumsum(lens))))
        yield pa.RecordBatch.from_arrays([batch.column(0), X.to_strings(out, off, none)], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids) rows; null for null ids. ids must be pieces of the model.

    Empty ids give an empty text; doc_id may be null or repeat. An empty table gives an empty one.
    """
    pos, names = positional(encoded)
    src = pos.select(F.col(column(names, "doc_id")).cast("bigint").alias("doc_id"), F.col(column(names, "ids")).cast("array<int>").alias("ids"))
    return src.mapInArrow(lambda it: _decode(it, model), "doc_id bigint, text string")
