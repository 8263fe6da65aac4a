"""Secrets behind layers of encoding.

A worklist starts with the text itself. Every layer is scanned by the rules,
and what its decoders find to unwrap in it (URL escapes, Unicode escapes,
base64 of either alphabet and over line ends, and gzip or zlib streams and
UTF-16 within these) gives a new layer, the text with those parts unwrapped;
bytes that aren't UTF-8 text are carried as a character each. Parts that stand
apart are unwrapped together, so that nested ones side by side add their depths
instead of multiplying them; where parts of two decoders overlap or touch, each
decoder gets a layer of its own as well. Layers that were seen before, by
digest, aren't added again, so the work ends at a fixpoint whatever the texts
decode to. For each character a layer records which characters of the original
text it came from and through which decoders, and findings are given in those.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import partial
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import pick

#: rule: (words of which a layer in lower case must have one, pattern whose last group is the secret)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern[str]]] = {
    "aws_access_key": (("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])")),
    "github_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})")),
    "slack_token": (("xox",), re.compile(r"(xox[abprs]-[0-9A-Za-z-]{10,})")),
    "payment_key": (("k_live_",), re.compile(r"([rs]k_live_[0-9A-Za-z]{16,})")),
    "google_api_key": (("aiza",), re.compile(r"(AIza[0-9A-Za-z_\-]{35})")),
    "json_web_token": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    "private_key": (("private key",), re.compile(r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)")),
    "assigned_secret": (
        ("token", "secret", "passw", "key", "credential"),
        re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_.~\-]{16,}={0,2})"),
    ),
}
#: Bits a character that an assigned secret has at least; words and file names have less.
ENTROPY = 2.8
#: Characters that a compressed stream may unwrap to; a larger one is reported as oversized_stream and scanned in pieces of PIECE, each with the last OVERLAP of the one before.
MAX_STREAM = 64 << 20
PIECE, OVERLAP = 4 << 20, 1 << 18

#: Escapes; one whose own escape character is escaped, however often, is one.
_URL_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_URL = re.compile(rf"(?:{_URL_ONE.pattern})+")
_UNICODE = re.compile(r"\\(?:u005[cC]|x5[cC])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_URL_TOKEN = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[!-$&-~])*")
_URL_CHAR = re.compile(r"%[0-9A-Fa-f]{2}|.", re.S)
_ESCAPE = re.compile(_UNICODE.pattern + r"|\\([0-7]{1,3}|[^\sxu0-7])")
_SIMPLE = {"a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPED_STREAM = re.compile(r"(?i)(?:\\x|\\u00|\\u\{|&#x)1f\}?;?(?:\\x|\\u00|\\u\{|&#x)8b|\\0?37\\213|&#31;&#139;|(?:x|\\x78|\\u0078|\\170)(?:(?:\\x|\\u00)(?:01|5e|9c|da)|\\0?01|\\136|\\234|\\332|\^(?=[ -~]{0,60}\\x))")
#: First characters of gzip and zlib streams.
_STREAM_HEADS = ("\x1f\x8b\x08", "x\x01", "x\x5e", "x\x9c", "x\xda")
_STREAM = re.compile("|".join(map(re.escape, _STREAM_HEADS)))
_STREAM_BYTES = re.compile(_STREAM.pattern.encode("latin-1"))
_WIDE = re.compile("(?:[^\0]\0){8,}|(?:[^\0]\0{3}){8,}")
_WIDE_BYTES = re.compile(rb"(?:[\t\r\n -~]\0){8}|(?:[\t\r\n -~]\0{3}){8}")
#: Characters of a stream that are unwrapped at once.
STEP = 1 << 14
#: Runs of either base64 alphabet, wrapped or not, and a line's last characters before such a run.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\\r)?(?:\\n|\r?\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,15}[ \t]*(?:\\r)?(?:\\n|\r?\n)[ \t]*\Z")
_BREAK = re.compile(r"\\[rn]|[ \t\r\n=]")
_SPACE = re.compile(r"\s")
#: Parts of two decoders so near to each other may belong together, even over white space.
NEAR = 16
#: What decoded bytes that aren't text must have: so many printable characters as the shortest secret.
_WORTH = re.compile(rb"[\t\r\n -~]{15}")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def inflate(text: str, at: int) -> tuple[bytes | None, int, bool] | None:
    """What the gzip or zlib stream holds whose bytes are the characters from `at` on, its end and if it is whole; None for anything else.

    Of a stream that is cut off or damaged it gives what comes before that. One
    above MAX_STREAM gives None for what it holds.
    """
    d, out, size, end = zlib.decompressobj(47), [], 0, at
    while not d.eof and end < len(text):
        try:
            piece = text[end : end + STEP].encode("latin-1")
        except UnicodeEncodeError as e:
            piece = text[end : end + e.start].encode("latin-1")
        if not piece:
            break
        try:
            out.append(d.decompress(piece, MAX_STREAM + 1 - size))
        except zlib.error:
            # again byte by byte, as a failing call gives nothing
            d = zlib.decompressobj(47)
            out, size = [], 0
            raw = text[at : end + len(piece)].encode("latin-1")
            for k in range(len(raw)):
                try:
                    out.append(d.decompress(raw[k : k + 1]))
                except zlib.error:
                    break
            end = at + k
            break
        size += len(out[-1])
        end += len(piece)
        if size > MAX_STREAM:
            return None, at, True
    raw = b"".join(out)
    if d.eof:
        return raw, end - len(d.unused_data), True
    return (raw, end, False) if _WORTH.search(raw) else None


def readable(raw: bytes) -> str | None:
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\t\r\n" for c in s) >= 0.95 * len(s) else None


def characters(raw: bytes) -> str:
    """raw as text; what isn't UTF-8 text is a character a byte, so that nothing of it is lost."""
    return readable(raw) or raw.decode("latin-1")


class Layer:
    """A text and, unless it is the original, for each character its place in the original and the number of its path in a list of paths."""

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None, via: np.ndarray | None = None):
        self.text, self.begin, self.end, self.via = text, begin, end, via

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a:b].min()), int(self.end[a:b].max()))

    def path(self, a: int, b: int, paths: list[tuple[str, ...]]) -> tuple[str, ...]:
        """The longest path of the characters from a to b."""
        return paths[0] if self.via is None else max((paths[i] for i in np.unique(self.via[a:b]).tolist()), key=len)

    def unwrapped(self, parts: list[tuple], paths: list[tuple[str, ...]], known: dict[tuple[str, ...], int]) -> Layer:
        """The layer with text[a:b] replaced for each part (a, b, new, begins, ends, name), whose lists are relative to a; None: the whole of a to b."""
        n = len(self.text)
        begin = np.arange(n) if self.begin is None else self.begin
        end = np.arange(1, n + 1) if self.end is None else self.end
        via = np.zeros(n, np.int32) if self.via is None else self.via
        out, bs, es, vs, at = [], [], [], [], 0
        for a, b, new, x, y, name in parts:
            out += [self.text[at:a], new]
            bs.append(begin[at:a])
            es.append(end[at:a])
            if x is None:
                lo, hi = self.span(a, b)
                bs.append(np.full(len(new), lo))
                es.append(np.full(len(new), hi))
            else:
                bs.append(begin[np.array(x, dtype=np.int64) + a])
                es.append(end[np.array(y, dtype=np.int64) + a - 1])
            path = (*self.path(a, b, paths), *name)
            if path not in known:
                known[path] = len(paths)
                paths.append(path)
            vs += [via[at:a], np.full(len(new), known[path], np.int32)]
            at = b
        out.append(self.text[at:])
        return Layer("".join(out), *[np.concatenate([*z, w[at:]]) for z, w in ((bs, begin), (es, end), (vs, via))])


def _chars(s: str, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of s's characters from those of its UTF-8 bytes."""
    lead = np.flatnonzero(np.frombuffer(s.encode(), np.uint8) & 0xC0 != 0x80)
    return begins[lead], ends[np.append(lead[1:], len(begins)) - 1]


def _url(text: str):
    if "%" not in text:
        return
    for m in _URL.finditer(text):
        ones = list(_URL_ONE.finditer(m[0]))
        raw = bytes.fromhex("".join(x[1] for x in ones))
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        yield m.start(), m.end(), s, *_chars(s, *(np.array([f(x) for x in ones]) for f in (re.Match.start, re.Match.end)))


def _url_bytes(text: str, plus: bool):
    """Tokens from their first escape on whose bytes aren't UTF-8, a character a byte; plus: + is a space."""
    if "%" not in text:
        return
    for m in _URL_TOKEN.finditer(text):
        token = m[0]
        if plus and "+" not in token:
            continue
        raw = unquote_to_bytes(token.replace("+", " ") if plus else token)
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            size = np.array([len(x[0]) for x in _URL_CHAR.finditer(token)])
            y = np.cumsum(size)
            yield m.start(), m.end(), raw.decode("latin-1"), y - size, y


def _unicode(text: str, simple: bool = False):
    """Escapes; simple: also those of one letter and octal ones, if a compressed stream starts in escapes."""
    if "\\u" not in text and "\\x" not in text and "&#" not in text and not (simple and "\\" in text):
        return
    if simple and not _ESCAPED_STREAM.search(text):
        return
    found = []
    for m in (_ESCAPE if simple else _UNICODE).finditer(text):
        if simple and m[6]:
            code = int(m[6], 8) if m[6][0] in "01234567" else ord(_SIMPLE.get(m[6], m[6]))
        else:
            code = int(m[1] or m[2] or m[3] or m[4] or "0", 16) if not m[5] else int(m[5])
        if code < 0x110000:
            found.append((m.start(), m.end(), code))
    i = 0
    while i < len(found):
        a, b, code = found[i]
        i += 1
        if 0xD800 <= code < 0xDC00 and i < len(found) and found[i][0] == b and 0xDC00 <= found[i][2] < 0xE000:
            code, b = 0x10000 + ((code - 0xD800) << 10) + found[i][2] - 0xDC00, found[i][1]
            i += 1
        if not 0xD800 <= code < 0xE000:
            yield a, b, chr(code), [0], [b - a]


def _holds_stream(raw: bytes) -> bool:
    if not _STREAM_BYTES.search(raw):
        return False
    text = raw.decode("latin-1")
    return any(inflate(text, m.start()) is not None for m in _STREAM.finditer(text))


def _base64(text: str, shift: int):
    """Parts that are base64 from their character of number shift on; what stands before it may be no base64, but a word or a path."""
    last = 0
    for m in _BASE64.finditer(text):
        a, b = m.span()
        if before := _BEFORE.search(text, max(last, a - 64), a):
            a = before.start()
        last = b
        run = _BREAK.sub(lambda x: " " * len(x[0]), text[a:b])
        at = np.flatnonzero(np.frombuffer(run.encode(), np.uint8) != 32)[shift:]
        body = run.replace(" ", "")[shift:].replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            body = body[:-1]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        n = np.arange(len(raw))
        x, y = at[4 * n // 3], at[(4 * n + 6) // 3 - 1] + 1
        if len(raw) and len(at) == len(body):
            y[-1] = b - a
        if (s := readable(raw)) is not None and (shift == 0 or _WORTH.search(raw)):
            yield a, b, s, *_chars(s, x, y)
        elif _WORTH.search(raw) or _WIDE_BYTES.search(raw) or _holds_stream(raw):
            yield a, b, raw.decode("latin-1"), x, y


def _streams(text: str, torn: bool):
    """gzip and zlib streams whose bytes are characters, whole or torn ones; the members of a file follow each other."""
    if not any(x in text for x in _STREAM_HEADS):
        return
    at = 0
    while m := _STREAM.search(text, at):
        at = m.start() + 1
        if (got := inflate(text, m.start())) is not None:
            raw, end, whole = got
            if raw is None:
                if not torn:
                    large = Large(text, m.start())
                    yield m.start(), (at := large.end()), large, None, None
                else:
                    at = Large(text, m.start()).end()
                continue
            at = end
            if whole != torn:
                yield m.start(), at, characters(raw), None, None


class Large:
    """A stream above MAX_STREAM, which is never held whole."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def end(self) -> int:
        for _, end in self._chunks():
            pass
        return end

    def _chunks(self) -> Iterator[tuple[bytes, int]]:
        """(bytes, place in the text so far): what the stream holds, up to where it ends or is damaged."""
        d, at = zlib.decompressobj(47), self.at
        try:
            while not d.eof and at < len(self.text):
                piece = self.text[at : at + STEP].encode("latin-1", "replace")
                while piece and not d.eof:
                    out = d.decompress(piece, PIECE)
                    piece = d.unconsumed_tail
                    yield out, min(at + STEP, len(self.text)) - len(piece) - len(d.unused_data)
                at += STEP
            if not d.eof:
                yield d.flush(), len(self.text)
        except zlib.error:
            return

    def pieces(self) -> Iterator[bytes]:
        """What the stream holds, unwrapped further while it starts with another stream, in overlapping pieces."""
        chunks, heads = (c for c, _ in self._chunks()), set()
        while True:
            head = b""
            for c in chunks:
                head += c
                if len(head) >= OVERLAP:
                    break
            key = hashlib.sha256(head[:OVERLAP]).digest()
            chunks = chain((head,), chunks)
            if key in heads or not _STREAM_BYTES.match(head) or zlib_starts(head) is None:
                break
            heads.add(key)
            chunks = _inflated(chunks)
        held = b""
        for c in chunks:
            held += c
            while len(held) >= PIECE:
                yield held[:PIECE]
                held = held[PIECE - OVERLAP :]
        yield held


def zlib_starts(head: bytes) -> bytes | None:
    try:
        return zlib.decompressobj(47).decompress(head, PIECE) or None
    except zlib.error:
        return None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the streams, one after the other, hold whose bytes come in chunks, up to what is none."""
    d = zlib.decompressobj(47)
    try:
        for c in chunks:
            while c:
                if d.eof:
                    d = zlib.decompressobj(47)
                yield d.decompress(c, PIECE)
                c = d.unused_data if d.eof else d.unconsumed_tail
        if not d.eof:
            yield d.flush()
    except zlib.error:
        return


def _wide(text: str):
    """UTF-16 and UTF-32 whose bytes are characters, without their zeros."""
    if "\0" not in text:
        return
    for m in _WIDE.finditer(text):
        at = np.array([i for i, c in enumerate(m[0]) if c != "\0"])
        yield m.start(), m.end(), m[0].replace("\0", ""), at, at + 1


#: Names that a layer's path gets, and decoders. Streams and wide characters are a matter of the bytes that a named one found.
DECODERS = [
    ((), partial(_streams, torn=False)), ((), partial(_streams, torn=True)), ((), _wide),
    (("url",), _url), *((("url",), partial(_url_bytes, plus=p)) for p in (False, True)),
    (("unicode",), _unicode), (("unicode",), partial(_unicode, simple=True)),
    *((("base64",), partial(_base64, shift=k)) for k in range(4)),
]


def _near(text: str, a: int, b: int) -> bool:
    """Whether no white space parts a from b, or hardly anything does."""
    return b - a <= NEAR or not _SPACE.search(text, a, b)


def _layers(text: str, found: list[list[tuple]]) -> Iterator[list[tuple]]:
    """What to unwrap together, from each decoder's parts: all that stand apart; and one decoder's where they don't."""
    order = sorted((a, b, k, i) for k, parts in enumerate(found) for i, (a, b, *_) in enumerate(parts))
    taken, alone, end, last = [], set(), 0, None
    for a, b, k, i in order:
        if last is not None and k != last and _near(text, end, a):
            alone |= {k, last}
        if a >= end or last is None:
            taken.append(found[k][i])
        if b > end or last is None:
            end, last = b, k
    yield taken
    for k in sorted(alone):
        yield found[k]


def scan(text: str, path: tuple[str, ...] = ()) -> list[tuple[str, str, int, int, str]]:
    """(rule, path of layers, begin, end, secret), each place and rule once, by the outermost layer that shows it.

    A large stream is one place: each of its secrets is given with its span.
    """
    found: dict[tuple[str, int, int], tuple[str, str]] = {}
    several: dict[tuple[str, int, int, str], str] = {}
    paths, known = [path], {path: 0}
    work, seen, large = deque([Layer(text)]), set(), set()
    named = lambda p: ">".join(p) or "text"
    while work:
        layer = work.popleft()
        low = layer.text.lower()
        for rule, (words, pattern) in RULES.items():
            if not any(w in low for w in words):
                continue
            for m in pattern.finditer(layer.text):
                secret = m[m.lastindex]
                if rule == "assigned_secret" and entropy(secret) < ENTROPY:
                    continue
                at = m.span(m.lastindex)
                found.setdefault((rule, *layer.span(*at)), (named(layer.path(*at, paths)), secret))
        by_decoder = []
        for name, decoder in DECODERS:
            parts = [(*x, name) for x in decoder(layer.text)]
            for i, (a, b, new, *_) in enumerate(parts):
                if isinstance(new, Large):
                    span, via = layer.span(a, b), layer.path(a, b, paths)
                    found.setdefault(("oversized_stream", *span), (named(via), ""))
                    for piece in new.pieces():
                        digest = hashlib.sha256(piece).digest()
                        if digest in large:
                            continue
                        large.add(digest)
                        for rule, inner, _, _, secret in scan(characters(piece), via):
                            several[rule, *span, secret] = inner
                    parts[i] = (a, b, " ", None, None, name)
            if parts:
                by_decoder.append(parts)
                if decoder is DECODERS[0][1]:
                    break  # a whole stream is certain: what else the layer holds is decoded in the new one, without its bytes
        if by_decoder and not seen:
            seen.add(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        for parts in _layers(layer.text, by_decoder) if by_decoder else ():
            new = layer.unwrapped(parts, paths, known)
            digest = hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest()
            if digest not in seen:
                seen.add(digest)
                work.append(new)
    rows = {(rule, path, a, b, secret) for (rule, a, b), (path, secret) in found.items()} | {(rule, path, a, b, secret) for (rule, a, b, secret), path in several.items() if found.get((rule, a, b), ("", None))[1] != secret}
    return sorted(rows, key=lambda x: (x[2], x[3], x[0], x[4]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for f in scan(t)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        hashed = [hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in cols[5]]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip([*cols[:5], hashed], (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "rule", "layers", "begin", "end", "secret_sha256"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, layers, begin, end int, secret_sha256): every secret of docs, hashed.

    begin and end are characters of the text; layers names the decoders down to
    the layer that shows the secret, or says text. Null and empty texts have no
    findings; a null doc_id stays null and repeated rows give repeated findings.
    A very long text is scanned whole. An empty table gives an empty one.
    """
    src = pick(docs, doc_id="bigint", text="string")
    return src.mapInArrow(_scan, "doc_id bigint, rule string, layers string, begin int, end int, secret_sha256 string")
