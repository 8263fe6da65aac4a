"""The byte format of containers, change blocks, records, messages and letters.

A container is an envelope of headers, data sections, an index of the sections,
appended change blocks, an index of these, and a trailer of fixed size at the
end. All offsets are absolute. The product's name within the markers is read
from the file; files are written under PRODUCT unless another one is given.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from dataclasses import dataclass, field

from ..functions import codec
from ..functions.text import find_blank, header, parse_headers

PRODUCT = os.environ.get("DELTAWEAVE_PRODUCT", "Deltaweave")
TRAILER, ENVELOPE_LIMIT, RECORD_LIMIT = 512, 65_536, 4096
LOCAL = "local"


class WireError(ValueError):
    """Bytes that don't follow the format."""


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


JSON = "application/json"


def head_block(*rows: tuple[str, object]) -> bytes:
    """A header block with the blank line that ends it."""
    return "".join(f"{k}: {v}\r\n" for k, v in rows).encode() + b"\r\n"


def _from(entity: str) -> tuple[str, str]:
    return "From", f"<{entity}@system.local>"


def dump(value) -> bytes:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


@dataclass
class Section:
    id: str
    ct: str
    name: str
    data: bytes
    enc: str = "raw"

    @classmethod
    def table(cls, id: str, content: dict) -> Section:
        """A section that holds a table's first state."""
        return cls(id, JSON, f"{id}.json", dump(content))


@dataclass
class Container:
    headers: list[tuple[str, str]]
    sections: list[dict]
    tail: list[dict]
    tail_off: int
    base_hash: str
    tail_seq: int
    tail_hash: str
    product: str
    raw: bytes = field(repr=False, default=b"")

    @property
    def entity(self) -> str | None:
        return header(self.headers, "X-Entity-ID")

    def section(self, id: str, key: bytes | None = None) -> bytes | None:
        """Content of the first section of this id."""
        s = next((s for s in self.sections if s["id"] == id), None)
        return None if s is None else codec.decode(s.get("enc", "raw"), _slice(self.raw, s["off"], s["len"]), key)

    def block(self, e: dict) -> bytes:
        return _slice(self.raw, e["off"], e["len"])

    def delta(self, seq: int, writer: str | None = None) -> bytes | None:
        """The first block of this number, of one writer if that is given."""
        e = next((e for e in self.tail if e["seq"] == seq and writer in (None, e["writer"])), None)
        return None if e is None else self.block(e)

    @property
    def base_end(self) -> int:
        return self.tail[0]["off"] if self.tail else self.tail_off


def _slice(raw: bytes, off: int, n: int) -> bytes:
    if off + n > len(raw):
        raise WireError(f"bytes {off} to {off + n} of a file of {len(raw)}")
    return raw[off : off + n]


def _int(headers: list[tuple[str, str]], name: str) -> int:
    v = header(headers, name)
    if v is None or not v.strip().isdigit():
        raise WireError(f"no number in {name}")
    return int(v)


def read(raw: bytes) -> Container:
    """A container by its indexes; sections and blocks aren't looked at."""
    blank = find_blank(raw[:ENVELOPE_LIMIT])
    if blank is None:
        raise WireError("no blank line after the envelope")
    headers = parse_headers(raw[: blank[0]])
    if not headers:
        raise WireError("no headers")
    index = json.loads(_slice(raw, _int(headers, "X-Index-Offset"), _int(headers, "X-Index-Length")))
    end = raw[-TRAILER:].decode("utf-8", "replace")
    mark = re.search(r"X-([A-Za-z0-9]+)-Trailer: v1", end)
    if len(raw) < TRAILER or not mark:
        raise WireError("no trailer")
    t: dict[str, str] = {}
    for line in end[mark.start() :].split("\n"):
        m = re.match(r"(X-[^:]*): (.*)", line.rstrip("\r"))
        if m:
            t[m[1].strip()] = m[2].strip()
        elif t:
            break
    off = int(t["X-Tail-Index-Offset"])
    tail = json.loads(_slice(raw, off, int(t["X-Tail-Index-Length"])))["entries"]
    for e in tail:
        e.setdefault("writer", LOCAL)
    return Container(headers, index["sections"], tail, off, t.get("X-Base-Hash", ""), int(t.get("X-Tail-Seq", 0)), t.get("X-Tail-Hash", ""), mark[1], raw)


def trailer(product: str, entity: str, total: int, base_hash: str, tail_hash: str, off: int, n: int) -> bytes:
    rows = (("Entity-ID", entity), ("Tail-Seq", total), ("Tail-Hash", tail_hash), ("Base-Hash", base_hash), ("Tail-Index-Offset", off), ("Tail-Index-Length", n))
    text = f"X-{product}-Trailer: v1\r\n" + "".join(f"X-{k}: {v}\r\n" for k, v in rows)
    if len(text.encode()) > TRAILER:
        raise WireError("the entity's name is too long for the trailer")
    return text.encode().ljust(TRAILER)


def _closing(product: str, entity: str, base_hash: str, entries: list[dict], off: int) -> bytes:
    index = dump({"v": 1, "entries": entries})
    return index + trailer(product, entity, len(entries), base_hash, entries[-1]["hash"] if entries else "", off, len(index))


def build(entity: str, subject: str, sections: list[Section], extra: list[tuple[str, str]] | None = None, key: bytes | None = None, product: str = PRODUCT) -> bytes:
    """A new container without blocks."""
    extra = [("X-EML-Type", "Application/Unified")] if extra is None else extra
    boundary = f"part_{sha(repr((entity, subject, time.time_ns())).encode())[:24]}"
    mark = f"--{boundary}\r\n".encode()

    def envelope(at: int, n: int) -> bytes:
        # both numbers have twenty digits, so the envelope's length is known before they are
        index = (("X-Index-Offset", f"{at:020}"), ("X-Index-Length", f"{n:020}"))
        return head_block(_from(entity), ("To", "<kernel@system.local>"), ("Subject", subject), ("X-Entity-ID", entity), *extra, ("X-EML-Version", "0.1.0"), *index, ("Content-Type", f'multipart/mixed; boundary="{boundary}"'))

    start = len(envelope(0, 0))
    body, listed = bytearray(), []
    for s in sections:
        data = codec.encode(s.enc, s.data, key)
        body += mark + head_block(("Content-Type", f'{s.ct}; name="{s.name}"'), ("Content-ID", f"<{s.id}>"), ("X-Encoding", s.enc))
        listed.append({"id": s.id, "ct": s.ct, "name": s.name, "off": start + len(body), "len": len(data), "enc": s.enc})
        body += data
    index = dump({"v": 1, "sections": listed})
    body += mark + head_block(("Content-Type", f"application/x-{product.lower()}-index+json"), ("Content-ID", "<eml-index>"), ("X-Encoding", "raw"))
    head = envelope(start + len(body), len(index))
    body += index + f"--{boundary}--\r\n".encode()
    base = head + bytes(body)
    return base + _closing(product, entity, sha(base), [], len(base))


def block_header(block: bytes, name: str) -> str | None:
    blank = find_blank(block)
    return None if blank is None else header(parse_headers(block[: blank[0]]), name)


def is_delta(block: bytes) -> bool:
    return re.match(rb"(?s)(?:.*\n)?X-[A-Za-z0-9]+-Delta:", block[: (find_blank(block) or (0, 0))[0]]) is not None


def block_body(block: bytes, key: bytes | None = None) -> bytes:
    blank = find_blank(block)
    if blank is None:
        raise WireError("no blank line in a block")
    return codec.decode(block_header(block, "X-Encoding") or "raw", block[sum(blank) :], key)


def parse_delta(block: bytes, key: bytes | None = None) -> dict | None:
    """The change that a block holds; None for another kind of block."""
    if not is_delta(block):
        return None
    d = json.loads(block_body(block, key))
    for k in ("op", "table", "key"):
        if not isinstance(d.get(k), str):
            raise WireError(f"a change without {k}")
    return {"value": None, "ts": 0, "id": None, "after": None} | d


def head(c: Container, writer: str) -> tuple[int, str]:
    """Number and hash that the writer's next block follows."""
    own = [e for e in c.tail if e["writer"] == writer]
    last = max(own, key=lambda e: e["seq"], default=None)
    return (0, c.base_hash) if last is None else (last["seq"], last["hash"])


def make_block(c: Container, writer: str, delta: dict, key: bytes | None = None, seed: bytes | None = None) -> bytes:
    """The writer's next block, encrypted with a key and signed with a seed."""
    seq, prev = head(c, writer)
    body = dump(delta)
    lines = [(f"X-{c.product}-Delta", "v1"), ("X-Entity-ID", c.entity), ("X-Writer-ID", writer), ("X-Delta-Seq", seq + 1), ("X-Prev-Hash", prev)]
    if key is not None:
        body = codec.encrypt(key, body)
    if seed is not None:
        lines += [("X-Writer-Key", codec.public_key(seed).hex()), ("X-Signature", codec.sign(seed, body).hex())]
    if key is not None:
        lines.append(("X-Encoding", "aes"))
    lines.append(("Content-Type", f"application/x-{c.product.lower()}-delta+json"))
    return head_block(*lines) + body


def append(raw: bytes, block: bytes, writer: str | None = None) -> bytes:
    """The container with one more block, which must be its writer's next one."""
    return append_all(raw, [(block, writer)])


def append_all(raw: bytes, blocks: list[tuple[bytes, str | None]]) -> bytes:
    """The container with more blocks (block, writer), each its writer's next one; read and copied once."""
    c = read(raw)
    at = c.tail[-1]["off"] + c.tail[-1]["len"] if c.tail else c.tail_off
    parts, entries, heads = [raw[:at]], list(c.tail), {}
    for block, writer in blocks:
        if not is_delta(block):
            raise WireError("not a block of changes")
        own = block_header(block, "X-Writer-ID") or LOCAL
        if writer is not None and own != writer:
            raise WireError(f"block of {own}, not of {writer}")
        seq, prev = block_header(block, "X-Delta-Seq"), block_header(block, "X-Prev-Hash")
        if seq is None or not seq.isdigit() or prev is None:
            raise WireError("a block without number or predecessor")
        last, want = heads[own] if own in heads else head(c, own)
        if int(seq) != last + 1:
            raise WireError(f"block {own}#{seq} where {last + 1} is next")
        if prev != want:
            raise WireError(f"block {own}#{seq} follows {prev}, not {want}")
        entries.append({"seq": int(seq), "writer": own, "off": at, "len": len(block), "hash": sha(block)})
        heads[own] = int(seq), entries[-1]["hash"]
        parts.append(block)
        at += len(block)
    return b"".join(parts) + _closing(c.product, c.entity or "", c.base_hash, entries, at)


def append_delta(raw: bytes, delta: dict, writer: str = LOCAL, key: bytes | None = None, seed: bytes | None = None) -> bytes:
    return append(raw, make_block(read(raw), writer, delta, key, seed), writer)


def write_file(path: str, raw: bytes, sync: bool = True) -> None:
    """Replaces a file in one step."""
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        f.write(raw)
        if sync:
            f.flush()
            os.fsync(f.fileno())
    os.replace(tmp, path)


def _json_end(raw: bytes, at: int) -> int | None:
    """Where the JSON value that begins at a place ends."""
    try:
        _, n = json.JSONDecoder().raw_decode(raw[at:].decode("utf-8", "surrogateescape"))
    except ValueError:
        return None
    return at + len(raw[at:].decode("utf-8", "surrogateescape")[:n].encode("utf-8", "surrogateescape"))


def repair(raw: bytes, keep: int | None = None) -> tuple[bytes, int]:
    """A container with its block index built anew from the blocks themselves, and their number.

    The last block ends with its JSON (an encrypted one at the closing index, if
    there is one). A block that isn't whole goes. keep: the first blocks only.
    """
    blank = find_blank(raw[:ENVELOPE_LIMIT])
    if blank is None:
        raise WireError("no blank line after the envelope")
    headers = parse_headers(raw[: blank[0]])
    start = _int(headers, "X-Index-Offset") + _int(headers, "X-Index-Length")
    marks = [m.start() for m in re.finditer(rb"X-[A-Za-z0-9]+-Delta: v1\r?\n", raw[start:])]
    if not marks:
        raise WireError("no blocks to repair from")
    marks = [start + m for m in marks]
    product = re.match(rb"X-([A-Za-z0-9]+)-", raw[marks[0] :])[1].decode()
    base_hash, entries = sha(raw[: marks[0]]), []
    for i, at in enumerate(marks):
        end = marks[i + 1] if i + 1 < len(marks) else None
        block = raw[at : end or len(raw)]
        b = find_blank(block)
        seq = block_header(block, "X-Delta-Seq") if b else None
        if b is None or seq is None or not seq.isdigit():
            break
        if end is None:
            if (block_header(block, "X-Encoding") or "raw") == "raw":
                end = _json_end(raw, at + sum(b))
            else:
                tail = raw.find(b'{"entries":[', at)
                end = tail if tail >= 0 else None
            if end is None:
                break
        entries.append({"seq": int(seq), "writer": block_header(block, "X-Writer-ID") or LOCAL, "off": at, "len": end - at, "hash": sha(raw[at:end])})
    if keep is not None:
        entries = entries[:keep]
    stop = entries[-1]["off"] + entries[-1]["len"] if entries else marks[0]
    return raw[:stop] + _closing(product, header(headers, "X-Entity-ID") or "repaired", base_hash, entries, stop), len(entries)


# --- records


def record(id: str, tags: list[str], device: str, ts: int, body, product: str = PRODUCT) -> bytes:
    if not id or id == "." or re.search(r"[/\\]|\.\.", id):
        raise WireError(f"not a flat id: {id!r}")
    rows = [(f"X-{product}-Record", "v1"), ("X-Record-ID", id), *[("X-Tag", t) for t in tags], *([("X-Device-ID", device)] if device else []), ("X-Timestamp", ts), ("Content-Type", JSON)]
    return head_block(*rows) + dump(body)


def insert_record(folder: str, id: str, tags: list[str], device: str, ts: int, body, product: str = PRODUCT) -> str:
    raw = record(id, tags, device, ts, body, product)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{id}.eml")
    write_file(path, raw, sync=False)
    return path


# --- messages and letters


def message(sender: str, to: str, event: str, body, product: str = PRODUCT) -> bytes:
    return head_block(_from(sender), ("To", f"<{to}>"), ("X-Event", event), (f"X-{product}-Msg", "v1"), ("Content-Type", JSON)) + dump(body)


def send(bus: str, sender: str, to: str, event: str, body, product: str = PRODUCT) -> str:
    """Writes a message to the bus; names sort in the order of sending."""
    os.makedirs(bus, exist_ok=True)
    path = os.path.join(bus, f"{time.time_ns():020}_{os.getpid()}.{re.sub('[ /:]', '_', event)}.msg.eml")
    write_file(path, message(sender, to, event, body, product), sync=False)
    return path


def parse_message(raw: bytes) -> dict:
    blank = find_blank(raw)
    if blank is None:
        raise WireError("no blank line in a message")
    h = parse_headers(raw[: blank[0]])
    try:
        body = json.loads(raw[sum(blank) :])
    except ValueError:
        body = {}
    return {"sender": (header(h, "From") or "").strip("<> "), "to": (header(h, "To") or "").strip("<> "), "event": header(h, "X-Event") or "", "body": body}


def sync_message(entity: str, to: str, writer: str, block: bytes, product: str = PRODUCT) -> bytes:
    return head_block(_from(entity), ("To", f"<{to}>"), (f"X-{product}-Sync", "v1"), ("X-Writer-ID", writer), ("Content-Type", f"application/x-{product.lower()}-delta")) + block


def _is_sync(h: list[tuple[str, str]]) -> bool:
    return any(re.fullmatch(r"(?i)X-[A-Za-z0-9]+-Sync", k) for k, _ in h)


def letter(entity: str, to: str, writer: str, blocks: list[tuple[int, bytes]], product: str = PRODUCT) -> bytes:
    """A mail with the blocks as they are, one a part."""
    mark = f"blocks_{sha(b''.join(b for _, b in blocks))[:32]}"
    out = head_block(("From", f"<{entity}>"), ("To", f"<{to}>"), ("Subject", f"changes of {entity}"), (f"X-{product}-Sync", "v1"), ("X-Writer-ID", writer), ("MIME-Version", "1.0"), ("Content-Type", f'multipart/mixed; boundary="{mark}"'))
    for seq, b in sorted(blocks):
        out += f"--{mark}\r\n".encode() + head_block(("Content-Type", f"application/x-{product.lower()}-delta"), ("Content-ID", f"<block-{seq}>")) + b + b"\r\n"
    return out + f"--{mark}--\r\n".encode()


def open_letter(raw: bytes) -> list[tuple[str, int, bytes]]:
    """(writer, number, block) of a mail; nothing for other mails. Only the line end that closes a part goes."""
    blank = find_blank(raw)
    if blank is None:
        raise WireError("no blank line in a mail")
    h = parse_headers(raw[: blank[0]])
    if not _is_sync(h):
        return []
    m = re.search(r'boundary="?([^";]+)', header(h, "Content-Type") or "")
    if not m:
        raise WireError("a mail without a boundary")
    out = []
    for part in raw[sum(blank) :].split(f"--{m[1]}".encode())[1:]:
        part = part.lstrip(b"\r\n") if not part.startswith(b"--") else b""
        b = find_blank(part)
        if b is None or not re.match(r"application/x-[a-z0-9]+-delta", header(parse_headers(part[: b[0]]), "Content-Type") or ""):
            continue
        block = re.sub(rb"\r?\n\Z", b"", part[sum(b) :])
        if block:
            seq = block_header(block, "X-Delta-Seq")
            if seq is None or not seq.isdigit():
                raise WireError("a block without a number")
            out.append((block_header(block, "X-Writer-ID") or LOCAL, int(seq), block))
    return out


def open_sync(raw: bytes) -> tuple[str, str, int, bytes] | None:
    """(addressee, writer, number, block) of a message that carries a block; None for another."""
    blank = find_blank(raw)
    if blank is None:
        return None
    h = parse_headers(raw[: blank[0]])
    block = raw[sum(blank) :]
    if not _is_sync(h) or find_blank(block) is None:
        return None
    seq = (block_header(block, "X-Delta-Seq") or "").strip()
    return (header(h, "To") or "").strip("<> "), block_header(block, "X-Writer-ID") or LOCAL, int(seq) if seq.isdigit() else 0, block
