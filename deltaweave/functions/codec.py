"""Encodings, hashes, keys and signatures."""

from __future__ import annotations

import hashlib
import os
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

#: Session settings with the key: 64 hex digits, or a pass-phrase.
KEY_CONF, PASS_CONF = "deltaweave.key", "deltaweave.passphrase"


class CodecError(ValueError):
    """An unknown encoding, a missing key or damaged content."""


def key_from(key_hex: str | None = None, passphrase: str | None = None) -> bytes | None:
    """The 32-byte key from 64 hex digits, else from a pass-phrase's SHA-256; None without either."""
    if key_hex:
        try:
            key = bytes.fromhex(key_hex.strip())
        except ValueError as e:
            raise CodecError("the key isn't hexadecimal") from e
        if len(key) != 32:
            raise CodecError("the key must have 64 hex digits")
        return key
    return hashlib.sha256(passphrase.encode()).digest() if passphrase else None


def session_key(spark) -> bytes | None:
    return key_from(spark.conf.get(KEY_CONF, None), spark.conf.get(PASS_CONF, None))


# --- AES-256-GCM without a library: counter mode and GHASH over AES

_SBOX: list[int] = []


def _tables() -> None:
    p = q = 1
    box = [0] * 256
    while True:
        p = p ^ (p << 1) & 0xFF ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        rot = lambda n: (q << n | q >> (8 - n)) & 0xFF
        box[p] = q ^ rot(1) ^ rot(2) ^ rot(3) ^ rot(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    _SBOX.extend(box)


def _expand(key: bytes) -> list[list[int]]:
    if not _SBOX:
        _tables()
    words = [list(key[i : i + 4]) for i in range(0, 32, 4)]
    rcon = 1
    for i in range(8, 60):
        w = list(words[-1])
        if i % 8 == 0:
            w = [_SBOX[x] for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = rcon << 1
        elif i % 8 == 4:
            w = [_SBOX[x] for x in w]
        words.append([a ^ b for a, b in zip(words[-8], w, strict=True)])
    return [sum(words[4 * r : 4 * r + 4], []) for r in range(15)]


def _block(keys: list[list[int]], data: bytes) -> bytes:
    s = [a ^ b for a, b in zip(data, keys[0], strict=True)]
    for r in range(1, 15):
        s = [_SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < 14:
            out = []
            for c in range(0, 16, 4):
                col = s[c : c + 4]
                t = col[0] ^ col[1] ^ col[2] ^ col[3]
                for i in range(4):
                    x = col[i] ^ col[(i + 1) % 4]
                    out.append(col[i] ^ t ^ ((x << 1) ^ (0x1B if x & 0x80 else 0)) & 0xFF)
            s = out
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def _ghash(h: int, data: bytes) -> int:
    y = 0
    for i in range(0, len(data), 16):
        y ^= int.from_bytes(data[i : i + 16].ljust(16, b"\0"), "big")
        z, v = 0, h
        for bit in range(127, -1, -1):
            if y >> bit & 1:
                z ^= v
            v = v >> 1 ^ (0xE1 << 120 if v & 1 else 0)
        y = z
    return y


def _gcm(key: bytes, nonce: bytes, data: bytes, cipher: bytes | None) -> tuple[bytes, bytes]:
    """data in counter mode, and the tag over the cipher text (that result, if cipher is None)."""
    keys = _expand(key)
    h = int.from_bytes(_block(keys, bytes(16)), "big")
    stream = b"".join(_block(keys, nonce + (2 + i).to_bytes(4, "big")) for i in range(-(-len(data) // 16)))
    out = bytes(a ^ b for a, b in zip(data, stream, strict=False))
    text = out if cipher is None else cipher
    pad = text.ljust(-(-len(text) // 16) * 16, b"\0")
    s = _ghash(h, pad + (0).to_bytes(8, "big") + (8 * len(text)).to_bytes(8, "big"))
    tag = s ^ int.from_bytes(_block(keys, nonce + b"\0\0\0\1"), "big")
    return out, tag.to_bytes(16, "big")


def encrypt(key: bytes, data: bytes, nonce: bytes | None = None) -> bytes:
    """AES-256-GCM: a 12-byte nonce, the cipher text, the tag."""
    nonce = nonce or os.urandom(12)
    out, tag = _gcm(key, nonce, data, None)
    return nonce + out + tag


def decrypt(key: bytes, data: bytes) -> bytes:
    if len(data) < 28:
        raise CodecError("encrypted content is too short")
    nonce, body, tag = data[:12], data[12:-16], data[-16:]
    out, want = _gcm(key, nonce, body, body)
    if want != tag:
        raise CodecError("wrong key or damaged content")
    return out


def encode(enc: str, data: bytes, key: bytes | None = None) -> bytes:
    """data under raw, deflate (a zlib stream) or aes."""
    if enc == "raw":
        return data
    if enc == "deflate":
        return zlib.compress(data)
    if enc == "aes":
        if key is None:
            raise CodecError("aes needs a key")
        return encrypt(key, data)
    raise CodecError(f"unknown encoding: {enc}")


def decode(enc: str, data: bytes, key: bytes | None = None) -> bytes:
    if enc == "raw":
        return data
    if enc == "deflate":
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise CodecError(f"deflate: {e}") from e
    if enc == "aes":
        if key is None:
            raise CodecError("aes needs a key")
        return decrypt(key, data)
    raise CodecError(f"unknown encoding: {enc}")


# --- columns


@F.pandas_udf(BinaryType())
def inflate(col: pd.Series) -> pd.Series:
    return col.map(lambda b: None if b is None else zlib.decompress(b))


@F.pandas_udf(BinaryType())
def deflate(col: pd.Series) -> pd.Series:
    return col.map(lambda b: None if b is None else zlib.compress(b))


def decoded(enc: Column, payload: Column, key: Column | None = None) -> Column:
    """The content of an encoded binary column. AES runs in the JVM; without a key it gives null. An unknown encoding is an error."""
    opened = F.try_aes_decrypt(payload, key, F.lit("GCM")) if key is not None else F.lit(None).cast("binary")
    return (
        F.when(F.coalesce(enc, F.lit("raw")) == "raw", payload)
        .when(enc == "deflate", inflate(F.when(enc == "deflate", payload)))
        .when(enc == "aes", opened)
        .otherwise(F.raise_error(F.concat(F.lit("unknown encoding: "), enc)).cast("binary"))
    )


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


# --- Ed25519, by RFC 8032

_Q = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _Q - 2, _Q) % _Q
_I = pow(2, (_Q - 1) // 4, _Q)


def _add(a, b):
    x = (a[1] - a[0]) * (b[1] - b[0]) % _Q
    y = (a[1] + a[0]) * (b[1] + b[0]) % _Q
    t, z = 2 * a[3] * b[3] * _D % _Q, 2 * a[2] * b[2] % _Q
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % _Q, g * h % _Q, f * g % _Q, e * h % _Q


def _times(n: int, p):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


def _recover(y: int, sign: int) -> int | None:
    if y >= _Q:
        return None
    x2 = (y * y - 1) * pow(_D * y * y + 1, _Q - 2, _Q) % _Q
    x = pow(x2, (_Q + 3) // 8, _Q)
    if (x * x - x2) % _Q:
        x = x * _I % _Q
    if (x * x - x2) % _Q or (x == 0 and sign):
        return None
    return _Q - x if x & 1 != sign else x


_BY = 4 * pow(5, _Q - 2, _Q) % _Q
_BX = _recover(_BY, 0)
_BASE = (_BX, _BY, 1, _BX * _BY % _Q)


def _pack(p) -> bytes:
    z = pow(p[2], _Q - 2, _Q)
    x, y = p[0] * z % _Q, p[1] * z % _Q
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes):
    n = int.from_bytes(b, "little")
    y, sign = n & (1 << 255) - 1, n >> 255
    x = _recover(y, sign)
    return None if x is None else (x, y, 1, x * y % _Q)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pk = _pack(_times(a, _BASE))
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % _L
    rr = _pack(_times(r, _BASE))
    k = int.from_bytes(hashlib.sha512(rr + pk + message).digest(), "little") % _L
    return rr + ((r + k * a) % _L).to_bytes(32, "little")


def verify(pk: bytes, sig: bytes, message: bytes) -> bool:
    if len(pk) != 32 or len(sig) != 64:
        return False
    a, r, s = _unpack(pk), _unpack(sig[:32]), int.from_bytes(sig[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = int.from_bytes(hashlib.sha512(sig[:32] + pk + message).digest(), "little") % _L
    x, y = _times(s, _BASE), _add(r, _times(k, a))
    return (x[0] * y[2] - y[0] * x[2]) % _Q == 0 and (x[1] * y[2] - y[1] * x[2]) % _Q == 0


def verify_hex(pk: str, sig: str, message: bytes) -> bool:
    try:
        return verify(bytes.fromhex(pk), bytes.fromhex(sig), message)
    except ValueError:
        return False


@F.pandas_udf(BooleanType())
def signature_ok(pk: pd.Series, sig: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or s is None else verify_hex(p, s, m or b"") for p, s, m in zip(pk, sig, message, strict=True)], dtype=object)
