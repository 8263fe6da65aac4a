import json
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.functions import codec, text
from deltaweave.operators.integrity import verify_path
from deltaweave.sources import readers, wire


def state(n=1):
    return wire.build("bank@system.local", "bank", [wire.Section.table("state", {"n": n})])


def set_(key, value, ts, table="state"):
    return {"op": "set", "table": table, "key": key, "value": value, "ts": ts}


def issues(spark, tmp_path, raw):
    p = tmp_path / "c.eml"
    p.write_bytes(raw)
    return [r.issue for r in verify_path(spark, str(p)).collect()]


def test_sections_keep_their_bytes():
    data = bytes(range(256)) * 3
    raw = wire.build("e", "s", [wire.Section("a", "application/octet-stream", "a.bin", data), wire.Section("b", "text/plain", "b", b"x" * 500, "deflate")])
    c = wire.read(raw)
    assert c.section("a") == data and c.section("b") == b"x" * 500 and c.section("none") is None
    assert c.base_hash == wire.sha(raw[: c.base_end]) and len(raw) == c.tail_off + len(b'{"entries":[],"v":1}') + wire.TRAILER
    for i in range(5):
        raw = wire.append_delta(raw, set_("k", i, i))
        assert wire.read(raw).section("a") == data


def test_blocks_must_follow_their_writers_head():
    raw = state()
    one = wire.append_delta(raw, set_("x", 1, 1), "A")
    two = wire.append_delta(one, set_("x", 2, 2), "A")
    block = wire.read(two).block(wire.read(two).tail[1])
    with pytest.raises(wire.WireError):
        wire.append(raw, block)  # its predecessor is missing
    assert wire.append(one, block) == two
    with pytest.raises(wire.WireError):
        wire.append(two, block)
    with pytest.raises(wire.WireError):
        wire.append(one, block, "B")
    with pytest.raises(wire.WireError):
        wire.append(one, b"X-Other: 1\r\n\r\n{}")


def test_sound_containers_have_no_issues(spark, tmp_path):
    raw = state()
    for i in range(3):
        raw = wire.append_delta(raw, set_("n", i, i), "AB"[i % 2])
    assert issues(spark, tmp_path, raw) == []
    flipped = raw.replace(b'{"n":1}', b'{"n":2}', 1)
    assert any("base hash" in x for x in issues(spark, tmp_path, flipped))
    tail = wire.read(raw).tail
    at = tail[1]["off"] + tail[1]["len"] - 2
    assert any("hash mismatch" in x for x in issues(spark, tmp_path, raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]))


def test_line_feeds_alone_and_no_writer(spark, tmp_path):
    c = wire.read(state())
    head = wire.head_block((f"X-{wire.PRODUCT}-Delta", "v1"), ("X-Delta-Seq", 1), ("X-Prev-Hash", c.base_hash)).replace(b"\r\n", b"\n")
    block = head + wire.dump(set_("n", 5, 1))
    raw = wire.append(c.raw, block)
    assert wire.read(raw).tail[0]["writer"] == "local" and wire.parse_delta(block)["value"] == 5 and issues(spark, tmp_path, raw) == []


def test_signed_blocks(spark, tmp_path):
    seed = bytes(range(32))
    raw = wire.append_delta(state(), set_("n", 5, 1), "w", seed=seed)
    assert issues(spark, tmp_path, raw) == []
    c = wire.read(raw)
    block = c.block(c.tail[0])
    forged = block.replace(b'"value":5', b'"value":6')
    bad = wire.append(state_like(c), forged)
    assert any("bad signature" in x for x in issues(spark, tmp_path, bad))


def state_like(c):
    return c.raw[: c.base_end] + wire._closing(c.product, c.entity, c.base_hash, [], c.base_end)


def test_repair_and_rollback():
    raw = state()
    for i in range(5):
        raw = wire.append_delta(raw, set_("n", i, i))
    fixed, n = wire.repair(raw)
    assert n == 5 and fixed == raw
    last = wire.read(raw).tail[-1]
    torn, n = wire.repair(raw[: last["off"] + 150])
    assert n == 4 and wire.parse_delta(wire.read(torn).block(wire.read(torn).tail[-1]))["value"] == 3
    back, n = wire.repair(raw, 1)
    assert n == 1 and len(wire.read(back).tail) == 1 and wire.read(back).tail_hash == wire.read(back).tail[0]["hash"]
    assert wire.repair(raw, 0)[1] == 0
    with pytest.raises(wire.WireError):
        wire.repair(state())


def test_encrypted(tmp_path):
    key = codec.key_from(passphrase="kv-secret")
    raw = wire.build("b", "b", [wire.Section("state", "application/json", "s", b'{"balance":0}', "aes")], key=key)
    raw = wire.append_delta(raw, set_("balance", 1000, 1), key=key)
    assert b"balance" not in raw and wire.read(raw).section("state", key) == b'{"balance":0}'
    assert wire.parse_delta(wire.read(raw).block(wire.read(raw).tail[0]), key)["value"] == 1000
    for k in (None, codec.key_from(passphrase="other")):
        with pytest.raises(codec.CodecError):
            wire.read(raw).section("state", k)
    assert wire.repair(raw)[0] == raw


def test_published_vectors(spark):
    assert codec.encrypt(bytes(32), bytes(16), bytes(12)).hex()[24:] == "cea7403d4d606b6e074ec5d3baf39d18d0d1c8a799996bf0265b98b5d48ab919"
    sk = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert codec.public_key(sk).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = codec.sign(sk, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a") and codec.verify(codec.public_key(sk), sig, b"") and not codec.verify(codec.public_key(sk), sig, b"x")
    assert not codec.verify_hex("zz", sig.hex(), b"")
    key, data = os.urandom(32), os.urandom(77)
    row = spark.createDataFrame([(codec.encrypt(key, data), key)], "d binary, k binary").selectExpr("aes_decrypt(d, k, 'GCM') as x").first()
    assert bytes(row.x) == data and codec.decrypt(key, codec.encrypt(key, data)) == data


def test_encodings(spark):
    from pyspark.sql import functions as F

    data = b"hello world " * 9
    assert len(codec.encode("deflate", data)) < len(data) and codec.decode("deflate", codec.encode("deflate", data)) == data
    with pytest.raises(codec.CodecError):
        codec.encode("zip", data)
    key = codec.key_from("07" * 32)
    rows = [("raw", data), ("deflate", zlib.compress(data)), ("aes", codec.encrypt(key, data))]
    df = spark.createDataFrame(rows, "enc string, payload binary")
    assert {bytes(r.x) for r in df.select(codec.decoded(F.col("enc"), F.col("payload"), F.lit(key)).alias("x")).collect()} == {data}
    for bad in ("12", "zz" * 32):
        with pytest.raises(codec.CodecError):
            codec.key_from(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[A-Za-z][A-Za-z-]{0,8}", fullmatch=True), st.from_regex(r"[!-9;-~]{0,12}", fullmatch=True)), max_size=5))
def test_headers_round_trip(pairs):
    assert text.parse_headers("".join(f"{k}: {v}\r\n" for k, v in pairs).encode()) == pairs


def test_header_details(spark):
    from pyspark.sql import functions as F

    raw = "A: 1\r\n two\r\nnone\r\nB:x:y\n\tz\na: 3"
    want = [("A", "1 two"), ("B", "x:y z"), ("a", "3")]
    assert text.parse_headers(raw.encode()) == want and text.header(want, "a") == "1 two"
    got = spark.createDataFrame([(raw,)], "t string").select(text.headers_column(F.col("t")).alias("h")).first().h
    assert [(h.k, h.v) for h in got] == want
    assert text.find_blank(b"a\n\nb\r\n\r\n") == (4, 4) and text.find_blank(b"a\n\nb") == (1, 2) and text.find_blank(b"a") is None


def test_records_are_read_by_their_headers(spark, tmp_path):
    db = str(tmp_path / "db")
    for i in range(50):
        wire.insert_record(db, f"rec_{i:04}", ["sensor_data", "telemetry" if i % 10 == 0 else "status_ok"], "node_01" if i % 2 else "", 1786528800 + i, {"temp": 24.5, "pad": "x" * 9000})
    (tmp_path / "db" / "rec_0007.eml").write_bytes(b"junk")
    from deltaweave.operators.store import query_records, record_stats

    rec = readers.records(spark, db).cache()
    n = lambda q: query_records(rec, q).count()
    assert record_stats(rec).first()[:3] == (49, 49 * 512, 1)
    assert n('X-Tag == "telemetry"') == 5 and n("X-Timestamp >= 1786528810 AND X-Timestamp < 1786528820") == 10 and n('X-Tag == "telemetry" AND X-Tag == "status_ok"') == 0
    assert n('X-Device-ID == "node_01"') == 24 and n('X-Device-ID != "node_01"') == 25
    for bad in ("../../etc/passwd", "a/b", "..", "", "."):
        with pytest.raises(wire.WireError):
            wire.insert_record(db, bad, [], "", 0, {})
    spark.createDataFrame([("new_1", ["t"], "d", 5, '{"a": 1}')], "record_id string, tags array<string>, device string, ts bigint, body string").write.format("weave_records").mode("append").save(db)
    assert query_records(readers.records(spark, db), 'X-Tag == "t"').first().record_id == "new_1"


def test_pack_and_unpack(tmp_path, spark):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("hi")
    (src / "sub" / "b.json").write_text("{}")
    (src / "c.bin").write_bytes(bytes(range(256)))
    raw = readers.pack(str(src), "pack@system.local")
    assert readers.unpack(raw, str(tmp_path / "out")) == 3 and (tmp_path / "out/sub/b.json").read_text() == "{}" and (tmp_path / "out/c.bin").read_bytes() == bytes(range(256))
    assert {(r.id, r.ct) for r in readers.directory(spark, str(src)).collect()} == {("a.txt", "text/plain"), ("sub/b.json", "application/json"), ("c.bin", "application/octet-stream")}
    for bad in ("../../evil", "/abs/evil"):
        evil = wire.build("e", "s", [wire.Section("ok.txt", "text/plain", "", b"1"), wire.Section(bad, "text/plain", "", b"2")])
        with pytest.raises(wire.WireError):
            readers.unpack(evil, str(tmp_path / "out2"))
        assert not (tmp_path / "out2").exists()
    (tmp_path / "empty").mkdir()
    with pytest.raises(wire.WireError):
        readers.pack(str(tmp_path / "empty"), "e")


def test_letters(spark, tmp_path):
    raw = state()
    for i in range(2):
        raw = wire.append_delta(raw, set_("n", f"line\r\n{i}\n", i), "devA")
    c = wire.read(raw)
    blocks = [(e["seq"], c.block(e)) for e in c.tail]
    mail = wire.letter(c.entity, "b@x", "devA", blocks)
    assert [(w, s, b) for w, s, b in wire.open_letter(mail)] == [("devA", s, b) for s, b in blocks]
    assert wire.open_letter(b"Subject: hello\r\n\r\nbody") == []
    m = wire.sync_message("e", "*", "devA", blocks[0][1])
    assert wire.open_sync(m) == ("*", "devA", 1, blocks[0][1]) and wire.open_sync(b"From: x\r\n\r\nnothing") is None
    (tmp_path / "l.eml").write_bytes(mail)
    (tmp_path / "m.eml").write_bytes(m)
    (tmp_path / "x.eml").write_bytes(b"none")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert readers.letter_blocks(files).count() == 3


def test_messages(spark, tmp_path):
    path = wire.send(str(tmp_path), "a", "b", "MO VE/x", {"dx": 1})
    assert path.endswith(".MO_VE_x.msg.eml") and wire.parse_message(open(path, "rb").read()) == {"sender": "a@system.local", "to": "b", "event": "MO VE/x", "body": {"dx": 1}}
    (tmp_path / "z.msg.eml").write_bytes(b"To: <c>\r\n\r\nnot json")
    got = readers.pending(spark, str(tmp_path)).collect()
    assert [(r.recipient, json.loads(r.body)) for r in got] == [("b", {"dx": 1}), ("c", {})]
