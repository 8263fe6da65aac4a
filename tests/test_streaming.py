import json
import shutil

from deltaweave import documents as D
from deltaweave.sources import wire
from deltaweave.streaming import replicate, runner


def two_copies(tmp_path):
    raw = wire.build("doc@system.local", "s", [wire.Section("state", "application/json", "", b'{"x":0}')])
    a, b = str(tmp_path / "a.eml"), str(tmp_path / "b.eml")
    for p in (a, b):
        wire.write_file(p, raw)
    return a, b


def pull(spark, path, bus, tmp_path):
    with open(path, "rb") as f:
        c = wire.read(f.read())
    out = replicate.pull(replicate.bus_blocks(spark, bus), c.entity, c.base_hash)
    out.writeStream.foreachBatch(replicate.append_to(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    with open(path, "rb") as f:
        return [e["seq"] for e in wire.read(f.read()).tail]


def test_blocks_wait_for_their_predecessors(spark, tmp_path):
    a, b = two_copies(tmp_path)
    for i in range(4):
        D.put(a, "state", "x", i, "A")
    every, bus = tmp_path / "all", tmp_path / "bus"
    assert replicate.push(spark, a, "A", str(every)) == 4 and replicate.push(spark, a, "A", str(tmp_path / "since"), since=3) == 1
    bus.mkdir()
    files = sorted(every.iterdir())
    for i, got in ((3, []), (1, []), (0, [1, 2]), (2, [1, 2, 3, 4])):
        shutil.copy(files[i], bus)
        assert pull(spark, b, str(bus), tmp_path) == got
    shutil.copy(files[1], bus / "again.msg.eml")
    assert pull(spark, b, str(bus), tmp_path) == [1, 2, 3, 4]
    assert {(r.key, r.value) for r in D.state(spark, b).collect()} == {("x", "3")}
    with open(a, "rb") as x, open(b, "rb") as y:
        assert [e["hash"] for e in wire.read(x.read()).tail] == [e["hash"] for e in wire.read(y.read()).tail]


def test_letters_and_strangers(spark, tmp_path):
    a, b = two_copies(tmp_path)
    D.put(a, "state", "x", 1, "A")
    with open(a, "rb") as f:
        c = wire.read(f.read())
    mail = tmp_path / "mail"
    for d in ("new", "cur"):
        (mail / d).mkdir(parents=True)
    (mail / "new" / "1").write_bytes(wire.letter(c.entity, "b", "A", [(1, c.block(c.tail[0]))]))
    (mail / "cur" / "2").write_bytes(b"Subject: hi\r\n\r\nhello")
    out = replicate.pull(replicate.mail_blocks(spark, str(mail)), c.entity, c.base_hash)
    out.writeStream.foreachBatch(replicate.append_to(b)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    with open(b, "rb") as f:
        assert [e["hash"] for e in wire.read(f.read()).tail] == [c.tail[0]["hash"]]


def test_advance_checks_the_chain():
    raw = wire.build("e", "s", [])
    one = wire.append_delta(raw, {"op": "set", "table": "t", "key": "k", "value": 1, "ts": 1}, "A")
    c = wire.read(one)
    block = c.block(c.tail[0])
    head, got, known = replicate.advance((0, None), {1: block}, c.base_hash)
    assert head == (1, c.tail[0]["hash"]) and got[0][2] == block and known == 0
    waiting = {1: block}
    assert replicate.advance((0, None), waiting, "other")[1] == [] and waiting
    assert replicate.advance((1, "h"), {1: block}, None)[2] == 1


def make_game():
    def game(state, event):
        if event["event"] == "MOVE":
            return [{"op": "set", "table": "state", "key": k, "value": state.get(k, 0) + event.get("d" + k, 0)} for k in "xy"], []
        if event["event"] == "FIRE":
            n = state.get("shots", 0) + 1
            return [{"op": "set", "table": "state", "key": "shots", "value": n}], [{"to": "<view>", "event": "SHOT", "data": {"shots": n}}]
        return [], []

    return game


def test_events_change_state_and_emit(spark, tmp_path):
    bus, outbox = tmp_path / "bus", tmp_path / "out"
    send = lambda to, ev, body: wire.send(str(bus), "pad", to, ev, body)
    send("game", "MOVE", {"dx": 5, "dy": -3})
    send("game", "FIRE", {})
    send("other", "MOVE", {"dx": 100})
    done = []

    def once():
        q = runner.run(runner.bus(spark, str(bus)), {"game": make_game()}, {"game": {"x": 42, "y": 108, "shots": 0}})

        def batch(df, epoch):
            done.extend(df.collect())
            runner.deliver(str(outbox))(df, epoch)

        q.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    once()
    assert {(r.key, r.value) for r in done if r.kind == "op"} == {("x", "47"), ("y", "105"), ("shots", "1")}
    sent = [wire.parse_message(p.read_bytes()) for p in outbox.iterdir()]
    assert [(m["to"], m["event"], m["body"]) for m in sent] == [("view", "SHOT", {"shots": 1})]
    done.clear()
    send("*", "MOVE", {"dx": 1})
    send("game", "MOVE", {"dx": 2})
    once()  # state is kept, and what was done isn't done again
    assert [json.loads(r.value) for r in done if r.key == "x"] == [48, 50]
