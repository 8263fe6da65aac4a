"""python -m deltaweave.cli COMMAND ...: the library's operators on files."""

from __future__ import annotations

import argparse
import json
import sys

from . import documents
from .sources import readers, wire


def _spark():
    from .session import session

    s = session(master="local[*]", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


def _show(df) -> None:
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def _raw(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _graph(path: str):
    from .operators.graph import analyse
    from .tools import CallGraph

    with open(path, encoding="utf-8") as f:
        return CallGraph(analyse(_spark().createDataFrame([(path, f.read())], "binary string, listing string")))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deltaweave")
    sub = p.add_subparsers(dest="cmd", required=True)

    def cmd(name: str, *args: str, **options: str | None):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("*"), nargs="*" if a.endswith("*") else None)
        for k, v in options.items():
            c.add_argument("--" + k, default=v)
        return c

    cmd("create", "file", "entity", "subject")
    cmd("mount", "file")
    cmd("get", "file", "section", key=None, passphrase=None)
    cmd("kv-get", "file", "table", "key")
    cmd("kv-set", "file", "table", "key", "value", writer=wire.LOCAL)
    cmd("kv-del", "file", "table", "key", writer=wire.LOCAL)
    cmd("kv-dump", "file")
    cmd("query", "folder", "query")
    cmd("insert", "folder", "id", "body", tag="", device="", ts="0")
    cmd("index", "folder")
    cmd("find", "folder", "query")
    cmd("mkdir", "folder", "name", "contains*", query=None)
    cmd("members", "folder")
    cmd("tag", "file", "tag")
    cmd("send", "bus", "sender", "to", "event", "body")
    cmd("pending", "bus")
    cmd("heads", "file")
    cmd("push", "file", "writer", "bus", to="*", since="0")
    cmd("pull", "file", "bus", "checkpoint")
    cmd("receive", "file", "maildir", "checkpoint")
    cmd("letter", "file", "writer", "to", "out", since="0")
    cmd("verify", "path")
    cmd("compact", "file", "out")
    cmd("repair", "file")
    cmd("pack", "folder", "file", "entity")
    cmd("unpack", "file", "folder")
    cmd("doc-init", "file")
    cmd("doc-add", "file", "text", writer=wire.LOCAL, after=None)
    cmd("doc-set", "file", "id", "text", writer=wire.LOCAL)
    cmd("doc-del", "file", "id", writer=wire.LOCAL)
    cmd("doc-list", "file")
    cmd("doc-edit", "file", "new", writer=wire.LOCAL)
    cmd("doc-log", "file")
    cmd("doc-revert", "file", "n")
    cmd("callers", "listing", "name")
    cmd("graph", "listing")
    cmd("dot", "listing")
    cmd("wave", "listing", "func", "arg", "type", depth="3")
    cmd("cluster", "listing", "pattern")
    cmd("diff", "listing", "other")
    cmd("lift", "listing", "func", structured=None)
    cmd("recon", "file")
    cmd("site", "folder", "out")
    cmd("front-matter", "folder", "out")
    a = p.parse_args(argv)
    c = a.cmd
    if c == "create":
        wire.write_file(a.file, wire.build(a.entity, a.subject, []))
    elif c == "mount":
        box = wire.read(_raw(a.file))
        print(box.entity, len(box.sections), "sections", len(box.tail), "blocks")
        for s in box.sections:
            print(s["id"], s["ct"], s["len"], s.get("enc", "raw"), sep="\t")
    elif c == "get":
        from .functions.codec import key_from

        data = wire.read(_raw(a.file)).section(a.section, key_from(a.key, a.passphrase))
        if data is None:
            print("no such section", file=sys.stderr)
            return 1
        sys.stdout.buffer.write(data)
    elif c == "kv-get":
        from .operators.replay import lookup

        _show(lookup(documents.state(_spark(), a.file), a.table, a.key).select("value"))
    elif c == "kv-set":
        documents.put(a.file, a.table, a.key, json.loads(a.value), a.writer)
    elif c == "kv-del":
        documents.remove(a.file, a.table, a.key, a.writer)
    elif c == "kv-dump":
        _show(documents.state(_spark(), a.file).orderBy("tbl", "key"))
    elif c == "query":
        from .operators.store import query_records

        _show(query_records(readers.records(_spark(), a.folder), a.query).select("record_id").orderBy("record_id"))
    elif c == "insert":
        wire.insert_record(a.folder, a.id, [t for t in a.tag.split(",") if t], a.device, int(a.ts), json.loads(a.body))
    elif c in ("index", "find", "members"):
        from .operators import store

        s = _spark()
        index = store.store_index(readers.containers(s, a.folder), documents.state(s, a.folder, strict=False))
        _show(index.select("entity", "eml_type", "subject", "tags").orderBy("entity") if c == "index" else store.query_store(index, a.query).select("entity").orderBy("entity") if c == "find" else store.resolve(index, store.directories(index)).orderBy("directory", "place"))
    elif c == "mkdir":
        from .operators.store import make_directory

        wire.write_file(f"{a.folder}/{a.name}.eml", make_directory(a.name, a.query, a.contains))
    elif c == "tag":
        documents.put(a.file, "tags", a.tag, True)
    elif c == "send":
        print(wire.send(a.bus, a.sender, a.to, a.event, json.loads(a.body)))
    elif c == "pending":
        _show(readers.pending(_spark(), a.bus))
    elif c == "heads":
        from .operators.replay import heads

        _show(heads(readers.containers(_spark(), a.file, "deltas")).orderBy("writer"))
    elif c == "push":
        from .streaming.replicate import push

        print(push(_spark(), a.file, a.writer, a.bus, a.to, int(a.since)))
    elif c in ("pull", "receive"):
        from .streaming import replicate

        s = _spark()
        box = wire.read(_raw(a.file))
        blocks = replicate.bus_blocks(s, a.bus) if c == "pull" else replicate.mail_blocks(s, a.maildir)
        out = replicate.pull(blocks, box.entity or "", box.base_hash)
        out.writeStream.foreachBatch(replicate.append_to(a.file)).option("checkpointLocation", a.checkpoint).trigger(availableNow=True).start().awaitTermination()
    elif c == "letter":
        box = wire.read(_raw(a.file))
        blocks = [(e["seq"], box.block(e)) for e in box.tail if e["writer"] == a.writer and e["seq"] > int(a.since)]
        wire.write_file(a.out, wire.letter(box.entity or "", a.to, a.writer, blocks, box.product))
    elif c == "verify":
        from .operators.integrity import verify_path

        issues = verify_path(_spark(), a.path).collect()
        for r in issues:
            print(r.path, r.issue, sep="\t")
        return int(bool(issues))
    elif c == "compact":
        print(*documents.compact(_spark(), a.file, a.out))
    elif c == "repair":
        raw, n = wire.repair(_raw(a.file))
        wire.write_file(a.file, raw)
        print(n)
    elif c == "pack":
        wire.write_file(a.file, readers.pack(a.folder, a.entity))
    elif c == "unpack":
        print(readers.unpack(_raw(a.file), a.folder))
    elif c == "doc-init":
        documents.init(a.file)
    elif c == "doc-add":
        print(documents.add(a.file, a.text, a.writer, a.after))
    elif c == "doc-set":
        print(documents.set_line(a.file, a.id, a.text, a.writer))
    elif c == "doc-del":
        print(documents.delete(a.file, a.id, a.writer))
    elif c == "doc-list":
        _show(documents.lines(_spark(), a.file).select("id", "v"))
    elif c == "doc-edit":
        print(documents.edit(_spark(), a.file, _raw(a.new).decode(), a.writer))
    elif c == "doc-log":
        _show(documents.log(_spark(), a.file))
    elif c == "doc-revert":
        print(*documents.revert(a.file, int(a.n)))
    elif c in ("callers", "graph", "dot", "wave", "cluster", "diff", "lift"):
        from pyspark.sql import functions as F

        from .operators import graph, lift

        g = _graph(a.listing)
        if c == "lift":
            f = lift.lift_structured if a.structured else lift.lift_linear
            _show(g.functions.where(F.col("name") == a.func).select(f("listing")))
        else:
            _show({"callers": lambda: g.get_callers(a.name), "graph": g.graph, "dot": lambda: graph.dot(g.edges), "wave": lambda: g.wave(a.func, int(a.arg.removeprefix("arg")), a.type, int(a.depth)), "cluster": lambda: g.cluster(a.pattern), "diff": lambda: g.diff(_graph(a.other))}[c]())
    elif c == "recon":
        from .operators import binary

        files = _spark().read.format("binaryFile").load(a.file)
        _show(binary.regions(binary.block_entropy(files)).orderBy("path", "begin"))
        _show(binary.strings(files))
    else:
        from .operators import site

        posts = readers.posts(_spark(), a.folder)
        print(site.write_files(site.pages(posts) if c == "site" else site.front_matter(posts), a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
