import pytest

from deltaweave.operators import binary, graph, lift
from deltaweave.tools import CallGraph

LISTING = """
0000000000001119 <net_send>:
    1119:\tpush   rbp
    111a:\tcall   1050 <helper>
    111f:\tret

000000000000111b <player_move>:
    111b:\tcall   1119 <net_send>
    1120:\tret

0000000000001120 <main>:
    1120:\tcall   111b <player_move>
    1125:\tcall   1119 <net_send>
    112a:\tret
"""
SAVED = """
0000000000001119 <net_send>:
    1119:\tret
000000000000115a <player_take_damage>:
    115a:\tpush   rbp
    115b:\tmov    rbp,rsp
    1162:\tmov    QWORD PTR [rbp-0x8],rdi
    1170:\tmov    rax,QWORD PTR [rbp-0x8]
    1174:\tmov    rsi,rax
    1186:\tcall   1119 <net_send>
    1190:\tret
0000000000001200 <main>:
    1200:\tmov    edi,0x5
    1205:\tcall   115a <player_take_damage>
    120a:\tret
"""


@pytest.fixture(scope="module")
def parsed(spark):
    return graph.analyse(spark.createDataFrame([("b", LISTING)], "binary string, listing string")).cache()


def test_edges(spark, parsed):
    edges = graph.call_edges(parsed)
    assert {(r.caller, r.callee) for r in edges.collect()} == {("net_send", "helper"), ("player_move", "net_send"), ("main", "player_move"), ("main", "net_send")}
    assert graph.callers(edges, "player_move").first().callers == ["main"]
    assert [(r.name, r.callees) for r in graph.callees(parsed, edges).orderBy("name").collect()] == [("main", ["player_move", "net_send"]), ("net_send", ["helper"]), ("player_move", ["net_send"])]
    assert '  "main" -> "player_move";' in [r.value for r in graph.dot(edges).collect()]
    assert graph.call_sites(parsed).where("caller = 'main' and site_no = 0").count() == 6


def test_wave(spark, parsed):
    g = CallGraph(parsed)
    assert [r.func for r in g.wave("net_send", 0, "Packet", 0).collect()] == ["net_send"]
    assert [(r.func, r.arg) for r in g.wave("net_send", 0, "Packet", 2).collect()] == [("net_send", 0), ("main", 0), ("player_move", 0)]
    assert {(r.func, tuple(r.types)) for r in g.types().collect()} == {(f, ("arg0=Packet",)) for f in ("net_send", "main", "player_move")}
    g.wave("net_send", 0, "Other", 2)
    assert all(r.types == ["arg0=Packet"] for r in g.types().collect())  # a type isn't overwritten
    assert graph.wave(parsed, g.passed, "nobody", 0).count() == 0


def test_wave_through_saved_parameters(spark):
    p = graph.analyse(spark.createDataFrame([("b", SAVED)], "binary string, listing string"))
    got = graph.wave(p, graph.passes(p), "net_send", 1, 5)
    assert sorted((r.func, r.arg) for r in got.collect()) == [("net_send", 1), ("player_take_damage", 0)]


def test_cluster_and_diff(spark, parsed):
    assert [r.name for r in graph.cluster(parsed, "PLAYER").orderBy("name").collect()] == ["main", "player_move"]
    moved = LISTING.replace("1119", "2229").replace("111a", "222a")
    b = graph.analyse(spark.createDataFrame([("b", moved.replace("<helper>", "<other>") + "0 <new>:\n 1:\tret\n")], "binary string, listing string"))
    assert [tuple(r) for r in graph.version_diff(parsed, b).orderBy("name").collect()] == [("net_send", "changed"), ("new", "added")]
    same = graph.analyse(spark.createDataFrame([("b", moved)], "binary string, listing string"))
    assert graph.version_diff(parsed, same).count() == 0


def test_normalised(spark):
    from pyspark.sql import functions as F

    from deltaweave.functions.text import normalised_lines

    raw = " 1:\t48 8d 05\tlea    rax,[rip+0xd18]        # 2004 <_IO+0x4>\n\n 2:\te8 00\tcall   1119 <net_send>\n 3:\tmov eax,[rip-0x10]\n"
    got = spark.createDataFrame([(raw,)], "t string").select(normalised_lines(F.col("t")).alias("x")).first().x
    assert got == "lea    rax,[rip+ADDR]       \ncall    <net_send>\nmov eax,[rip+ADDR]"


def test_branch(spark, parsed):
    b = graph.branch(parsed, "player_move", "b", 1)
    cells = {r.name: r for r in b.collect()}
    assert set(cells) == {"player_move@b", "main@b"} and cells["main@b"].callees == ["player_move@b", "net_send"] and cells["player_move@b"].root
    every = parsed.unionByName(b, allowMissingColumns=True)
    assert [tuple(r) for r in graph.branches(every).collect()] == [("b", "player_move@b", 2)]
    got = graph.wave(every, graph.passes(every), "player_move@b", 0, 2)
    assert {r.func for r in got.collect()} == {"player_move@b", "main@b"}
    assert graph.without_branch(every, "b").count() == 3


def test_lift():
    body = ["115a:\t55                    \tpush   rbp", "115b:\t48 89 e5              \tmov    rbp,rsp", "1162:\t48 89 7d f8           \tmov    QWORD PTR [rbp-0x8],rdi", "1186:\te8 xx                 \tcall   1119 <net_send>", "1190:\tc3                    \tret"]
    assert lift.linear(body) == ["push rbp;", "rbp = rsp;", "*[rbp-0x8] = rdi;", "net_send(...);", "return;"]
    for insn, want in (("lea rax,[rbp-4]", "rax = &*[rbp-4];"), ("xor eax,eax", "eax ^= eax;"), ("inc ecx", "ecx++;"), ("not eax", "eax = ~eax;"), ("jle 10", "if (<=) goto 10;"), ("jmp 5", "goto 5;"), ("nop", ""), ("hlt", "/* hlt  */"), ("sete al", "al = cond;")):
        assert lift.statement(insn) == want


def test_lift_structured():
    body = ["111b:\t55\tpush   rbp", "111c:\t8b\tmov    eax,DWORD PTR [rbp-0x8]", "111f:\t85 c0\ttest   eax,eax", "1121:\t7e 0a\tjle    112d", "1123:\tbf\tmov    edi,0x3", "1128:\te8 xx\tcall   114a <render_sprite>", "112d:\tc9\tleave", "112e:\tc3\tret"]
    out = lift.structured(body)
    assert 0 <= out.index("if (eax <= 0) {") < out.index("render_sprite") and "return;" in out
    assert lift.structured([]) == "" and lift.condition("jne", ("cmp", "a", "b")) == "a != b" and lift.condition("je", ("test", "a", "a")) == "(a & a) == 0"


def test_strings_and_regions(spark):
    import random

    blob = b"A" * 8192 + random.Random(1).randbytes(8192) + b"\0tail text here"
    files = spark.createDataFrame([("p", blob)], "path string, content binary")
    got = binary.regions(binary.block_entropy(files)).orderBy("begin").collect()
    assert [(r.begin, r.end, r["class"]) for r in got] == [(0, 8192, "plain"), (8192, 16384, "compressed"), (16384, len(blob), "plain")]
    texts = {(r.off, r.text) for r in binary.strings(files).collect()}
    assert (16385, "tail text here") in texts and any(o == 0 and t.startswith("A" * 8192) for o, t in texts)


def test_pointer_runs(spark):
    import struct

    words = [1, 0x1000, 0x1008, 0x10FF, 0x2000, 0x1000, 0x1001, 5, *([0x1010] * 4)]
    blob = b"\0" * 64 + struct.pack(f"<{len(words)}Q", *words)
    files = spark.createDataFrame([("p", blob)], "path string, content binary")
    secs = spark.createDataFrame([("p", ".text", 0x1000, 0, 0x100), ("p", ".rodata", 0x4000, 64, 8 * len(words)), ("p", ".bss", 0, 0, 0)], "path string, name string, vaddr bigint, off bigint, size bigint")
    assert [(r.vaddr, r.n) for r in binary.top_pointer_runs(binary.pointer_runs(files, secs)).collect()] == [(0x4000 + 64, 4), (0x4008, 3)]


def test_string_references(spark):
    t = "0 <f>:\n 1:\tlea rdi,[rip+1] # <hello>\n 2:\tlea rdi,[rip+2] # <hello>\n 3:\tlea # <bye>\n"
    p = graph.analyse(spark.createDataFrame([("b", t)], "binary string, listing string"))
    assert graph.string_references(p).first().refs == ["hello", "bye"]


def test_reach_of_a_complete_graph(spark):
    names = [f"f{i}" for i in range(12)]
    edges = spark.createDataFrame([(a, b, 0) for a in names for b in names], "caller string, callee string, pos int")
    assert sorted((r.name, r.depth) for r in graph.reach(edges, "f3", 6).collect()) == sorted([("f3", 0), *[(n, 1) for n in names if n != "f3"]])


def test_regions_equal_a_fold(spark):
    import random

    rng = random.Random(2)
    rows = [(p, i, 4096 * i, 4096 * (i + 1), rng.choice([1.0, 4.0, 5.0, 7.0, 7.9])) for p in "ab" for i in range(60)]
    want = []
    for p, _, a, b, e in rows:
        kind = "plain" if e < 4.5 else "code" if e < 7.5 else "compressed"
        if want and want[-1][0] == p and want[-1][4] == kind:
            want[-1] = (p, want[-1][1], b, (want[-1][3] + e) / 2, kind)
        else:
            want.append((p, a, b, e, kind))
    got = binary.regions(spark.createDataFrame(rows, "path string, block bigint, begin bigint, end bigint, entropy double")).orderBy("path", "begin").collect()
    assert [(*r[:3], round(r[3], 9), r[4]) for r in got] == [(*w[:3], round(w[3], 9), w[4]) for w in want]


def test_calls_see_ten_lines_back():
    body = ["mov rdi,rax", "mov esi,0x5", *["nop"] * 8, "call 1 <a>", "call 1 <b>", "call 1 <a>", "mov rdx,rbx", "call 1 <c>"]
    got = graph.parse_listing("\n".join(["0 <f>:", *body]))[0]
    every = list(enumerate(graph.REGISTERS))
    assert got["sites"] == [("a", [(1, "0x5"), (0, "rax")]), ("b", [(1, "0x5")]), ("a", every), ("c", [(2, "rbx")])] and got["callees"] == ["a", "b", "c"]
    assert all(args == graph.call_arguments(body[:at]) for (_, args), at in zip(got["sites"], (10, 11, 12, 14), strict=True))


def test_parsed_batches_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graph, "BATCH_ROWS", 4)
    rows = pa.RecordBatch.from_pydict({"binary": ["b", None, "c"], "listing": ["".join(f"0 <f{i}>:\ncall 1 <g>\n" for i in range(9)), None, "0 <h>:\n" + "x" * 99]})
    got = list(graph.parsed_batches(iter([rows])))
    assert [x.num_rows for x in got] == [4, 4, 2] and [n for x in got for n in x["name"].to_pylist()] == [*[f"f{i}" for i in range(9)], "h"]
    assert got[2].to_pylist()[1] == {"binary": "c", "name": "h", "listing": "x" * 99, "lines": 1, "callees": [], "sites": []}
    monkeypatch.setattr(graph, "BATCH_CHARS", 10)
    assert [x.num_rows for x in graph.parsed_batches(iter([rows]))] == [1] * 10


def test_callees_are_parsed_once(spark, data, parsed, capsys):
    from deltaweave.plans.queries import queries

    queries()["listing_callees"](spark, data).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, graph.own_callees(parsed).collect())) == sorted(map(tuple, graph.callees(parsed, graph.call_edges(parsed)).collect()))


def test_a_source_is_followed_once_a_function(monkeypatch):
    import pyarrow as pa

    body = ["mov QWORD PTR [rbp-0x8],rdi", "mov rsi,rax", *[f"call 1 <g{i}>" for i in range(9)], "nop", "mov rax,QWORD PTR [rbp-0x8]"]
    parsed = list(graph.parsed_batches(iter([pa.RecordBatch.from_pydict({"binary": ["b"] * 2, "listing": ["\n".join(["0 <f>:", *body]), "0 <none>:\nret"]})])))
    walks, walk = [], graph.parameter_of
    monkeypatch.setattr(graph, "parameter_of", lambda *a: walks.append(a[1]) or walk(*a))
    got = [x for b in graph.passed_batches(b.select(["name", "listing", "sites"]) for b in parsed) for x in b.to_pylist()]
    assert walks == ["rax"] and got == [{"caller": "f", "callee": f"g{i}", "callee_arg": 1, "caller_arg": 0} for i in range(9)]


def test_normalising_computes_no_value_twice(spark):
    from deltaweave.functions.text import normalised_lines

    t = "a\t1000 <f>\r\n\r\n \t55\tjmp  1f0 <f+0x3>  # note <s>\n10:\tlea rdi,[rip+0x0x1f ] \n[rip-9]\tx  dead <g> beef\n # all\n deadbeef\t<h>\nlast\r\r"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(normalised_lines(df.t)).collect()] == [" <f>\njmp   <f+0x3> \nlea rdi,[rip+ADDR]\nx   <g> beef\n# all\n<h>\nlast", None, ""]
    plan = df.select(normalised_lines(df.t))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan and "regexp_replace(regexp_replace" not in plan and "element_at(split(" not in plan


def test_recurring_instructions_are_lifted_once():
    lift._remembered.cache_clear()
    body = ["1:\tPUSH rbp", "2:\tcall 10 <f>", "3:\tmov rax,rdi", "4:\tcall", "5:\tcallq 0x1"] * 3
    assert lift.linear(body) == ["push rbp;", "f(...);", "rax = rdi;", "?(...);", "/* callq 0x1 */"] * 3
    assert lift._remembered.cache_info()[:2] == (6, 3)  # calls, whose targets differ, take no room


def test_tasks_of_regions_grow_with_the_blocks(spark, data, monkeypatch, capsys):
    from deltaweave.plans.queries import queries

    monkeypatch.setattr(binary, "TASK_BLOCKS", 100)
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 100)
    queries()["entropy_regions"](spark, data).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and f", {n}), REPARTITION_BY_NUM" in plan


def test_string_batches_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(binary, "BATCH_ROWS", 3)
    rows = pa.RecordBatch.from_pydict({"path": ["a", "b", None, "c"], "content": [b"abcdef\n" * 5, b"", b"12345\xff1234567", b"x" * 90]})
    got = list(binary.string_batches(iter([rows, rows.slice(3)])))
    every = [*[("a", 7 * i, 6, "abcdef") for i in range(5)], (None, 6, 7, "1234567"), ("c", 0, 90, "x" * 90), ("c", 0, 90, "x" * 90)]
    assert [b.num_rows for b in got] == [3, 3, 2] and [tuple(r.values()) for b in got for r in b.to_pylist()] == every
    monkeypatch.setattr(binary, "BATCH_CHARS", 12)
    assert [tuple(r.values()) for b in binary.string_batches(iter([rows, rows.slice(3)])) for r in b.to_pylist()] == every
