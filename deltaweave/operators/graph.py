"""Call graphs from disassembly listings: edges, callers, type waves, branches, version differences.

Tables: functions(name, listing), call_edges(caller, callee, pos), call_sites
(caller, site_no, callee, arg, src), arg_types(func, arg, type), passes(caller,
callee, callee_arg, caller_arg).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import body_hash
from ..storage import stored

#: Registers of the first six arguments in the System V calling convention.
REGISTERS = tuple("rdi rsi rdx rcx r8 r9".split())
#: Lines that are looked through: before a call for its arguments, at a function's start, and back from its end for a register.
SITE_LINES, SITE_ARGS, PROLOGUE, BACK = 10, 4, 8, 12
WAVE_DEPTH, BRANCH_DEPTH = 3, 2
#: Functions, and characters of their lines, of a batch that a parser hands on; lines whose parts are remembered.
BATCH_ROWS, BATCH_CHARS, MEMORY = 10_000, 1 << 24, 1 << 14


def _operands(line: str) -> tuple[str, str] | None:
    """The two operands after the first mov of a line, in lower case."""
    _, found, after = line.lower().partition("mov")
    parts = [p.strip() for p in after.split(",")]
    return (parts[0], parts[1]) if found and len(parts) == 2 else None


def _word(s: str, last: bool) -> str:
    parts = s.split()
    return "" if not parts else parts[-1 if last else 0]


@lru_cache(MEMORY)
def _bare(s: str) -> str:
    return re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", s.lower())


@lru_cache(MEMORY)
def _move(line: str) -> tuple[int, str] | None:
    """(argument, source) of a move into an argument's register."""
    two = _operands(line)
    if two is None:
        return None
    dst = _word(two[0], True)
    arg = next((i for i, r in enumerate(REGISTERS) if dst in (r, "e" + r[1:])), None)
    return None if arg is None else (arg, _word(two[1], False))


#: Arguments and sources of a call that all registers pass on.
_ALL = tuple(range(len(REGISTERS))), REGISTERS


def _last_moves(moves: list[tuple[int, str]]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """The arguments that moves set, the last one first, and their sources."""
    out: dict[int, str] = {}
    for arg, src in reversed(moves):
        out.setdefault(arg, src)
        if len(out) >= SITE_ARGS:
            break
    return (tuple(out), tuple(out.values())) if out else _ALL


def call_arguments(before: list[str]) -> list[tuple[int, str]]:
    """(argument, source) of a call by the moves before it; without any, all registers pass on."""
    return list(zip(*_last_moves([m for line in before[-SITE_LINES:] if (m := _move(line))]), strict=True))


_CALL = re.compile(r"call[^<]*<([^>]*)>")


def _functions(text: str) -> Iterator[tuple[str, list[str], dict[str, None], list[tuple]]]:
    """(name, lines, callees, call sites) of each function of a listing, one at a time."""
    name: str | None = None
    begin = 0
    lines = [raw.strip() for raw in text.split("\n")]
    for i, line in enumerate(lines):
        if line[-1:] in (">", ":") and " <" in line and (line.endswith(">:") or line.endswith(">") and ">:" in line):
            if name is not None:
                yield name, lines[begin:i], callees, sites
            name, begin, callees, sites, moves, args = line[line.index(" <") + 2 : -2], i + 1, {}, [], [], _ALL
            continue
        if name is None:
            continue
        if "call" in line and (m := _CALL.search(line)):
            if args is None or moves and moves[0][0] < i - SITE_LINES:
                moves = [x for x in moves if x[0] >= i - SITE_LINES]
                args = _last_moves([x for _, x in moves])
            callees[m[1]] = None
            sites.append((m[1], args))
        if "mov" in line.lower() and (x := _move(line)):
            moves, args = [*moves[1 - SITE_LINES :], (i, x)], None
    if name is not None:
        yield name, lines[begin:], callees, sites


def parse_listing(text: str) -> list[dict]:
    """Functions of a listing: name, lines, callees in the order of their first calls, call sites."""
    return [{"name": n, "body": b, "callees": list(c), "sites": [(s, list(zip(*a, strict=True))) for s, a in x]} for n, b, c, x in _functions(text)]


_PARSED = "binary string, name string, listing string, lines int, callees array<string>, sites array<struct<callee:string,args:array<struct<arg:int,src:string>>>>"


class _Parsed:
    """Columns of parsed functions, nested ones as flat lists with the places where each row begins."""

    def __init__(self):
        self.binary, self.name, self.listing, self.lines = [], [], [], []
        self.callees, self.callee_at = [], [0]
        self.site, self.site_at = [], [0]
        self.arg, self.src, self.arg_at = [], [], [0]
        self.chars = 0

    def add(self, binary: str | None, name: str, body: list[str], callees: dict[str, None], sites: list[tuple]) -> None:
        self.binary.append(binary)
        self.name.append(name)
        self.listing.append("\n".join(body))
        self.lines.append(len(body))
        self.callees += callees
        self.callee_at.append(len(self.callees))
        for callee, args in sites:
            self.site.append(callee)
            self.arg += args[0]
            self.src += args[1]
            self.arg_at.append(len(self.arg))
        self.site_at.append(len(self.site))
        self.chars += len(self.listing[-1])

    def batch(self) -> pa.RecordBatch:
        text, number = (lambda x: pa.array(x, pa.string())), (lambda x: pa.array(x, pa.int32()))
        nested = lambda at, values: pa.ListArray.from_arrays(number(at), values)
        args = nested(self.arg_at, pa.StructArray.from_arrays([number(self.arg), text(self.src)], ["arg", "src"]))
        sites = pa.StructArray.from_arrays([text(self.site), args], ["callee", "args"])
        return pa.RecordBatch.from_arrays([text(self.binary), text(self.name), text(self.listing), number(self.lines), nested(self.callee_at, text(self.callees)), nested(self.site_at, sites)], ["binary", "name", "listing", "lines", "callees", "sites"])


def parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Functions of batches of (binary, listing), in batches of BATCH_ROWS functions or, but for the last one's lines, BATCH_CHARS characters."""
    out = _Parsed()
    for batch in batches:
        for b, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for x in _functions(t.as_py() or ""):
                out.add(b, *x)
                if len(out.name) >= BATCH_ROWS or out.chars >= BATCH_CHARS:
                    yield out.batch()
                    out = _Parsed()
    if out.name:
        yield out.batch()


def analyse(listings: DataFrame) -> DataFrame:
    """Functions of listings (binary, listing), one row each, with callees and call sites."""
    return listings.select("binary", "listing").mapInArrow(parsed_batches, _PARSED)


def call_edges(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("name").alias("caller"), F.posexplode("callees").alias("pos", "callee")).select("caller", "callee", "pos")


def call_sites(parsed: DataFrame) -> DataFrame:
    sites = parsed.select(F.col("name").alias("caller"), F.posexplode("sites").alias("site_no", "s"))
    return sites.select("caller", "site_no", F.col("s.callee").alias("callee"), F.explode("s.args").alias("a")).select("caller", "site_no", "callee", "a.arg", "a.src")


def callees(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, callees) of every function."""
    own = edges.groupBy(F.col("caller").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "callee"))), lambda x: x["callee"]).alias("callees"))
    return functions.select("name").join(own, "name", "left").select("name", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


def own_callees(parsed: DataFrame) -> DataFrame:
    """(name, callees) of parsed functions as they stand, a row each: what callees gives where no two have one name."""
    return parsed.select("name", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


def callers(edges: DataFrame, name: str | None = None) -> DataFrame:
    """(callee, callers sorted) of all functions, or of one."""
    rows = edges if name is None else edges.where(F.col("callee") == name)
    return rows.groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


# --- what a caller passes on


def _slot(s: str) -> str | None:
    m = re.fullmatch(r"\[([^+\-]*)([+-])(.*)\]", s.strip())
    if not m or m[1].strip() != "rbp":
        return None
    return ("-" if "-" in s else "+") + re.sub(r"^(0x)+", "", m[3].strip())


@lru_cache(MEMORY)
def _saved(line: str) -> tuple[str, int] | None:
    """(stack slot, parameter) of a line that saves one."""
    two = _operands(line)
    slot = _slot(_word(two[0], True)) if two else None
    src = _word(two[1], False) if two else ""
    return (slot, REGISTERS.index(src)) if slot is not None and src in REGISTERS else None


def saved_parameters(body: list[str]) -> dict[str, int]:
    """Stack slots in which the first lines save parameters."""
    out: dict[str, int] = {}
    for line in body[:PROLOGUE]:
        if "mov" in line.lower() and (x := _saved(line)):
            out.setdefault(*x)
    return out


def _on_stack(s: str) -> int | None:
    m = re.fullmatch(r"\[([^+]*)\+(.*)\]", s.strip())
    if not m or m[1].strip() != "rbp":
        return None
    try:
        n = int(re.sub(r"^(0x)+", "", m[2].strip()), 16)
    except ValueError:
        return None
    return (n - 16) // 8 if n >= 16 else None


@lru_cache(MEMORY)
def _parts(after: str) -> tuple[list[str], str]:
    """Operands, and the first one's register."""
    parts = [p.strip() for p in after.split(",")]
    return parts, _bare(_word(parts[0], True))


def parameter_of(body: list[str], src: str, slots: dict[str, int]) -> int | None:
    """The parameter that a register holds at the body's last call, followed back through moves; None for anything else."""
    reg, calls = _bare(src), 0
    for raw in body[: -BACK - 1 : -1]:
        line = raw.lower()
        kind = "mov" if "mov" in line else "lea" if "lea" in line else None
        if kind is None:
            if "call" in line:
                calls += 1
                if calls > 1:
                    return None
            continue
        after = line[line.index(kind) + 3 :]
        if reg not in after:
            continue
        parts, dst = _parts(after)
        if len(parts) != 2 or not parts[0]:
            return None
        if dst != reg:
            continue
        value = parts[1]
        if "[" in value:
            at = value[value.rindex("[") :]
            slot = _slot(at)
            if slot is None:
                return None
            return slots.get(slot) if slot.startswith("-") else _on_stack(at)
        if value.startswith("0x") or value[:1].isdigit():
            return None
        reg = _bare(value)
    return None


def _rows(lists: pa.ListArray) -> tuple[list[int], list[int], pa.Array]:
    """Where each row's elements begin and end, and the elements of all rows; null lists have none."""
    at, null = lists.offsets.to_numpy().tolist(), lists.is_null().to_numpy(zero_copy_only=False).tolist()
    return at[:-1], [a if n else b for a, b, n in zip(at[:-1], at[1:], null, strict=True)], lists.values


def passed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """passes of batches of (name, listing, sites), in batches of little more than BATCH_ROWS rows."""
    schema = pa.schema([("caller", pa.string()), ("callee", pa.string()), ("callee_arg", pa.int32()), ("caller_arg", pa.int32())])
    out: list[list] = [[], [], [], []]
    for batch in batches:
        begin, end, sites = _rows(batch.column(2))
        arg_begin, arg_end, args = _rows(sites.field("args"))
        callee, arg, src = sites.field("callee").to_pylist(), args.field("arg").to_pylist(), args.field("src").to_pylist()
        for k, (name, listing) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            if begin[k] == end[k]:
                continue
            body = [x.strip() for x in (listing.as_py() or "").split("\n")]
            slots, seen = saved_parameters(body), set()
            held: dict[tuple[int, str], int | None] = {}  # the walk back starts at the body's end for every site
            for s in range(begin[k], end[k]):
                to = callee[s]
                for j in range(arg_begin[s], arg_end[s]):
                    i = arg[j]
                    if (to, i) in seen:
                        continue
                    key = i, src[j]
                    if key not in held:
                        held[key] = i if i < 6 and _bare(src[j]) == REGISTERS[i] else parameter_of(body, src[j], slots)
                    got = held[key]
                    if got is not None:
                        seen.add((to, i))
                        for column, x in zip(out, (name, to, i, got), strict=True):
                            column.append(x)
            if len(out[0]) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                out = [[], [], [], []]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def passes(parsed: DataFrame) -> DataFrame:
    """(caller, callee, callee_arg, caller_arg): arguments in which a caller passes on a parameter of its own; the first site that does."""
    return parsed.select("name", "listing", "sites").mapInArrow(passed_batches, "caller string, callee string, callee_arg int, caller_arg int")


# --- waves and branches


def wave(functions: DataFrame, passed: DataFrame, func: str, arg: int, max_depth: int = WAVE_DEPTH) -> DataFrame:
    """(func, arg, depth, path): functions that a type of one argument reaches through callers that pass it on.

    A function is reached once, by the first in breadth-first order, callers by
    name; path has the functions from the start to it, and sorting by depth and
    path gives that order. Every level is one join of the stored frontier with
    passed and one of the callers found with functions; Spark sends whichever
    side is small.
    """
    spark = functions.sparkSession
    names = functions.select(F.col("name").alias("func"))
    start = spark.createDataFrame([(func, arg, 0, [func])], "func string, arg int, depth int, path array<string>")
    front = seen = stored(start.join(names.where(F.col("func") == func).distinct(), "func"))
    for depth in range(1, max_depth + 1):
        step = front.select(F.col("func").alias("callee"), F.col("arg").alias("callee_arg"), "path").join(passed, ["callee", "callee_arg"])
        step = step.select(F.col("caller").alias("func"), F.col("caller_arg").alias("arg"), F.lit(depth).alias("depth"), F.concat("path", F.array("caller")).alias("path"))
        first = Window.partitionBy("func").orderBy("path", "arg")
        step = stored(step.join(seen.select("func"), "func", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
        front = stored(step.join(step.select("func").join(names, "func").distinct(), "func"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def mark(arg_types: DataFrame, reached: DataFrame, type_: str) -> DataFrame:
    """arg_types with the type on every reached argument that has none."""
    new = reached.select("func", "arg").distinct().join(arg_types, ["func", "arg"], "left_anti").withColumn("type", F.lit(type_))
    return arg_types.select("func", "arg", "type").unionByName(new.select("func", "arg", "type"))


def type_map(arg_types: DataFrame) -> DataFrame:
    """(func, types): arg=type of each function, by argument."""
    return arg_types.groupBy("func").agg(F.transform(F.array_sort(F.collect_list(F.struct("arg", "type"))), lambda x: F.format_string("arg%d=%s", x["arg"], x["type"])).alias("types"))


def signatures(arg_types: DataFrame) -> DataFrame:
    """(func, signature) of the typed functions."""
    args = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arg", "type"))), lambda x: F.format_string("%s arg%d", x["type"], x["arg"])), ", ")
    return arg_types.groupBy("func").agg(args.alias("_a")).select("func", F.concat(F.substring_index("func", "@", 1), F.lit("("), "_a", F.lit(")")).alias("signature"))


def reach(edges: DataFrame, func: str, depth: int) -> DataFrame:
    """(name, depth): a function and its callers up to a number of calls away, each by its least depth.

    Every level is one join of the stored frontier with edges; what has been
    reached isn't followed again, so the work is bounded by the edges.
    """
    seen = front = stored(edges.sparkSession.createDataFrame([(func, 0)], "name string, depth int"))
    for d in range(1, depth + 1):
        step = front.select(F.col("name").alias("callee")).join(edges.select("callee", "caller"), "callee").select(F.col("caller").alias("name")).distinct()
        front = stored(step.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def branch(parsed: DataFrame, func: str, name: str, depth: int = BRANCH_DEPTH) -> DataFrame:
    """Copies name@branch of a function and its callers, calling one another, with branch, root and origin."""
    inside = reach(call_edges(parsed), func, depth).select("name")
    own = inside.agg(F.collect_set("name").alias("_in"))
    rows = parsed.join(inside, "name", "left_semi").crossJoin(F.broadcast(own))
    link = lambda c: F.when(F.array_contains("_in", c), F.concat(c, F.lit(f"@{name}"))).otherwise(c)
    sites = F.transform("sites", lambda s: F.struct(link(s["callee"]).alias("callee"), s["args"].alias("args")))
    return rows.select("binary", F.concat("name", F.lit(f"@{name}")).alias("name"), "listing", "lines", F.transform("callees", link).alias("callees"), sites.alias("sites"), F.lit(name).alias("branch"), (F.col("name") == func).alias("root"), F.col("name").alias("origin"))


def branches(cells: DataFrame) -> DataFrame:
    """(branch, root, n) of the cells that belong to branches; a branch without a root has its least name."""
    return cells.where("branch is not null").groupBy("branch").agg(F.coalesce(F.min(F.when(F.col("root"), F.col("name"))), F.min("name")).alias("root"), F.count("*").alias("n"))


def without_branch(cells: DataFrame, name: str) -> DataFrame:
    return cells.where(~F.endswith("name", F.lit(f"@{name}")))


# --- search and comparison


def cluster(functions: DataFrame, pattern: str) -> DataFrame:
    """Names of functions in whose name or lines the pattern occurs, in any case."""
    return functions.where(F.contains(F.lower(F.concat_ws(" ", "name", "listing")), F.lit(pattern.lower()))).select("name")


def version_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, change): functions added, removed or changed from one version to the other, by their normalised lines."""
    x = a.select("name", body_hash(F.col("listing")).alias("x"), F.lit(1).alias("in_a"))
    y = b.select("name", body_hash(F.col("listing")).alias("y"), F.lit(1).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return x.join(y, "name", "full_outer").select("name", change.alias("change")).where("change is not null")


def string_references(parsed: DataFrame) -> DataFrame:
    """(name, refs): labels in the comments of each function's lines, in order, each once."""
    lines = F.filter(F.split("listing", "\n"), lambda x: F.contains(x, F.lit(" # <")))
    return parsed.select("name", F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r" # <(.*?)>*\s*$", 1))).alias("refs"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of the graph in the DOT language."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.orderBy("caller", "pos").select(F.concat(F.lit("  "), quote(F.col("caller")), F.lit(" -> "), quote(F.col("callee")), F.lit(";")).alias("value"))


def disassemble(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(binary, listing) of files (path), by objdump where the workers have it; an error where they don't."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                at = re.sub("^file:/+", "/", path)
                for style in (["-M", "intel"], []):
                    r = subprocess.run(["objdump", "-d", *style, at], capture_output=True)
                    if r.returncode == 0:
                        break
                else:
                    raise RuntimeError(f"objdump {at}: {r.stderr.decode(errors='replace')}")
                out.append((path, r.stdout.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["binary", "listing"])

    return files.select("path").mapInPandas(f, "binary string, listing string")
