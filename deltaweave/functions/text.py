"""Text, dates and JSON: header blocks, addresses, HTML, file types, times."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- header blocks


def find_blank(data: bytes) -> tuple[int, int] | None:
    """Place and length of the blank line that ends a header block: the first CRLFCRLF anywhere, only else the first LFLF."""
    for sep in (b"\r\n\r\n", b"\n\n"):
        at = data.find(sep)
        if at >= 0:
            return at, len(sep)
    return None


def parse_headers(head: bytes) -> list[tuple[str, str]]:
    """Headers in order. A line that begins with white space continues the one before; lines without a colon don't count."""
    out: list[list[str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t"):
            if out:
                out[-1][1] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append([k.strip(), v.strip()])
    return [(k, v) for k, v in out]


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header, in any case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def header_column(headers: Column, name: str) -> Column:
    """The first value of a header, null without one; headers is an ARRAY<STRUCT<k, v>>."""
    return F.get(F.filter(headers, lambda h: F.lower(h["k"]) == name.lower()), F.lit(0))["v"]


def headers_column(text: Column) -> Column:
    """ARRAY<STRUCT<k, v>> of a header block's text."""
    unfolded = F.regexp_replace(F.regexp_replace(text, r"\r*\n", "\n"), r"\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, "\n"), lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))


def blank_at(text: Column) -> Column:
    """Place (from 1) of the blank line in text of one character a byte; null without one."""
    return F.coalesce(F.nullif(F.instr(text, "\r\n\r\n"), F.lit(0)), F.nullif(F.instr(text, "\n\n"), F.lit(0)))


# --- names


def address(col: Column) -> Column:
    """An address without angle brackets and spaces around it."""
    return F.btrim(col, F.lit("<> "))


def event_name(col: Column) -> Column:
    """An event's name as part of a file name."""
    return F.translate(col, " /:", "___")


def file_name(col: Column) -> Column:
    """A name as a file name."""
    return F.translate(col, "/\\", "__")


def safe_id(col: Column) -> Column:
    """Whether a record's id is a flat file name."""
    return F.coalesce((F.length(col) > 0) & ~col.rlike(r"[/\\]|\.\.") & (col != "."), F.lit(False))


_TYPES = {
    "text/html": "html htm", "text/plain": "txt log", "text/markdown": "md", "text/css": "css", "message/rfc822": "eml", "application/json": "json", "application/yaml": "yml yaml",
    "text/x-python": "py", "text/x-rust": "rs", "text/x-c": "c h", "text/x-shellscript": "sh", "text/x-toml": "toml",
}
MIME = {ext: kind for kind, all_ in _TYPES.items() for ext in all_.split()}
OTHER_MIME = "application/octet-stream"


def mime(path: Column) -> Column:
    """Content type by a path's extension."""
    ext = F.lower(F.regexp_extract(path, r"[^./\\][^/\\]*\.([^./\\]+)$", 1))  # a name that only begins with a dot has none
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(table[ext], F.lit(OTHER_MIME))


def mime_of(path: str) -> str:
    m = re.search(r"[^./\\][^/\\]*\.([^./\\]+)$", path)
    return MIME.get(m[1].lower(), OTHER_MIME) if m else OTHER_MIME


def is_text(col: Column) -> Column:
    """Whether a section's text can be printed: no control characters but tabs and line ends."""
    return ~col.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]")


# --- dates


def civil_time(ts: Column) -> Column:
    """Seconds of the epoch as YYYY-MM-DD hh:mm UTC; the session's zone is UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def civil_date(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def day_time(ts: Column) -> Column:
    """Seconds of the epoch as dDAY hh:mm, ? for 0."""
    return F.when(ts == 0, F.lit("?")).otherwise(F.format_string("d%d %02d:%02d", F.floor(ts / 86400), F.floor(ts % 86400 / 3600), F.floor(ts % 3600 / 60)))


# --- HTML and markdown


def escape(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _inline(s: str) -> str:
    """Links, or, where there is bold text, that alone."""
    bold = s.split("**")
    if len(bold) >= 3:
        return "".join(("" if i == 0 else "<b>" if i % 2 else "</b>") + escape_text(p) for i, p in enumerate(bold))
    out, rest = "", s
    while "[" in rest:
        before, _, rest = rest.partition("[")
        out += escape_text(before)
        if "]" not in rest:
            out += "["
            break
        label, _, after = rest.partition("]")
        if after.startswith("(") and ")" in after:
            url, _, rest = after[1:].partition(")")
            out += f'<a href="{escape_text(url)}">{escape_text(label)}</a>'
        else:
            out, rest = out + escape_text(label), after
    return out + escape_text(rest)


def markdown(src: str) -> str:
    """HTML of a small markdown: three levels of headings, fenced code, lists, paragraphs, links, bold."""
    out: list[str] = []
    code = listed = False

    def end_list() -> None:
        nonlocal listed
        if listed:
            out.append("</ul>")
            listed = False

    lines = src.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.rstrip()
        if line.startswith("```"):
            end_list()
            out.append("</code></pre>" if code else "<pre><code>")
            code = not code
        elif code:
            out.append(escape_text(line) + "\n")
        elif m := re.match(r"(#{1,3}) (.*)", line):
            end_list()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif line[:2] in ("- ", "* "):
            if not listed:
                out.append("<ul>")
                listed = True
            out.append(f"<li>{_inline(line[2:])}</li>")
        else:
            end_list()
            if line.strip():
                out.append(f"<p>{_inline(line)}</p>")
    end_list()
    return "".join(out) + ("</code></pre>" if code else "")


@F.pandas_udf(StringType())
def markdown_html(col: pd.Series) -> pd.Series:
    return col.map(lambda s: None if s is None else markdown(s))


# --- JSON


def canonical_json(col: Column) -> Column:
    """JSON text with sorted keys; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(col))


def json_or_empty(col: Column) -> Column:
    """JSON text, {} for anything else."""
    return F.coalesce(canonical_json(col), F.lit("{}"))


# --- listings


def normalised_lines(listing: Column) -> Column:
    """A disassembly without what moves when it is built anew: addresses, bytes, comments, call targets, offsets from rip."""
    having = lambda sign, f: lambda x: F.when(F.contains(x, F.lit(sign)), f(x)).otherwise(x)
    steps = [
        lambda x: F.trim(F.substring_index(x, "\t", -1)),
        having(" #", lambda x: F.regexp_replace(x, r"(?s) #.*$", "")),
        having("<", lambda x: F.regexp_replace(x, r"(?<!\S)[0-9A-Fa-f]++(?=\s+<)", "")),
        having("[rip", lambda x: F.regexp_replace(x, r"\[rip[+-]\s*(0x)*[0-9A-Fa-f]+\s*\]", "[rip+ADDR]")),
    ]
    # a pass for each step, so that no value is computed twice; carriage returns before line ends are trimmed
    lines = F.filter(F.transform(F.split(listing, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: F.length(x) > 0)
    for step in steps:
        lines = F.transform(lines, step)
    return F.array_join(lines, "\n")


def body_hash(listing: Column) -> Column:
    return F.sha2(normalised_lines(listing), 256)
