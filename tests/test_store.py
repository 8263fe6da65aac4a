import json

from deltaweave import cli
from deltaweave import documents as D
from deltaweave.functions import text
from deltaweave.operators import site, store
from deltaweave.sources import readers, wire


def build(tmp_path):
    for e, s in (("game_arcade_v1@system.local", "Retro Arcade"), ("audio_engine@system.local", "Audio Engine"), ("manual@system.local", "User Manual")):
        wire.write_file(str(tmp_path / f"{e.split('@')[0]}.eml"), wire.build(e, s, [wire.Section("state", "application/json", "", b'{"x":0}')]))
    (tmp_path / "junk.eml").write_bytes(b"junk")
    return str(tmp_path)


def index(spark, folder):
    return store.store_index(readers.containers(spark, folder), D.state(spark, folder, strict=False))


def test_index_tags_and_queries(spark, tmp_path):
    f = build(tmp_path)
    assert readers.containers(spark, f).where("error is not null").count() == 1
    D.put(f"{f}/game_arcade_v1.eml", "tags", "retro", True)
    D.put(f"{f}/audio_engine.eml", "tags", "retro", False)
    D.put(f"{f}/manual.eml", "tags", "gone", None)
    rows = index(spark, f).orderBy("entity").collect()
    assert [(r.entity.split("@")[0], r.tags) for r in rows] == [("audio_engine", ["retro"]), ("game_arcade_v1", ["retro"]), ("manual", [])]
    find = lambda q: [r.entity.split("@")[0] for r in store.query_store(index(spark, f), q).collect()]
    assert find('X-Tag == "retro" AND Subject == "arcade"') == ["game_arcade_v1"] and find('X-Tag != "retro"') == ["manual"]


def test_directories(spark, tmp_path):
    f = build(tmp_path)
    D.put(f"{f}/game_arcade_v1.eml", "tags", "retro", True)
    for name, q, c in (("games", 'X-Tag == "retro"', []), ("docs", None, ["manual@system.local", "none@x"]), ("mixed", 'X-EML-Type == "Application/Unified"', ["manual@system.local"]), ("bad", "nothing", [])):
        wire.write_file(f"{f}/{name}.eml", store.make_directory(name, q, c))
    ix = index(spark, f).cache()
    got: dict = {}
    for r in store.resolve(ix, store.directories(ix)).orderBy("place").collect():
        got.setdefault(r.directory.split("@")[0], []).append(r.entity.split("@")[0])
    assert got == {"games": ["game_arcade_v1"], "docs": ["manual"], "mixed": ["manual", "audio_engine", "game_arcade_v1"]}


def test_posts_site_and_front_matter(spark, tmp_path):
    posts = tmp_path / "posts"
    posts.mkdir()
    for n, ts, tags in (("a", 1704067200, "x, y"), ("b", 1704153600, "y"), ("c", 0, "")):
        extra = [("X-Tag", tags)] if tags else []
        wire.write_file(str(posts / f"{n}.eml"), wire.build(n, f'T "<{n}>"', [wire.Section("body", "text/markdown", "body.md", b"# Hi\n- i\n\n**b** [l](u)\n")], [*extra, ("X-Timestamp", str(ts))]))
    df = readers.posts(spark, str(posts)).cache()
    assert [(r.name, r.tags) for r in df.collect()] == [("b", ["y"]), ("a", ["x", "y"]), ("c", [])]
    assert [(r.tag, r.names) for r in store.tag_members(df).orderBy("tag").collect()] == [("x", ["a"]), ("y", ["b", "a"])]
    out = tmp_path / "out"
    assert site.write_files(site.pages(df), str(out)) == 5
    html = (out / "index.html").read_text()
    assert html.index("post/b.html") < html.index("post/a.html") and "2024-01-01 00:00 UTC" in html and "&lt;a&gt;" in html
    assert "<h1>Hi</h1><ul><li>i</li></ul>" in (out / "post/a.html").read_text() and 'id="y"' in (out / "tags.html").read_text()
    assert site.write_files(site.front_matter(df), str(out)) == 3
    assert (out / "posts/a.md").read_text() == '---\ntitle: "T \\"<a>\\""\ndate: 2024-01-01\ntags:\n    - "x"\n    - "y"\n---\n\n# Hi\n- i\n\n**b** [l](u)\n'


def test_markdown():
    assert text.markdown("## a <b>\n```\nx < y\n```\n* one\n* two\ntext [l](u) end") == "<h2>a &lt;b&gt;</h2><pre><code>x &lt; y\n</code></pre><ul><li>one</li><li>two</li></ul><p>text <a href=\"u\">l</a> end</p>"
    assert text.markdown("**b** and [l](u)") == "<p><b>b</b> and [l](u)</p>".replace("<p><b>", "<p><b>") and text.markdown("a [open") == "<p>a [open</p>" and text.markdown("") == ""


def test_cli(tmp_path, capsys):
    p = str(tmp_path / "d.eml")
    assert cli.main(["doc-init", p]) == 0 and cli.main(["doc-add", p, "hello"]) == 0 and cli.main(["mount", p]) == 0
    assert cli.main(["insert", str(tmp_path / "db"), "r1", '{"a": 1}', "--tag", "x,y"]) == 0
    assert cli.main(["get", p, "none"]) == 1 and "1 blocks" in capsys.readouterr().out
    raw = (tmp_path / "db/r1.eml").read_bytes()
    assert raw.count(b"X-Tag:") == 2 and json.loads(raw.split(b"\r\n\r\n")[1]) == {"a": 1}
