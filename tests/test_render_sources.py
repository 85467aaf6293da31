import zipfile

import pytest
from pyspark.sql import functions as F

from pagequarry import cli
from pagequarry.operators import evaluate, normalize
from pagequarry.operators.render import CUT, block, render, shortened
from pagequarry.params import InvalidParam, NoMarkdown, SourceError, TooLarge
from pagequarry.sources import collections, markdown
from pagequarry.streaming import resliced


def hit(body, **kw):
    return {"score": 2.5, "level": 1, "heading": "H", "breadcrumb": ["a", "b"], "path": "p.md", "url": None, "cited": True, "body": body} | kw


def test_budgets():
    for n, error in ((0, InvalidParam), (2**62 + 1, TooLarge)):
        with pytest.raises(error):
            render("q", [], n)
    # A long body is cut to the budget in characters, however many bytes they have.
    assert len(render("q", [hit("ж" * 2000)], 150)) <= 600 and CUT in render("q", [hit("ж" * 2000)], 150)
    # What a short section leaves goes to the next.
    text = render("q", [hit("few"), hit("w" * 900 + "LAST")], 400)
    assert "LAST" in text and CUT not in text
    # Bodies end with a whole line where one fits.
    rows = [f"row {i:03d} " + "=" * 30 for i in range(40)]
    kept = [x for x in render("q", [hit("\n".join(rows))], 120).split("\n") if x.startswith("row")]
    assert 0 < len(kept) < 40 and kept == rows[: len(kept)]
    assert shortened("~~~~\n" + "y = 2\n" * 30, 70).endswith("\n~~~~") and shortened("~~~\na\n~~~\nb\nc\n", 11) == "~~~\na\n~~~\n"
    assert shortened("z" * 30, 7) == "z" * 7 and shortened("abc", 3) == "abc"


def test_blocks():
    text = block(hit("body\n"), 10_000)
    assert text == "--- DÉBUT DE SECTION (Score: 3) ---\n# H\n> a > b\n> File: p.md\nbody\n\n--- FIN DE SECTION ---\n\n"
    assert "# H" not in block(hit("x", level=0), 999) and "> Source: u\n> File" in block(hit("x", url="u"), 999)
    assert "> File" not in block(hit("x", cited=False), 999)
    assert CUT not in block(hit("x" * 500), 120)


PAGES = [
    ("cmd/tar.1.md", "tar"), ("cmd/zip.1.en.md", "zip"), ("conf/app.toml.7.md", "app.toml"), ("x.y/max.depth.md", "max.depth"), ("Api/GetItem.md", "getitem"),
    ("v1.100.md", "v1.100"), ("v1.12.md", "v1"), ("UP.MD", "up.md"), ("a.fr.md", "a.fr"), (".md", ""),
]
FRONTS = [
    ("---\nurl: http://h.example/one\ntitle: 'One'\n---\nbody one", "http://h.example/one", "One", "body one"),
    ("\ufeff---\r\ntitle: \"Two\"\r\n---\r\n\r\ntwo\r\n", None, "Two", "\r\ntwo\r\n"),
    ("---\ntitle: open\n", None, None, "---\ntitle: open\n"), (" ---\nurl: no\n---\n", None, None, " ---\nurl: no\n---\n"),
    ("---\n---\n", None, None, ""), ("---\nurl: first\nurl:   \nurl: second\n...\nrest", "second", None, "rest"), ("", None, None, ""), (None, None, None, None),
    ("---\n  url: indented\ntitle: \"\"\n---", None, None, ""), ("no front\n---\ntitle: t\n---\n", None, None, "no front\n---\ntitle: t\n---\n"),
]


def test_identity_and_front_matter(spark):
    df = spark.createDataFrame([(p,) for p, _ in PAGES], "p string").select(markdown.page_stem(F.col("p")).alias("s"))
    assert [r.s for r in df.collect()] == [s for _, s in PAGES]
    df = spark.createDataFrame([(f"{i}.md", t[0]) for i, t in enumerate(FRONTS)], "path string, text string")
    rows = markdown.pages_from(df).orderBy("path").collect()
    assert [(r.url, r.title, r.body) for r in rows] == [t[1:] for t in FRONTS]
    assert rows[0].page_name == "One 0" and rows[1].page_name == "Two 1" and rows[2].page_name == "2"
    assert markdown.pages_from(df, single=True).first().page_name == ""


@pytest.fixture
def corpus(tmp_path):
    files = {
        "start.md": "---\ntitle: First steps\nurl: https://d.example/start\n---\n# Setup\n\nthe tarpaulin setting\n", "deep/er/ropes.md": "## Knots\n\na bowline holds\n",
        ".git/old.md": "# Old\n\nbowline\n", "list.txt": "bowline", "_part/bits.md": "# Bits\n\ncleat\n", "two words.MD": "# Two\n\nfender\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_directories(spark, corpus):
    pages = ["_part/bits.md", "deep/er/ropes.md", "start.md", "two words.MD"]
    assert markdown.markdown_files(str(corpus)) == pages
    assert ".git/old.md" in markdown.markdown_files(str(corpus), every=True)
    found, directory = markdown.load_corpus(spark, str(corpus))
    assert directory and sorted(r.path for r in found.collect()) == pages
    # The same through Hadoop's file systems, as object stores are read.
    found, directory = markdown.load_corpus(spark, f"file://{corpus}")
    assert directory and sorted(r.path for r in found.collect()) == pages
    (corpus / "bad.md").write_bytes(b"\xff")
    for root in (str(corpus), f"file://{corpus}"):
        with pytest.raises(Exception, match="(?i)utf-8"):
            markdown.load_corpus(spark, root)[0].collect()
    with pytest.raises(SourceError):
        markdown.load_corpus(spark, str(corpus / "bad.md"))


def test_command_line(spark, corpus, capsys):
    def run(*args):
        try:
            code = cli.main([str(a) for a in args])
        except SystemExit as e:
            code = e.code
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, _ = run(corpus, "tarpaulin")
    assert code == 0 and "# Setup\n> Source: https://d.example/start\n> File: start.md\n" in out and "title:" not in out
    code, out, _ = run(corpus, "bowline", "--top-k", 9)
    assert code == 0 and out.count("FIN DE SECTION") == 1 and "> File: deep/er/ropes.md" in out
    assert run(corpus, "cleat")[0] == run(corpus, "fender", 500, 1)[0] == 0
    assert run(corpus, "notthere")[:2] == (1, "")
    code, out, _ = run(corpus / "start.md", "tarpaulin")
    assert code == 0 and "> File" not in out
    for args, word in (((corpus / "none.md", "x"), "error"), ((corpus, "x", "--top-k", 0), "top_k"), ((corpus, "cleat", "--max-tokens", 0), "max_tokens"),
                       ((corpus, "cleat", 2**63), "max_tokens"), ((corpus, "x", "many"), ""), ((corpus, "x", 5, 1, "--top-k", 1), ""),
                       ((corpus, "x", "--max-level", 0), ""), ((corpus, "..."), "keyword")):
        code, out, err = run(*args)
        assert code == 2 and word in err, args
    assert run(corpus, "notthere", "--max-tokens", 0)[0] == 1
    assert run("--help")[0] == run("--version")[0] == 0
    (corpus / "nothing").mkdir()
    assert "no .md file" in run(corpus / "nothing", "x")[2]
    with pytest.raises(NoMarkdown):
        markdown.load_corpus(spark, str(corpus / "nothing"))
    # The other job: normalizing.
    (corpus / "raw.md").write_text("Manual\n# T\n```\ncode\nCopy to clipboard\ntext\n")
    assert cli.normalize_main(["godot", "--input", str(corpus / "raw.md"), "--dry-run"]) == 0 and not (corpus / "raw_clean.md").exists()
    assert "fences balanced: False" in capsys.readouterr().out
    assert cli.normalize_main(["godot", "--input", str(corpus / "raw.md")]) == 0
    assert (corpus / "raw_clean.md").read_text() == "# T\n```\ncode\n```\ntext\n" and (corpus / "BUILT_AT.txt").exists()
    (corpus / "open.md").write_text("# T\n```\nnever closed\n")
    assert cli.normalize_main(["blender", "--input", str(corpus / "open.md")]) == 2 and not (corpus / "open_clean.md").exists()
    assert cli.normalize_main(["roblox-docs", "--input", str(corpus / "gone.md")]) == 2


def test_other_sources(spark, tmp_path):
    index = spark.createDataFrame([("[a](/docs/b.md) [b](/docs/a.md) [c](/x/c.md) [d](/docs/b.md)",), (None,)], "text string")
    assert sorted(r.link for r in collections.links(index).collect()) == ["/docs/a.md", "/docs/b.md"]
    with pytest.raises(ValueError):
        collections.checked_links(index)
    calls = {"/docs/a.md": "---\nt: x\n---\nA \n\n"}
    got = collections.fetched(collections.links(index), lambda x: calls[x], tries=2, wait_s=0)
    assert {r.link: (r.text is None, r.error is None) for r in got.collect()} == {"/docs/a.md": (False, True), "/docs/b.md": (True, False)}
    assert [r.text for r in collections.concatenated(got).collect()] == ["A\n\n"]
    book, outer = tmp_path / "b.epub", tmp_path / "o.zip"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", "x")
        z.writestr("img/a.PNG", b"1")
        z.writestr("../evil.png", b"2")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(book, "b.epub")
    files = spark.createDataFrame([("o", outer.read_bytes()), ("bad", b"zip?")], "path string, content binary")
    rows = {(r.archive, r.member, r.kind) for r in collections.archive_members(files).collect()}
    assert rows == {("o", "META-INF/container.xml", "other"), ("o", "img/a.PNG", "image"), ("bad", None, None)}
    assert [(r.member, bytes(r.content)) for r in collections.archive_images(files).collect()] == [("img/a.PNG", b"1")]
    (tmp_path / "set.json").write_text('{"description": "d", "cases": [{"docset": "s", "query": "q", "kind": "task", "expected": ["a/"]}]}')
    assert [r.expected for r in collections.relevance_cases(spark, str(tmp_path / "set.json")).collect()] == [["a/"]]
    parts = spark.createDataFrame([(f"l{i:03d}", f"page {i}\r\n---\n \n") for i in range(40)], "link string, text string").repartition(5)
    collections.write_corpus(collections.concatenated(parts), "m", str(tmp_path / "out"), collections.links(index), "2020-01-01")
    joined = "".join(f.read_text(newline="") for f in sorted((tmp_path / "out" / "m_clean.md").glob("part-*")))
    assert joined == "".join(f"page {i}\r\n---\n\n" for i in range(40)) and (tmp_path / "out" / "BUILT_AT.txt").exists()


def test_normalization(spark):
    heal = lambda *x: [(line, kind) for line, kind in normalize.healed(x)]
    assert heal("````py", "x", "Copy to clipboard", "y") == [("````py", None), ("x", None), ("````", "clipboard"), ("Copy to clipboard", None), ("y", None)]
    assert heal("```", "> Source: http://x")[1] == ("```", "page-start") and heal("```", "a [Content truncated due to length]")[1][1] == "marker"
    assert heal("Copy to clipboard") == [("Copy to clipboard", None)]
    kinds = lambda *x: list(normalize.scaffolding(x))
    assert kinds("Manual", " * Godot Engine 4.7 documentation in English", "* Index", "* more", "Copy to clipboard", "* * *", "---", "  ", "", "text",
                 "# X — Godot Engine (stable) documentation in English") == [
        "nav", None, None, None, "copy-to-clipboard", "separator", "thematic-break", "whitespace-only", None, None, "h1-suffix"]
    rules = normalize.SiteRules(breadcrumb="* Home")
    assert list(normalize.scaffolding([" * Home", "* Index", "* more"], rules)) == ["breadcrumb", "breadcrumb", None]
    assert kinds("## User-contributed notes", "a", "Hosted by x", "Manual") == ["footer", "footer", "footer", "nav"]
    assert kinds("## User-contributed notes", "a", "# Manual", "b") == ["footer", "footer", None, None]
    assert kinds("## User-contributed notes", *["a"] * 45)[:44] == ["footer"] * 42 + [None] * 2
    assert kinds("```", "Manual", "```") == [None] * 3
    cases = {
        "``````bash": "```bash", "a:```py": "a:\n```py", "x ``````": "x\n```", "| ``` | y": "|\n```", "    a```": "    a```", "````|": "````|",
        "plain": "plain", "```": "```", "  `````x": "  ```x", "`a` b": "`a` b",
    }
    df = spark.createDataFrame([(str(i), a) for i, a in enumerate(cases)] + [("n", None)], "path string, body string")
    got = {r.path: (r.body, r.fixes) for r in normalize.fix_midline_fences(df).collect()}
    assert [got[str(i)][0] for i in range(len(cases))] == list(cases.values()) and got["n"] == (None, 0)
    assert got["6"][1] == 0 and got["0"][1] == 1


def test_normalization_is_checked(spark, tmp_path):
    pages = spark.createDataFrame([("a", "```\nx\n> Source: http://y\n"), ("b", "Manual\ntext")], "path string, body string")
    rows = normalize.write_checked(pages, "godot", str(tmp_path / "n")).collect()
    assert {(r.path, r.balanced_before, r.balanced) for r in rows} == {("a", False, True), ("b", True, True)}
    assert {r.path: r.body for r in spark.read.parquet(str(tmp_path / "n")).collect()}["b"] == "text"
    with pytest.raises(ValueError):
        normalize.write_checked(pages, "other", str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()
    assert "headings_before" in normalize.write_checked(pages, "godot", str(tmp_path / "k"), dry_run=True).columns


def test_evaluation(spark, tmp_path):
    pages = spark.createDataFrame(
        [("d/a/x.md", "d", "same"), ("d/b/x.md", "d", "---\nt: 1\n---\nsame"), ("d/c.md", "d", "other"), ("e/z.md", "e", None)], "path string, docset string, body string"
    )
    cases = spark.createDataFrame(
        [(1, "d", "q", "task", ["a/x.md"]), (1, "d", "q", "task", ["a/x.md"]), (2, "d", "q", "Identifier ", ["a/"]), (3, "d", "q", None, ["gone.md"]), (4, "d", "q", "x", ["x.md"])],
        "case_id bigint, docset string, query string, kind string, expected array<string>",
    )
    cases = evaluate.distinct_cases(cases)
    assert {r.case_id: r.kind for r in cases.collect()} == {1: "task", 2: "identifier", 3: "other", 4: "other"}
    assert [tuple(r) for r in evaluate.missing_expectations(cases, pages).collect()] == [(3, "gone.md")]
    hits = spark.createDataFrame([(1, 1, "d/b/x.md"), (1, 2, "d/a/x.md"), (2, 1, "d/b/x.md"), (2, 2, "d/a/x.md"), (3, 1, "d/c.md"), (4, 1, "d/b/x.md")], "case_id bigint, rank int, path string")
    results = evaluate.first_good_ranks(cases, hits, pages)
    assert {r.case_id: r["rank"] for r in results.collect()} == {1: 1, 2: 2, 3: None, 4: 1}
    total = evaluate.quality(results).where("docset is null and kind is null").first()
    assert (total.cases, total.hit1, total.hit3, total.mrr5) == (4, 2, 3, 0.625)
    assert {r.case_id for r in evaluate.misses(results).collect()} == {2, 3}
    evaluate.write_cases(results, str(tmp_path / "cases"))
    assert spark.read.json(str(tmp_path / "cases")).count() == 4
    keys = spark.createDataFrame([("---\u2028a: 1\x0b---\x85x\ny",), ("x\x1cy",), ("x y",)], "t string").select(evaluate.content_key(F.col("t")).alias("k"))
    keys = [r.k for r in keys.collect()]
    assert keys[0] == keys[1] != keys[2]
    outputs = spark.createDataFrame([("1", block(hit("Needle"), 999))], "query_id string, output string")
    checks = spark.createDataFrame([(1, "1", "rank1", "needle"), (2, "1", "top3", "no"), (3, "2", "found", None), (4, None, "found", None)], "case_id int, query_id string, expectation string, substr string")
    assert {r.case_id: r.status for r in evaluate.assertions(outputs, checks).collect()} == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "SKIP"}


def test_streaming(spark, tmp_path):
    schema = "path string, body string, ingested_at timestamp"
    source = tmp_path / "in"
    for i, rows in enumerate([[("a", "# A\n\nx\n", None)], [("a", "# A2\n\ny\n", None), ("b", "# B\n", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = resliced.slice_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        got = {(r.path, r.heading) for r in resliced.current_sections(spark, str(tmp_path / "out")).collect()}
        assert got == [{("a", "A")}, {("a", "A2"), ("b", "B")}][i]
