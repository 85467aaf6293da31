import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.operators.slicer import CLOSES, OPENS, OUTSIDE, WITHIN, Fences, register, sections_of, slice_text

T = "```"


def heads(text, level=3):
    return [(s.level, s.heading, s.breadcrumb) for s in slice_text(text, level)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"## Install\n{T}sh\n# apt update\n## apt upgrade\n{T}\n### Verify\nok", [(2, "Install", []), (3, "Verify", ["Install"])]),
        ("~~~\n# in tildes\n```\n~~~\n# out\n", [(0, "", []), (1, "out", [])]),
        ("`````\n```\n# quoted\n`````\n# seen\n", [(0, "", []), (1, "seen", [])]),
        ("```\n# never closed\n", [(0, "", [])]),
        ("```a`b\n# no fence before\n", [(0, "", []), (1, "no fence before", [])]),
        ("lead\n## One\n# Two\n### Three\n", [(0, "", []), (2, "One", []), (1, "Two", []), (3, "Three", ["Two"])]),
        ("Guide\n=====\nwords\n\nPart\n-\nmore\n", [(1, "Guide", []), (2, "Part", ["Guide"])]),
        ("two\nlines\n---\n# H\n", [(0, "", []), (1, "H", [])]),
        ("\n---\n\n***\n", [(0, "", [])]),
        ("+ point\n====\n", [(1, "+ point", [])]),
        ("    # code\n ## kept\n##glued\n\t# tab\n", [(0, "", []), (2, "kept", [])]),
        ("### Tail ####\n## in # side #\n# C#\n", [(3, "Tail", []), (2, "in # side", []), (1, "C#", [])]),
        ("#### four\n---\n", [(2, "#### four", [])]),
        ("#\ntext under none\n## b\n", [(1, "", []), (2, "b", [""])]),
        ("#\n", []),
        ("only\nwords", [(0, "", [])]),
        ("", []),
        ("# W\r\n\r\nx\r\n## Z\r\n", [(1, "W", []), (2, "Z", ["W"])]),
    ],
)
def test_shapes(text, expected):
    assert heads(text) == expected


def test_levels():
    text = "# Top\n##### five\nunder five\n#### four\n## Two\n"
    assert heads(text) == [(1, "Top", []), (2, "Two", ["Top"])]
    assert heads(text, 4) == [(1, "Top", []), (4, "four", ["Top"]), (2, "Two", ["Top"])]
    assert heads(text, 5) == heads(text, 6) == [(1, "Top", []), (5, "five", ["Top"]), (4, "four", ["Top"]), (2, "Two", ["Top"])]
    assert heads(text, 40) == heads(text, 6) and heads(text, -1) == heads(text, 1) == [(1, "Top", [])]
    assert heads("Under\n--\n", 1) == [(2, "Under", [])] and heads("####### seven", 6) == [(0, "", [])]


def test_bodies():
    rows = list(slice_text("before\n# A\n## B\n\n   \n## C\nc\n"))
    assert [(s.heading, s.has_body, s.body) for s in rows] == [("", True, "before\n"), ("A", False, ""), ("B", False, "\n   \n"), ("C", True, "c\n")]
    assert [s.sec_no for s in rows] == [0, 1, 2, 3]
    assert [s.body for s in slice_text("Over\n==\nunder\n")] == ["under\n"]
    assert next(slice_text("# Q\r\nline\r\n")).body == "line\r\n"


def fold(text, level):
    """An independent statement of the rules, over whole lines and with another control flow."""
    out, state = [], {"fence": None, "para": [], "head": (0, "", []), "stack": [], "body": []}

    def flush(lines):
        lv, h, crumb = state["head"]
        body = "".join(lines)
        if h or body.strip():
            out.append((lv, h, crumb, body))

    def open_heading(lv, h):
        state["stack"] = [x for x in state["stack"] if x[0] < lv] if all(a[0] < b[0] for a, b in zip(state["stack"], state["stack"][1:])) else state["stack"]
        state["head"] = (lv, h, [x[1] for x in state["stack"]])
        state["stack"].append((lv, h))
        state["body"], state["para"] = [], []

    for line in re.split(r"(?<=\n)", text):
        if not line:
            continue
        if state["fence"]:
            state["body"].append(line)
            if re.fullmatch(r" {0,3}" + re.escape(state["fence"][0]) + "{%d,}" % state["fence"][1] + r"\s*", line):
                state["fence"] = None
        elif m := re.fullmatch(r"(?s) {0,3}(?:(`{3,})[^`]*|(~{3,}).*)", line):
            run = m[1] or m[2]
            state["fence"], state["para"] = (run[0], len(run)), []
            state["body"].append(line)
        elif m := re.match(r" {0,3}(#{1,%d})(?:[ \t]|\s*$)" % level, line):
            flush(state["body"])
            open_heading(len(m[1]), re.sub(r"(?:^|[ \t]+)#+$", "", line[m.end(1):].strip()).strip())
        elif (m := re.match(r" {0,3}(=+|-+)\s*$", line)) and len(state["para"]) == 1:
            at = max(i for i, x in enumerate(state["body"]) if x is state["para"][0])
            flush(state["body"][:at])
            open_heading(1 if m[1][0] == "=" else 2, state["para"][0].strip())
        else:
            state["body"].append(line)
            if m or not line.strip():
                state["para"] = []
            elif state["para"] or not line.startswith("    "):
                state["para"] = [*state["para"], line]
    flush(state["body"])
    return out


LINES = st.sampled_from(
    ["# a", "## b ##", "### c", "#### d", "text", "more text", "", "---", "===", "```", "```py", "````", "~~~", "    code", "   ---", "#", "- x", "\t", "a`b"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(LINES, max_size=14), st.integers(1, 6), st.booleans())
def test_same_as_fold(lines, level, end):
    text = "\n".join(lines) + ("\n" if end else "")
    assert [(s.level, s.heading, s.breadcrumb, s.body) for s in slice_text(text, level)] == fold(text, level)


def test_offsets_cover_the_text():
    text = "é\n\n# A\n\nbody ü\n\n## B\n"
    for s in slice_text(text):
        assert text[s.start : s.end] == s.body


def test_table_function_and_frame(spark):
    pages = spark.createDataFrame(
        [("a.md", "# É\n\nü\n", "x"), ("a.md", "# É\n\nü\n", "x"), ("b.md", None, "x"), (None, "# c\n", "x"), ("e.md", "", "x")],
        "path string, body string, sec_no string",
    )
    rows = sections_of(pages).collect()
    assert [(r.path, r.heading, r.body_bytes, r.range_start, r.range_end, r.page) for r in rows] == [("a.md", "É", 4, 5, 9, "")]
    register(spark)
    got = spark.sql("SELECT path, heading, range_end FROM {p}, LATERAL md_sections(body, 3)", p=pages.where("path = 'a.md'").distinct())
    assert [tuple(r) for r in got.collect()] == [("a.md", "É", 9)]
    assert sections_of(pages.limit(0)).count() == 0


def test_fences():
    f = Fences()
    steps = [("````x", OPENS), ("```", WITHIN), ("    ````", WITHIN), ("~~~~", WITHIN), ("  ``````\t", CLOSES), ("``` a`", OUTSIDE), ("~~~ `", OPENS)]
    assert [f.step(line) for line, _ in steps] == [kind for _, kind in steps] and f.mark == "~~~"


def test_versions_of_a_page_do_not_mix(spark):
    rows = [("p", "# Old\n\n## A\n\n## B\n", 1), ("p", "# New\n\ntext\n", 2), ("p", "# New\n\ntext\n", 2), ("q", "# Q\n", None)]
    pages = spark.createDataFrame(rows, "path string, body string, t int").withColumn("ingested_at", F.timestamp_seconds("t"))
    got = sorted((r.path, r.heading) for r in sections_of(pages).collect())
    assert got == [("p", "New"), ("q", "Q")]
    got = {r.heading for r in sections_of(pages.drop("ingested_at")).where("path = 'p'").collect()}
    assert got in ({"New"}, {"Old", "A", "B"})


def test_matches_given_sections(spark, folder):
    pages, given_ = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "sections"))
    columns = ["path", "sec_no", "heading", "body", "has_body", "range_start", "range_end"]
    a, b = sections_of(pages).select(*columns), given_.select(*columns).distinct()
    assert a.count() == b.count() and a.subtract(b).count() == 0

