import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import confusables, leakage, mojibake, packing, sitelines, truncation
from pagequarry.llm import queries as Q

T = "```"


# ---- 1
@pytest.mark.parametrize(
    ("body", "kinds"),
    [
        ("A whole sentence.\n", ["text, stop"]), ("Stops in the midd", ["text, word:3"]), ("One. Two thr", ["text, word:1"]), ("Stops after `code`", ["text, code:3"]),
        ("See [a link", ["text, open"]), ("See [a link](https://x.exam", ["text, open"]), ("See [a link](https://x.example/y)\n", ["text, link"]),
        (f"{T}py\nx = 1\n{T}\n", []), ("- one\n- two\n", ["entry after first, word:1", "entry after none, word:1"]), ("| a | b |\n", ["row, bar"]),
        ("| a | b", ["row, word:3"]), ("# Title\n", ["heading, word:1"]), ("Odd � e�", ["text, lost"]), ("", []), ("\n \n", []),
        ("- `a`: done.\n- `b`: not do", ["entry after first, stop", "entry after stop, word:1"]), ("text.\n\n---\n", ["text, stop", "rule, rule"]),
        ("Uses `a.", ["text, open"]), ("A" * 60 + "\n", ["text, data"]), ("- a\n  b c d.\n", ["entry after first, stop"]), ("a\nb c\n\nd", ["text, word:1", "text, word:1"]),
        ("One 3.", ["text, number"]), ("**Name**\n", ["text, label"]), ("> Quoted.\n", ["text, stop"]),
    ],
)
def test_kinds_of_endings(body, kinds):
    found, is_open = truncation.blocks(body.rstrip().split("\n"))
    assert [k for _, k in found] == kinds and not is_open
    assert truncation.blocks(f"a.\n\n{T}\nx".split("\n")) == ([(0, "text, stop")], True)


def cut_corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(8)).capitalize() + "."
    text = lambda n: "# Head\n\n" + "\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(n))
    site = "Copyright of all the pages by us"
    rows = [(f"w{i}", "s", text(rng.randint(10, 20)) + "\n\n" + site + "\n") for i in range(150)]
    rows += [(f"c{i}", "s", text(12)[: rng.randint(300, 1500)].rstrip() + "qu" + (f"\n\n{site}\n" if i % 2 else "")) for i in range(30)]
    rows += [(f"m{i}", "s", text(12)[: rng.randint(300, 1500)].rstrip() + "qu [cut here]") for i in range(6)]
    rows += [(f"o{i}", "s", text(2) + f"\n\n{T}\nx = {i}") for i in range(8)]
    # At a limit, with an ending that could be whole: all short pages end in such lists.
    rows += [(f"l{i}", "s", text(3) + "\n\n" + "\n".join(f"- {word()}" for _ in range(3)) + "\n") for i in range(30)]
    rows += [(f"h{i}", "s", (text(9)[:770] + ".\n\n- " + word()).ljust(800, "y")) for i in range(8)]
    return rows


def test_cut_texts(spark, monkeypatch):
    rows = cut_corpus()
    rows += [("z", "s", None), (None, "s", "x"), rows[160], ("w0", "s", rows[155][2]), ("b", "t", " \n")]
    df = spark.createDataFrame(rows, "path string, docset string, body string").withColumn("chars", F.lit("clash"))
    got = {}
    for r in truncation.cut_texts(df).collect():
        got.setdefault(r.path, r)
    # Of one path two bodies count, if one is cut the path is.
    want = {p for p, _, _ in rows if p and p[0] in "cmoh"} | {"w0"}
    assert set(got) == want
    assert {p[0]: got[p].reason for p in sorted(want - {"w0"})} == {"c": "ending", "m": "mark", "o": "block", "h": "limit"}
    assert all(got[p].at_limit == (p[0] == "h") for p in want)
    report = {r.docset: r for r in truncation.cut_report(df, truncation.cut_texts(df)).collect()}
    assert report["s"].cut == len(want) and report["s"].cut_at_limit == 8 and report["t"].cut == 0
    assert truncation.cut_texts(df.limit(0)).count() == 0
    # The hazards decide: without those of lengths the texts at the limit are lost, without those of endings the others.
    none = truncation.significant_lengths
    monkeypatch.setattr(truncation, "significant_lengths", lambda e, p: none(e, p).limit(0))
    assert {r.path[0] for r in truncation.cut_texts(df).collect()} == {"c", "m", "o", "w"}
    monkeypatch.undo()
    endings = truncation.incomplete_endings
    monkeypatch.setattr(truncation, "incomplete_endings", lambda *a: endings(*a).limit(0))
    assert {r.path[0] for r in truncation.cut_texts(df).collect()} == {"h", "m"}


def test_hazards(spark):
    rng = random.Random(2)
    lengths = [rng.randint(100, 5000) for _ in range(800)] + [4000] * 12
    df = spark.createDataFrame([(f"p{i}", "s", n, n + i % 90) for i, n in enumerate(lengths)], "path string, source string, chars bigint, bytes bigint")
    for params in (truncation.CutParams(), truncation.CutParams(length_block=300)):
        rows = truncation.length_hazards(df, params).where("measure = 'chars'").collect()
        assert len(rows) == len(set(lengths))
        for r in rows:
            assert r.ended == lengths.count(r.length) and r.at_risk == sum(n >= r.length for n in lengths)
            near = [n for n in range(max(0, r.length - 200), r.length + 201) if n != r.length]
            risk = sum(sum(n >= at for n in lengths) for at in near)
            ends = sum(lengths.count(n) for n in near)
            assert r.neighbour_hazard == pytest.approx(min(0.5, (ends + 0.5) / max(1, risk)))
    assert [(r.measure, r.length) for r in truncation.significant_lengths(df).collect()] == [("chars", 4000)]
    assert truncation.length_hazards(df.limit(0)).count() == 0


# ---- 3
@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｆｕｌｌ１２", "Full12"), ("cafe\u0301", "café"), ("a\u200bb \u00adc", "ab c"), ("a\u00a0b\u2009c\u202fd", "a b c d"), ("re\u2010do\u2011it", "re-do-it"),
        ("ﬁeld", "field"), ("Sess\u0456on", "Session"), ("b\u03bf\u03bfl", "bool"), ("\u0421\u0430\u0441\u04bb\u0435", "Cache"), ("Р\u0430здел про яp\u043bык", "Раздел про ярлык"),
        ("\u0435dge_\u0445\u043e в файле", "edge_xo в файле"), ("𝐛𝐨𝐥𝐝", "bold"), ("x² ½ ™ — “q” …", "x² ½ ™ — “q” …"), ("API-сервер открыт", "API-сервер открыт"),
        ("Все", "Все"), ("не со всем", "не со всем"), ("\ufffd", "\ufffd"), ("œuvre Größe", "œuvre Größe"), ("", ""), ("е\u0308лка и\u0306", "ёлка й"), ("c\u0251che f\u0131le", "cache file"), ("ağ k\u0131sa", "ağ k\u0131sa"), ("part \u2163", "part IV"), ("part \u2160", "part I"),
    ],
)
def test_one_form(looks, text, form):
    assert looks.one_form(text) == form
    assert looks.skeleton(text) == looks.skeleton(form)


@pytest.fixture(scope="module")
def looks(spark):
    return confusables.confusables(spark)


def test_the_table_is_unicodes(looks):
    assert len(looks.prototypes) > 5000 and len(looks.look_alike) > 100
    # Scripts, digits, punctuation and sequences that no list here has.
    for a, b in (("ꓖ", "G"), ("೦", "o"), ("՝", "'"), ("⁄", "/"), ("ⅿ", "m"), ("œ", "oe"), ("Ӏ", "I"), ("І", "I"), ("۱", "1"), ("О", "O"), ("ㅤ", "")):
        assert looks.skeleton(a) == looks.skeleton(b), (a, b)
    for a, b in ("lI", "1l", "O0", "I1"):
        assert looks.skeleton(a) != looks.skeleton(b)
    assert looks.skeleton("modern") == "modern"


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="aeоеАﬁｗ\u200b\u0301\u00a0 -_.ы1éɑı", max_size=20))
def test_one_form_is_stable(looks, text):
    once = looks.one_form(text)
    assert looks.one_form(once) == once or looks.one_form(looks.one_form(once)) == looks.one_form(once)
    assert looks.skeleton(looks.skeleton(text)) == looks.skeleton(text)
    assert unicodedata.is_normalized("NFC", once)


def test_without_the_table_nothing_is_found_by_look(spark, monkeypatch):
    rows = [("a", 0, "H\u0435ad", "x"), ("a", 1, "Head", "x"), ("a", 2, "\u0421\u043e\u0440\u0443", "Copy"), ("b", 0, "Copy", None), ("b", 1, "Copy", None)]
    df = spark.createDataFrame(rows, "path string, sec_no int, heading string, body string")
    found = lambda: {(r.path, r.sec_no) for r in confusables.look_alikes(df).collect()}
    assert found() == {("a", 0), ("a", 2)}
    monkeypatch.setattr(confusables, "confusables", lambda spark: confusables.Confusables({}))
    assert found() == set()


def test_look_alikes(spark, looks):
    rows = [("a", 0, "H\u0435ad", "x", "k"), ("a", 0, "H\u0435ad", "x", "k"), ("a", 1, None, None, "k"), ("a", 2, "", "b\u00a0c", "k"), ("b", 0, "plain", "déjà", "k")]
    df = spark.createDataFrame(rows, "path string, sec_no int, heading string, body string, k0 string")
    got = sorted(tuple(r) for r in confusables.look_alikes(df).collect())
    assert got == [("a", 0, "Head", "x"), ("a", 2, "", "b c")]
    assert confusables.look_alikes(df.limit(0)).count() == 0
    # What the JVM lets pass is in one form already.
    chars = [(chr(c),) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    passed = spark.createDataFrame(chars, "c string").where(~confusables.may_differ(F.col("c"))).collect()
    assert len(passed) > 10_000 and all(looks.one_form(r.c) == r.c for r in passed)
    names = spark.createDataFrame([("Head",), ("H\u0435ad",), ("Head",), ("other",), (None,)], "h string")
    assert [(r.spellings, r.one) for r in confusables.equal_looking(names, "h").collect()] == [(2, "Head")]


def test_words_take_the_usual_spelling_of_their_skeleton(spark):
    copy, he = "\u0421\u043e\u0440\u0443", "\u041d\u0435"  # all in Russian-shaped letters
    rows = [("p", i, "Copy", "copy a file, He said") for i in range(4)]
    rows += [("r", i, "Раздел", f"{he} открыт, а закрыт. {'Все файлы' if i else 'Bce файлы `Bce`'}.") for i in range(4)]
    rows += [("x", 0, copy, "a file"), ("x", 1, copy, None), ("x", 2, "Раздел", f"Нажмите {copy}."), ("x", 3, he, "Русский текст"), ("x", 4, "Vitamin \u0421", "C")]
    df = spark.createDataFrame(rows, "path string, sec_no int, heading string, body string")
    got = {(r.path, r.sec_no): (r.heading, r.body) for r in confusables.look_alikes(df).collect()}
    assert got == {
        ("x", 0): ("Copy", "a file"), ("x", 1): ("Copy", None), ("x", 2): ("Раздел", "Нажмите Copy."), ("x", 4): ("Vitamin C", "C"),
        ("r", 0): ("Раздел", f"{he} открыт, а закрыт. Все файлы `Bce`."),
    }


def test_groups_of_headings_and_bodies_have_members(spark, tmp_path):
    odd = "c\u0430che"
    rows = [("a", 0, "Cache", "The cache, open"), ("a", 1, "other", f"A {odd} and the {odd}."), ("b", 0, "C\u0430che", None), ("b", 1, "ca\u00adche", ""), ("a", 1, "other", f"A {odd} and the {odd}.")]
    spark.createDataFrame(rows, "path string, sec_no int, heading string, body string").write.parquet(f"{tmp_path}/sections.parquet")
    groups = {(r.unit, r.skeleton): r for r in Q.p3_groups(spark, str(tmp_path)).collect()}
    assert {k: (r.spellings, r.one) for k, r in groups.items()} == {("text", "Cache"): (2, "Cache"), ("word", "Cache"): (2, "Cache"), ("word", "cache"): (3, "cache")}
    got = sorted((r.path, r.sec_no, r.column, r.unit, r.group, r.original) for r in Q.p3_members(spark, str(tmp_path)).collect())
    small, large = groups["word", "cache"].group, groups["word", "Cache"].group
    assert got == sorted([
        ("a", 0, "heading", "text", groups["text", "Cache"].group, "Cache"), ("b", 0, "heading", "text", groups["text", "Cache"].group, "C\u0430che"),
        ("a", 0, "heading", "word", large, "Cache"), ("b", 0, "heading", "word", large, "C\u0430che"),
        ("a", 0, "body", "word", small, "cache"), ("a", 1, "body", "word", small, odd), ("b", 1, "heading", "word", small, "ca\u00adche"),
    ])


# ---- 5
def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 30000):
        bits = np.sort(rng.choice(65536, n, replace=False))
        data = sitelines.container(bits)
        assert (sitelines.bits_of(data) == bits).all() and sitelines.cardinality(data) == n and len(data) <= 8193
        ask = rng.integers(0, 65536, 500)
        assert (sitelines.has_bits(data, ask) == np.isin(ask, bits)).all()
    a, b = np.arange(0, 9000, 2), np.arange(0, 9000, 3)
    assert (sitelines.bits_of(sitelines.union([sitelines.container(a), sitelines.container(b)])) == np.union1d(a, b)).all()


def brute_lines(rows):
    forms, places, sizes = {}, [], {}
    for path, source, body in rows:
        if path is None:
            continue
        sizes.setdefault(source, set()).add(path)
        fence = None
        for no, line in enumerate((body or "").split("\n"), 1):
            t = line.strip()
            if fence:
                fence = None if t[:3] == fence else fence
                continue
            if t[:3] in (T, "~~~"):
                fence = t[:3]
                continue
            f = re.sub("[0-9]+", "0", re.sub(r"\s+", " ", t).lower())
            if len(f) >= 25 and t[0] not in "#|":
                forms.setdefault((source, f), set()).add(path)
                places.append((path, no, source, f))
    return {(p, n) for p, n, s, f in places if len(forms[s, f]) >= 3 and len(forms[s, f]) * 20 >= len(sizes[s])}


def test_repeated_lines(spark):
    rng = random.Random(4)
    lines = ["Share this page: copy  link {n} mail", "# Share this page: copy link mail", "| share this page copy link mail |", "share this page", T, "~~~", "",
             "Rare line number {r} of this page only", "  SHARE this page: copy link {n} mail ", "Line of a few pages, that is all"]
    rows = []
    for i in range(70):
        picked = rng.sample(lines, rng.randint(1, 7))
        rows.append((f"p{i}", "big" if i < 60 else None, "\n".join(x.format(n=rng.randint(1, 999), r="abcdefghij"[i % 10] * i) for x in picked)))
    rows += [rows[3], rows[3], ("null", "big", None), (None, "big", lines[0]), ("e", "big", "")]
    df = spark.createDataFrame(rows, "path string, docset string, body string").withColumn("form", F.lit(1))
    for params in (sitelines.LineParams(), sitelines.LineParams(group_pages=5)):
        got = {(r.path, r.line_no) for r in sitelines.repeated_lines(df, params=params).collect()}
        assert got == brute_lines(rows) and got
    found = sitelines.repeated_lines(df)
    clean = {r.path: r for r in sitelines.without_lines(df, found).where("path is not null").collect()}
    for path, _, body in rows:
        if path and body is not None:
            gone = {n for p, n in got if p == path}
            assert clean[path].body == "\n".join(x for n, x in enumerate(body.split("\n"), 1) if n not in gone)
    assert clean["null"].body is None
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


# ---- 6
@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_obeys_capacities(choose):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 100, 700)
    p = packing.PackParams(tokens=100, documents=6, attention=0.6, choose=choose)
    bins = packing.best_fit(sizes, p)
    for b in np.unique(bins):
        own = sizes[bins == b]
        assert own.sum() <= 100 and len(own) <= 6 and ((own.astype(float) ** 2).sum() <= 6000 or len(own) == 1)
    free = packing.PackParams(tokens=100, documents=700, attention=1.0, choose=choose)
    assert packing.best_fit(sizes, free).max() + 1 <= 1.02 * sizes.sum() / 100 + 1
    assert len(packing.best_fit(np.zeros(0, np.int64), free)) == 0


def test_packing(spark):
    sizes = [0, 1, 8191, 8192, 8193, 16384, 20000, 300, 4000, 4191]
    rows = [(i, "x" * n, i) for i, n in enumerate(sizes)] + [(99, None, 0), (98, "é" * 5000, 0), (7, "x" * 300, 1), (97, "x" + "€" * 9000, 0), (96, "xx😀" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int")
    for params in (packing.PackParams(), packing.PackParams(block_rows=2)):
        got = packing.pack_texts(df, params=params).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {r[0] for r in rows}
        for i, text, _ in rows:
            own = sorted(by[i], key=lambda r: r.piece_no)
            if text is None:
                assert own[0].container is None
                continue
            size = len(text.encode())
            assert own[0].byte_start == 0 and own[-1].byte_end == size and all(a.byte_end == b.byte_start for a, b in zip(own, own[1:]))
            assert max(1, -(-size // 8192)) <= len(own) == own[0].n_pieces <= max(1, -(-size // 8189))
            assert "".join(text.encode()[r.byte_start : r.byte_end].decode() for r in own) == text
        load = {}
        for r in got:
            if r.container:
                load[r.container] = load.get(r.container, 0) + r.tokens
        assert max(load.values()) <= 8192
    both = spark.createDataFrame([(1, "a" * 9000), (1, "b" * 10), (1, "b" * 10)], "doc_id bigint, text string")
    assert sorted((r.piece_no, r.tokens) for r in packing.pack_texts(both).collect()) == [(0, 10), (0, 8192), (1, 808)]
    report = packing.fill_report(packing.pack_texts(df)).first()
    assert report.containers <= report.fewest_possible + 2
    assert packing.pack_texts(df.limit(0)).count() == 0
    assert all(r.covered and r.whole_characters and r.fits for r in packing.packing_checks(df, packing.pack_texts(df)).collect())


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_capacity_binds(choose):
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(1, 20, 400), rng.integers(50, 100, 100)])
    p = packing.PackParams(tokens=100, documents=8, attention=0.7, choose=choose)
    bins = packing.best_fit(sizes, p)
    docs, cost = np.bincount(bins), np.bincount(bins, sizes.astype(float) ** 2) / 7000
    assert docs.max() == 8 and ((cost > 0.95) & (cost <= 1)).any()
    for loose in (packing.PackParams(tokens=100, documents=500, attention=0.7), packing.PackParams(tokens=100, documents=8, attention=1.0)):
        assert packing.best_fit(sizes, loose).max() < bins.max()


# ---- 7
def brute_leaks(docs, items, n=13):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgéж1") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(10, 60)))) for i in range(30)] + [(77, None), (78, "a b c d e f g h i j k l m n o")]
    docs = []
    for d in range(200):
        text = say(rng.randint(0, 150))
        if d % 2:
            w = items[d % 30][1].split()
            n = rng.choice([11, 12, 13, 14, 30])
            at = rng.randint(0, max(0, len(w) - n))
            part = w[at : at + n]
            if d % 5 == 0 and len(part) > 5:
                part[len(part) // 2] = "changed"
            text[5:5] = part
        glue = [" ", ", ", "\r\n", "-", "_", " “"]
        docs.append((d, "".join(w.upper() + rng.choice(glue) if rng.random() < 0.3 else w + rng.choice(glue) for w in text)))
    docs += [(500, None), (501, ""), (502, "x A b-C d E f g h i j k l M n o y"), (503, docs[1][1]), (1, docs[1][1]), (504, "word " * 200_000 + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1))
    t = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 30
    for params in (leakage.LeakParams(), leakage.LeakParams(index_bytes=20_000), leakage.LeakParams(held_pairs=40), leakage.LeakParams(edits=0)):
        got = leakage.leaked_passages(d, t, params)
        assert {(r.doc_id, r.item_id) for r in got.where("run_words >= 13").collect()} == want
    at = got.where("doc_id = 504 and item_id = 3").first()
    assert at is None or at.doc_start > 900_000
    assert leakage.leaked_items(got).count() == len({i for _, i in want})
    assert leakage.leaked_passages(d.limit(0), t).count() == leakage.leaked_passages(d, t.limit(0)).count() == 0


def test_near_passages_are_found():
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    index = leakage.ItemIndex([1], [item], leakage.LeakParams(edits=2, q=8))
    broken = item[:50] + "#x" + item[52:90] + item[91:]
    found = leakage.find(index, [7, 8], ["prefix " + broken + " suffix", "nothing of that kind here at all"])
    assert [(r[0], r[1]) for r in found] == [(7, 1)]


def test_short_items_and_second_stretches():
    rng = random.Random(18)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    short, long = say(7), say(60)
    index = leakage.ItemIndex([1, 2], [" ".join(short), " ".join(long)], leakage.LeakParams())
    # The better stretch has an edit in each run of 13 words, the lesser one none; both are on one diagonal.
    first = list(long)
    for k in range(5, 40, 9):
        first[k] = first[k][:2] + "z" + first[k][3:]
    first[41:44] = ["q" * 6] * 3
    first[57:] = ["v" * 6] * 3
    rows = leakage.find(index, [5, 6], ["x " + " ".join(short) + " y", "x " + " ".join(first) + " y"])
    assert {(r[0], r[1]): r[4] for r in rows} == {(5, 1): 7, (6, 2): 13}


def test_memory_is_that_of_a_block(spark):
    rng = random.Random(19)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(400)]
    sizes = [leakage.ItemIndex(list(range(n)), texts[:n], leakage.LeakParams()) for n in (100, 400)]
    bytes_of = [sum(v.nbytes for v in x.__dict__.values() if isinstance(v, np.ndarray)) - x.seen.nbytes for x in sizes]
    chars = [sum(map(len, texts[:n])) for n in (100, 400)]
    assert all(b <= leakage.BYTES_PER_CHAR * c for b, c in zip(bytes_of, chars))


def test_all_nearly_equal_runs_are_found(spark):
    rng = random.Random(20)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(20)]
    docs = []
    for d in range(100):
        text = items[d % 20][1].split()[rng.randint(0, 10) :]
        text = " ".join([rng.choice(words) for _ in range(20)] + text[: rng.randint(10, 15)] + [rng.choice(words) for _ in range(5)])
        for _ in range(d % 3):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "x", text[at] + "y"]) + text[at + 1 :]
        docs.append((d, text))
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    brute = {tuple(r) for r in leakage.exhaustive_pairs(d, t).collect()}
    assert len(brute) > 30 and brute >= brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_passages(d, t).collect()} >= brute


# ---- 8
RIGHT = ["Für die Größe gelten höchstens drei Einträge.", "Après déjà créé, c’est réglé — “très” bien.", "Чтобы создать слой, сначала откройте каталог.", "La opción está válida, ¿no?"]


def test_segments_are_maximal():
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 12))]
        got = mojibake.maximal_segments([float(x) for x in s])

        def split(lo, hi):  # by the definition: the best segment, then left and right of it
            best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if not best or best[0] <= 0:
                return []
            return split(lo, best[2]) + [best] + split(best[3], hi)

        assert [g[2] for g in got] == [float(b[0]) for b in split(0, len(s))] or sum(g[2] for g in got) == sum(b[0] for b in split(0, len(s)))


def garble(text, right, wrong, times=1):
    for _ in range(times):
        text = text.encode(right).decode(wrong, "replace")
    return text


def test_garbled_texts(spark):
    sound = [(i, f"{i} {RIGHT[i % 4]} Text {i % 7}.") for i in range(400)]
    bad, want = [], {}
    for n, (text, right, wrong, times) in enumerate([
        (RIGHT[0], "utf-8", "latin-1", 1), (RIGHT[1], "utf-8", "cp437", 1), (RIGHT[0], "utf-8", "mac_roman", 1), (RIGHT[2], "cp1251", "latin-1", 1),
        (RIGHT[2], "koi8-r", "cp1251", 1), (RIGHT[3], "utf-8", "latin-1", 2), (RIGHT[0], "utf-8", "cp1251", 1),
    ]):
        bad.append((1000 + n, garble(text, right, wrong, times)))
        want[1000 + n] = text
    for n, head in enumerate(("#", "D")):  # byte-order marks, misread
        bad.append((1100 + n, f"ï»¿{head} {RIGHT[n % 4]}"))
        want[1100 + n] = f"\ufeff{head} {RIGHT[n % 4]}"
    lost = [(2000, "caf\ufffd na\ufffdve text"), (2001, garble(RIGHT[0], "latin-1", "utf-8"))]
    fine = [(3000, "Shows `Ã©` and `\ufffd` here."), (3001, "├── a\n└── b"), (3002, "\ufeffText"), (3003, "ÉQUIPE ÀÉ ×2 ±3° ½"), (3004, ""), (3005, None), (3006, "cut\ufffd")]
    df = spark.createDataFrame(sound + bad + lost + fine + bad[:1] + [(bad[0][0], "sound text")], "doc_id bigint, text string").withColumn("id", F.lit("clash"))
    got = {r.doc_id: r for r in mojibake.garbled_texts(df).collect()}
    assert set(got) == set(want) | {2000, 2001}
    assert {i: got[i].restored_text for i in want} == want
    assert got[2000].lost_chars == 2 and got[2000].restored_stretches == 0
    assert mojibake.garbled_texts(df.limit(0)).count() == 0


# ---- all
def test_queries_run(spark, folder):
    for name, query in Q.queries().items():
        rows = query(spark, folder)
        assert rows.columns and rows.count() >= 0, name
        if name.endswith("_found"):
            assert rows.count() == rows.distinct().count(), name
