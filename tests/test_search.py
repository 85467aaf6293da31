import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry import session
from pagequarry.functions import matching as M
from pagequarry.operators import batch, render, search
from pagequarry.operators.slicer import sections_of
from pagequarry.params import EmptyQuery, InvalidParam, RankingParams
from pagequarry.sources.markdown import pages_from


def corpus(spark, files, single=False):
    raw = spark.createDataFrame(list(files.items()), "path string, text string")
    return search.prepared(sections_of(pages_from(raw, single=single)).withColumn("docset", F.lit("d")))


def hits(spark, files, query, k=3, single=False):
    return [(r.path, r.sec_no) for r in search.rank_sections(corpus(spark, files, single), query, k).orderBy("rank").collect()]


def scores_of(spark, text, query):
    """Scores by section number of a single-file corpus."""
    return {r.sec_no: r.score for r in search.scored(corpus(spark, {"f": text}, True), query).collect()}


@pytest.mark.parametrize(
    ("word", "kept"),
    [
        ("throughput!", "throughput"), ("[max_conn]", "max_conn"), ("flush_all(now)", "flush_all(now"), ("“quoted”", "quoted"), ("key=1;", "key=1"),
        ("¿Dónde", "dónde"), ("os.path.join", "os.path.join"), ("F#", "f#"), ("a++b", "a++b"), ("-v", "-v"), (".env", ".env"), ("Map<K>", "map<k>"), ("...", None), ("`x`", "x"),
    ],
)
def test_query_punctuation(spark, word, kept):
    assert M.keywords_of(word) == ([kept] if kept else [])
    row = spark.createDataFrame([(word,)], "q string").select(M.keywords(F.col("q")).alias("w")).first()
    assert row.w == ([kept] if kept else [])


def test_whole_words_take_the_counted_places(spark):
    rows = [("xa-a-a", "a-a", 0, 1), ("input inputs", "input", 1, 2), ("a_input_b", "input", 1, 1), ("éinput", "input", 1, 1), ("aa", "a", 0, 2)]
    got = spark.createDataFrame([(t, w) for t, w, _, _ in rows], "t string, w string").select(
        M.whole_words(F.col("t"), F.col("w")).alias("x"), M.occurrences(F.col("t"), F.col("w"), 20).alias("n")
    )
    assert [tuple(r) for r in got.collect()] == [(x, n) for _, _, x, n in rows]


@pytest.mark.parametrize(
    ("text", "word", "starts"),
    [
        ("__Timeout__ in seconds", "timeout", True), ("first\n   + [port]: y", "port", True), ("the port", "port", False), ("-v prints", "-v", False),
        ("-v prints", "v", True), ("|  depth | 3 |", "depth", True), ("\n>\t\"limit\"", "limit", True), ("port the port\nan port", "port", True),
    ],
)
def test_definition_lines(spark, text, word, starts):
    row = spark.createDataFrame([(text.lower(),)], "t string").select(M.starts_a_line(F.col("t"), word).alias("x")).first()
    assert row.x == starts
    scan = search.NeedleScan({word: {"d"}}, 20)
    found = {r[4]: r[7] for r in scan.of("d", "p", 0, 0, text.lower(), "", "", "page")}
    assert found.get(word, False) == starts


def test_names_of_pages_count(spark):
    text = "## Intro\n\nRotate the log file often.\n"
    assert hits(spark, {"a/misc.md": text, "b/log-rotate.md": text + "."}, "rotate log")[0][0] == "b/log-rotate.md"  # the name has both words
    files = {"x/timeouts.md": "## T\n\ntimeout one\n", "x/timeout.md": "## U\n\ntimeout and more of it\n"}
    assert hits(spark, files, "Timeout")[0][0] == "x/timeout.md"  # the stem is the query
    pages = {"all_keys.md": "## K\n\n" + "Prose goes on here. " * 250 + "\n- `max_age`: seconds\n", "tips.md": "## T\n\nset max_age once\n"}
    assert hits(spark, pages, "max_age")[0][0] == "all_keys.md"  # a line that defines the word
    # In a single file no page has a name, so mentions decide.
    assert hits(spark, {"f": "## A\n\nmax_age max_age max_age\n\n## B\n\n- max_age\n"}, "max_age", single=True)[0] == ("f", 0)


def test_repeats_and_pages_are_limited(spark):
    many = "".join(f"## Part {i}\n\nshard number {i}\n\n" for i in range(4))
    got = hits(spark, {"big.md": many, "small.md": "## S\n\none shard\n"}, "shard", 5)
    assert sum(p == "big.md" for p, _ in got) == 2 and ("small.md", 0) in got and len(got) == 3
    twin = "## Flags\n\nquota flag\n"
    got = hits(spark, {"one.md": twin, "three.md": twin, "two.md": twin + "\n\n", "other.md": "## Flags\n\nquota flag here\n"}, "quota", 9)
    assert len(got) == 2  # trimmed bodies are compared


def test_counts_words_and_order(spark):
    text = "## A\n\n" + "red " * 8 + "\n\n## B\n\nred bluet\n\n## C\n\nred blue\n"
    assert [n for _, n in hits(spark, {"f": text}, "red blue", single=True)] == [2, 1, 0]  # more keywords before more mentions
    s = scores_of(spark, "## A\n\n" + "k " * 45 + "\n\n## B\n\n" + "k " * 20 + "-" * 50 + "\n\n", "k")
    assert s[0] == pytest.approx(s[1], abs=1e-9)  # more than the cap doesn't count
    s = scores_of(spark, "## A\n\na mapped x\n\n## B\n\na map x  xx\n", "map")
    assert s[1] > s[0]  # whole words
    text = "".join(f"## {h}\n\nsame words\n\n" for h in ("q", "r", "s")) + "## t\n\nnone\n"
    assert hits(spark, {"f": text}, "same", 2, single=True) == [("f", 0), ("f", 1)]  # equal scores by place


def test_phrases_titles_and_bare_headings(spark):
    text = "## A\n\ncold and warm start\n\n## B\n\nthe cold start now\n"
    assert hits(spark, {"f": text}, "COLD  start", single=True)[0] == ("f", 1)
    assert hits(spark, {"f": "# Top\n\n## Orphan\n\n## Rest\n\nno such thing\n"}, "orphan", single=True) == [("f", 1)]
    text = "## Rest\n\nnothing else\n\n# Buffer\n\nThe buffer.\n\n### Buffer size\n\n" + "buffer " * 5 + "\n"
    assert [n for _, n in hits(spark, {"f": text}, "buffer", single=True)] == [1, 2]  # a short page title that begins so
    text = "## Nothing\n\nword pair word\n\n## WordPair\n\nword\n"
    assert hits(spark, {"f": text}, "word pair", single=True)[0] == ("f", 1)


def test_repeated_and_outdated_sections(spark, tmp_path):
    c = corpus(spark, {"a.md": "## A\n\nkey one\n", "b.md": "## B\n\nkey two\n"})
    twice = c.union(c)
    assert search.document_frequencies(twice, ["key"]).first().n == 2
    assert [tuple(r) for r in search.rank_sections(twice, "key").collect()] == [tuple(r) for r in search.rank_sections(c, "key").collect()]
    # Of two versions of one section the search takes one, and all of it from that.
    old = c.where("path = 'a.md'").withColumn("body_n", F.lit("lock lock")).withColumn("version", F.lit(-(2**63)))
    both = c.union(old.select(c.columns))
    assert search.rank_sections(both, "lock").count() == 0 and search.document_frequencies(both, ["lock"]).first().df_0 == 0
    q = spark.createDataFrame([("1", "lock", "d"), ("2", "key", "d")], "query_id string, query string, docset string")
    assert {(r.query_id, r.path) for r in search.batch_search(q, both).collect()} == {("2", "a.md"), ("2", "b.md")}
    raw = spark.createDataFrame([("a.md", "## A\n\nkey one\n"), ("b.md", "## B\n\nkey two\n")], "path string, text string")
    search.write_index(sections_of(pages_from(raw)).withColumn("docset", F.lit("d")), str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in search.rank_sections(index, "key two").collect()] == [tuple(r) for r in search.rank_sections(c, "key two").collect()]
    assert search.batch_search(q, index).count() == 2


def test_no_body_is_shuffled_for_a_query(spark):
    table = spark.createDataFrame(
        [("a", 0, 1, "h", ["c"], "key text", "p", "s", "d")],
        "path string, sec_no int, level int, heading string, breadcrumb array<string>, body string, page string, page_stem string, docset string",
    )
    plan = search.rank_sections(search.prepared(table), "key text")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Aggregate" in line or "Window" in line or "Join" in line:
            assert "body_n" not in line and "heading_n" not in line, line


def test_errors_and_empty(spark):
    c = corpus(spark, {"a.md": "# A\n\nx\n"})
    for q in ("", "  ", "?? !"):
        with pytest.raises(EmptyQuery):
            search.rank_sections(c, q)
    with pytest.raises(InvalidParam):
        search.rank_sections(c, "x", 0)
    assert search.rank_sections(c, "nothing").count() == 0
    assert search.rank_sections(c.limit(0), "x").count() == 0


def test_folding(spark):
    sections = sections_of(pages_from(spark.createDataFrame([("f", "# Résumé\n\nx\n")], "path string, text string")))
    assert search.rank_sections(search.prepared(sections), "resume").count() == 0
    p = RankingParams(fold_diacritics=True)
    assert search.rank_sections(search.prepared(sections, p), "resume", 3, p).count() == 1


def test_batch_gives_what_single_queries_give(spark):
    files = {
        "a/x.md": "# Cache header\n\nThe cache header is cached.\n\n## Index\n\nsearch index\n",
        "a/cache-header.md": "# Other\n\nheader\n\n**cache** x\n", "a/y.1.en.md": "# Index\n\n- index: first search\n\n## Bare\n",
    }
    c = corpus(spark, files)
    asked = ["cache header", "index", "search, index!", "bare", "y", "nothing", "header (cache)"]
    q = spark.createDataFrame([(str(i), t, "d") for i, t in enumerate(asked)] + [("n", None, "d"), ("e", "?!", "d")], "query_id string, query string, docset string")
    got = {}
    for r in search.batch_scored(q, c).collect():
        got.setdefault(r.query_id, {})[r.path, r.sec_no] = r.score
    for i, t in enumerate(asked):
        alone = {(r.path, r.sec_no): r.score for r in search.scored(c, t).collect() if r.score > 0}
        assert got.get(str(i), {}) == pytest.approx(alone)
    assert {"n", "e"}.isdisjoint(got)
    assert search.batch_search(q.limit(0), c).count() == 0


def test_scans_agree():
    words = {"ab": {"d"}, "b": {"d", "e"}, "aba": {"e"}, "a b": {"e"}}
    one_by_one, automaton = search.NeedleScan(words, 20), search.NeedleScan(words, 20, few=0)
    for scope in ("d", "e", "none"):
        args = (scope, "p", 1, 0, "ababa b abab", "ab", "b", "aba x")
        assert sorted(one_by_one.of(*args)) == sorted(automaton.of(*args))


def shuffled(df):
    """Rows that the plan's exchanges write when it runs."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += plan.metrics().apply("shuffleRecordsWritten").value()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def many(spark):
    """Sections that all have some word of all queries, some of them equal, on pages with several."""
    files = {f"p{i}.md": "".join(f"## Part {(i + j) % 7}\n\nshard and key {j * i % 5}\n\n" for j in range(5)) for i in range(16)}
    asked = ["shard", "key 3", "part shard", "and 2", "p7", "key and shard"] * 5
    return corpus(spark, files), asked, spark.createDataFrame([(str(i), t, "d") for i, t in enumerate(asked)], "query_id string, query string, docset string")


def test_batch_search_shuffles_few_rows(spark):
    c, asked, q = many(spark)
    assert search.batch_scored(q, c).count() > 1500
    assert shuffled(search.batch_search(q, c, 3)) <= 2 * 3 * len(asked)
    assert shuffled(search.batch_scored(q, c)) == 0


def test_shards_and_blocks_give_what_single_queries_give(spark, monkeypatch):
    c, asked, q = many(spark)
    for name, most in (("SHARD_ROWS", 6), ("TASK_BYTES", 600), ("BLOCK_BYTES", 30)):
        monkeypatch.setattr(batch, name, most)
    got = {}
    for r in search.batch_search(q, c.union(c), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.path, r.sec_no))
    alone = {t: [(r.rank, r.path, r.sec_no) for r in search.rank_sections(c, t, 4).orderBy("rank").collect()] for t in set(asked)}
    assert got == {str(i): alone[t] for i, t in enumerate(asked) if alone[t]}


def test_all_pairs_leave_no_shuffle_on_disk(spark, monkeypatch):
    c, _, q = many(spark)
    packed = []
    monkeypatch.setattr(batch, "drop_shuffles", lambda df: (packed.append(df), session.drop_shuffles(df)))
    scored = search.batch_scored(q, c.union(c), digits=6, pages=False)
    ids = list(packed[0]._jdf.queryExecution().executedPlan().context().shuffleIds())
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    assert ids and not any(tracker.containsShuffle(i) for i in ids)
    assert scored.columns == ["query_id", "path", "sec_no", "score"]
    # Rounded in the task as Spark rounds, each section once, equal ones too.
    key = ["query_id", "path", "sec_no"]
    alone = search.batch_scored(q, c).select(*key, F.round("score", 6).alias("score"))
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, alone.collect()))


def test_rounding_is_that_of_spark(spark):
    x = [0.0, 5e-7, 4.999999e-7, 1.0000005, 2.0000015, 1.0000004999999999, 0.1234565, 123.4567885, 7.3999995, 1e10 / 3, 98765.4321015, 2.5e15, 1e22]
    x += [(2 * i + 1) / 2e6 for i in range(2000)] + [i / 7 for i in range(2000)]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert batch.rounded(np.array(x), 6).tolist() == want


def test_rendering_shuffles_no_section_without_a_hit(spark):
    fields = "path string, sec_no int, level int, heading string, breadcrumb array<string>, body string, url string"
    sections = spark.createDataFrame([(f"p{i}", 0, 1, f"h{i}", [], f"text {i}", None) for i in range(300)], fields)
    q = spark.createDataFrame([("1", "a"), ("2", "b")], "query_id string, query string")
    # As hits come from a search: of a size that isn't known when the plan is made.
    hits = spark.createDataFrame([("1", 1, 2.0, "p7", 0), ("1", 2, 1.0, "p9", 0), ("2", 1, 3.0, "p7", 0)], "query_id string, rank int, score double, path string, sec_no int")
    hits = hits.mapInArrow(lambda batches: batches, hits.schema)
    outputs = render.rendered(hits, sections.union(sections), q)
    assert shuffled(outputs) <= 20
    got = {r.query_id: r.output for r in outputs.collect()}
    assert set(got) == {"1", "2"} and got["1"].index("text 7") < got["1"].index("text 9") and got["1"].count("text 7") == 1
