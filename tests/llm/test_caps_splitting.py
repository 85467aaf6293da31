import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.llm.caps import Cap, cap_hits_per_page, dropped, keep_best, quota
from pagequarry.llm.splitting import BOUNDARIES, SplitParams, cut_points, split_pieces

def order():
    return [F.col("score").desc_nulls_last(), F.col("id")]


def rows_of(df):
    return sorted(r.id for r in df.collect())


def test_nested_caps_take_the_best_set(spark):
    rng = random.Random(3)
    data = [(i, f"o{i % 2}", f"d{i % 4}", f"a{i % 8}", round(rng.random(), 2)) for i in range(14)]
    df = spark.createDataFrame(data, "id int, org string, domain string, author string, score double")
    caps = [Cap(["author"], most=1), Cap(["domain"], most=2), Cap(["org"], most=3)]
    kept = rows_of(keep_best(df, caps, order()))

    def allowed(ids):
        for col, most in ((3, 1), (2, 2), (1, 3)):
            for _, g in itertools.groupby(sorted(ids, key=lambda i: data[i][col]), key=lambda i: data[i][col]):
                if len(list(g)) > most:
                    return False
        return True

    best = max((s for n in range(15) for s in itertools.combinations(range(14), n) if allowed(s)), key=lambda s: sum(data[i][4] for i in s))
    assert sum(data[i][4] for i in kept) == pytest.approx(sum(data[i][4] for i in best)) and allowed(kept)


def test_shares_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (3, "a", 1.0), (4, None, 0.5), (5, None, None)], "id int, author string, score double")
    assert rows_of(keep_best(df, [Cap(["author"], most=1)], order())) == [2, 4]
    assert rows_of(keep_best(df, [Cap(["author"], share=0.5)], order())) == [2, 3, 4, 5]
    assert rows_of(keep_best(df, [Cap(["author"], share=0.1)], order())) == [2, 4]  # too few authors for a tenth each
    assert rows_of(keep_best(df.limit(0), [Cap(["author"], share=0.5)], order())) == []
    kept = keep_best(df, [Cap(["author"], most=1)], order())
    assert rows_of(dropped(df, kept, ["id"])) == [1, 3, 5]
    for bad in ({}, {"most": 1, "share": 0.5}, {"share": 0.0}, {"most": -1}):
        with pytest.raises(ValueError):
            Cap(["x"], **bad)


def best_quota(sizes, share):
    return max([1] + [q for q in range(max(sizes, default=0) + 1) if q <= share * sum(min(n, q) for n in sizes) + 1e-9])


def test_quotas(spark):
    rng = random.Random(12)
    for share in (0.05, 0.2, 0.25, 1 / 3, 0.5, 1.0):
        for _ in range(2):
            sizes = [rng.choice([1, 1, 2, 3, 10, 40]) for _ in range(rng.randint(1, 25))]
            df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
            assert quota(df, ["g"], share).first().quota == best_quota(sizes, share), (sizes, share)


def test_nobody_has_more_than_the_share_of_what_is_kept(spark):
    data = [(i, "hot" if i < 90 else f"a{i}", i / 100) for i in range(100)]
    df = spark.createDataFrame(data, "id int, author string, score double")
    kept = keep_best(df, [Cap(["author"], share=0.2)], order()).collect()
    hot = sorted(r.id for r in kept if r.author == "hot")
    assert len(kept) - len(hot) == 10 and hot == [88, 89] and len(hot) <= 0.2 * len(kept)


def test_shares_of_a_large_group(spark):
    rng = random.Random(11)
    data = [(i, "hot" if i % 3 else f"a{i % 7}", rng.choice([None, 0.1, 0.2, 0.5])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, author string, score double").repartition(6)
    groups = {}
    for i, a, s in data:
        groups.setdefault(a, []).append((s is None, -(s or 0), i))
    most = best_quota([len(g) for g in groups.values()], 0.3)
    want = sorted(x[2] for g in groups.values() for x in sorted(g)[:most])
    assert most > 200 and rows_of(keep_best(df, [Cap(["author"], share=0.3)], order())) == want


def test_hits_per_page(spark):
    sections = spark.createDataFrame(
        [("a", 0, "P"), ("a", 1, "P"), ("a", 2, "P"), ("a", 2, "P"), ("s", 0, ""), ("n", 0, None)], "path string, sec_no int, page string"
    )
    hits = spark.createDataFrame(
        [("q", "a", 0, 1.0, 9), ("q", "a", 1, 1.0, 9), ("q", "a", 1, 1.0, 8), ("q", "a", 2, None, 9), ("q", "s", 0, 5.0, 9), ("q", "gone", 0, 5.0, 9),
         (None, "a", 0, 1.0, 9), (None, "a", 1, 2.0, 9), (None, "a", 2, 3.0, 9), ("q", "n", 0, 5.0, 9)],
        "query_id string, path string, sec_no int, score double, page int",
    )
    kept, out = cap_hits_per_page(hits, sections)
    key = lambda df: sorted((r.query_id or "", r.path, r.sec_no) for r in df.collect())
    assert key(kept) == [("", "a", 1), ("", "a", 2), ("q", "a", 0), ("q", "a", 1)]
    assert key(out) == [("", "a", 0), ("q", "a", 2)]
    kept, out = cap_hits_per_page(hits.limit(0), sections)
    assert kept.count() == out.count() == 0


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéж") for _ in range(rng.randint(1, 9)))
    for sep in ("\n\n", "\n", ". ", " ", ""):
        yield sep, sep.join(" ".join(word() for _ in range(rng.randint(1, 12))) if sep != "" else word() for _ in range(1500))


@pytest.mark.parametrize(("sep", "text"), list(texts()))
def test_cuts_lose_nothing_and_are_natural(sep, text):
    p = SplitParams()
    ends = cut_points(text, p)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    start = 0
    for i, end in enumerate(ends):
        start = ends[i - 1] - p.overlap if i else 0
        assert 0 < end - start <= p.limit
        if i + 1 < len(ends) and sep:
            begun = start + (p.overlap if i else 0)
            earliest = begun + max(1, int((start + p.limit - begun) * p.reach))
            kinds = [any(earliest <= min(m.end(), start + p.limit) for m in b.finditer(text, earliest - 1, start + p.limit)) for b in BOUNDARIES]
            # Words are parted only where the window has no other boundary.
            ours = BOUNDARIES[:3] if any(kinds[:3]) else BOUNDARIES[3:]
            assert any(min(m.end(), start + p.limit) == end for b in ours for m in b.finditer(text, earliest - 1, start + p.limit))


@pytest.mark.parametrize(("sep", "sign"), [("\n\n", "block"), ("\n", "line"), (". ", "sentence"), (" ", "word")])
def test_boundaries_before_the_window_are_used(sep, sign):
    text = "some" + sep + "x" * 3900 + sep + "y" * 4377 + sep + "z" * 3700 + sep + "end"
    ends = cut_points(text)
    # No piece breaks a run that fits one; the run longer than a piece is cut hard, after the boundary before it.
    assert ends[0] == text.index("y"), sign
    assert text.index("z") in ends and all(not (text.index("x") < e < text.index("y") or text.index("z") < e < len(text) - 3) for e in ends)
    head = "a" * 300 + sep
    assert cut_points(head + "q" * 4377 + sep + "end")[0] == len(head)


def test_pieces_shorter_than_the_overlap_are_not_cut():
    text = "a" * 145 + "\n\n" + "b" * 4400
    ends = cut_points(text)
    assert ends[0] == 4000 and ends[-1] == len(text)


def test_class_and_depth_are_weighed_together():
    cat, dog = "Cat purr milk. " * 20, "Dog bark bone. " * 20
    # A blank line within one topic, only a sentence's end between two.
    text = cat * 3 + dog + "\n\n" + dog * 6
    end = cut_points(text, SplitParams(limit=1600, overlap=0))[0]
    assert text[end:].startswith("Dog") and text[:end].rstrip().endswith("milk.")
    same = cat * 4 + "\n\n" + cat * 6
    assert same[: cut_points(same, SplitParams(limit=1600, overlap=0))[0]].endswith("\n\n")


def test_cohesion_picks_the_topic_boundary():
    cat, dog = "cat purr milk. " * 20, "dog bark bone. " * 20
    text = "\n\n".join([cat] * 4 + [dog] * 8)
    end = cut_points(text, SplitParams(limit=2200, overlap=0))[0]
    assert text[end:].startswith("dog") and text[:end].rstrip().endswith("milk.")


def test_pieces(spark):
    long, marks = "word " * 3000, "e" + "́" * 9000
    rows = spark.createDataFrame(
        [("a", 0, "short", 1), ("a", 1, long, 1), ("a", 1, long, 2), ("b", 0, None, 1), ("b", 1, "", 1), ("m", 0, marks, 1)],
        "path string, sec_no int, body string, piece_no int",
    )
    got = split_pieces(rows, "body", ["path", "sec_no"]).orderBy("path", "sec_no", "piece_no").collect()
    assert {(r.path, r.sec_no) for r in got} == {("a", 1), ("m", 0)}
    for path, text in (("a", long), ("m", marks)):
        own = [r for r in got if r.path == path]
        assert [r.piece_no for r in own] == list(range(own[0].n_pieces))
        assert own[0].piece + "".join(r.piece[200:] for r in own[1:]) == text
        assert all(a.piece[-200:] == b.piece[:200] for a, b in zip(own, own[1:]))
        assert all(r.piece == text[r.piece_start : r.piece_end] and len(r.piece) <= 4000 for r in own)
    assert split_pieces(rows, "body", ["path", "sec_no"], oversized_only=False).where("n_pieces = 1").count() == 2
    assert split_pieces(rows.limit(0), "body", ["path"]).count() == 0
    with pytest.raises(ValueError):
        SplitParams(limit=100, overlap=100)
