"""Retrieval quality against judged cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(text: Column) -> Column:
    """Hash of a page without front matter; copies under other paths share it."""
    # Every line end counts, as in text files read by lines.
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n", -1)
    # As lines are counted, a line end at the very end starts no further line.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    fence = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "") == "---"
    marks = F.filter(F.transform(lines, lambda x, i: F.when(fence(x), i + 1)), lambda i: i.isNotNull())
    fronted = (F.size(marks) > 1) & (marks[0] == 1)
    body = F.when(fronted, F.slice(lines, F.try_element_at(marks, F.lit(2)) + 1, F.size(lines))).otherwise(lines)
    return F.sha2(F.array_join(body, "\n"), 256)


def distinct_cases(cases: DataFrame) -> DataFrame:
    """Each case once. Of kinds, only "identifier" and "task" are known; others, null included, are "other"."""
    kind = F.lower(F.trim("kind"))
    rows = cases.groupBy("case_id").agg(F.min(F.struct("docset", "query", "kind", "expected")).alias("c"))
    rows = rows.select("case_id", "c.docset", "c.query", "c.kind", "c.expected")
    return rows.withColumn("kind", F.when(kind.isin("identifier", "task"), kind).otherwise("other"))


def _expected_pages(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, expected, path (null where no page matches), by an equality join on what paths of a docset end in.

    A path matches an expected page through one of its own suffixes, and a prefix through one of its own prefixes from
    some component on; so both sides meet on equal keys and no pairs are tried.
    """
    want = cases.select("case_id", "docset", F.explode("expected").alias("expected"))
    inside = F.regexp_replace("path", r"^[^/]*/", "")
    parts = pages.where(F.col("path").isNotNull()).select("docset", "path", inside.alias("inside")).distinct()
    pieces = F.split("inside", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    suffixes = parts.select("docset", "path", F.explode(tails).alias("key"))
    exact = want.where(~F.col("expected").rlike("[/-]$")).join(
        suffixes.withColumnRenamed("key", "expected"), ["docset", "expected"], "left"
    )
    # A prefix ends in / or -; the same stretches of each suffix are its keys.
    heads = F.filter(
        F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", F.lit(1), i)), lambda x: x.rlike("[/-]$")
    )
    prefixes = suffixes.select("docset", "path", F.explode(heads).alias("expected")).distinct()
    below = want.where(F.col("expected").rlike("[/-]$")).join(prefixes, ["docset", "expected"], "left")
    return exact.select("case_id", "expected", "path").unionByName(below.select("case_id", "expected", "path")).distinct()


def missing_expectations(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, expected of expectations that no page of the case's docset meets."""
    return _expected_pages(cases, pages).where(F.col("path").isNull()).select("case_id", "expected")


def first_good_ranks(cases: DataFrame, hits: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, docset, kind, rank (null without a good hit), returned (paths in rank order) of every case.

    hits has case_id, rank, path. A page is good if it is expected, or a copy of an expected page by its content
    key; where any expectation is a prefix, copies don't count.
    """
    good = _expected_pages(cases, pages).where(F.col("path").isNotNull()).select("case_id", "path").distinct()
    keys = pages.where(F.col("body").isNotNull()).select("path", content_key(F.col("body")).alias("key")).distinct()
    strict = cases.where(~F.exists("expected", lambda e: e.rlike("[/-]$"))).select("case_id")
    copies = good.join(strict, "case_id", "left_semi").join(keys, "path").select("case_id", "key").join(keys, "key")
    good = good.unionByName(copies.select("case_id", "path")).distinct().withColumn("good", F.lit(True))
    ranked = hits.join(good, ["case_id", "path"], "left").groupBy("case_id").agg(
        F.min(F.when(F.col("good"), F.col("rank"))).alias("rank"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("returned"),
    )
    none = F.array().cast("array<string>")
    return cases.select("case_id", "docset", "kind").join(ranked, "case_id", "left").withColumn(
        "returned", F.coalesce("returned", none)
    )


def quality(results: DataFrame) -> DataFrame:
    """cases, hit1, hit3, hit5 and mrr5 by docset, by kind, and over all (both null)."""
    within = lambda k: F.count_if(F.col("rank") <= k)
    reciprocal = F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)
    return results.groupingSets([["docset"], ["kind"], []], "docset", "kind").agg(
        F.count(F.lit(1)).alias("cases"), within(1).alias("hit1"), within(3).alias("hit3"), within(5).alias("hit5"),
        F.round(F.sum(reciprocal) / F.count(F.lit(1)), 6).alias("mrr5"),
    )


def write_cases(results: DataFrame, to: str) -> None:
    """Each case's outcome as JSON lines: case_id, docset, kind, rank (left out without one), returned."""
    results.write.mode("overwrite").json(to)


def misses(results: DataFrame) -> DataFrame:
    """Cases without a good page at the first rank, with what came back."""
    return results.where(F.col("rank").isNull() | (F.col("rank") > 1))


def assertions(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, status of text assertions: cases (case_id, query_id, expectation, substr) against rendered outputs.

    expectation is "rank1" or "top3" (the text stands in the first, or the first three blocks, whatever its case) or
    "found" (there is any output). A case without query_id is skipped: its corpus is missing.
    """
    blocks = F.regexp_extract_all(F.lower("output"), F.lit("(?s)--- début de section.*?--- fin de section"), F.lit(0))
    rows = cases.join(outputs.select("query_id", blocks.alias("blocks")), "query_id", "left")
    found = F.size(F.coalesce("blocks", F.array().cast("array<string>"))) > 0
    holds = lambda n: F.exists(F.slice(F.coalesce("blocks", F.array().cast("array<string>")), 1, n), lambda b: F.contains(b, F.lower("substr")))
    passed = F.when(F.col("expectation") == "rank1", holds(1)).when(F.col("expectation") == "top3", holds(3)).otherwise(found)
    status = F.when(F.col("query_id").isNull(), "SKIP").when(passed, "PASS").otherwise("FAIL")
    return rows.select("case_id", status.alias("status"))


def assertion_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))
