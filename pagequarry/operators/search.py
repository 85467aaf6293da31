"""Ranking sections for keyword queries: one query as one expression, or many queries in one distributed plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import matching as M
from pagequarry.operators.batch import any_whole, batch_hits
from pagequarry.params import EmptyQuery, InvalidParam, RankingParams

#: Bytes of keywords and phrases that one pass over the sections looks for.
NEEDLE_BYTES = 8 << 20


def prepared(sections: DataFrame, params: RankingParams = RankingParams()) -> DataFrame:
    """Sections with the columns that matching reads: rows of the index, row by row, without a shuffle.

    Null texts are empty, null level is 0; has_body and body_bytes are taken from the body, as a given body_bytes may be
    null or outdated. `version` is a hash of all of them: of rows with one (path, sec_no) the search takes the largest.
    """
    fold = params.fold_diacritics
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = sections.select(
        "path", "sec_no", F.coalesce("level", F.lit(0)).cast("int").alias("level"),
        M.normalized(text("heading"), fold).alias("heading_n"), M.normalized(text("body"), fold).alias("body_n"),
        M.normalized(F.array_join(F.coalesce("breadcrumb", F.array().cast("array<string>")), " "), fold).alias("crumb_n"),
        M.normalized(text("page"), fold).alias("page_n"), text("page").alias("page"), F.lower(text("page_stem")).alias("stem"),
        F.octet_length(text("body")).alias("body_bytes"), F.regexp_like(text("body"), F.lit(r"(?U)\S")).alias("has_body"),
        *[c for c in ("docset",) if c in sections.columns],
    )
    return rows.withColumn("version", F.xxhash64("level", "heading_n", "crumb_n", "page", "stem", "body_n"))


def once(rows: DataFrame) -> DataFrame:
    """One row of each (path, sec_no) of prepared sections: the largest version."""
    others = [c for c in rows.columns if c not in ("path", "sec_no")]
    return rows.groupBy("path", "sec_no").agg(F.max_by(F.struct(*others), "version").alias("r")).select("path", "sec_no", "r.*")


def write_index(sections: DataFrame, to: str, params: RankingParams = RankingParams()) -> None:
    """Writes prepared sections, each once, as Parquet; a search over read_index shuffles nothing to tell repeats."""
    same = F.sha2(F.concat_ws("\0", "heading_n", M.unicode_trim(F.col("body_n"))), 256)
    once(prepared(sections, params)).withColumn("same", same).withColumn("version", F.lit(None).cast("bigint")).write.mode("overwrite").parquet(to)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("version")


def _sum(columns: list[Column], zero: float = 0.0) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(zero))


def term_flags(word: str, params: RankingParams) -> dict[str, Column]:
    """What one keyword is in a prepared section."""
    body, needle = F.col("body_n"), F.lit(word)
    paged = F.col("page") != ""
    occ = M.occurrences(body, needle, params.occ_cap)
    return {
        "occ": occ, "whole": (occ > 0) & (M.whole_words(body, word) > 0),
        "heading": F.contains("heading_n", needle), "crumb": F.contains("crumb_n", needle),
        "page_word": paged & F.contains("page_n", needle) & (M.whole_words(F.col("page_n"), word) > 0),
        "page_sub": F.contains("page_n", needle),
        "line": paged & (occ > 0) & M.starts_a_line(body, word),
    }


def document_frequencies(sections: DataFrame, words: list[str], params: RankingParams = RankingParams()) -> DataFrame:
    """One row: n sections, df_0 .. df_k sections with each word in their body."""
    has = [F.contains("body_n", F.lit(w)).alias(f"has_{i}") for i, w in enumerate(words)]
    version = [c for c in ("version",) if c in sections.columns]
    rows = sections.select("path", "sec_no", *has, *version)
    return (once(rows) if version else rows).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"has_{i}").alias(f"df_{i}") for i in range(len(words))]
    )


def idf(n: Column, df: Column, params: RankingParams) -> Column:
    return F.greatest(F.log((n + 1) / (df + 1)), F.lit(params.idf_floor))


def scored(sections: DataFrame, query: str, params: RankingParams = RankingParams()) -> DataFrame:
    """path, sec_no, page, same and score of the prepared sections that match a query, unrolled by keyword so that doubles
    are added in the keywords' order. `same` is a hash of what makes two sections equal.

    Texts are read where they lie: what is shuffled, to tell repeated sections, is a row's numbers and flags. Rows of a
    written index (without a column `version`) need no shuffle here.
    """
    words = M.keywords_of(query, params.fold_diacritics)
    if not words:
        raise EmptyQuery
    k, p = len(words), params
    flags = [{name: f"{name}_{i}" for name in term_flags(w, p)} for i, w in enumerate(words)]
    f = lambda i, name: F.col(flags[i][name])
    phrase = F.contains("heading_n", F.lit(" ".join(words))) | F.contains("body_n", F.lit(" ".join(words)))
    rows = sections.select(
        "*", *[c.alias(f"{name}_{i}") for i, w in enumerate(words) for name, c in term_flags(w, p).items()],
        phrase.alias("phrased"), F.startswith("heading_n", F.lit(words[0])).alias("titled"),
    )
    matched = reduce(lambda a, b: a | b, [(f(i, "occ") > 0) | f(i, "heading") | f(i, "crumb") | f(i, "page_word") for i in range(k)])
    same = F.col("same") if "same" in sections.columns else F.sha2(F.concat_ws("\0", "heading_n", M.unicode_trim(F.col("body_n"))), 256)
    narrow = ["path", "sec_no", "page", "level", "stem", "body_bytes", "has_body", "phrased", "titled"]
    narrow += [c for flag in flags for c in flag.values()] + [c for c in ("version",) if c in sections.columns]
    rows = rows.select(*narrow, F.when(matched, same).alias("same"))
    if "version" in sections.columns:
        rows = once(rows)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f(i, "occ") > 0).alias(f"df_{i}") for i in range(k)])
    weights = stats.select(*[idf(F.col("n"), F.col(f"df_{i}"), p).alias(f"w{i}") for i in range(k)])
    # The filter comes before the weights: every weight is above 0, so what has no match has no score.
    rows = rows.where(F.col("same").isNotNull()).crossJoin(F.broadcast(weights))
    w = [F.col(f"w{i}") for i in range(k)]
    avg = _sum(w) / k
    score, identity = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        identity = identity + F.when(f(i, "page_word"), p.page_name_bonus * w[i]).otherwise(0.0)
        identity = identity + F.when(f(i, "line"), p.definition_bonus * w[i]).otherwise(0.0)
        score = score + f(i, "occ") * w[i] + F.when(f(i, "whole"), p.whole_word_bonus * w[i]).otherwise(0.0)
        score = score + F.when(f(i, "heading"), p.heading_bonus * w[i]).otherwise(0.0)
        score = score + F.when(f(i, "crumb"), p.page_bonus * w[i]).otherwise(0.0)
    everywhere = reduce(lambda a, b: a & b, [f(i, "heading") | f(i, "crumb") | f(i, "page_sub") for i in range(k)])
    score = F.when(everywhere, score * p.all_in_headings_mult).otherwise(score)
    if k > 1:
        score = score + F.when(F.col("phrased"), p.phrase_bonus * avg).otherwise(0.0)
    titled = (F.col("level") <= 2) & F.col("titled")
    titled = reduce(lambda a, b: a & b, [f(i, "heading") for i in range(k)], titled)
    score = score + F.when(titled, p.title_prefix_bonus * avg).otherwise(0.0)
    stem, paged = F.col("stem"), F.col("page") != ""
    whole = paged & stem.isin([j.join(words) for j in M.STEM_JOINERS])
    single = _sum([F.when(stem == x, p.stem_keyword_bonus * w[i]).otherwise(0.0) for i, x in enumerate(words)])
    identity = identity + F.when(whole, p.stem_query_bonus * avg).when(paged, single).otherwise(0.0)
    hit = [(f(i, "occ") > 0) | f(i, "heading") | f(i, "crumb") | f(i, "page_word") for i in range(k)]
    coverage = _sum([m.cast("int") for m in hit], 0) / k
    score = score * coverage
    score = score / (1 + F.sqrt(F.col("body_bytes") / p.len_norm_bytes)) + identity * coverage
    score = F.when(F.col("has_body"), score).otherwise(score * p.empty_body_factor)
    return rows.select("path", "sec_no", "page", "same", score.alias("score"))


def _best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("path"), F.col("sec_no")]


def deduplicated(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best of hits with equal headings and trimmed bodies, by their hash."""
    rank = F.row_number().over(Window.partitionBy(*by, "same").orderBy(*_best_first()))
    return hits.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "same")


def capped(hits: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """At most so many hits of a page; hits without a page (single-file corpora) aren't capped and stay spread out."""
    # Where there is no page, each row is a group of its own, so that no task gets all of them.
    group = F.when(F.col("page") != "", F.col("page"))
    alone = F.when(F.col("page") == "", F.struct("path", "sec_no"))
    rank = F.row_number().over(Window.partitionBy(*by, group, alone).orderBy(*_best_first()))
    return hits.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def rank_sections(sections: DataFrame, query: str, top_k: int = 3, params: RankingParams = RankingParams()) -> DataFrame:
    """rank, score, path, sec_no of the best top_k prepared sections: by score, then path, then number; equal
    sections once, at most params.max_sections_per_page of a page. No match gives no rows.

    Raises InvalidParam for top_k < 1 and EmptyQuery for a query without keywords.
    """
    if top_k < 1:
        raise InvalidParam("top_k")
    hits = deduplicated(scored(sections, query, params))
    hits = capped(hits, params.max_sections_per_page).orderBy(*_best_first()).limit(top_k)
    # top_k rows are left, so one window over all of them is small.
    rank = F.row_number().over(Window.orderBy(*_best_first()))
    return hits.select(rank.cast("int").alias("rank"), "score", "path", "sec_no")


# ---- many queries
def query_terms(queries: DataFrame, params: RankingParams = RankingParams(), scope: str = "docset") -> DataFrame:
    """query_id, scope, words of the queries that have keywords; repeated rows once (the least text of an id)."""
    rows = queries.where(F.col("query").isNotNull()).groupBy("query_id").agg(
        F.min(F.struct("query", F.col(scope).alias("scope"))).alias("q")
    )
    words = M.keywords(F.col("q.query"), params.fold_diacritics)
    return rows.select("query_id", F.col("q.scope").alias("scope"), words.alias("words")).where(F.size("words") > 0)


def _needle_blocks(terms: DataFrame) -> Iterator[dict[str, set[str]]]:
    """Keywords and phrases with the scopes that ask for them, NEEDLE_BYTES at a time."""
    phrase = F.array(F.array_join("words", " "))
    needles = terms.select("scope", F.explode(F.array_union("words", phrase)).alias("needle")).groupBy("needle").agg(
        F.collect_set("scope").alias("scopes")
    )
    block: dict[str, set[str]] = {}
    size = 0
    for row in needles.orderBy("needle").toLocalIterator():
        if block and size > NEEDLE_BYTES:
            yield block
            block, size = {}, 0
        block[row.needle] = set(row.scopes)
        size += len(row.needle.encode()) + sum(map(len, row.scopes))
    if block:
        yield block


def needle_matches(sections: DataFrame, terms: DataFrame, params: RankingParams = RankingParams()) -> DataFrame:
    """Every needle that a prepared section of an asking scope has somewhere: scope, path, sec_no, needle and flags; of
    rows with one (path, sec_no) the largest version's.

    Each section is read once for all needles of a block; the work grows with text and matches, not with queries times
    sections, and a larger query set takes more passes, not more memory.
    """
    spark = sections.sparkSession
    fields = "scope string, path string, sec_no int, version bigint, needle string, occ int, whole boolean, line boolean, heading boolean, crumb boolean, page_word boolean, page_sub boolean, title boolean"  # noqa: E501
    names = [x.split()[0] for x in fields.split(", ")]
    version = F.col("version") if "version" in sections.columns else F.lit(0).cast("bigint")
    texts = sections.select(F.col("docset").alias("scope"), "path", "sec_no", version.alias("version"), "body_n", "heading_n", "crumb_n", "page_n")
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), *[pa.bool_()] * 7]
    found = None
    for block in _needle_blocks(terms):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = NeedleScan(sent.value, params.occ_cap)
            for batch in batches:
                rows: list[tuple] = []
                for section in zip(*(batch.column(i).to_pylist() for i in range(8))):
                    rows += scan.of(*section)
                    if len(rows) > 50_000:
                        yield _batch(rows, names, kinds)
                        rows = []
                yield _batch(rows, names, kinds)

        part = texts.mapInArrow(run, fields)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], fields).drop("version")
    if "version" in sections.columns:
        # Of the sections only their keys are shuffled.
        last = sections.groupBy("path", "sec_no").agg(F.max("version").alias("version"))
        found = found.join(last, ["path", "sec_no", "version"], "left_semi").dropDuplicates(["scope", "path", "sec_no", "needle"])
    return found.drop("version")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


class NeedleScan:
    """Finds a scope's needles in its sections: one by one where they are few, else by an automaton over all of them."""

    #: Needles of a scope up to which looking for each is faster; the rows are the same.
    FEW = 300

    def __init__(self, needles: dict[str, set[str]], cap: int, few: int = FEW) -> None:
        self.cap, self.few = cap, few
        self.by_scope: dict[str, list[str]] = {}
        for needle, scopes in needles.items():
            for scope in scopes:
                self.by_scope.setdefault(scope, []).append(needle)
        self.automata: dict[str, object] = {}

    def _automaton(self, scope: str):
        if scope not in self.automata:
            automaton = self.automata[scope] = ahocorasick.Automaton()
            for needle in self.by_scope[scope]:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
        return self.automata[scope]

    def _present(self, text: str, scope: str) -> set[str]:
        needles = self.by_scope.get(scope, ())
        if len(needles) > self.few:
            return {needle for _, needle in self._automaton(scope).iter(text)}
        return {n for n in needles if n in text}

    def of(self, scope: str, path: str, sec_no: int, version: int, body: str, heading: str, crumb: str, page: str) -> list[tuple]:
        rows = []
        # No needle has a line end in it, so none is found across fields.
        for needle in self._present(f"{body}\n{heading}\n{crumb}\n{page}", scope):
            n = body.count(needle)
            in_page = needle in page
            rows.append((
                scope, path, sec_no, version, needle, min(self.cap, n), n > 0 and any_whole(body, needle),
                n > 0 and bool(page) and _defines(body, needle), needle in heading, needle in crumb,
                in_page and any_whole(page, needle), in_page, heading.startswith(needle),
            ))
        return rows


def _defines(text: str, needle: str) -> bool:
    """Whether a line starts with the needle; occurrences that overlap one before count here too."""
    at = text.find(needle)
    while at >= 0:
        before = text[at - 1] if at else "\n"
        if (before in M.LINE_LEADS or before.isspace()) and M.line_start(text, at):
            return True
        at = text.find(needle, at + 1)
    return False


def batch_scored(
    queries: DataFrame, sections: DataFrame, params: RankingParams = RankingParams(), digits: int | None = None, pages: bool = True
) -> DataFrame:
    """query_id, path, sec_no, page, score: every section of a query's docset that matches it, by the scores of `scored`.

    Document frequencies are counted by docset and keyword. The rows grow with queries times sections; none is shuffled.
    Scores are rounded to digits, if given, and without pages there is no page: rows take less time so.
    """
    return batch_hits(query_terms(queries, params), sections, params, partial(idf, params=params), digits=digits, pages=pages)


def batch_search(
    queries: DataFrame, sections: DataFrame, top_k: int = 5, params: RankingParams = RankingParams()
) -> DataFrame:
    """query_id, rank, score, path, sec_no: the best top_k sections of each query within its docset.

    Null, blank and punctuation-only queries have no rows. Equal sections and pages are limited as in rank_sections.
    """
    if top_k < 1:
        raise InvalidParam("top_k")
    # Of each shard of a docset come a query's best only; equal sections share one, so they are told apart there.
    hits = batch_hits(query_terms(queries, params), sections, params, partial(idf, params=params), top_k)
    hits = capped(hits, params.max_sections_per_page, ("query_id",))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best_first()))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top_k).select("query_id", "rank", "score", "path", "sec_no")
