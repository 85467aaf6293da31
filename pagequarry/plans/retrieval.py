"""Queries of search, slicing, normalization and evaluation over the whole test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import matching as M
from pagequarry.operators import evaluate, normalize, render, search, slicer
from pagequarry.params import RankingParams
from pagequarry.plans import sql, sql_text
from pagequarry.session import table
from pagequarry.sources import collections, markdown

PARAMS = RankingParams()
#: The fixed queries of single-query plans.
ONE, TWO, NONE = "cache header", "search index, first!", "zzqqxxyy"


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return search.prepared(table(spark, folder, "sections"), PARAMS)


def _once(spark: SparkSession, folder: str, *columns: Column | str) -> DataFrame:
    """Columns of the prepared sections, each section once."""
    return search.once(_sections(spark, folder).select("path", "sec_no", *columns, "version")).drop("version")


def _joined(words: str | Column) -> Column:
    return F.array_join(words, " ")


# ---- pages and front matter
def page_identity(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select(
        "path", markdown.page_name(F.col("title"), F.col("path")).alias("page_name"), markdown.page_stem(F.col("path")).alias("page_stem")
    ).distinct()


def front_matter_fields(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    pages = markdown.pages_from(raw)
    return pages.select(F.col("path").cast("long").alias("doc_id"), "url", "title", F.sha2("body", 256).alias("body_hash")).distinct()


def copy_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    keys = docs.select("doc_id", evaluate.content_key(F.col("text")).alias("content_key"))
    return keys.groupBy("content_key").agg(F.countDistinct("doc_id").alias("documents")).where("documents > 1")


# ---- slicing
def section_slices(spark: SparkSession, folder: str) -> DataFrame:
    rows = slicer.sections_of(table(spark, folder, "pages"))
    return rows.select(
        "path", "sec_no", F.col("level").cast("int").alias("level"), "heading", "has_body", F.sha2("body", 256).alias("body_hash"),
        "range_start", "range_end", "page", "page_stem",
    )


def section_slices_udtf(spark: SparkSession, folder: str) -> DataFrame:
    slicer.register(spark)
    pages = table(spark, folder, "pages").select("path", "body").distinct()
    return spark.sql(
        "SELECT path, sec_no, heading, range_start FROM {pages}, LATERAL md_sections(body, 3)", pages=pages
    )


def section_slices_level6(spark: SparkSession, folder: str) -> DataFrame:
    rows = slicer.sections_of(table(spark, folder, "pages"), max_level=6)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("sections"), F.max("level").cast("int").alias("deepest"))


def section_breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    rows = slicer.sections_of(table(spark, folder, "pages"))
    return rows.select("path", "sec_no", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


def bare_headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = slicer.sections_of(table(spark, folder, "pages"))
    return rows.where(~F.col("has_body")).select("path", "sec_no", "heading")


def fence_stats(spark: SparkSession, folder: str) -> DataFrame:
    return slicer.heading_statistics(table(spark, folder, "pages"))


# ---- query analysis and matching
def keyword_analysis(spark: SparkSession, folder: str) -> DataFrame:
    terms = search.query_terms(table(spark, folder, "queries"))
    return terms.select("query_id", _joined("words").alias("phrase"), F.size("words").alias("n"))


def fold_diacritics(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "sections").select("path", "sec_no", "heading").distinct()
    return heads.select("path", "sec_no", M.normalized(F.col("heading"), fold=True).alias("folded"))


def term_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Of each docset and needle: sections that have it, occurrences, whole words and definition lines."""
    terms = search.query_terms(table(spark, folder, "queries"))
    found = search.needle_matches(_sections(spark, folder), terms)
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return found.groupBy(F.col("scope").alias("docset"), "needle").agg(
        F.sum("occ").alias("occurrences"), F.count_if(F.col("occ") > 0).alias("df"),
        *map(count, ("whole", "line", "heading", "crumb", "page_word", "page_sub", "title")),
    )


def _flags(spark: SparkSession, folder: str, word: str) -> DataFrame:
    return _once(spark, folder, *[c.alias(n) for n, c in search.term_flags(word, PARAMS).items()])


def occurrence_count(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder, "cache").where("occ > 0").select("path", "sec_no", "occ")


def whole_word_count(spark: SparkSession, folder: str) -> DataFrame:
    has = F.contains("body_n", F.lit("cache"))
    return _once(spark, folder, F.when(has, M.whole_words(F.col("body_n"), "cache")).alias("whole")).where("whole is not null")


def definition_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder, "cache").where("line").select("path", "sec_no")


def phrase_match(spark: SparkSession, folder: str) -> DataFrame:
    has = F.contains("heading_n", F.lit(ONE)) | F.contains("body_n", F.lit(ONE))
    return _once(spark, folder, has.alias("has")).where("has").select("path", "sec_no")


def title_prefix(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "level", "heading_n")
    return rows.where((F.col("level") <= 2) & F.startswith("heading_n", F.lit("cache"))).select("path", "sec_no", "heading_n")


def stem_match(spark: SparkSession, folder: str) -> DataFrame:
    """Of every page's stem, taken apart into words as someone would ask for it: the pages of its docset with that stem."""
    words = F.regexp_replace("page_stem", r"[-_.]", " ").alias("query")
    terms = search.query_terms(table(spark, folder, "pages").select(F.col("path").alias("query_id"), words, "docset"))
    stems = terms.select(
        "query_id", "scope", F.explode(F.array_distinct(F.array(*[F.array_join("words", j) for j in M.STEM_JOINERS]))).alias("stem")
    )
    pages = _once(spark, folder, "docset", "stem", "page").where("page <> ''").select(F.col("docset").alias("scope"), "stem", "page").distinct()
    return stems.join(pages, ["scope", "stem"]).select("query_id", "page").distinct()


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    words = M.keywords_of(TWO)
    return search.document_frequencies(_sections(spark, folder), words)


def idf_weights(spark: SparkSession, folder: str) -> DataFrame:
    stats = document_frequency(spark, folder)
    n = len(M.keywords_of(TWO))
    return stats.select(*[F.round(search.idf(F.col("n"), F.col(f"df_{i}"), PARAMS), 6).alias(f"w{i}") for i in range(n)])


def length_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "body_bytes")
    return rows.select("path", "sec_no", F.round(1 / (1 + F.sqrt(F.col("body_bytes") / PARAMS.len_norm_bytes)), 6).alias("factor"))


# ---- scores and hits of one query
def section_scores_dir(spark: SparkSession, folder: str) -> DataFrame:
    return search.scored(_sections(spark, folder), TWO).select("path", "sec_no", F.round("score", 6).alias("score"))


def section_scores(spark: SparkSession, folder: str) -> DataFrame:
    """As if all sections were of a single file: no page has a name."""
    rows = _sections(spark, folder).withColumns({c: F.lit("") for c in ("page", "page_n", "stem")})
    return search.scored(rows, TWO).select("path", "sec_no", F.round("score", 6).alias("score"))


def dedup_sections(spark: SparkSession, folder: str) -> DataFrame:
    return search.deduplicated(search.scored(_sections(spark, folder), ONE)).select("path", "sec_no")


def page_cap(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.deduplicated(search.scored(_sections(spark, folder), ONE))
    return search.capped(hits, PARAMS.max_sections_per_page).select("path", "sec_no")


def _top(spark: SparkSession, folder: str, query: str, k: int) -> DataFrame:
    return search.rank_sections(_sections(spark, folder), query, k).select("rank", F.round("score", 6).alias("score"), "path", "sec_no")


def top_k_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, ONE, 10)


def search_or_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, f"cache {NONE}", 5)


def search_no_match(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, NONE, 5)


def search_folded(spark: SparkSession, folder: str) -> DataFrame:
    params = replace(PARAMS, fold_diacritics=True)
    rows = search.prepared(table(spark, folder, "sections"), params)
    return search.rank_sections(rows, "préréglage schéma", 10, params).select("rank", F.round("score", 6).alias("score"), "path", "sec_no")


# ---- many queries
def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    return search.batch_scored(table(spark, folder, "queries"), _sections(spark, folder), digits=6, pages=False)


def batch_search(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.batch_search(table(spark, folder, "queries"), _sections(spark, folder))
    return hits.withColumn("score", F.round("score", 6))


def render_output(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "queries")
    hits = search.batch_search(queries, _sections(spark, folder), top_k=3)
    return render.rendered(hits, table(spark, folder, "sections"), queries)


def render_block(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and characters of every query's output under a small budget."""
    queries = table(spark, folder, "queries")
    hits = search.batch_search(queries, _sections(spark, folder), top_k=3)
    out = render.rendered(hits, table(spark, folder, "sections"), queries, max_tokens=500)
    blocks = F.size(F.regexp_extract_all("output", F.lit("(?s)--- DÉBUT DE SECTION.*?--- FIN DE SECTION"), F.lit(0)))
    return out.select("query_id", blocks.alias("blocks"), F.length("output").alias("chars"))


# ---- evaluation
def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.distinct_cases(table(spark, folder, "relevance_cases"))


def expected_missing(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.missing_expectations(_cases(spark, folder), table(spark, folder, "pages"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder)
    queries = cases.select(F.col("case_id").cast("string").alias("query_id"), "query", "docset")
    hits = search.batch_search(queries, _sections(spark, folder), top_k=5)
    hits = hits.select(F.col("query_id").cast("long").alias("case_id"), "rank", "path")
    return evaluate.first_good_ranks(cases, hits, table(spark, folder, "pages"))


def eval_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("case_id", "rank")


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.quality(_results(spark, folder))


def eval_misses(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.misses(_results(spark, folder))
    return rows.select("case_id", "docset", "kind", F.array_join("returned", " ").alias("returned"))


def eval_assertions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a case's first expected page shows among the first three rendered blocks, by status."""
    cases = _cases(spark, folder)
    queries = cases.select(F.col("case_id").cast("string").alias("query_id"), "query", "docset")
    hits = search.batch_search(queries, _sections(spark, folder), top_k=3)
    outputs = render.rendered(hits, table(spark, folder, "sections"), queries, max_tokens=800)
    checks = cases.select(
        "case_id", F.col("case_id").cast("string").alias("query_id"), F.lit("top3").alias("expectation"),
        F.coalesce(F.try_element_at("expected", F.lit(1)), F.lit("")).alias("substr"),
    )
    return evaluate.assertion_totals(evaluate.assertions(outputs, checks))


# ---- normalization
def midline_fence_fix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body"))
    rows = normalize.fix_midline_fences(docs)
    return rows.select(F.col("path").alias("doc_id"), F.sha2("body", 256).alias("body_hash"), "fixes")


def fence_heal(spark: SparkSession, folder: str) -> DataFrame:
    lines = normalize.heal_fences(_glued(spark, folder))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind").isNotNull()).alias("healed"))


def _glued(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a crawl leaves them: an anchor line inside every block of code, navigation at the end."""
    body = F.regexp_replace("body", r"(?m)^(```|~~~)(\w+)$", "$1$2\nCopy to clipboard")
    body = F.concat(body, F.lit("\nManual\n * Godot Engine 4.7 documentation in English\n* Index\n \n* * *\n---\n"))
    return table(spark, folder, "pages").select("path", body.alias("body")).distinct()


def scaffold_strip(spark: SparkSession, folder: str) -> DataFrame:
    lines = normalize.strip_scaffolding(_glued(spark, folder))
    return lines.where("kept").groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def normalized_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a family whose fences are healed and whose scaffolding is stripped; CR left out of the hash."""
    rows = normalize.normalized(_glued(spark, folder), "godot")
    return rows.select("path", F.sha2(F.regexp_replace("body", "\r", ""), 256).alias("body_hash"))


def rule_counters(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.rule_counts(normalize.strip_scaffolding(_glued(spark, folder)))


def link_source(spark: SparkSession, folder: str) -> DataFrame:
    """Links of indexes made of all pages' paths, among others that are none or look like some."""
    parts = ("[x](/docs/", "path", ") [y](/other/", "path", ") (/docs/", "path", "#part) [z](/docs/a(b/", "path", ") [w](/docs/", "docset", "/index.mdx) [v](/docs/",
             "docset", "/p).md)(/docs/", "page_stem", ".md)")
    index = F.concat(*[F.col(x) if x in ("path", "docset", "page_stem") else F.lit(x) for x in parts])
    return collections.links(table(spark, folder, "pages").select(index.alias("text")))


_NAMES = (
    page_identity, front_matter_fields, copy_keys, section_slices, section_slices_udtf, section_slices_level6, section_breadcrumbs,
    bare_headings, fence_stats, keyword_analysis, fold_diacritics, term_matches, occurrence_count, whole_word_count,
    definition_lines, phrase_match, title_prefix, stem_match, document_frequency, idf_weights, length_normalized,
    section_scores, section_scores_dir, dedup_sections, page_cap, top_k_hits, search_or_coverage, search_no_match, search_folded,
    batch_scores, batch_search, render_output, render_block, expected_missing, eval_ranks, eval_metrics, eval_misses, eval_assertions,
    midline_fence_fix, fence_heal, scaffold_strip, rule_counters, normalized_pages, link_source,
)
QUERIES = {f.__name__: f for f in _NAMES}


# ---- SQL
def _query_table(text: str, paged: bool = True) -> list[str]:
    """CTEs up to c for one query over all sections, as a query of one docset with all of them."""
    one = f"queries AS (SELECT 'q' AS query_id, '{text}' AS query, 'all' AS docset)"
    blank = "" if paged else ", '' AS page, '' AS page_stem"
    keep = "*" if paged else "* EXCLUDE (page, page_stem)"
    every = f"sections AS (SELECT * REPLACE ('all' AS docset){blank} FROM (SELECT {keep} FROM main.sections))"
    return [one, every, sql.QUERIES, sql.SECTIONS, sql.MATCHES, sql.WEIGHTS, sql.SCORES, sql.LIMITS]


def _hits(text: str, k: int) -> str:
    return sql.with_(*_query_table(text)) + f"""
    SELECT (row_number() OVER (ORDER BY score DESC, path, sec_no))::INT AS rank, round(score, 6) AS score, path, sec_no
    FROM c ORDER BY score DESC, path, sec_no LIMIT {k}"""


_BATCH = (sql.QUERIES, sql.SECTIONS, sql.MATCHES, sql.WEIGHTS, sql.SCORES, sql.LIMITS)
_RANKED = """rk AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, sec_no) AS rank,
    score, path, sec_no FROM c) WHERE rank <= 5)"""
_ONE_SECTION = "SELECT DISTINCT ON (path, sec_no) * FROM sections"
_PREPARED = sql.with_(sql.SECTIONS)
_CASES = """
cs AS (SELECT * FROM (SELECT case_id, docset, query, expected, CASE WHEN lower(trim(kind)) IN ('identifier', 'task') THEN lower(trim(kind))
         ELSE 'other' END AS kind, row_number() OVER (PARTITION BY case_id ORDER BY docset, query, kind NULLS FIRST, expected) AS rn
       FROM relevance_cases) WHERE rn = 1),
pg AS (SELECT DISTINCT docset, path, regexp_replace(path, '^[^/]*/', '') AS inside FROM pages WHERE path IS NOT NULL),
ex AS (SELECT case_id, docset, unnest(expected) AS e FROM cs),
gd AS (SELECT DISTINCT ex.case_id, e, pg.path FROM ex JOIN pg ON pg.docset = ex.docset AND
         CASE WHEN e[-1] IN ('/', '-') THEN starts_with(inside, e) OR contains(inside, '/' || e)
              ELSE inside = e OR ends_with(inside, '/' || e) END)
"""
_KEY = r"""
kt AS (SELECT DISTINCT path, body, regexp_replace(regexp_replace(body, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', '') AS t FROM pages WHERE body IS NOT NULL),
kl AS (SELECT path, string_split(t, chr(10)) AS ls FROM kt),
ky AS (SELECT DISTINCT path, sha256(array_to_string(CASE WHEN trim(ls[1]) = '---' AND
         len(list_filter(ls, lambda x: trim(x) = '---')) > 1 THEN ls[list_filter(range(2, len(ls) + 1), lambda i: trim(ls[i]) = '---')[1] + 1:]
         ELSE ls END, chr(10))) AS k FROM kl)
"""
_EVAL = """
good AS (SELECT case_id, path FROM gd UNION SELECT gd.case_id, k2.path FROM gd JOIN cs USING (case_id) JOIN ky k1 ON k1.path = gd.path
         JOIN ky k2 ON k2.k = k1.k WHERE len(list_filter(cs.expected, lambda e: e[-1] IN ('/', '-'))) = 0),
rs AS (SELECT cs.case_id, any_value(cs.docset) AS docset, any_value(cs.kind) AS kind, min(CASE WHEN good.path IS NOT NULL THEN rank END) AS rank,
         array_to_string(coalesce(list(rk.path ORDER BY rank) FILTER (rk.path IS NOT NULL), []), ' ') AS returned
       FROM cs LEFT JOIN rk ON rk.query_id = cs.case_id::VARCHAR LEFT JOIN good ON good.case_id = cs.case_id AND good.path = rk.path
       GROUP BY cs.case_id)
"""
_EVALUATED = sql.with_(
    _CASES, "queries AS (SELECT case_id::VARCHAR AS query_id, query, docset FROM cs)", *_BATCH, _RANKED, _KEY, _EVAL
)
_FOLDED = sql.SECTIONS
for _field in ("lower(coalesce(heading, ''))", "lower(coalesce(body, ''))", "lower(coalesce(array_to_string(breadcrumb, ' '), ''))", "lower(coalesce(page, ''))"):
    _FOLDED = _FOLDED.replace(_field, f"translate({_field}, '{M.FOLD_FROM}', '{M.FOLD_TO}')")
# Fences by a fold over lines: the open fence's character and length, and headings so far.
_FENCES = r"""
WITH l AS (SELECT DISTINCT path, body FROM pages WHERE body IS NOT NULL AND path IS NOT NULL),
f AS (SELECT path, list_reduce(list_transform(string_split(body, chr(10)), lambda x: {'o': regexp_extract(x, '^ {0,3}(`{3,})[^`]*$', 1)
        || regexp_extract(x, '^ {0,3}(~{3,}).*$', 1), 'r': regexp_extract(x, '^ {0,3}(`+|~+)\s*$', 1), 'h': regexp_matches(x, '^ {0,3}#{1,3} \S')}),
        lambda a, x: CASE WHEN a.f = '' AND x.o <> '' THEN {'f': x.o[1], 'n': length(x.o), 'h': a.h}
          WHEN a.f <> '' AND x.r <> '' AND x.r[1] = a.f AND length(x.r) >= a.n THEN {'f': '', 'n': 0::BIGINT, 'h': a.h}
          WHEN a.f = '' AND x.h THEN {'f': '', 'n': 0::BIGINT, 'h': a.h + 1} ELSE a END, {'f': '', 'n': 0::BIGINT, 'h': 0}) AS a FROM l)
SELECT DISTINCT path, a.f = '' AS balanced, a.h::INT AS headings FROM f"""
# Lines with their backticks taken apart.
_MIDLINE = r"""
WITH t AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(13))) AS ls FROM documents),
p AS (SELECT doc_id, text, ls, list_transform(ls, lambda x: {'l': x, 'i': regexp_extract(x, '^( {0,3})', 1), 'run': regexp_extract(x, '^ {0,3}(`*)', 1),
        'rest': regexp_extract(x, '(?s)^ {0,3}`*(.*)$', 1), 'at': strpos(x, '```'), 'tail': ltrim(substr(x, strpos(x, '```')), '`')}) AS ps FROM t),
q AS (SELECT doc_id, text, ls, list_transform(ps, lambda p: CASE WHEN starts_with(p.l, '    ') THEN [p.l]
        WHEN length(p.run) > 3 AND NOT starts_with(p.rest, '|') THEN [p.i || '```' || p.rest]
        WHEN length(p.run) >= 3 OR p.at = 0 THEN [p.l]
        ELSE [rtrim(substr(p.l, 1, p.at - 1), ' ' || chr(9)), CASE WHEN contains(p.tail, '|') THEN rtrim('```' || string_split(p.tail, '|')[1], ' ' || chr(9))
          ELSE '```' || p.tail END] END) AS fx FROM p),
r AS (SELECT *, len(list_filter(range(1, len(ls) + 1), lambda i: len(fx[i]) > 1 OR fx[i][1] <> ls[i])) AS n FROM q)
SELECT doc_id, sha256(CASE WHEN n > 0 THEN array_to_string(flatten(fx), chr(10)) ELSE text END) AS body_hash, coalesce(n, 0)::INT AS fixes FROM r"""
_FRONT = r"(?s)\A---[^\S\n]*\n((?:.*?\n)?)(?:---|\.\.\.)[^\S\n]*(?:\n|\z)"
_VALUE = (
    "list_filter(list_transform(regexp_extract_all(f, '(?m)^{0}:([^\\n]*)', 1), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\"'''))"
    ", lambda x: x <> '')[-1]"
)

ORACLES = {
    "page_identity": r"""SELECT DISTINCT path, CASE WHEN title IS NULL THEN '' ELSE title || ' ' END || regexp_replace(path, '\.md$', '') AS page_name,
        regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', '')), '\.en$', ''), '\.[0-9]{1,2}$', '') AS page_stem
        FROM pages""",
    "front_matter_fields": f"""WITH t AS (SELECT doc_id, ltrim(text, chr(65279)) AS x FROM documents),
        b AS (SELECT doc_id, CASE WHEN x IS NULL THEN NULL ELSE regexp_extract(x, '{_FRONT}', 0) END AS g, regexp_extract(x, '{_FRONT}', 1) AS f, x FROM t)
        SELECT DISTINCT doc_id, {_VALUE.format('url')} AS url, {_VALUE.format('title')} AS title, sha256(substr(x, length(g) + 1)) AS body_hash FROM b""",
    "copy_keys": """WITH pages AS (SELECT doc_id::VARCHAR AS path, text AS body FROM documents),""" + _KEY
        + "SELECT k AS content_key, count(DISTINCT path) AS documents FROM ky GROUP BY ALL HAVING count(DISTINCT path) > 1",
    "section_slices": f"""SELECT path, sec_no, level::INT AS level, heading, has_body, sha256(body) AS body_hash, range_start, range_end, page, page_stem
        FROM ({_ONE_SECTION})""",
    "section_slices_udtf": f"SELECT path, sec_no, heading, range_start FROM ({_ONE_SECTION})",
    "section_breadcrumbs": f"SELECT path, sec_no, array_to_string(breadcrumb, ' > ') AS breadcrumb FROM ({_ONE_SECTION})",
    "bare_headings": f"SELECT path, sec_no, heading FROM ({_ONE_SECTION}) WHERE NOT has_body",
    "keyword_analysis": sql.with_(sql.QUERIES) + "SELECT query_id, array_to_string(words, ' ') AS phrase, len(words)::INT AS n FROM ql",
    "fold_diacritics": f"SELECT DISTINCT path, sec_no, translate(lower(heading), '{M.FOLD_FROM}', '{M.FOLD_TO}') AS folded FROM sections",
    "term_matches": sql.with_(sql.QUERIES, sql.SECTIONS, sql.MATCHES) + """SELECT docset, needle, sum(occ)::BIGINT AS occurrences, count_if(occ > 0)::BIGINT AS df,
        count_if(whole)::BIGINT AS whole, count_if(line)::BIGINT AS line, count_if(heading)::BIGINT AS heading, count_if(crumb)::BIGINT AS crumb, count_if(page_word)::BIGINT AS page_word,
        count_if(page_sub)::BIGINT AS page_sub, count_if(title)::BIGINT AS title FROM m GROUP BY ALL""",
    "occurrence_count": _PREPARED + "SELECT path, sec_no, least(20, len(string_split(b, 'cache')) - 1)::INT AS occ FROM s WHERE contains(b, 'cache')",
    "whole_word_count": _PREPARED + f"SELECT path, sec_no, {sql.whole_list('b', chr(39) + 'cache' + chr(39))}::INT AS whole FROM s WHERE contains(b, 'cache')",
    "definition_lines": _PREPARED + f"SELECT path, sec_no FROM s WHERE page <> '' AND contains(b, 'cache') AND {sql.starts_line('b', chr(39) + 'cache' + chr(39))}",
    "phrase_match": _PREPARED + f"SELECT path, sec_no FROM s WHERE contains(h, '{ONE}') OR contains(b, '{ONE}')",
    "title_prefix": _PREPARED + "SELECT path, sec_no, h AS heading_n FROM s WHERE level <= 2 AND starts_with(h, 'cache')",
    "stem_match": sql.with_(
        "queries AS (SELECT DISTINCT path AS query_id, regexp_replace(page_stem, '[-_.]', ' ', 'g') AS query, docset FROM pages)", sql.QUERIES, sql.SECTIONS
    ) + """SELECT DISTINCT query_id, page FROM ql JOIN s USING (docset) WHERE page <> '' AND
        list_contains([array_to_string(words, ''), array_to_string(words, '-'), array_to_string(words, '_'), array_to_string(words, '.'), array_to_string(words, ' ')], stem)""",
    "document_frequency": _PREPARED + """SELECT count(*) AS n, count_if(contains(b, 'search'))::BIGINT AS df_0, count_if(contains(b, 'index'))::BIGINT AS df_1,
        count_if(contains(b, 'first'))::BIGINT AS df_2 FROM s""",
    "idf_weights": _PREPARED + "SELECT " + ", ".join(
        f"round(greatest(ln((count(*) + 1.0::DOUBLE) / (count_if(contains(b, '{w}')) + 1)), 0.25::DOUBLE), 6) AS w{i}"
        for i, w in enumerate(("search", "index", "first"))) + " FROM s",
    "length_normalized": _PREPARED + "SELECT path, sec_no, round(1 / (1 + sqrt(bytes / 6000.0::DOUBLE)), 6) AS factor FROM s",
    "section_scores_dir": sql.with_(*_query_table(TWO)) + "SELECT path, sec_no, round(score, 6) AS score FROM sc",
    "section_scores": sql.with_(*_query_table(TWO, paged=False)) + "SELECT path, sec_no, round(score, 6) AS score FROM sc",
    "dedup_sections": sql.with_(*_query_table(ONE)) + "SELECT path, sec_no FROM d",
    "page_cap": sql.with_(*_query_table(ONE)) + "SELECT path, sec_no FROM c",
    "top_k_hits": _hits(ONE, 10),
    "search_or_coverage": _hits(f"cache {NONE}", 5),
    "search_no_match": _hits(NONE, 5),
    "search_folded": sql.with_(
        "queries AS (SELECT 'q' AS query_id, 'prereglage schema' AS query, 'all' AS docset)",
        "sections AS (SELECT * REPLACE ('all' AS docset) FROM main.sections)", sql.QUERIES, _FOLDED, sql.MATCHES, sql.WEIGHTS, sql.SCORES, sql.LIMITS,
    ) + """SELECT (row_number() OVER (ORDER BY score DESC, path, sec_no))::INT AS rank, round(score, 6) AS score, path, sec_no
        FROM c ORDER BY score DESC, path, sec_no LIMIT 10""",
    "fence_stats": _FENCES,
    "midline_fence_fix": _MIDLINE,
    "batch_scores": sql.with_(*_BATCH) + "SELECT query_id, path, sec_no, round(score, 6) AS score FROM sc",
    "batch_search": sql.with_(*_BATCH, _RANKED) + "SELECT query_id, rank::INT AS rank, round(score, 6) AS score, path, sec_no FROM rk",
    "expected_missing": sql.with_(_CASES) + """SELECT DISTINCT ex.case_id, ex.e AS expected FROM ex
        WHERE NOT EXISTS (SELECT 1 FROM gd WHERE gd.case_id = ex.case_id AND gd.e = ex.e)""",
    "eval_ranks": _EVALUATED + "SELECT case_id, rank::INT AS rank FROM rs",
    "eval_misses": _EVALUATED + "SELECT case_id, docset, kind, returned FROM rs WHERE rank IS NULL OR rank > 1",
    "eval_metrics": _EVALUATED + """SELECT docset, kind, count(*) AS cases, count_if(rank <= 1)::BIGINT AS hit1, count_if(rank <= 3)::BIGINT AS hit3,
        count_if(rank <= 5)::BIGINT AS hit5, round(sum(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END) / count(*), 6) AS mrr5
        FROM rs GROUP BY GROUPING SETS ((docset), (kind), ())""",
    "section_slices_level6": sql_text.LEVEL_6,
    "fence_heal": sql_text.HEALED,
    "scaffold_strip": sql_text.STRIPPED,
    "rule_counters": sql_text.COUNTED,
    "render_output": sql.with_(*_BATCH, _RANKED, sql_text.rendered(8000)) + "SELECT query_id, output FROM outp",
    "render_block": sql.with_(*_BATCH, _RANKED, sql_text.rendered(500)) + """SELECT query_id, len(string_split(output, '--- FIN DE SECTION')) - 1 AS blocks,
        length(output)::INT AS chars FROM outp""",
    "eval_assertions": sql.with_(_CASES, "queries AS (SELECT case_id::VARCHAR AS query_id, query, docset FROM cs)", *_BATCH, _RANKED, sql_text.rendered(800)) + """
        , st AS (SELECT CASE WHEN contains(lower(output), lower(coalesce(expected[1], ''))) THEN 'PASS' ELSE 'FAIL' END AS status
                 FROM cs LEFT JOIN outp ON outp.query_id = cs.case_id::VARCHAR)
        SELECT status, count(*) AS cases FROM st GROUP BY status""",
    "normalized_pages": sql_text.NORMALIZED,
    "link_source": r"""SELECT DISTINCT unnest(regexp_extract_all('[x](/docs/' || path || ') [y](/other/' || path || ') (/docs/' || path || '#part) [z](/docs/a(b/' || path
        || ') [w](/docs/' || docset || '/index.mdx) [v](/docs/' || docset || '/p).md)(/docs/' || page_stem || '.md)', '\((/docs[^)]*\.md)\)', 1)) AS link FROM pages""",
}
