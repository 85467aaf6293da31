"""Queries of the training-data operators, over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import caps, confusables, leakage, mojibake, packing, sitelines, splitting, truncation
from pagequarry.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_cut(spark, folder).select("path").distinct()


def p1_cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(table(spark, folder, "pages"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_report(table(spark, folder, "pages"), p1_cut(spark, folder))


def _capped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return caps.cap_hits_per_page(table(spark, folder, "hits"), table(spark, folder, "sections"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder)[1].select("query_id", "path", "sec_no")


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder)[0].select("query_id", "path", "sec_no", "score", "page")


def p2_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Of all hits at most 2 per query and page, of those 30 per page, of those a 200th for each folder and, of what is
    left, a 20th for each docset: author, domain and parent organisation of what a search shows."""
    kept = _capped(spark, folder)[0].withColumns({"docset": F.split("path", "/")[0], "folder": F.split("path", "/")[1]})
    order = [F.col("score").desc_nulls_last(), F.col("path"), F.col("sec_no"), F.col("query_id")]
    levels = [caps.Cap(["docset", "page"], most=30), caps.Cap(["docset", "folder"], share=0.005), caps.Cap(["docset"], share=0.05)]
    return caps.keep_best(kept, levels, order).select("query_id", "path", "sec_no", "docset", "score")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_forms(spark, folder).select("path", "sec_no").distinct()


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.look_alikes(table(spark, folder, "sections"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.equal_looking_groups(table(spark, folder, "sections"))


def p3_members(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.equal_looking_places(table(spark, folder, "sections"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).where(F.col("n_pieces") > 1).select("path", "sec_no").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_pieces(table(spark, folder, "sections"), "body", ["path", "sec_no"])


def p4_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every split text: joined without overlaps it is the text; pieces fit; each begins with what the
    one before ends in; none is cut within a word if it has a boundary beyond its overlap."""
    pieces = p4_pieces(spark, folder)
    new = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", F.lit(201), F.length("piece")))
    cut = F.col("piece").rlike(r"(?U)(\s|[.!?…。！？][\"'”’»)\]*_`]*)$") | ~F.substring("piece", F.lit(201), F.length("piece")).rlike(r"(?U)\s") | (F.col("piece_no") + 1 == F.col("n_pieces"))
    parts = pieces.withColumn("new", new).groupBy("path", "sec_no", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "piece", "new"))).alias("ps"), F.max(F.length("piece")).alias("longest"),
        F.bool_and(cut).alias("natural"), F.max("n_pieces").alias("n"),
    )
    follows = F.forall(F.sequence(F.lit(1), F.size("ps") - 1), lambda i: F.right(F.get("ps", i - 1)["piece"], F.lit(200)) == F.left(F.get("ps", i)["piece"], F.lit(200)))
    return parts.select(
        "path", "sec_no", (F.md5(F.array_join(F.transform("ps", lambda p: p["new"]), "")) == F.col("text_hash")).alias("lossless"),
        ((F.col("longest") <= 4000) & (F.size("ps") == F.col("n"))).alias("fits"), follows.alias("overlaps"), "natural", "text_hash",
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, folder, "pages")).select("path", "line_no").distinct()


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return sitelines.without_lines(pages, sitelines.repeated_lines(pages))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_texts(table(spark, folder, "documents"))
    return packed.where(F.col("n_pieces") > 1).select("doc_id").distinct()


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, folder))


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every packed text."""
    return packing.packing_checks(table(spark, folder, "documents"), p6_containers(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_passages(spark, folder).where(F.col("run_words") >= 13).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(p7_passages(spark, folder))


def p7_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the pairs with a 13-word run that one character is amiss in, or none, in every 50th document by exhaustive search:
    how many p7_passages has."""
    near = table(spark, folder, "documents").where(F.col("doc_id") % 50 == 0)
    pairs = leakage.exhaustive_pairs(near, table(spark, folder, "benchmark"))
    found = p7_passages(spark, folder).select("doc_id", "item_id", F.lit(1).alias("found")).distinct()
    return pairs.join(found, ["doc_id", "item_id"], "left").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("found").alias("found"),
        F.round(F.coalesce(F.count("found") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)), 6).alias("recall"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_restored(spark, folder).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_texts(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


# Lines outside of code, by a fold over each page's lines, and their compared forms.
_LINES = """
WITH p AS (SELECT DISTINCT docset, path, string_split(body, chr(10)) AS ls, body AS whole FROM pages),
f AS (SELECT docset, path, ls, whole, list_reduce(list_transform(ls, lambda x: left(trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), 3)), lambda a, h:
        CASE WHEN a.o = '' AND h IN (chr(96) || chr(96) || chr(96), '~~~') THEN {'o': h, 'c': list_append(a.c, true)}
             WHEN a.o <> '' THEN {'o': CASE WHEN h = a.o THEN '' ELSE a.o END, 'c': list_append(a.c, true)}
             ELSE {'o': '', 'c': list_append(a.c, false)} END, {'o': '', 'c': []::BOOLEAN[]}).c AS code FROM p),
l AS (SELECT docset, path, md5(whole) AS v, unnest(ls) AS line, unnest(code) AS code, generate_subscripts(ls, 1) AS line_no FROM f),
c AS (SELECT docset, path, v, line_no, regexp_replace(lower(regexp_replace(regexp_replace(line, '[\\s\\x0b\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')), '[0-9]+', '0', 'g') AS form
      FROM l WHERE NOT code),
k AS (SELECT * FROM c WHERE length(form) >= 25 AND form[1] NOT IN ('#', '|')),
z AS (SELECT docset, count(DISTINCT path) AS of FROM pages GROUP BY docset),
n AS (SELECT docset, form FROM k JOIN z USING (docset) GROUP BY docset, form, of HAVING count(DISTINCT path) >= 3 AND count(DISTINCT path) * 20 >= of)
"""

# Runs of 13 words.
_RUNS = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d),
bg AS (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b)
"""


_PAGED = """
WITH h AS (SELECT query_id, path, sec_no, max(score) AS score FROM hits GROUP BY ALL),
     s AS (SELECT path, sec_no, max(page) AS page FROM sections WHERE page <> '' GROUP BY ALL),
     r AS (SELECT h.*, s.page, row_number() OVER (PARTITION BY query_id, page
                  ORDER BY score DESC NULLS LAST, path, sec_no) AS n
           FROM h JOIN s USING (path, sec_no))
"""
# The quota of a level by trial of every number.
_TRIED = """q_{to} AS (SELECT greatest(1, max(q)) AS q FROM (SELECT unnest(range(0, (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM {of} GROUP BY {by})))) AS q) t
       WHERE q <= {share} * (SELECT sum(least(n, q)) FROM (SELECT count(*) AS n FROM {of} GROUP BY {by}))),
     {to} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC NULLS LAST, path, sec_no, query_id) AS k FROM {of})
       WHERE k <= (SELECT q FROM q_{to}))"""
_NESTED = (
    _PAGED
    + """, a AS (SELECT *, split_part(path, '/', 1) AS docset, split_part(path, '/', 2) AS folder FROM r WHERE n <= 2),
     b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docset, page
                  ORDER BY score DESC NULLS LAST, path, sec_no, query_id) AS m FROM a) WHERE m <= 30),
     """
    + _TRIED.format(to="c", of="b", by="docset, folder", share="0.005::DOUBLE") + ", "
    + _TRIED.format(to="d", of="c", by="docset", share="0.05::DOUBLE")
    + " SELECT query_id, path, sec_no, docset, score FROM d"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _PAGED + "SELECT query_id, path, sec_no FROM r WHERE n > 2",
        "p2_kept": _PAGED + "SELECT query_id, path, sec_no, score, page FROM r WHERE n <= 2",
        "p2_nested": _NESTED,
        "p4_found": "SELECT DISTINCT path, sec_no FROM sections WHERE length(body) > 4000",
        "p4_rejoined": """SELECT DISTINCT path, sec_no, true AS lossless, true AS fits, true AS overlaps, true AS "natural", md5(body) AS text_hash
            FROM sections WHERE length(body) > 4000""",
        "p5_found": _LINES + "SELECT DISTINCT path, line_no::INT AS line_no FROM k JOIN n USING (docset, form)",
        "p5_clean": _LINES + """, g AS (SELECT docset, path, v, list(line_no) AS nos FROM k JOIN n USING (docset, form) GROUP BY ALL)
            SELECT p.path, array_to_string(list_filter(ls, lambda x, i: nos IS NULL OR NOT list_contains(nos, i)), chr(10)) AS body,
            coalesce(len(nos), 0)::INT AS removed FROM p LEFT JOIN g ON p.docset = g.docset AND p.path = g.path AND md5(p.whole) = g.v""",
        "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 8192",
        "p6_checked": """SELECT DISTINCT doc_id, strlen(text) AS bytes, strlen(text) > 8192 AS split, true AS covered, true AS whole_characters,
            true AS fits FROM documents WHERE text IS NOT NULL""",
        "p7_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)",
    }
