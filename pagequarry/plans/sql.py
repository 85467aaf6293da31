"""SQL fragments that state the matching rules for DuckDB, independently of the Spark code."""

from __future__ import annotations

WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LEADING = "([{\"''«“‘¿¡`"
TRAILING = ")]}([{\"''»”’`,;:!?."

#: Keyword lists: ql(query_id, docset, query, words).
QUERIES = f"""
q AS (SELECT query_id, query, docset FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY query, docset) AS rn
        FROM queries WHERE query IS NOT NULL) WHERE rn = 1),
qk AS (SELECT query_id, docset, query, list_filter(list_transform(string_split_regex(query, '{WS}+'),
         lambda w: lower(rtrim(ltrim(w, '{LEADING}'), '{TRAILING}'))), lambda w: w <> '') AS ks FROM q),
ql AS (SELECT query_id, docset, query, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS words FROM qk WHERE len(ks) > 0)
"""

#: Sections as they are matched: s(path, sec_no, docset, level, h, b, c, pn, page, stem, bytes, has_body).
SECTIONS = f"""
s AS (SELECT DISTINCT ON (path, sec_no) path, sec_no, docset, coalesce(level, 0) AS level, lower(coalesce(heading, '')) AS h,
        lower(coalesce(body, '')) AS b, lower(coalesce(array_to_string(breadcrumb, ' '), '')) AS c,
        lower(coalesce(page, '')) AS pn, coalesce(page, '') AS page, lower(coalesce(page_stem, '')) AS stem,
        strlen(coalesce(body, '')) AS bytes, regexp_replace(coalesce(body, ''), '{WS}+', '', 'g') <> '' AS has_body
      FROM sections)
"""


def whole(text: str, needle: str) -> str:
    """Number of whole-word matches, from the pieces between non-overlapping matches."""
    sp = f"string_split({text}, {needle})"
    return (
        f"(SELECT count(*) FROM (SELECT {sp} AS sp, unnest(range(1, len({sp}))) AS i) WHERE "
        f"NOT regexp_matches(CASE WHEN i = 1 AND sp[1] = '' THEN '' WHEN sp[i] <> '' THEN right(sp[i], 1) ELSE right({needle}, 1) END, '[A-Za-z0-9]') AND "
        f"NOT regexp_matches(CASE WHEN sp[i + 1] <> '' THEN left(sp[i + 1], 1) WHEN i + 1 = len(sp) THEN '' ELSE left({needle}, 1) END, '[A-Za-z0-9]'))"
    )


def whole_list(text: str, needle: str) -> str:
    """The same as an expression without a subquery."""
    sp = f"string_split({text}, {needle})"
    return (
        f"len(list_filter(range(1, len({sp})), lambda i: "
        f"NOT regexp_matches(CASE WHEN i = 1 AND {sp}[1] = '' THEN '' WHEN {sp}[i] <> '' THEN right({sp}[i], 1) ELSE right({needle}, 1) END, '[A-Za-z0-9]') AND "
        f"NOT regexp_matches(CASE WHEN {sp}[i + 1] <> '' THEN left({sp}[i + 1], 1) WHEN i + 1 = len({sp}) THEN '' ELSE left({needle}, 1) END, '[A-Za-z0-9]')))"
    )


def starts_line(text: str, needle: str) -> str:
    lead = WS[:-1] + r'*`+|>_\["-]+'
    return f"len(list_filter(string_split({text}, chr(10)), lambda l: starts_with(regexp_replace(l, '^{lead}', ''), {needle}))) > 0"


#: Every needle with every section of an asking docset that has it somewhere: m(docset, needle, path, sec_no, occ, ...).
MATCHES = f"""
nd AS (SELECT DISTINCT docset, unnest(list_append(words, array_to_string(words, ' '))) AS needle FROM ql),
m0 AS (SELECT s.docset, needle, path, sec_no, b, h, c, pn, page, contains(b, needle) AS inb, contains(h, needle) AS heading,
         contains(c, needle) AS crumb, contains(pn, needle) AS page_sub, starts_with(h, needle) AS title
       FROM nd JOIN s ON s.docset = nd.docset
       WHERE contains(b, needle) OR contains(h, needle) OR contains(c, needle) OR contains(pn, needle)),
m AS (SELECT docset, needle, path, sec_no, heading, crumb, page_sub, title,
        CASE WHEN inb THEN least(20, len(string_split(b, needle)) - 1) ELSE 0 END AS occ,
        inb AND {whole_list("b", "needle")} > 0 AS whole,
        inb AND page <> '' AND {starts_line("b", "needle")} AS line,
        page_sub AND {whole_list("pn", "needle")} > 0 AS page_word
      FROM m0)
"""

#: Weights: w(query_id, docset, pos, kw, w) and qa(query_id, docset, words, k, avg_w).
WEIGHTS = """
nn AS (SELECT docset, count(*) AS n FROM s GROUP BY ALL),
df AS (SELECT docset, needle, count(*) AS df FROM m WHERE occ > 0 GROUP BY ALL),
t AS (SELECT query_id, docset, unnest(words) AS kw, generate_subscripts(words, 1) - 1 AS pos FROM ql),
w AS (SELECT t.query_id, t.docset, pos, kw, greatest(ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)), 0.25::DOUBLE) AS w
      FROM t JOIN nn USING (docset) LEFT JOIN df ON df.docset = t.docset AND df.needle = t.kw),
qa AS (SELECT query_id, docset, list(kw ORDER BY pos) AS words, list(w ORDER BY pos) AS ws, count(*) AS k,
         list_reduce(list(w ORDER BY pos), lambda a, x: a + x, 0::DOUBLE) / count(*) AS avg_w FROM w GROUP BY ALL)
"""

#: Scores of all matching pairs: sc(query_id, path, sec_no, page, score).
SCORES = """
x AS (SELECT w.query_id, m.path, m.sec_no, list({'w': w, 'occ': occ, 'whole': whole, 'line': line, 'heading': heading,
         'crumb': crumb, 'pw': page_word, 'ps': page_sub, 'title': title AND pos = 0} ORDER BY pos) AS ts
      FROM w JOIN m ON m.docset = w.docset AND m.needle = w.kw GROUP BY ALL),
ph AS (SELECT qa.query_id, m.path, m.sec_no FROM qa JOIN m ON m.docset = qa.docset AND m.needle = array_to_string(words, ' ')
       WHERE k > 1 AND (occ > 0 OR heading)),
y AS (SELECT x.query_id, x.path, x.sec_no, s.page, ts, k, avg_w, words, ws, ph.path IS NOT NULL AS phrased, level, stem, bytes, has_body,
        list_reduce(flatten(list_transform(ts, lambda z: [z.occ * z.w, CASE WHEN z.whole THEN 3.0 * z.w ELSE 0 END,
          CASE WHEN z.heading THEN 15.0 * z.w ELSE 0 END, CASE WHEN z.crumb THEN 10.0 * z.w ELSE 0 END]::DOUBLE[])),
          lambda a, v: a + v, 0::DOUBLE) AS base,
        list_reduce(flatten(list_transform(ts, lambda z: [CASE WHEN z.pw THEN 10.0 * z.w ELSE 0 END,
          CASE WHEN z.line THEN 5.0 * z.w ELSE 0 END]::DOUBLE[])), lambda a, v: a + v, 0::DOUBLE) AS ident
      FROM x JOIN qa USING (query_id) JOIN s ON s.path = x.path AND s.sec_no = x.sec_no
      LEFT JOIN ph ON ph.query_id = x.query_id AND ph.path = x.path AND ph.sec_no = x.sec_no),
y1 AS (SELECT *, (CASE WHEN len(list_filter(ts, lambda z: z.heading OR z.crumb OR z.ps)) = k THEN base * 1.4::DOUBLE ELSE base END)
        + (CASE WHEN phrased THEN 15.0::DOUBLE * avg_w ELSE 0 END)
        + (CASE WHEN level <= 2 AND len(list_filter(ts, lambda z: z.heading)) = k AND len(list_filter(ts, lambda z: z.title)) > 0
             THEN 25.0::DOUBLE * avg_w ELSE 0 END) AS sc1,
        ident + (CASE WHEN page <> '' AND list_contains([array_to_string(words, ''), array_to_string(words, '-'), array_to_string(words, '_'), array_to_string(words, '.'), array_to_string(words, ' ')],
             stem)
             THEN 30.0::DOUBLE * avg_w WHEN page <> '' THEN list_reduce(list_transform(range(1, len(words) + 1), lambda i:
               CASE WHEN words[i] = stem THEN 10.0::DOUBLE * ws[i] ELSE 0::DOUBLE END), lambda a, v: a + v, 0::DOUBLE)
             ELSE 0 END) AS ident1,
        len(list_filter(ts, lambda z: z.occ > 0 OR z.heading OR z.crumb OR z.pw)) / k::DOUBLE AS cov
      FROM y WHERE base + ident > 0),
sc AS (SELECT query_id, path, sec_no, page, (sc1 * cov / (1 + sqrt(bytes / 6000.0::DOUBLE)) + ident1 * cov)
         * (CASE WHEN has_body THEN 1::DOUBLE ELSE 0.2::DOUBLE END) AS score FROM y1)
"""

#: Hits without duplicates and within the page cap: d and c(query_id, path, sec_no, page, score).
LIMITS = f"""
d AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id, h, regexp_replace(b, '^{WS}+|{WS}+$', '', 'g')
        ORDER BY score DESC, path, sec_no) AS r FROM sc JOIN s USING (path, sec_no)) WHERE r = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY score DESC, path, sec_no) AS p FROM d)
      WHERE page = '' OR p <= 2)
"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
