"""SQL that states slicing at any level, repairs and rendering for DuckDB, as folds over lines and hits."""

from __future__ import annotations

#: Of a line x: o, the run of backticks or tildes that opens a fence; r, that of a line which can close one.
_FENCE_OF = r"""'o': regexp_extract(x, '^ {0,3}(`{3,})[^`]*$', 1) || regexp_extract(x, '^ {0,3}(~{3,}).*$', 1),
        'r': regexp_extract(x, '^ {0,3}(`+|~+)\s*$', 1)"""
#: Whether line x closes the open fence a.m.
_CLOSES = "x.r <> '' AND x.r[1] = a.m[1] AND length(x.r) >= length(a.m)"

# Sections of a page at heading levels up to 6, counted by a fold: m is the open fence, p the lines of the paragraph, b
# whether the section has a body so far without it, h whether it has a heading, l its level; s and d count what is done.
_DONE = "a.s + CASE WHEN a.h OR a.b{0} THEN 1 ELSE 0 END, 'd': CASE WHEN a.h OR a.b{0} THEN greatest(a.d, a.l) ELSE a.d END"
_PAST = " OR a.p > 0"
LEVEL_6 = (
    r"""
WITH q AS (SELECT DISTINCT path, body FROM pages WHERE body IS NOT NULL AND path IS NOT NULL),
f AS (SELECT path, list_reduce(list_transform(string_split(body, chr(10)), lambda x: {"""
    + _FENCE_OF
    + r""", 'h': length(regexp_extract(x, '^ {0,3}(#{1,6})(?:[ \t]|\s*$)', 1)),
          't': regexp_replace(trim(regexp_replace(x, '^ {0,3}#{1,6}', ''), ' ' || chr(9) || chr(13)), '(^|[ \t]+)#+$', '') <> '',
          'u': regexp_extract(x, '^ {0,3}(=+|-+)\s*$', 1)[1], 'e': trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) = '', 'i': starts_with(x, '    ')}),
        lambda a, x: CASE
          WHEN a.m <> '' THEN {'m': CASE WHEN """ + _CLOSES + r""" THEN '' ELSE a.m END, 'p': 0, 'b': a.b OR NOT x.e, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d}
          WHEN x.o <> '' THEN {'m': x.o, 'p': 0, 'b': true, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d}
          WHEN x.h > 0 THEN {'m': '', 'p': 0, 'b': false, 'h': x.t, 'l': x.h, 's': """ + _DONE.format(_PAST) + r"""}
          WHEN x.u <> '' AND a.p = 1 THEN {'m': '', 'p': 0, 'b': false, 'h': true, 'l': CASE x.u WHEN '=' THEN 1 ELSE 2 END, 's': """ + _DONE.format("") + r"""}
          WHEN x.u <> '' THEN {'m': '', 'p': 0, 'b': true, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d}
          WHEN x.e THEN {'m': '', 'p': 0, 'b': a.b OR a.p > 0, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d}
          WHEN a.p > 0 OR NOT x.i THEN {'m': '', 'p': a.p + 1, 'b': a.b, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d}
          ELSE {'m': '', 'p': 0, 'b': true, 'h': a.h, 'l': a.l, 's': a.s, 'd': a.d} END,
        {'m': '', 'p': 0, 'b': false, 'h': false, 'l': 0::BIGINT, 's': 0, 'd': 0::BIGINT}) AS a FROM q)
SELECT path, (""" + _DONE.format(_PAST).split(", 'd': ")[0] + """)::BIGINT AS sections, (""" + _DONE.format(_PAST).split("'d': ")[1] + """)::INT AS deepest
FROM f WHERE a.s > 0 OR a.h OR a.b OR a.p > 0"""
)

# Pages as a crawl leaves them, and their lines.
_GLUED = r"""
WITH q AS (SELECT DISTINCT path, regexp_replace(body, '(?m)^(```|~~~)(\w+)(\r?)$', '\1\2' || chr(10) || 'Copy to clipboard\3', 'g')
        || E'\nManual\n * Godot Engine 4.7 documentation in English\n* Index\n \n* * *\n---\n' AS body FROM pages WHERE body IS NOT NULL AND path IS NOT NULL),
ln AS (SELECT path, list_transform(string_split(body, chr(10))[:-2], lambda x: rtrim(x, chr(13))) AS ls FROM q),
"""
HEALED = (
    _GLUED
    + r"""f AS (SELECT path, len(ls) AS n, list_reduce(list_transform(ls, lambda x: {""" + _FENCE_OF + r""",
          'g': contains(x, '[Content truncated due to length]') OR trim(x) = 'Copy to clipboard' OR starts_with(trim(x), '> Source: http')
               OR (starts_with(trim(x), '# ') AND contains(x, ' — Godot Engine'))}),
        lambda a, x: CASE WHEN a.m <> '' AND x.g THEN {'m': '', 'k': a.k + 1} WHEN a.m <> '' AND """ + _CLOSES + r""" THEN {'m': '', 'k': a.k}
          WHEN a.m = '' AND x.o <> '' THEN {'m': x.o, 'k': a.k} ELSE a END, {'m': '', 'k': 0}) AS a FROM ln)
SELECT path, n + a.k AS lines, a.k::BIGINT AS healed FROM f"""
)
# The kind of each line, '' where it is kept; t counts the notes' lines.
_KINDS = (
    _GLUED
    + r"""f AS (SELECT path, list_reduce(list_transform(ls, lambda x: {""" + _FENCE_OF + r""", 'l': regexp_matches(x, '^ {0,3}(```|~~~)'), 'b': trim(x, ' ' || chr(9)),
          'w': x <> '' AND trim(x, ' ' || chr(9)) = '', 'h': regexp_matches(x, '^#\s.* — Godot Engine \(stable\) documentation in English\s*$')}),
        lambda a, x: CASE
          WHEN a.m <> '' THEN {'m': CASE WHEN """ + _CLOSES + r""" THEN '' ELSE a.m END, 't': a.t, 'k': list_append(a.k, '')}
          WHEN x.l THEN {'m': x.o, 't': a.t, 'k': list_append(a.k, '')}
          WHEN a.t > 0 AND starts_with(x.b, 'Hosted by ') THEN {'m': '', 't': 0, 'k': list_append(a.k, 'footer')}
          WHEN a.t > 0 AND (x.b = '---' OR starts_with(x.b, '> Source:') OR starts_with(x.b, '#') OR a.t > 41) THEN {'m': '', 't': 0, 'k': list_append(a.k, '')}
          WHEN a.t > 0 THEN {'m': '', 't': a.t + 1, 'k': list_append(a.k, 'footer')}
          WHEN x.b = '## User-contributed notes' THEN {'m': '', 't': 1, 'k': list_append(a.k, 'footer')}
          ELSE {'m': '', 't': 0, 'k': list_append(a.k, CASE
            WHEN x.b IN ('About', 'Getting started', 'Manual', 'Engine details', 'Community', 'Class reference') THEN 'nav'
            WHEN x.b = 'Copy to clipboard' THEN 'copy-to-clipboard' WHEN x.b = '* * *' THEN 'separator' WHEN x.b = '---' THEN 'thematic-break'
            WHEN x.h THEN 'h1-suffix' WHEN x.w THEN 'whitespace-only' ELSE '' END)} END, {'m': '', 't': 0, 'k': []::VARCHAR[]}).k AS ks FROM ln),
k AS (SELECT path, unnest(ks) AS kind FROM f)
"""
)
_ANCHOR = r"""contains(x, '[Content truncated due to length]') OR trim(x) = 'Copy to clipboard' OR starts_with(trim(x), '> Source: http')
               OR (starts_with(trim(x), '# ') AND contains(x, ' — Godot Engine'))"""
# Healed, then stripped: the lines that are left.
NORMALIZED = (
    _GLUED.replace("ln AS", "l0 AS")
    + r"""ln AS (SELECT path, list_reduce(list_transform(ls, lambda x: {'x': x, """ + _FENCE_OF + r""", 'g': """ + _ANCHOR + r"""}),
        lambda a, x: CASE WHEN a.m <> '' AND x.g THEN {'m': '', 'k': list_concat(a.k, [a.m, x.x])}
          WHEN a.m <> '' AND """ + _CLOSES + r""" THEN {'m': '', 'k': list_append(a.k, x.x)}
          WHEN a.m = '' AND x.o <> '' THEN {'m': x.o, 'k': list_append(a.k, x.x)} ELSE {'m': a.m, 'k': list_append(a.k, x.x)} END,
        {'m': '', 'k': []::VARCHAR[]}).k AS ls FROM l0),
"""
    + _KINDS[len(_GLUED) :].replace("k AS (SELECT path, unnest(ks) AS kind FROM f)", "k AS (SELECT path, ls, ks FROM f JOIN ln USING (path))")
    + "SELECT path, sha256(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: ks[i] = ''), lambda i: ls[i] || chr(10)), '')) AS body_hash FROM k"
)
STRIPPED = _KINDS + "SELECT path, count(*) AS lines FROM k WHERE kind = '' GROUP BY path"
COUNTED = _KINDS + "SELECT kind, count(*) AS lines FROM k WHERE kind <> '' GROUP BY kind"


def rendered(tokens: int, top_k: int = 3) -> str:
    """CTEs up to outp(query_id, output): the text of every query's hits in rk, under a budget of tokens."""
    begin, end = "'--- DÉBUT DE SECTION (Score: ' || floor(x.score + 0.5)::BIGINT || ') ---' || chr(10)", "'--- FIN DE SECTION ---'"
    cut = "chr(10) || chr(10) || '[... Section tronquée pour respecter le budget de tokens ...]'"
    one = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    head = (
        f"{begin} || CASE WHEN x.level > 0 THEN repeat('#', x.level) || ' ' || x.heading || chr(10) ELSE '' END"
        " || CASE WHEN x.crumb <> '' THEN '> ' || x.crumb || chr(10) ELSE '' END"
        " || CASE WHEN x.url IS NOT NULL THEN '> Source: ' || x.url || chr(10) ELSE '' END || '> File: ' || x.path || chr(10)"
    )
    mark = f"""list_reduce(list_transform(string_split(k, chr(10)), lambda x: {{{_FENCE_OF}}}), lambda a, x: CASE WHEN a.m <> '' AND {_CLOSES} THEN {{'m': ''}}
        WHEN a.m = '' AND x.o <> '' THEN {{'m': x.o}} ELSE a END, {{'m': ''}}).m"""
    closed = f"k || {one(mark, 'm', chr(39) * 2 + ' || CASE WHEN m <> ' + chr(39) * 2 + ' AND NOT ends_with(k, chr(10)) THEN chr(10) ELSE ' + chr(39) * 2 + ' END || m')}"
    kept = "CASE WHEN contains(left(x.body, r.short), chr(10)) THEN regexp_extract(left(x.body, r.short), '(?s)^.*\\n', 0) ELSE left(x.body, r.short) END"
    body = f"CASE WHEN r.whole THEN x.body WHEN r.short = 0 THEN '' WHEN length(x.body) <= r.short THEN x.body || {cut} ELSE {one(kept, 'k', closed)} || {cut} END"
    room = f"greatest(0, t - (length(h) + length({end}) + 3))"
    sizes = f"{{'whole': length(x.body) <= {room}, 'short': greatest(0, {room} - length({cut}))}}"
    block = one(head, "h", one(sizes, "r", f"h || {body} || chr(10) || {end} || chr(10) || chr(10)"))
    # One hit: t is its share; without any nothing more comes.
    step = one("a.rest // (a.of - a.i)", "t", f"CASE WHEN t = 0 THEN {{'rest': 0::BIGINT, 'i': a.i, 'of': a.of, 'text': a.text}} ELSE " + one(
        block, "y", "{'rest': greatest(0, a.rest - length(y))::BIGINT, 'i': a.i + 1, 'of': a.of, 'text': a.text || y}") + " END")
    return f"""
ss AS (SELECT DISTINCT ON (path, sec_no) path, sec_no, coalesce(level, 0) AS level, coalesce(heading, '') AS heading,
         coalesce(array_to_string(breadcrumb, ' > '), '') AS crumb, url, coalesce(body, '') AS body FROM sections),
hh AS (SELECT query_id, list({{'score': score, 'level': level, 'heading': heading, 'crumb': crumb, 'path': path, 'url': url, 'body': body}} ORDER BY rank) AS hs
       FROM rk JOIN ss USING (path, sec_no) WHERE rank <= {top_k} GROUP BY query_id),
qn AS (SELECT query_id, coalesce(min(query), '') AS query FROM queries GROUP BY query_id),
hd AS (SELECT query_id, hs, 'Résultats de recherche pour ''' || query || ''' :' || chr(10) || chr(10) AS top FROM hh JOIN qn USING (query_id)),
outp AS (SELECT query_id, list_reduce(hs, lambda a, x: {step},
           {{'rest': greatest(0, {tokens * 4} - length(top))::BIGINT, 'i': 0, 'of': len(hs), 'text': top}}).text AS output FROM hd)
"""
