"""Pieces of the DuckDB SQL that says what the registered queries return, for those that need more than one statement."""

from __future__ import annotations

from corpusloom.functions.text import SPACE, WORD

GAP = "chr(10) || chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def title(x: str) -> str:
    return f"regexp_replace({strip(x)}, '^#{{1,6}}[{SPACE}]*', '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[{WORD}]+|[^{SPACE}]')"


def chunked(size: int, overlap: int) -> str:
    """CTEs from input (source, t) to chunked (chunk_id, source, idx, text, chapter, section).

    Blocks, captions and sections are window functions; table parts, packing and merging are one recursion each.
    """
    joined = f"""array_to_string(list_transform(range(1, len(held) + 1), lambda k: (CASE WHEN k = 1 OR (NOT held[k].tab AND NOT held[k - 1].tab) THEN '' ELSE {GAP} END) || held[k].text), '')"""
    total = "coalesce(list_sum(list_transform(held, lambda h: length(h.text))), 0)"
    tail = f"held[list_min(list_filter(range(1, len(held) + 2), lambda k: len(list_filter(held[k:], lambda h: h.tab)) = 0 AND coalesce(list_sum(list_transform(held[k:], lambda h: length(h.text))), 0) <= {overlap})):]"
    return f"""
stripped AS (SELECT source, {strip("coalesce(t, '')")} AS t FROM input),
plain AS (SELECT source, t FROM stripped WHERE length(t) <= {size} AND NOT contains(t, chr(10)) AND t <> ''),
blocks AS (SELECT source, generate_subscripts(b, 1) AS pos, unnest(b) AS block FROM (SELECT source,
  list_filter(list_transform(regexp_split_to_array(t, '\\n[{SPACE}]*\\n'), lambda x: trim(x, chr(10))), lambda x: {strip("x")} <> '') AS b FROM stripped WHERE length(t) > {size} OR contains(t, chr(10)))),
kinds AS (SELECT source, pos, block, {strip("block")} AS line, CASE WHEN regexp_matches(block, '^[{SPACE}]*(\\[表格\\]|\\|)') THEN 'table'
  WHEN regexp_matches({strip("block")}, '^#{{1,6}}[{SPACE}]') AND NOT contains({strip("block")}, chr(10)) THEN 'heading' ELSE 'para' END AS kind FROM blocks),
caps AS (SELECT *, kind = 'para' AND coalesce(lead(kind) OVER w = 'table', false) AND length(line) < 40 AND regexp_matches(line, '^表[{SPACE}]*\\p{{Nd}}') AS cap FROM kinds WINDOW w AS (PARTITION BY source ORDER BY pos)),
named AS (SELECT source, pos, kind, cap, line, CASE WHEN coalesce(lag(cap) OVER w, false) THEN lag(line) OVER w || {GAP} || block ELSE block END AS text FROM caps WINDOW w AS (PARTITION BY source ORDER BY pos)),
headed AS (SELECT *, CASE WHEN kind = 'heading' THEN {title("line")} END AS title FROM named WHERE NOT cap),
numbered AS (SELECT *, sum(CAST(kind = 'heading' AS INT)) OVER w AS section_no, last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER w AS heading, last_value(title IGNORE NULLS) OVER w AS own,
  last_value(CASE WHEN regexp_matches(title, '^第[一二三四五六七八九十百零〇两]+章') THEN title END IGNORE NULLS) OVER w AS chapter FROM headed WINDOW w AS (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING)),
body AS (SELECT source, section_no, pos, kind, text, chapter, CASE WHEN NOT regexp_matches(own, '^第[一二三四五六七八九十百零〇两]+章') THEN own END AS section,
  CASE WHEN chapter <> '' AND NOT starts_with(coalesce(own, ''), chapter) THEN '【' || chapter || '】' || chr(10) ELSE '' END AS lead, CASE WHEN heading <> '' THEN heading || {GAP} ELSE '' END AS prefix FROM numbered WHERE kind <> 'heading'),
roomed AS (SELECT *, greatest(60, {size} - length(lead) - length(prefix)) AS room FROM body),
tabled AS (SELECT *, string_split(text, chr(10)) AS ls FROM roomed WHERE kind = 'table'),
topped AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '^[{SPACE}]*\\|')), true) AS top FROM tabled),
wide AS (SELECT *, top + CAST(len(ls) > top AND {strip("replace(replace(ls[top + 1], '|', ''), '-', '')")} = '' AS INT) AS rows_at FROM topped WHERE length(text) > room AND top IS NOT NULL),
cut AS (SELECT source, pos, room, rows_at, array_to_string(ls[1:rows_at], chr(10)) AS head, ls[rows_at + 1:] AS rest FROM wide),
grouped AS (SELECT source, pos, 0 AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS made FROM cut UNION ALL
  SELECT g.source, g.pos, i + 1, CASE WHEN flush THEN [rest[i + 1]] ELSE list_append(held, rest[i + 1]) END, CASE WHEN flush THEN head || chr(10) || array_to_string(held, chr(10)) END
  FROM (SELECT g.*, c.rest, c.head, length(c.head) + coalesce(list_sum(list_transform(g.held, lambda x: length(x) + 1)), 0) + length(c.rest[g.i + 1]) + 1 > c.room AND len(g.held) >= c.rows_at AS flush FROM grouped g JOIN cut c USING (source, pos) WHERE g.i < len(c.rest)) g),
parts AS (SELECT source, pos, i, made FROM grouped WHERE made IS NOT NULL UNION ALL SELECT g.source, g.pos, i + 1, head || chr(10) || array_to_string(held, chr(10)) FROM grouped g JOIN cut c ON c.source = g.source AND c.pos = g.pos AND i = len(rest) WHERE len(held) > 0),
said AS (SELECT source, pos, room, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda x: {strip("x")}), lambda x: x <> '') AS s FROM roomed WHERE kind = 'para'),
spread AS (SELECT source, pos, room, generate_subscripts(s, 1) AS a, unnest(s) AS x FROM said),
units AS (SELECT source, pos, a, unnest(range(0, (length(x) - 1) // room + 1)) AS b, false AS tab, x, room FROM spread
  UNION ALL SELECT source, pos, 0, 0, true, text, length(text) FROM topped WHERE length(text) <= room OR top IS NULL
  UNION ALL SELECT source, pos, i, 0, true, made, length(made) FROM parts),
listed AS (SELECT u.source, r.section_no, row_number() OVER (PARTITION BY u.source, r.section_no ORDER BY u.pos, a, b) AS n, tab, substr(x, CAST(b * u.room + 1 AS INT), u.room) AS text, r.room FROM units u JOIN roomed r USING (source, pos)),
packed AS (SELECT source, section_no, n, [{{'tab': tab, 'text': text}}] AS held, CAST(NULL AS VARCHAR) AS made FROM listed WHERE n = 1 UNION ALL
  SELECT source, section_no, n, list_append(CASE WHEN flush THEN {tail} ELSE held END, {{'tab': tab, 'text': text}}), CASE WHEN flush THEN {joined} END
  FROM (SELECT p.source, p.section_no, l.n, p.held, l.tab, l.text, {total.replace("held", "p.held")} + length(l.text) > l.room AS flush FROM packed p JOIN listed l ON l.source = p.source AND l.section_no = p.section_no AND l.n = p.n + 1)),
lasts AS (SELECT source, section_no, max(n) AS n FROM listed GROUP BY 1, 2),
made AS (SELECT source, section_no, n, made FROM packed WHERE made IS NOT NULL UNION ALL SELECT p.source, p.section_no, p.n + 1, {joined} FROM packed p JOIN lasts USING (source, section_no, n)),
heads AS (SELECT source, section_no, any_value(lead) AS lead, any_value(prefix) AS prefix, any_value(chapter) AS chapter, any_value(section) AS section FROM roomed GROUP BY 1, 2),
chunks0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY section_no, n) AS n, lead || {strip("prefix || made")} AS text, chapter, section FROM made JOIN heads USING (source, section_no) WHERE {strip("prefix || made")} <> ''),
merged AS (SELECT source, n, text, chapter, section, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS VARCHAR) AS done_chapter, CAST(NULL AS VARCHAR) AS done_section FROM chunks0 WHERE n = 1 UNION ALL
  SELECT source, n, CASE WHEN fits THEN text || {GAP} || t ELSE t END, CASE WHEN fits THEN chapter ELSE c END, CASE WHEN fits THEN section ELSE s END, CASE WHEN NOT fits THEN text END, CASE WHEN NOT fits THEN chapter END, CASE WHEN NOT fits THEN section END
  FROM (SELECT m.source, k.n, m.text, m.chapter, m.section, k.text AS t, k.chapter AS c, k.section AS s, length(k.text) < least(250, {size} // 3) AND m.chapter IS NOT DISTINCT FROM k.chapter AND length(m.text) + 2 + length(k.text) <= {size}
    AND NOT (k.chapter IS NOT NULL AND k.section IS NULL) AND NOT (m.chapter IS NOT NULL AND m.section IS NULL) AS fits FROM merged m JOIN chunks0 k ON k.source = m.source AND k.n = m.n + 1)),
finals AS (SELECT source, max(n) AS n FROM chunks0 GROUP BY 1),
all_ AS (SELECT source, 0 AS n, t AS text, CAST(NULL AS VARCHAR) AS chapter, CAST(NULL AS VARCHAR) AS section FROM plain
  UNION ALL SELECT source, n, done, done_chapter, done_section FROM merged WHERE done IS NOT NULL UNION ALL SELECT m.source, m.n + 1, text, chapter, section FROM merged m JOIN finals USING (source, n)),
chunked AS (SELECT source || '::' || (row_number() OVER w - 1) AS chunk_id, source, CAST(row_number() OVER w - 1 AS INT) AS idx, text, chapter, section FROM all_ WINDOW w AS (PARTITION BY source ORDER BY n))
"""


def encoded(dim: int = 64, tag: str = "") -> str:
    """CTEs from keys (key) and tokens (key, token) to vectors (key, e) of the default encoder, and directions (key, u): doubles of length 1; names end in ``tag``."""
    return f"""
crc_table{tag} AS (SELECT list(list_reduce([b] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY b) AS t FROM range(256) r(b)),
coded{tag} AS (SELECT token, xor(list_reduce([4294967295] || list_transform(range(0, octet_length(encode(token))), lambda i: CAST('0x' || substr(hex(encode(token)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM (SELECT DISTINCT token FROM tokens), crc_table{tag}),
summed{tag} AS (SELECT key, h % {dim} AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM tokens JOIN coded{tag} USING (token) GROUP BY 1, 2),
lengths{tag} AS (SELECT key, sqrt(sum(x * x)) AS len FROM summed{tag} GROUP BY 1),
vectors{tag} AS (SELECT k.key, list(coalesce(CAST(s.x / CASE WHEN l.len = 0 THEN 1 ELSE l.len END AS FLOAT), 0) ORDER BY r.d) AS e FROM keys k CROSS JOIN range({dim}) r(d) LEFT JOIN summed{tag} s ON s.key = k.key AND s.d = r.d LEFT JOIN lengths{tag} l ON l.key = k.key GROUP BY 1),
directions{tag} AS MATERIALIZED (SELECT key, list_transform(d, lambda x: x / CASE WHEN list_inner_product(d, d) = 0 THEN 1 ELSE sqrt(list_inner_product(d, d)) END) AS u FROM (SELECT key, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS d FROM vectors{tag}))
"""


#: CTEs from d (chunk_id, t: tokens) to terms (term, df, idf), post (term, chunk_id, tf, dl) and stats (n, avgdl).
BM25 = """
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf, min(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY 1, 2),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1), raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats), mean AS MATERIALIZED (SELECT avg(r) AS m FROM raw),
terms AS MATERIALIZED (SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 9) AS idf FROM raw, mean)"""


def scored(queries: str) -> str:
    """CTEs from those of BM25 and ``queries`` (query_id, t) to scored (query_id, chunk_id, score)."""
    return f""", asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM {queries}) GROUP BY 1, 2),
scored AS (SELECT q.query_id, p.chunk_id, round(sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)) * q.qtf), 9) AS score FROM asked q JOIN terms t USING (term) JOIN post p USING (term), stats s GROUP BY 1, 2)"""


def stitched(texts: str) -> str:
    """A list of texts joined one after the other over their longest overlap of 6 to 200 characters, else with a blank line."""
    n = "list_max(list_filter(range(6, least(length(a), length(b), 200) + 1), lambda n: right(a, n) = left(b, n)))"
    return f"list_reduce({texts}, lambda a, b: a || CASE WHEN {n} IS NULL THEN {GAP} || b ELSE substr(b, CAST({n} AS INT) + 1) END)"


def expanded(least: int = 300, target: int = 600, most: int = 4) -> str:
    """CTEs from hits (h, source, idx, text) and store (source, idx, text), all of one chapter, to grown (h, expanded, low, high, text).

    Neighbours are taken in turn from both sides, so a running sum of lengths in that order says where it ends.
    """
    return f"""
short AS (SELECT h, source, idx, text, regexp_matches(text, '^[{SPACE}]*[#【]') AS opens FROM hits WHERE length(text) < {least}),
turns AS (SELECT s.h, s.source, s.idx AS base, o.idx, length(s.text) + coalesce(sum(length(o.text)) OVER (PARTITION BY s.h ORDER BY abs(o.idx - s.idx), (o.idx > s.idx) <> s.opens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM short s JOIN store o ON o.source = s.source AND o.idx <> s.idx AND abs(o.idx - s.idx) <= {most}),
spans AS (SELECT h, source, least(min(idx), min(base)) AS low, greatest(max(idx), max(base)) AS high FROM turns WHERE before < {target} GROUP BY 1, 2),
joined AS (SELECT p.h, {stitched("list(o.text ORDER BY o.idx)")} AS text FROM spans p JOIN store o ON o.source = p.source AND o.idx BETWEEN p.low AND p.high GROUP BY 1),
grown AS (SELECT h.*, p.low IS NOT NULL AS expanded, p.low, p.high, coalesce(j.text, h.text) AS grown_text FROM hits h LEFT JOIN spans p ON p.h = h.h LEFT JOIN joined j ON j.h = h.h)
"""
