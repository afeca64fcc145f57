"""DuckDB SQL for the registered queries of the engine's own operators."""

from __future__ import annotations

from .. import types as T
from ..functions.lexer import pattern
from ..operators.report import LEANS, SUGGESTIONS
from .snippets import ASKED, EXPECTED, IMPORTED, SEEDS, SOURCES

PATTERN = pattern(r"\p{L}\p{Nl}_$", r"\p{L}\p{N}_$", "")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in row) + ")" for row in rows)


def choice(column: str, of: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in of.items()) + " END"


def lexemes(column: str) -> str:
    return f"regexp_extract_all({column}, {text(PATTERN)}, 0)"


COMMENT = "(starts_with(x, '//') OR starts_with(x, '/*'))"
WORDS = ", ".join(map(text, T.KEYWORDS))
CODE = rf"""CASE WHEN x[1] IN ('''', '"', '`') THEN 'T' WHEN x[1] BETWEEN '0' AND '9' THEN 'N'
  WHEN regexp_matches(x, '^[\p{{L}}\p{{Nl}}_$]') THEN CASE WHEN x IN ({WORDS}) THEN 'K:' || x ELSE 'I' END ELSE 'S:' || x END"""


def tokens(column: str) -> str:
    return f"list_transform(list_filter({lexemes(column)}, lambda x: NOT {COMMENT}), lambda x: {CODE})"


def or_null(items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN list_sort(list_distinct({items})) END"


REST = "regexp_extract(url, '^[^:]*://([^?#]*)', 1)"
DIRS = f"list_concat([string_split({REST}, '/')[1]], list_filter(string_split({REST}, '/')[2:-2], lambda x: x <> ''))"
HREFS = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
PAGES = f"pages0 AS (SELECT page_id AS id, {tokens('html')} AS t, {HREFS} AS m, {DIRS} AS dirs FROM pages), chunks AS (SELECT id, {or_null('t')} AS tokens, {or_null('m')} AS modules, dirs FROM pages0)"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE)"


STEPS = "(len(a.dirs) + len(b.dirs) - 2 * len(list_filter(range(1, least(len(a.dirs), len(b.dirs)) + 1), lambda z: a.dirs[1:z] = b.dirs[1:z])))"
SIGNALS = f"signals AS (SELECT a.id AS id_a, b.id AS id_b, {jaccard('a.tokens', 'b.tokens')} AS structural_similarity, {jaccard('a.modules', 'b.modules')} AS import_overlap, {STEPS} AS module_distance FROM chunks a JOIN chunks b ON a.id < b.id)"


def leans(threshold: float = T.STRUCTURAL_THRESHOLD) -> str:
    return f"""leans AS (SELECT *,
  CASE WHEN structural_similarity >= {threshold}::DOUBLE THEN '{T.TOWARD_EXTRACT}' ELSE '{T.NEITHER}' END AS structural_lean,
  CASE WHEN import_overlap IS NULL THEN '{T.NEITHER}' WHEN import_overlap >= 0.5 THEN '{T.TOWARD_EXTRACT}' ELSE '{T.TOWARD_DO_NOT}' END AS import_lean,
  CASE WHEN module_distance >= 2 THEN '{T.TOWARD_DO_NOT}' ELSE '{T.TOWARD_EXTRACT}' END AS distance_lean FROM signals),
verdicts AS (SELECT *,
  CASE WHEN import_overlap >= 0.5 THEN '{T.SAME}' WHEN import_overlap < 0.5 AND module_distance >= 2 THEN '{T.SEPARATE}' ELSE '{T.UNDECIDABLE}' END AS domain,
  CASE WHEN structural_similarity >= {threshold}::DOUBLE AND import_overlap >= 0.5 THEN '{T.EXTRACT}'
    WHEN structural_similarity >= {threshold}::DOUBLE AND import_overlap < 0.5 AND module_distance >= 2 THEN '{T.DO_NOT_EXTRACT}' ELSE '{T.REVIEW}' END AS verdict FROM leans)"""


PAIRS = f"WITH {PAGES}, {SIGNALS}"
VERDICTS = f"{PAIRS}, {leans()}"
DOCS = f"docs AS (SELECT doc_id, t, {or_null('t')} AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)), sets AS (SELECT tokens, min(doc_id) AS id, count(*) AS n FROM docs GROUP BY tokens)"
SET_PAIRS = f"SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, {jaccard('a.tokens', 'b.tokens')} AS similarity FROM sets a JOIN sets b ON a.id < b.id"
LINES = r"""parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN e ELSE list_append(e, p[-1]) END AS lines FROM
  (SELECT doc_id, p, list_transform(p[1:-2], lambda x: CASE WHEN ends_with(x, chr(13)) THEN x[1:-2] ELSE x END) AS e FROM parts))"""
SHOWN = lambda c: f"printf('%.2f', round({c}, 2))"
CLIMB = "CASE WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:-2] ELSE list_append(acc, '..') END"
SPECIFIERS = "['./pad', '../utils/pad', '../../shared', '../../../../../out', '..', '.', 'react', './a/./b//c/../d', '../x/../../y']"
NUMBER = r"CASE WHEN NOT regexp_matches({0}, '^\+?[0-9]+$') THEN 'NotANumber' WHEN regexp_matches({0}, '^\+?0+$') THEN 'Zero' END"

LINES_OF = lambda path, first, last: "\n".join(dict(SOURCES)[path].split("\n")[first - 1 : last])

SQL: dict[str, str] = {
    "lex_tokens": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "token_class_counts": f"SELECT c[1] AS class, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS c FROM conversations) GROUP BY 1",
    "keyword_frequency": f"SELECT c[3:] AS keyword, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS c FROM documents) WHERE starts_with(c, 'K:') GROUP BY 1",
    "comment_lexemes": f"SELECT page_id, pos - 1 AS pos, length(c[pos]) AS n_chars FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS pos FROM (SELECT page_id, list_filter({lexemes("concat_ws(chr(10), url, html)")}, lambda x: {COMMENT}) AS c FROM pages))",
    "token_sets": f"WITH {DOCS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n FROM docs",
    "token_set_null": f"SELECT doc_id, len({tokens('blanked')}) = 0 AS not_measured FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' // nothing but a comment' ELSE text END AS blanked FROM documents)",
    "token_jaccard": f"WITH {DOCS} {SET_PAIRS}",
    "similar_pairs": f"WITH {DOCS} SELECT id_a AS rep_a, id_b AS rep_b, n_a, n_b, similarity FROM ({SET_PAIRS}) WHERE similarity >= 0.85::DOUBLE",
    "similarity_display": f"{PAIRS} SELECT {SHOWN('structural_similarity')} AS shown, count(*) AS n FROM signals GROUP BY 1",
    "href_sets": f"SELECT page_id, array_to_string({or_null(HREFS)}, ' ') AS modules FROM pages",
    "resolve_specifiers": f"""WITH r AS (SELECT page_id, list_filter({DIRS}, lambda x: x NOT IN ('.', '..')) AS dirs, unnest({SPECIFIERS}) AS specifier FROM pages)
SELECT page_id, specifier, CASE WHEN starts_with(specifier, './') OR starts_with(specifier, '../') OR specifier = '..' THEN
  array_to_string(list_reduce(list_transform(string_split(specifier, '/'), lambda s: [s]), lambda acc, s: CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] = '..' THEN {CLIMB} ELSE list_append(acc, s[1]) END, dirs), '/')
  ELSE specifier END AS module FROM r""",
    "import_overlap": f"{PAIRS} SELECT id_a, id_b, import_overlap FROM signals",
    "module_distance": f"{PAIRS} SELECT id_a, id_b, module_distance FROM signals",
    "pair_signals": f"{PAIRS} SELECT id_a, id_b, structural_similarity, import_overlap, module_distance FROM signals",
    "lean_columns": f"{VERDICTS} SELECT id_a, id_b, structural_lean, import_lean, distance_lean FROM leans",
    "domain_column": f"{VERDICTS} SELECT id_a, id_b, domain FROM verdicts",
    "verdict_pairs": f"{VERDICTS} SELECT id_a, id_b, verdict FROM verdicts",
    "verdict_low_threshold": f"{PAIRS}, {leans(0.5)} SELECT id_a, id_b, verdict FROM verdicts",
    "verdict_histogram": f"{VERDICTS} SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict",
    "verdict_without_imports": f"""WITH pages0 AS (SELECT page_id AS id, {tokens("html")} AS t, list_filter({HREFS}, lambda x: starts_with(x, '/th')) AS m, {DIRS} AS dirs FROM pages), chunks AS (SELECT id, {or_null("t")} AS tokens, {or_null("m")} AS modules, dirs FROM pages0),
{SIGNALS}, {leans(0.5)} SELECT import_overlap IS NULL AS unmeasured, import_lean, domain, verdict, count(*) AS n FROM verdicts GROUP BY ALL""",
    "reasons_exploded": f"""{VERDICTS} SELECT id_a, id_b, 0::BIGINT AS pos, 'structural_similarity' AS signal, structural_similarity AS value, structural_lean AS lean FROM verdicts
UNION ALL SELECT id_a, id_b, 1, 'import_overlap', import_overlap, import_lean FROM verdicts
UNION ALL SELECT id_a, id_b, 2, 'module_distance', module_distance::DOUBLE, distance_lean FROM verdicts""",
    "report_text": f"""{VERDICTS} SELECT id_a, id_b, '[' || verdict || '] page:' || id_a || ' <-> page:' || id_b || chr(10) || '  structural similarity: '
|| coalesce({SHOWN("structural_similarity")} || ' (threshold 0.85)', 'not measured (no tokens)') || ' -> ' || {choice("structural_lean", LEANS)} || chr(10)
|| '  reasons: ' || coalesce('overlap of dependencies ' || {SHOWN("import_overlap")}, 'overlap of dependencies not measured (a file has none)') || ' -> ' || {choice("import_lean", LEANS)} || chr(10)
|| '           module distance ' || module_distance || ' steps -> ' || {choice("distance_lean", LEANS)} || chr(10) || '  suggestion: ' || {choice("verdict", SUGGESTIONS)} AS report FROM verdicts""",
    "pair_cap": "SELECT n, n * (n - 1) // 2 AS pairs, n < 2 AS too_few, n * (n - 1) // 2 > 200000 AS stopped FROM (SELECT count(*) AS n FROM documents)",
    "line_split": f"WITH {LINES} SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_number, unnest(lines) AS line FROM lines",
    "line_slice": f"WITH {LINES} SELECT doc_id, array_to_string(lines[2:4], chr(10)) AS source FROM lines",
    "line_lookup_error": f"WITH {LINES}, asked AS (SELECT doc_id, len(lines) AS total, unnest(['0', '1', '3', '+7', '1000000', 'x', '']) AS asked FROM lines) SELECT doc_id, asked, coalesce({NUMBER.format('asked')}, CASE WHEN try_cast(ltrim(asked, '+') AS BIGINT) > total THEN 'LineBeyondSource' END) AS error FROM asked",
    "innermost_range": """WITH r AS (SELECT l_orderkey, l_partkey - floor(l_quantity)::BIGINT AS s, l_partkey + floor(l_quantity)::BIGINT AS e, l_partkey * 1000 + floor(l_quantity)::BIGINT * 10 + l_linenumber AS seq FROM lineitem
  UNION ALL SELECT l_orderkey, min(l_partkey), max(l_partkey), 0 FROM lineitem GROUP BY l_orderkey),
p AS (SELECT DISTINCT l_orderkey, l_partkey AS line FROM lineitem)
SELECT l_orderkey, line, s AS start_line, e AS end_line, seq FROM p JOIN r USING (l_orderkey) WHERE line BETWEEN s AND e
QUALIFY row_number() OVER (PARTITION BY l_orderkey, line ORDER BY e - s, seq) = 1""",
    "parse_location": rf"""WITH t AS (SELECT doc_id, unnest([source || ':' || doc_id, 'C:\src\' || lang || ':12', lang, ':42', source || ':abc', source || ':0', source || ':+7', source || ': 7', source || ':']) AS text, unnest(range(0, 9)) AS pos FROM documents),
s AS (SELECT *, regexp_extract(text, '(?s)^(.*):([^:]*)$', 1) AS p, regexp_extract(text, '(?s)^(.*):([^:]*)$', 2) AS l FROM t),
e AS (SELECT *, CASE WHEN NOT contains(text, ':') THEN 'MissingSeparator' WHEN p = '' THEN 'EmptyPath' ELSE {NUMBER.format("l")} END AS error FROM s)
SELECT doc_id, pos, CASE WHEN error IS NULL THEN p END AS path, CASE WHEN error IS NULL THEN try_cast(ltrim(l, '+') AS BIGINT) END AS line, error, CASE WHEN error IS NULL THEN p || ':' || try_cast(ltrim(l, '+') AS BIGINT) END AS shown FROM e""",
    "parse_threshold": r"""WITH t AS (SELECT event_id, unnest([printf('%.10f', floor(value * 8) / 1024), 'high', '1.5', 'nan', '-0.1', ' 0.5', '0.5f', '1', '0', '5e-1', 'inf', '']) AS text FROM events),
v AS (SELECT *, CASE WHEN regexp_matches(text, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN text::DOUBLE END AS x FROM t)
SELECT event_id, text, CASE WHEN x BETWEEN 0 AND 1 THEN x END AS value, CASE WHEN text IN ('nan', 'inf') THEN 'OutOfRange' WHEN x IS NULL THEN 'NotANumber' WHEN NOT x BETWEEN 0 AND 1 THEN 'OutOfRange' END AS error FROM v""",
    "seed_lines": f"SELECT path, line::BIGINT AS line FROM ({values(SEEDS)}) AS t(path, line)",
    "seed_lines_documents": rf"""WITH planted AS (SELECT doc_id, concat_ws(chr(10), text, lang || '(' || source || ') {{', chr(9) || 'if (' || lang || ') {{', '}} ' || lang || '() {{', lang || ') ( {{', lang || ' {{') AS text FROM documents),
{LINES.replace("FROM documents", "FROM planted")}, each AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, trim(unnest(lines), ' ' || chr(9)) AS x FROM lines)
SELECT doc_id, line FROM each WHERE NOT starts_with(x, '}}') AND ends_with(x, '{{') AND regexp_matches(x, '^[^(]*\(.*\)', 's')
  AND regexp_extract(x, '^([A-Za-z0-9_$]*)', 1) NOT IN ({", ".join(map(text, T.CONTROL_WORDS))})""",
    "ts_chunks": f"SELECT path, seq::BIGINT AS seq, kind, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, has_error, source FROM ({values([(*x, LINES_OF(x[0], x[3], x[4])) for x in EXPECTED])}) AS t(path, seq, kind, start_line, end_line, has_error, source)",
    "ts_imports": f"SELECT path, pos::BIGINT AS pos, specifier, module FROM ({values(IMPORTED)}) AS t(path, pos, specifier, module)",
    "source_files": f"SELECT path, n_lines::BIGINT AS n_lines FROM ({values([(p, len(s.splitlines())) for p, s in SOURCES])}) AS t(path, n_lines)",
    "compare_locations": f"SELECT * FROM ({values(ASKED)}) AS t(a, b, verdict, error, error_at, cause, error_text)",
    "split_results": f"SELECT a, b, CASE WHEN verdict IS NULL THEN 'failure' ELSE 'verdict' END AS kind FROM ({values(ASKED)}) AS t(a, b, verdict, error, error_at, cause, error_text)",
    "scan_pairs": f"""WITH t AS (SELECT path, seq, path || ':' || start_line AS at, start_line FROM ({values(EXPECTED)}) AS t(path, seq, kind, start_line, end_line, has_error) WHERE NOT has_error)
SELECT a.at AS a, b.at AS b FROM t a JOIN t b ON (a.path, a.start_line, a.seq) < (b.path, b.start_line, b.seq)""",
    "compare_one": "SELECT 'broken/half.ts:5' AS a, 'broken/open.ts:2' AS b, 1.0::DOUBLE AS similarity, NULL::DOUBLE AS import_overlap, 0::BIGINT AS module_distance, 'REVIEW' AS verdict",
    "line_ranges": """SELECT DISTINCT l_orderkey, l_linenumber, q, CASE WHEN e >= l_linenumber THEN l_linenumber || '-' || e END AS shown, l_linenumber || '-' || (l_linenumber + e) AS shown_more,
4 BETWEEN l_linenumber AND l_linenumber + e AS has_4, l_linenumber::BIGINT - 1 AS index FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity)::INTEGER AS q, floor(l_quantity)::INTEGER % 10 AS e FROM lineitem)""",
    "similarity_values": "SELECT event_id, CASE WHEN event_id % 50 <> 0 AND x BETWEEN 0 AND 1 THEN x END AS similarity FROM (SELECT event_id, floor(value * 8) / 256 - 0.25 AS x FROM events)",
    "capped_pairs": """SELECT 'nation' AS name, (SELECT count(*) FROM nation) || ' chunks' AS outcome
UNION ALL SELECT 'lineitem', CASE WHEN n * (n - 1) // 2 > 200000 THEN 'pairs are more than 200000' ELSE n || ' chunks' END FROM (SELECT count(*) AS n FROM lineitem)""",
    "recurrence": """WITH last AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'error'), 0) AS last FROM events GROUP BY user_id),
t AS (SELECT e.user_id, last, count(*) FILTER (event_type <> 'error' AND event_id > last) AS recurrence, count(*) FILTER (event_type <> 'error') AS total FROM events e JOIN last l ON e.user_id = l.user_id GROUP BY ALL)
SELECT user_id AS tag, recurrence, total, (SELECT count(DISTINCT event_id) FROM events x WHERE x.event_id > t.last) AS records_after, last AS last_intervention FROM t WHERE total > 0""",
}
