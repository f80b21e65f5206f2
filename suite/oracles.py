"""The registered queries as DuckDB SQL, written relationally from the definition of each operator.

Each entry is a chain of common table expressions and a final select.
"""

from __future__ import annotations

from sourceloom.functions import rules, text
from sourceloom.functions.vector import BUCKETS
from sourceloom.limits import BOUNDED, DEFAULTS, Limits
from sourceloom.operators import repos, retrieve, traces
from suite import fixed
from suite.queries import CAP, SMALL_WINDOWS


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{array(values)}[1 + ({index}) % {len(values)}]"


def lookup(values: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items())
    return f"CASE {key} {whens} END"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def strip(value: str) -> str:
    return f"regexp_replace({value}, {lit(f'^{text.SPACE}+|{text.SPACE}+$')}, '', 'g')"


def token_count(value: str) -> str:
    return f"len(regexp_extract_all({value}, {lit(text.TOKEN)}))"


def words(value: str) -> str:
    return f"regexp_extract_all(lower({value}), {lit(text.WORD)})"


def suffix(path: str) -> str:
    name = f"string_split({path}, '/')[-1]"
    return f"lower(regexp_extract({name}, '^(?s:.+)(\\.[^.]+)$', 1))"


def bucket(word: str) -> str:
    return f"(('0x' || substr(md5({word}), 6, 3))::INTEGER % {BUCKETS})"


def chunk_id(repo: str, path: str, line: str) -> str:
    return f"substr(sha256({repo} || ':' || {path} || ':' || {line}), 1, 16)"


NL = "chr(10)"
NAME = ("CASE WHEN doc_id % 29 = 0 THEN 'd' || doc_id || '/yarn.lock' "
        "WHEN doc_id % 31 = 0 THEN 'f' || doc_id || '.min.js' "
        f"ELSE 'f' || doc_id || {pick(fixed.SUFFIXES, 'doc_id')} END")
LANGUAGE = lookup(rules.LANGUAGES, suffix("path"))

FILES = f"""files AS (
  SELECT *, {LANGUAGE} AS language FROM (
    SELECT doc_id, source AS repo_id, {pick(fixed.DIRS, 'doc_id')} || '/' || lang || '/' || {NAME} AS path,
           strlen(text) AS size, text AS content FROM documents))"""

IN_SKIPPED_DIR = (f"len(list_filter(string_split(path, '/')[:-2], lambda p: p IN "
                  f"({', '.join(lit(d) for d in rules.SKIP_DIRS)}) OR starts_with(p, '.'))) > 0")


def skipped_name(globs: bool) -> str:
    name = "string_split(path, '/')[-1]"
    exact = f"{name} IN ({', '.join(lit(n) for n in rules.SKIP_NAMES + rules.SKIP_GLOBS)})"
    ends = [f"ends_with({name}, {lit(g.removeprefix('*'))})" for g in rules.SKIP_GLOBS] if globs else []
    return "(" + " OR ".join([exact, *ends]) + ")"


def eligible(cap: int | None = None, globs: bool = True, max_bytes: int | None = None) -> str:
    within = "" if cap is None else f" WHERE rn <= {cap}"
    size = "size >= 1" if max_bytes is None else f"size BETWEEN 1 AND {max_bytes}"
    return f"""eligible AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY string_split(path, '/')) AS rn
    FROM files
    WHERE {size} AND language IS NOT NULL
      AND NOT ({IN_SKIPPED_DIR}) AND NOT {skipped_name(globs)}
      AND regexp_matches(content, {lit(text.NON_SPACE)})
  ){within})"""


# Chunks --------------------------------------------------------------------------------------

def fallback(source: str, name: str, limits: Limits = DEFAULTS) -> str:
    """Whole file when small enough, else windows; windows start while an earlier one has not ended."""
    return f"""
{name}_lines AS (
  SELECT *, string_split(content, {NL}) AS ls, {token_count('content')} AS tok FROM {source}
  WHERE content <> ''),
{name}_cut AS (
  SELECT *, 0 AS i, len(ls) AS e, true AS whole FROM {name}_lines WHERE tok <= {limits.max_tokens}
  UNION ALL
  SELECT *, least(i + {limits.window}, len(ls)) AS e, false AS whole FROM (
    SELECT *, unnest(range(0, len(ls), {limits.stride})) AS i FROM {name}_lines
    WHERE tok > {limits.max_tokens})
  WHERE i = 0 OR i - {limits.stride} + {limits.window} < len(ls)),
{name} AS (
  SELECT {chunk_id('repo_id', 'path', '(i + 1)')} AS id, repo_id, path AS file_path, language,
         'module' AS node_type,
         string_split(path, '/')[-1] || CASE WHEN whole THEN '' ELSE ':L' || (i + 1) || '-L' || e END AS node_name,
         (i + 1)::INTEGER AS start_line, e::INTEGER AS end_line,
         array_to_string(ls[i + 1:e], {NL}) AS content, '' AS context_header,
         ({token_count(f'array_to_string(ls[i + 1:e], {NL})')})::INTEGER AS token_count
  FROM {name}_cut)"""


CHUNKS = FILES + "," + fallback("files", "chunks")


def _template_map() -> str:
    return "CASE language " + " ".join(
        f"WHEN {lit(k)} THEN {array(v)}" for k, v in fixed.TEMPLATES.items()) + " END"


CODE = f"""code AS (
  SELECT doc_id, repo_id, path, language, array_to_string(list_transform(string_split(text, {NL}),
    lambda t, i: replace(replace(tpl[1 + (i - 1) % len(tpl)], '{{n}}', i::VARCHAR), '{{t}}', t)), {NL}) AS content
  FROM (SELECT *, {_template_map()} AS tpl FROM (
    SELECT doc_id, source AS repo_id, text,
           'src/f' || doc_id || {pick(list(rules.LANGUAGES), 'doc_id')} AS path,
           {pick(list(rules.LANGUAGES.values()), 'doc_id')} AS language FROM documents)))"""


def _unit() -> str:
    """Unit type of a line by language, the first matching rule first."""
    cases = []
    for language, boundaries in rules.BOUNDARIES.items():
        whens = []
        for b in boundaries:
            hit = f"regexp_matches(line, {lit(b.pattern)})"
            if b.unless:
                hit += f" AND NOT regexp_matches(line, {lit(b.unless)})"
            whens.append(f"WHEN {hit} THEN {lit(b.type)}")
        whens.append(f"WHEN regexp_matches(line, {lit(rules.IMPORTS[language])}) THEN {lit(rules.IMPORT_TYPE)}")
        cases.append(f"WHEN {lit(language)} THEN CASE {' '.join(whens)} END")
    return f"CASE language {' '.join(cases)} END"


def _declared(line: str) -> str:
    """Declared name of a unit, from group 1 of its rule."""
    whens = [
        f"WHEN t.language = {lit(language)} AND t.unit = {lit(b.type)} "
        f"THEN regexp_extract({line}, {lit(b.pattern)}, 1)"
        for language, boundaries in rules.BOUNDARIES.items() for b in boundaries
        if b.type not in rules.UNNAMED_TYPES and "(" in b.pattern.replace("(?:", "")]
    return f"CASE {' '.join(whens)} END"


def _pairs(table: dict[str, list[str]]) -> str:
    return ", ".join(f"({lit(k)}, {lit(u)})" for k, v in table.items() for u in v)


def _matches(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN regexp_matches({column}, {lit(p)})" for k, p in table.items())
    return f"CASE language {whens} ELSE false END"


# Units: every opening line looks up its end among the later lines of its file.
UNITS = f"""
raw AS (
  SELECT doc_id, repo_id, path, language, unnest(string_split(content, {NL})) AS line,
         generate_subscripts(string_split(content, {NL}), 1) AS no FROM code),
opening AS (SELECT doc_id, no, {_unit()} AS unit FROM raw),
mark AS (
  SELECT r.*, o.unit, length(regexp_extract(line, '^[ \\t]*')) AS indent,
         regexp_matches(line, {lit(rules.CLOSER)}) AS closer,
         regexp_matches(line, {lit(rules.CONTINUATION)}) AS continued,
         regexp_matches(line, {lit(rules.DECORATOR)}) AS decorator,
         lag(no) OVER (PARTITION BY doc_id ORDER BY no) AS before
  FROM raw r LEFT JOIN opening o USING (doc_id, no)
  WHERE regexp_matches(line, {lit(text.NON_SPACE)})
    AND (o.unit IS NOT NULL OR NOT {_matches('line', rules.COMMENTS)})),
head AS (SELECT * FROM mark WHERE unit IS NOT NULL),
stop AS (
  SELECT h.doc_id, h.no AS head, min(m.no) AS at FROM head h JOIN mark m
    ON m.doc_id = h.doc_id AND m.no > h.no AND m.indent <= h.indent AND NOT m.continued
  GROUP BY ALL),
last AS (SELECT doc_id, max(no) AS no FROM mark GROUP BY doc_id),
breaker AS (
  SELECT h.doc_id, h.no AS head, max(m.no) AS at FROM head h JOIN mark m
    ON m.doc_id = h.doc_id AND m.no < h.no AND m.indent <= h.indent AND NOT m.continued
       AND NOT (m.decorator AND m.indent = h.indent)
  GROUP BY ALL),
deco AS (
  SELECT h.doc_id, h.no AS head, min(m.no) AS at
  FROM head h LEFT JOIN breaker b ON b.doc_id = h.doc_id AND b.head = h.no
  JOIN mark m ON m.doc_id = h.doc_id AND m.no < h.no AND m.no > coalesce(b.at, 0)
       AND m.decorator AND m.indent = h.indent
  GROUP BY ALL),
ended AS (
  SELECT h.doc_id, h.repo_id, h.path, h.language, h.unit, h.indent, h.no AS head, h.line AS head_line,
         d.at AS deco,
         CASE WHEN s.at IS NULL THEN l.no WHEN m.closer AND m.indent = h.indent THEN m.no
              ELSE m.before END AS end_line
  FROM head h JOIN last l ON l.doc_id = h.doc_id
  LEFT JOIN stop s ON s.doc_id = h.doc_id AND s.head = h.no
  LEFT JOIN mark m ON m.doc_id = s.doc_id AND m.no = s.at
  LEFT JOIN deco d ON d.doc_id = h.doc_id AND d.head = h.no),
unit AS (
  SELECT * EXCLUDE (deco), CASE WHEN (language, unit) IN ({_pairs(rules.DECORATED_PULL)})
         THEN coalesce(deco, head) ELSE head END AS start_line FROM ended
  UNION ALL
  SELECT doc_id, repo_id, path, language, {lit(rules.WRAPPED_TYPE)}, indent, deco, NULL, end_line, deco
  FROM ended
  WHERE deco IS NOT NULL AND (language, unit) IN ({_pairs(rules.DECORATED_WRAP)})),
line_token AS (SELECT doc_id, no, line, {token_count('line')} AS n FROM raw),
block AS (
  SELECT u.*, (SELECT sum(t.n) FROM line_token t WHERE t.doc_id = u.doc_id
                 AND t.no BETWEEN u.start_line AND u.end_line)::INTEGER AS token_count,
         (SELECT count(*) FROM unit p WHERE p.doc_id = u.doc_id AND p.unit <> {lit(rules.IMPORT_TYPE)}
            AND p.start_line <= u.start_line AND p.end_line >= u.end_line
            AND (p.start_line, p.end_line) <> (u.start_line, u.end_line)) AS depth
  FROM unit u)"""

IS_BOUNDARY = f"unit <> {lit(rules.IMPORT_TYPE)}"
IN_RANGE = f"token_count BETWEEN {DEFAULTS.min_tokens} AND {DEFAULTS.max_tokens}"


def _docstring(quote: str) -> str:
    return (f"WHEN starts_with(rest, {lit(quote)}) AND len(string_split(rest, {lit(quote)})) >= 3 "
            f"THEN {lit(quote)} || string_split(rest, {lit(quote)})[2] || {lit(quote)}")


HEADERS = f"""
first AS (
  SELECT doc_id, min(no) AS no FROM raw
  WHERE language = 'python' AND regexp_matches(line, {lit(text.NON_SPACE)})
    AND NOT regexp_matches(line, {lit(rules.COMMENTS['python'])}) GROUP BY doc_id),
doc AS (
  SELECT doc_id, 0 AS no, CASE {_docstring('"""')} {_docstring("'''")} END AS piece FROM (
    SELECT doc_id, string_agg(line, {NL} ORDER BY r.no) AS rest FROM raw r JOIN first f USING (doc_id)
    WHERE r.no >= f.no GROUP BY doc_id)),
piece AS (
  SELECT * FROM doc WHERE piece IS NOT NULL
  UNION ALL
  SELECT u.doc_id, u.start_line, string_agg(r.line, {NL} ORDER BY r.no)
  FROM unit u JOIN raw r ON r.doc_id = u.doc_id AND r.no BETWEEN u.start_line AND u.end_line
  WHERE u.indent = 0 AND (u.unit = {lit(rules.IMPORT_TYPE)} OR (u.language = 'rust' AND u.unit = 'use_declaration'))
  GROUP BY u.doc_id, u.start_line),
budget AS (
  SELECT *, coalesce(sum({token_count('piece')}) OVER (PARTITION BY doc_id ORDER BY no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM piece),
header AS (
  SELECT c.doc_id, c.repo_id, c.path, c.language, coalesce(b.header, '') AS context_header
  FROM code c LEFT JOIN (SELECT doc_id, string_agg(piece, {NL} ORDER BY no) AS header FROM budget
                         WHERE before <= {DEFAULTS.header_tokens} GROUP BY doc_id) b USING (doc_id))"""


def _classify(value: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({value}, {lit(n)})' for n in needles)} THEN {lit(name)}"
        for needles, name in rules.NODE_TYPES)
    return f"CASE {whens} ELSE 'other' END"


FIRST_LINE = strip(f"substr(string_split(content, {NL})[1], 1, 60)")
CODE_CHUNKS = f"""
kept AS (
  SELECT n.* FROM block n WHERE {IS_BOUNDARY} AND {IN_RANGE} AND NOT EXISTS (
    SELECT 1 FROM block p WHERE p.doc_id = n.doc_id AND p.{IS_BOUNDARY.replace("depth", "p.depth")} AND p.{IN_RANGE}
      AND p.start_line <= n.start_line AND p.end_line >= n.end_line
      AND (p.start_line, p.end_line) <> (n.start_line, n.end_line))),
text_of AS (
  SELECT k.*, ltrim(c.body, ' ' || chr(9)) AS content FROM kept k JOIN (
    SELECT k.doc_id, k.start_line, string_agg(r.line, {NL} ORDER BY r.no) AS body
    FROM kept k JOIN raw r ON r.doc_id = k.doc_id AND r.no BETWEEN k.start_line AND k.end_line
    GROUP BY k.doc_id, k.start_line) c USING (doc_id, start_line)),
unit_chunk AS (
  SELECT {chunk_id('t.repo_id', 't.path', 't.start_line')} AS id, t.repo_id, t.path AS file_path,
         t.language, {_classify('t.unit')} AS node_type,
         coalesce(nullif({_declared('t.head_line')}, ''), {FIRST_LINE}) AS node_name,
         t.start_line::INTEGER AS start_line, t.end_line::INTEGER AS end_line, t.content,
         h.context_header, t.token_count
  FROM text_of t JOIN header h USING (doc_id)),
uncut AS (SELECT * FROM code WHERE doc_id NOT IN (SELECT doc_id FROM kept)),""" + fallback(
    "uncut", "rest").lstrip() + """,
chunks AS (SELECT * FROM unit_chunk UNION ALL SELECT * FROM rest)"""
ALL_CODE = (CODE, UNITS, HEADERS, CODE_CHUNKS)
COLUMNS = ("id, repo_id, file_path, language, node_type, node_name, start_line, end_line, content, "
           "context_header, token_count")
EMBEDDING_TEXT = (f"CASE WHEN context_header <> '' THEN context_header || {NL} || {NL} ELSE '' END || '# ' || "
                  f"node_type || ': ' || node_name || {NL} || {NL} || content")

# Search --------------------------------------------------------------------------------------

FEATURES = f"""
feature AS (
  SELECT id, repo_id, {bucket('w')} AS bucket, count(*) AS tf FROM (
    SELECT id, repo_id, unnest({words(EMBEDDING_TEXT)}) AS w FROM chunks) GROUP BY ALL),
norm AS (SELECT id, sum(tf * tf) AS n2 FROM feature GROUP BY id)"""

QUESTIONS = """question AS (
  SELECT item_id AS question_id, 'src' || (item_id % 20) AS repo_id, text AS question,
         (item_id % 20 + 1)::INTEGER AS top_k FROM benchmark)"""
GATE_QUESTIONS = """question AS (
  SELECT item_id AS question_id, 'src' || (item_id % 30) AS repo_id, text AS question,
         coalesce(CASE WHEN item_id % 7 <> 0 THEN item_id % 23 END, 8)::INTEGER AS top_k FROM benchmark)"""

HITS = f"""
question_feature AS (
  SELECT question_id, {bucket('w')} AS bucket, count(*) AS tf FROM (
    SELECT question_id, unnest({words('question')}) AS w FROM question) GROUP BY ALL),
question_norm AS (SELECT question_id, sum(tf * tf) AS n2 FROM question_feature GROUP BY question_id),
dot AS (
  SELECT question_id, f.repo_id, f.id, sum(q.tf * f.tf) AS dot
  FROM question_feature q JOIN question USING (question_id)
  JOIN feature f ON f.bucket = q.bucket AND f.repo_id = question.repo_id GROUP BY ALL),
scored AS (
  SELECT question_id, d.repo_id, d.id, d.dot::DOUBLE / sqrt((n.n2 * m.n2)::DOUBLE) AS score
  FROM dot d JOIN norm n USING (id) JOIN question_norm m USING (question_id)),
hit AS (
  SELECT s.*, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INTEGER
                         AS rank FROM scored) s JOIN question USING (question_id)
  WHERE rank <= least(top_k * 2, {DEFAULTS.max_top_k}))"""

FOLDED_HITS = f"""
folded AS (
  SELECT id, repo_id, list(coalesce(v, 0) ORDER BY d)::DOUBLE[] AS v FROM (SELECT DISTINCT id, repo_id FROM feature), range(64) a(d)
  LEFT JOIN (SELECT id AS fid, bucket % 64 AS fd, sum(CASE WHEN bucket // 64 % 2 = 1 THEN tf ELSE -tf END) AS v
             FROM feature GROUP BY ALL) ON fid = id AND fd = d GROUP BY ALL),
question_folded AS (
  SELECT question_id, list(coalesce(v, 0) ORDER BY d)::DOUBLE[] AS v FROM question, range(64) a(d)
  LEFT JOIN (SELECT question_id AS fid, bucket % 64 AS fd, sum(CASE WHEN bucket // 64 % 2 = 1 THEN tf ELSE -tf END) AS v
             FROM (SELECT question_id, {bucket('w')} AS bucket, count(*) AS tf FROM (
               SELECT question_id, unnest({words('question')}) AS w FROM question) GROUP BY ALL) GROUP BY ALL)
    ON fid = question_id AND fd = d GROUP BY question_id),
scored AS (
  SELECT question_id, f.repo_id, f.id, list_dot_product(q.v, f.v) AS dot,
         list_dot_product(q.v, q.v) * list_dot_product(f.v, f.v) AS product, top_k
  FROM question_folded q JOIN question USING (question_id) JOIN folded f ON f.repo_id = question.repo_id),
hit AS (
  SELECT * FROM (
    SELECT question_id, repo_id, id, round(dot / sqrt(product), 4) AS score, top_k,
           row_number() OVER (PARTITION BY question_id ORDER BY round(dot / sqrt(product), 4) DESC, id)::INTEGER AS rank
    FROM scored WHERE product > 0) WHERE rank <= least(top_k * 2, {DEFAULTS.max_top_k}))"""

FOLD = """list_reduce(list_transform(hs, lambda x: [x]), lambda k, r: CASE WHEN len(list_filter(k,
    lambda y: y.file_path = r[1].file_path AND NOT (r[1].end_line < y.start_line OR r[1].start_line > y.end_line))) > 0
    THEN k ELSE list_concat(k, r) END)"""
DEDUP = f"""
listed AS (
  SELECT question_id, list({{'repo_id': h.repo_id, 'id': h.id, 'score': h.score, 'file_path': c.file_path,
      'start_line': c.start_line, 'end_line': c.end_line}} ORDER BY h.rank) AS hs
  FROM hit h JOIN chunks c ON c.repo_id = h.repo_id AND c.id = h.id GROUP BY question_id),
disjoint AS (
  SELECT question_id, unnest(kept) AS h, generate_subscripts(kept, 1)::INTEGER AS rank
  FROM (SELECT question_id, {FOLD} AS kept FROM listed))"""
SOURCES = f"""
sources AS (
  SELECT d.question_id, d.h.repo_id AS repo_id, d.rank, d.h.id AS id, c.file_path, c.node_type, c.node_name,
         c.start_line, c.end_line, coalesce(c.language, 'unknown') AS language,
         c.content, d.h.score AS score
  FROM disjoint d JOIN chunks c ON c.repo_id = d.h.repo_id AND c.id = d.h.id JOIN question USING (question_id)
  WHERE d.rank <= top_k)"""


def repo_events(cte: str, folded: int | None) -> str:
    repo = "user_id::VARCHAR" if folded is None else f"'src' || (user_id % {folded})"
    return f"""{cte} AS (
  SELECT repo_id, seq, ts, status,
         CASE WHEN event_type = 'click' THEN 'https://github.com/org/' || repo_id END AS url,
         CASE WHEN event_type = 'click' THEN 'b' || (k % 3) END AS branch,
         CASE WHEN event_type = 'signup' THEN k END AS file_count,
         CASE WHEN event_type = 'purchase' THEN k * 3 END AS chunk_count,
         CASE WHEN event_type = 'error' THEN 'error ' || k END AS error
  FROM (SELECT *, {repo} AS repo_id, event_id AS seq, {lookup(fixed.STATUS_OF, 'event_type')} AS status,
               json_extract_string(props, '$.k')::INTEGER AS k FROM events))"""


def latest(cte: str, events: str) -> str:
    columns = ", ".join(
        f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ("url", "branch", "status", "file_count", "chunk_count", "error"))
    return f"""{cte} AS (
  SELECT repo_id, {columns}, min(ts) AS created_at, arg_max(ts, seq) AS updated_at
  FROM {events} GROUP BY repo_id)"""


REPOS = (repo_events("event", None), latest("repo", "event"))
FOLDED_REPOS = (repo_events("event", 25), latest("repo", "event"))

CENTROIDS = """
vector AS (SELECT vec_id AS id, 'set' || (vec_id % 4) AS repo_id, embedding::DOUBLE[] AS v, label FROM embeddings),
coordinate AS (SELECT repo_id, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vector),
centroid AS (
  SELECT repo_id || '/' || label AS question_id, repo_id, label, list(x ORDER BY d) AS c FROM (
    SELECT repo_id, label, d, avg(x) AS x FROM coordinate GROUP BY ALL) GROUP BY repo_id, label)"""
DENSE_SCORE = ("round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 4)")
DENSE = f"""
hit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
      SELECT question_id, q.repo_id, q.label AS wanted, v.label, v.id, {DENSE_SCORE} AS score
      FROM centroid q JOIN vector v ON v.repo_id = q.repo_id))
  WHERE rank <= 20)"""
LSH = f"""
plane AS (
  SELECT p, list(s ORDER BY d) AS s FROM (
    SELECT p, d, CASE WHEN ('0x' || right(md5(p || ':' || d), 1))::INTEGER % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS s
    FROM range(24) a(p), range(64) b(d)) GROUP BY p),
hashed AS (
  SELECT kind, key, p // 3 AS t, sum(CASE WHEN list_dot_product(v, s) >= 0 THEN 1 << (p % 3) ELSE 0 END) AS b
  FROM (SELECT 'v' AS kind, id::VARCHAR AS key, v FROM vector
        UNION ALL SELECT 'q', question_id, c FROM centroid), plane GROUP BY ALL),
pair AS (
  SELECT DISTINCT q.key AS question_id, v.key::BIGINT AS id FROM hashed q JOIN hashed v USING (t, b)
  WHERE q.kind = 'q' AND v.kind = 'v'),
hit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
      SELECT question_id, q.repo_id, v.id, {DENSE_SCORE} AS score
      FROM pair JOIN centroid q USING (question_id) JOIN vector v USING (id) WHERE v.repo_id = q.repo_id))
  WHERE rank <= 20)"""

TURNS = """turn_pair AS (
  SELECT q.conv_id * 1000 + q.turn AS question_id, q.conv_id, q.turn, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

SCORES = """score AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, quality,
         CASE WHEN quality = 1 THEN toxic END AS toxic,
         CASE WHEN doc_id % 2 = 0 THEN n_chars END AS length
  FROM documents JOIN labels USING (doc_id))"""

SCORE_ROWS = """score_row AS (
  SELECT 't' || doc_id AS trace_id, name, value, 'RAGAS ' || name AS comment FROM (
    SELECT doc_id, 'quality' AS name, quality::DOUBLE AS value FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels))"""

HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"
ADDRESSES = f"""address AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN base WHEN 1 THEN base || '/' WHEN 2 THEN base || '.git'
         WHEN 3 THEN ' ' || chr(9) || base || '.git//' || {NL} WHEN 4 THEN base || '/tree/main'
         WHEN 5 THEN replace(base, 'https', 'http') ELSE url END AS url
  FROM (SELECT page_id, url, 'https://github.com/' || {HOST} || '/p' || page_id AS base FROM pages))"""
MESSAGES = """message AS (
  SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '{' || repo || ', "github_url": ""}'
         WHEN page_id % 11 = 1 THEN '{' || address || '}'
         WHEN page_id % 11 = 2 THEN 'not json ' || number
         WHEN page_id % 11 = 3 THEN '{' || repo || ', "branch": null, ' || address || '}'
         WHEN page_id % 11 < 7 THEN '{' || repo || ', ' || address || '}'
         ELSE '{' || repo || ', "branch": "dev", ' || address || '}' END AS value
  FROM (SELECT page_id, page_id // 2 AS number, '"repo_id": "r' || number || '"' AS repo,
               '"github_url": "https://github.com/' || regexp_extract(url, 'example\\.([a-z]+)', 1) || '/p'
               || number || '"' AS address FROM pages)),
decoded AS (
  SELECT *, nullif(json_extract_string(j, '$.repo_id'), '') AS repo_id,
         nullif(json_extract_string(j, '$.github_url'), '') AS github_url,
         coalesce(json_extract_string(j, '$.branch'), 'main') AS branch
  FROM (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM message))"""


def chunked(cap_limits: Limits) -> tuple[str, ...]:
    """Chunks of eligible prose files (boundaries included)."""
    # Documents are prose: no line opens a unit, so the fallback decides. The check that this holds
    # is the comparison itself.
    return (FILES, eligible(cap_limits.max_files), fallback("eligible", "chunks", cap_limits))


SUMMARY = """
counted AS (
  SELECT repo_id, count(*) AS chunk_count, count(*) FILTER (WHERE NOT contains(content, '@')) AS stored
  FROM chunks GROUP BY repo_id),
filed AS (SELECT repo_id, count(*) AS file_count FROM eligible GROUP BY repo_id),
summary AS (
  SELECT r.repo_id, r.url AS github_url, r.branch, coalesce(f.file_count, 0) AS file_count,
         coalesce(c.chunk_count, 0) AS chunk_count, coalesce(c.stored, 0) AS vectors_upserted
  FROM repo r LEFT JOIN filed f USING (repo_id) LEFT JOIN counted c USING (repo_id))"""
STATUS = (f"CASE WHEN file_count = 0 THEN 'failed' ELSE 'ready' END AS status, "
          f"CASE WHEN file_count = 0 THEN {lit(repos.NO_FILES)} END AS error")


def sql() -> dict[str, str]:
    """SQL per registered query."""
    cleaned = f"regexp_replace(rtrim({strip('url')}, '/'), '\\.git$', '')"
    hits = (CHUNKS, QUESTIONS, FEATURES, HITS)
    small = (FILES + "," + fallback("files", "chunks", SMALL_WINDOWS), QUESTIONS, FEATURES, HITS)
    prompt_context = f"""coalesce(string_agg('## [' || rank || '] ' || file_path || ':L' || start_line || '-L' || end_line
      || ' (' || language || ' ' || node_type || ': ' || node_name || ')' || {NL} || '```' || language || {NL}
      || content || {NL} || '```', {NL} || {NL} ORDER BY rank), {lit(retrieve.NO_CONTEXT)})"""
    two = f"{NL} || {NL}"
    return {
        "detect_language": with_(FILES, select="SELECT doc_id, path, language FROM files"),
        "skip_dirs": with_(FILES, select=f"SELECT doc_id, path FROM files WHERE NOT ({IN_SKIPPED_DIR})"),
        "skip_files": with_(FILES, select=f"SELECT doc_id, path FROM files WHERE NOT {skipped_name(True)}"),
        "eligible_files": with_(FILES, eligible(), select="""
            SELECT repo_id, path, size, language, length(content)::INTEGER AS n_chars FROM eligible"""),
        "eligible_files_capped": with_(FILES, eligible(CAP, False, BOUNDED.max_bytes), select=(
            "SELECT repo_id, path, language FROM eligible")),
        "file_outcomes": with_(FILES, f"""judged AS (
            SELECT repo_id, path, CASE WHEN size < 1 THEN 'empty' WHEN size > {BOUNDED.max_bytes} THEN 'too_large'
                WHEN language IS NULL THEN 'no_language' WHEN {skipped_name(True)} THEN 'skipped_name'
                WHEN {IN_SKIPPED_DIR} THEN 'skipped_dir' WHEN size BETWEEN 100 AND 127 THEN 'unreadable'
                WHEN NOT regexp_matches(content, {lit(text.NON_SPACE)}) THEN 'blank' ELSE 'eligible' END AS outcome
            FROM files)""", select=f"""
            SELECT repo_id, path, CASE WHEN outcome = 'eligible' AND row_number() OVER (
                PARTITION BY repo_id, outcome ORDER BY string_split(path, '/')) > {CAP} THEN 'over_cap' ELSE outcome END
                AS outcome FROM judged"""),
        "chunk_outcomes": with_(*ALL_CODE, select="""
            SELECT c.repo_id, c.path, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE coalesce(n, 0) END::INTEGER AS chunk_count,
                   CASE WHEN doc_id % 11 = 0 THEN 'no content' END AS error
            FROM code c LEFT JOIN (SELECT repo_id, file_path AS path, count(*) AS n FROM chunks GROUP BY ALL)
              USING (repo_id, path)"""),
        "language_counts": with_(FILES, eligible(), select="""
            SELECT language, count(*) AS file_count FROM eligible GROUP BY language ORDER BY 2 DESC"""),
        "token_counts": f"SELECT doc_id, ({token_count('text')})::INTEGER AS token_count FROM documents",
        "chunk_ids": with_(FILES, select=(
            f"SELECT doc_id, {chunk_id('repo_id', 'path', '(size % 97 + 1)')} AS id FROM files")),
        "classify_nodes": with_(CODE, UNITS, select=f"""
            SELECT repo_id, path, start_line::INTEGER AS start_line, unit AS boundary_type,
                   {_classify('unit')} AS node_type FROM block WHERE {IS_BOUNDARY}"""),
        "line_windows": with_(FILES, fallback("files", "chunks", SMALL_WINDOWS),
                              select=f"SELECT {COLUMNS} FROM chunks"),
        "fallback_chunks": with_(CHUNKS, select=f"SELECT {COLUMNS} FROM chunks"),
        "code_blocks": with_(CODE, UNITS, select=f"""
            SELECT repo_id, path, language, unit AS boundary_type, indent::INTEGER AS indent,
                   start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, token_count
            FROM block WHERE {IS_BOUNDARY}"""),
        "context_headers": with_(CODE, UNITS, HEADERS, select=(
            "SELECT repo_id, path, language, context_header FROM header")),
        "code_chunks": with_(*ALL_CODE, select=f"SELECT {COLUMNS} FROM chunks"),
        "embedding_text": with_(*ALL_CODE, select=f"""
            SELECT id, {EMBEDDING_TEXT} AS embedding_text,
                   file_path || ':L' || start_line || '-L' || end_line AS location FROM chunks"""),
        "vector_metadata": with_(CHUNKS, select=f"""
            SELECT id, repo_id, file_path, language, node_type, node_name, start_line, end_line, token_count,
                   substr(content, 1, {BOUNDED.metadata_chars}) AS content FROM chunks"""),
        "chunk_sample": with_(*ALL_CODE, select="""
            SELECT node_type, node_name, file_path, start_line, end_line, token_count FROM chunks
            ORDER BY repo_id, string_split(file_path, '/'), chunks.start_line, id LIMIT 5"""),
        "sparse_features": with_(CHUNKS, FEATURES, select="SELECT id, repo_id, bucket, tf FROM feature"),
        "index_stats": with_(CHUNKS, select="""
            SELECT repo_id, count(*) AS vector_count, sum(token_count)::BIGINT AS token_count
            FROM chunks GROUP BY ROLLUP (repo_id)"""),
        "search_sparse": with_(*hits, select="SELECT question_id, repo_id, rank, score, id FROM hit"),
        "search_dense": with_(CENTROIDS, DENSE, select="SELECT question_id, repo_id, rank, score, id FROM hit"),
        "search_lsh": with_(CENTROIDS, LSH, select="SELECT question_id, repo_id, rank, score, id FROM hit"),
        "overlap_dedup": with_(*small, DEDUP, select="""
            SELECT question_id, rank, h.id AS id, h.score AS score, h.file_path AS file_path,
                   h.start_line AS start_line, h.end_line AS end_line FROM disjoint"""),
        "rag_dense": with_(CHUNKS, QUESTIONS, FEATURES, FOLDED_HITS, DEDUP, SOURCES, select="SELECT * FROM sources"),
        "rag_sources": with_(*hits, DEDUP, SOURCES, select="SELECT * FROM sources"),
        "prompts": with_(*hits, DEDUP, SOURCES, *FOLDED_REPOS, f"""context AS (
            SELECT question_id, count(*) AS n, {prompt_context} AS block FROM sources GROUP BY question_id)""",
            select=f"""
            SELECT q.question_id, q.repo_id, coalesce(c.n, 0)::INTEGER AS source_count,
                   {lit(retrieve.SYSTEM_PROMPT)} AS system,
                   'Repository: ' || coalesce(string_split(r.url, 'github.com/')[-1], q.repo_id) || {two}
                   || '## Retrieved Code Context' || {two} || coalesce(c.block, {lit(retrieve.NO_CONTEXT)}) || {two}
                   || '## Question' || {two} || q.question || {two} || {lit(retrieve.CLOSING)} AS message
            FROM question q LEFT JOIN context c USING (question_id) LEFT JOIN repo r ON r.repo_id = q.repo_id"""),
        "query_gate": with_(CHUNKS, GATE_QUESTIONS, FEATURES, HITS, *FOLDED_REPOS, select="""
            SELECT question_id, q.repo_id, q.top_k, r.status, coalesce(n, 0) AS hit_count,
                   CASE WHEN q.top_k NOT BETWEEN 1 AND 20 THEN 'invalid' WHEN r.status IS NULL THEN 'not_found'
                        WHEN r.status <> 'ready' THEN 'not_ready' WHEN coalesce(n, 0) = 0 THEN 'no_results'
                        ELSE 'ok' END AS outcome
            FROM question q LEFT JOIN repo r ON r.repo_id = q.repo_id
            LEFT JOIN (SELECT question_id, count(*) AS n FROM hit GROUP BY question_id) USING (question_id)"""),
        "repo_urls": with_(ADDRESSES, select=f"""
            SELECT page_id, clean_url, string_split(clean_url, 'github.com/')[-1] AS repo_name,
                   CASE WHEN regexp_matches(clean_url, {lit(rules.REPO_URL)}) THEN 'accepted' ELSE 'invalid' END AS outcome
            FROM (SELECT page_id, {cleaned} AS clean_url FROM address)"""),
        "job_payloads": with_(MESSAGES, select="""
            SELECT DISTINCT repo_id, github_url, branch FROM decoded
            WHERE repo_id IS NOT NULL AND github_url IS NOT NULL"""),
        "dead_letters": with_(MESSAGES, select="""
            SELECT page_id, value FROM decoded WHERE repo_id IS NULL OR github_url IS NULL"""),
        "repo_latest": with_(*REPOS, select="SELECT * FROM repo"),
        "job_durations": with_(repo_events("event", None), select="""
            SELECT repo_id, started_at, ended_at, CASE WHEN ended_at >= started_at
                THEN (epoch_ms(ended_at) - epoch_ms(started_at)) / 1000.0::DOUBLE END AS duration_seconds
            FROM (SELECT repo_id, min(ts) FILTER (status = 'cloning') AS started_at,
                         max(ts) FILTER (status IN ('ready', 'failed')) AS ended_at FROM event GROUP BY repo_id)"""),
        "repo_list": with_(*REPOS, select=f"""
            SELECT repo_id, status, created_at, least(total, {DEFAULTS.list_limit}) AS returned, total
            FROM (SELECT *, count(*) OVER () AS total FROM repo)
            ORDER BY created_at DESC, repo_id LIMIT {DEFAULTS.list_limit}"""),
        "upsert_chunks": with_(FILES, """
            again AS (SELECT doc_id, repo_id, path, size, content || ' revised' AS content, language FROM files
                      WHERE doc_id IN (SELECT doc_id FROM labels)),
            twice AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
            fallback("files", "c0"), fallback("again", "c1"), fallback("twice", "c2"), select="""
            SELECT id, repo_id, file_path, content, seq FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (
                SELECT *, 0::BIGINT AS seq FROM c0 UNION ALL SELECT *, 1 FROM c1 UNION ALL SELECT *, 2 FROM c2))
            WHERE rn = 1"""),
        "delete_repo": with_(CHUNKS, *FOLDED_REPOS, select="""
            SELECT id, repo_id, file_path FROM chunks
            WHERE repo_id NOT IN (SELECT repo_id FROM repo WHERE status = 'failed')"""),
        "upsert_batches": with_(*chunked(SMALL_WINDOWS), f"""placed AS (
            SELECT repo_id, NOT contains(content, '@') AS ok, (row_number() OVER (PARTITION BY repo_id
              ORDER BY string_split(file_path, '/'), start_line) - 1) // {DEFAULTS.upsert_batch} AS batch
            FROM chunks)""", select="""
            SELECT repo_id, batch, count(*) AS row_count, bool_and(ok) AS ok,
                   CASE WHEN bool_and(ok) THEN count(*) ELSE 0 END AS upserted FROM placed GROUP BY ALL"""),
        "ingest_summary": with_(*chunked(DEFAULTS), *FOLDED_REPOS, SUMMARY,
                                select=f"SELECT *, {STATUS} FROM summary"),
        "ingest_traces": with_(*chunked(DEFAULTS), *FOLDED_REPOS, SUMMARY, select=f"""
            SELECT {lit(traces.INGEST_TRACE)} AS name, * EXCLUDE (branch), 'ingestion,' || status AS tags FROM (
              SELECT *, round_even(chunk_count * 0.125::DOUBLE, 2) AS duration_seconds, {STATUS} FROM summary)"""),
        "query_traces": with_(TURNS, select=f"""
            SELECT 't' || question_id AS trace_id, {lit(traces.QUERY_TRACE)} AS name, 'src' || (conv_id % 20) AS repo_id,
                   model, split_part(model, '/', 1) AS provider, (question_id % 20 + 1)::INTEGER AS top_k,
                   length(answer) AS latency_ms, len(string_split(answer, {NL}))::INTEGER AS chunks_retrieved,
                   'Q: ' || question || {NL} || 'Context: ' || substr(array_to_string(list_transform(
                     string_split(answer, {NL})[1:{traces.CONTEXT_CHUNKS}], lambda c: substr(c, 1, {traces.CONTENT_CUT})),
                     {two}), 1, {traces.CONTEXT_CUT}) || '...' AS generation_input,
                   CASE WHEN question_id % 3 <> 0 THEN qt ELSE 0 END AS input, ct AS output, qt + ct AS total,
                   'query,' || split_part(model, '/', 1) AS tags
            FROM (SELECT *, {token_count('question')} AS qt, {token_count('answer')} AS ct,
                         CASE WHEN question_id % 2 = 0 THEN 'alpha/small' ELSE 'beta/large' END AS model
                  FROM turn_pair)"""),
        "usage_by_model": f"""
            SELECT model, count(*) AS requests, sum(k)::BIGINT AS prompt_tokens, sum(o)::BIGINT AS completion_tokens,
                   sum(k + o)::BIGINT AS total_tokens, sum(ms)::DOUBLE / count(*) AS avg_latency_ms,
                   quantile_cont(ms, 0.5)::DOUBLE AS median_latency_ms, split_part(model, '/', 1) AS provider
            FROM (SELECT {lookup(fixed.MODEL_OF, 'event_type')} AS model, floor(value * 10)::BIGINT AS ms,
                         json_extract_string(props, '$.k')::BIGINT AS k, event_id % 97 AS o FROM events)
            GROUP BY model""",
        "score_rows": with_(SCORE_ROWS, select="SELECT * FROM score_row"),
        "trace_scores": with_(TURNS, SCORE_ROWS, select="""
            SELECT 't' || question_id AS trace_id, conv_id, turn, name, value, comment
            FROM turn_pair JOIN score_row ON score_row.trace_id = 't' || conv_id"""),
        "context_precision": with_(CENTROIDS, DENSE, """running AS (
            SELECT question_id, rank, v, sum(v) OVER (PARTITION BY question_id ORDER BY rank) AS so_far
            FROM (SELECT question_id, rank, (label = wanted)::INTEGER AS v FROM hit))""", select="""
            SELECT question_id, CASE WHEN sum(v) > 0 THEN sum(v * so_far / rank::DOUBLE) / sum(v) ELSE 0.0 END::DOUBLE
                   AS context_precision FROM running GROUP BY question_id"""),
        "context_recall": """
            SELECT source AS question_id, avg((quality = 1)::INTEGER) AS context_recall
            FROM documents JOIN labels USING (doc_id) GROUP BY source""",
        "faithfulness": with_(TURNS, f"""claim AS (
            SELECT question_id, claim, known FROM (
              SELECT question_id, unnest(string_split_regex(answer, '[.!?\\n]+')) AS claim, {words('question')} AS known
              FROM turn_pair) WHERE len({words('claim')}) > 0)""", select=f"""
            SELECT question_id, avg((len(list_filter({words('claim')}, lambda w: NOT list_contains(known, w))) = 0)::INTEGER)
                   AS faithfulness FROM claim GROUP BY question_id"""),
        "answer_relevancy": with_(TURNS, f"""probe AS (
            SELECT t.question_id, t.question, c.text AS probe FROM turn_pair t JOIN conversations c
              ON c.conv_id = t.conv_id AND c.turn = t.turn + 2 WHERE c.role = 'user')""", f"""
            side AS (SELECT question_id, 'q' AS side, unnest({words('question')}) AS w FROM probe
                     UNION ALL SELECT question_id, 'p', unnest({words('probe')}) FROM probe)""", f"""
            feature AS (SELECT question_id, side, {bucket('w')} AS b, count(*) AS tf FROM side GROUP BY ALL)""", """
            norm AS (SELECT question_id, sum(tf * tf) FILTER (WHERE side = 'q') AS q,
                            sum(tf * tf) FILTER (WHERE side = 'p') AS p FROM feature GROUP BY question_id)""", """
            dot AS (SELECT a.question_id, sum(a.tf * b.tf) AS dot FROM feature a JOIN feature b
                      ON b.question_id = a.question_id AND b.b = a.b AND a.side = 'q' AND b.side = 'p' GROUP BY ALL)""",
            select="""
            SELECT question_id, CASE WHEN q > 0 AND p > 0 THEN coalesce(dot, 0)::DOUBLE / sqrt((q * p)::DOUBLE) ELSE 0.0 END
                   AS answer_relevancy
            FROM probe LEFT JOIN norm USING (question_id) LEFT JOIN dot USING (question_id)"""),
        "eval_means": with_(SCORES, select="""
            SELECT provider, avg(quality) AS quality, avg(toxic) AS toxic, avg(length) AS length
            FROM score GROUP BY provider"""),
        "provider_compare": with_(SCORES, """means AS (
            SELECT metric, coalesce(avg(value) FILTER (WHERE provider = 'alpha'), 0.0)::DOUBLE AS first_mean,
                   coalesce(avg(value) FILTER (WHERE provider = 'beta'), 0.0)::DOUBLE AS second_mean FROM (
              SELECT provider, 'quality' AS metric, quality::DOUBLE AS value FROM score
              UNION ALL SELECT provider, 'toxic', toxic FROM score UNION ALL SELECT provider, 'length', length FROM score)
            GROUP BY metric)""", select="""
            SELECT *, second_mean - first_mean AS difference FROM means ORDER BY metric"""),
        "eval_join": """
            SELECT d.doc_id AS question_id, d.text AS question, CASE WHEN l.doc_id IS NULL THEN 'ERROR'
                   ELSE 'quality ' || l.quality END AS answer,
                   CASE WHEN l.doc_id IS NULL THEN '' ELSE 'a,' || l.toxic END AS contexts,
                   CASE WHEN l.doc_id IS NULL THEN 'alpha/error' ELSE 'alpha/small' END AS model, d.lang AS ground_truth
            FROM documents d LEFT JOIN labels l USING (doc_id)""",
    }
