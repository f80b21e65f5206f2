"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from sourceloom.llm.quality_rules import RULES, STOP_WORDS

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _without(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


def _quality() -> str:
    checks = ["NOT base_failed"]
    for rule in RULES:
        if rule.low is not None:
            checks.append(f"1000 * {rule.part} >= {rule.low} * {rule.whole}")
        if rule.high is not None:
            checks.append(f"1000 * {rule.part} <= {rule.high} * {rule.whole}")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n
      FROM g),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, {_without("t", SPACE)} AS word_chars,
        length(t) - {_without("t", r"[#*$%&|<>]")} AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        length(t) - {_without("t", "[A-Z]")} AS n_upper, length(t) - {_without("t", "[A-Za-z]")} AS n_letters,
        len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words
      FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  {" AND ".join(checks)} AS kept FROM b"""


def _manifest() -> str:
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
                 ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return f"sha256({' || '.join(parts)})"

    def climbed(nodes: str, at: str) -> tuple[str, str]:
        """Siblings before and after place ``at`` (from 0) in a list of nodes."""
        first = f"({at} // 3 * 3)"
        return (f"array_to_string({nodes}[{first} + 1:{at}], '')", f"array_to_string({nodes}[{at} + 2:{first} + 3], '')")

    up = "list_transform(range(0, len(nodes), 3), lambda j: sha256(array_to_string(nodes[j + 1:j + 3], '')))"
    low, high = climbed("t.nodes", "c.place"), climbed("u.nodes", "c.place")
    # The checksum of zlib, bit by bit: DuckDB has none of its own.
    crc = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT)))"""
    return f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS k, doc_id, {leaf("text")} AS leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    CASE WHEN xor({crc}, 4294967295::UBIGINT) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS found
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t(s, level, nodes) AS (SELECT s, 0, list(leaf ORDER BY i) FROM n GROUP BY s
  UNION ALL SELECT s, level + 1, {up} FROM t WHERE len(nodes) > 1),
r AS (SELECT s, level AS height, nodes[1] AS subroot FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (SELECT 0, list(subroot ORDER BY s) FROM r UNION ALL SELECT level + 1, {up} FROM u WHERE len(nodes) > 1),
c(k, s, level, place, proof, folded) AS (SELECT k, s, 0, i, '', found FROM n
  UNION ALL SELECT c.k, c.s, c.level + 1, c.place // 3, c.proof || {low[0]} || {low[1]}, sha256({low[0]} || c.folded || {low[1]})
  FROM c JOIN t ON c.s = t.s AND c.level = t.level WHERE len(t.nodes) > 1),
g AS (SELECT c.* FROM c JOIN r ON c.s = r.s AND c.level = r.height),
h(k, level, place, proof, folded) AS (SELECT k, 0, s, proof, folded FROM g
  UNION ALL SELECT c.k, c.level + 1, c.place // 3, c.proof || {high[0]} || {high[1]}, sha256({high[0]} || c.folded || {high[1]})
  FROM h c JOIN u ON c.level = u.level WHERE len(u.nodes) > 1)
SELECT n.doc_id, n.leaf, r.subroot, u.nodes[1] AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root,
  h.folded = u.nodes[1] AS verified
FROM n JOIN r ON n.s = r.s JOIN h ON n.k = h.k JOIN u ON h.level = u.level WHERE len(u.nodes) = 1"""


def _hard_negatives() -> str:
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


def sql() -> dict[str, str]:
    return {"op4_quality_rules": _quality(), "op11_recursive_manifest": _manifest(),
            "op12_angular_negatives": _hard_negatives()}
