"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLE_SQL = {}

# fixed values: the reversed polynomial of crc32 is 3988292384, its start and final mask 4294967295
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), range(8)), lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""


def _field(value):
    text = f"({value})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _leaf(text):
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS seen,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
    FROM documents),
up AS (
    SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY source
    UNION ALL
    SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda pos: sha256(array_to_string(nodes[pos + 1:pos + 3], '')))
    FROM up WHERE len(nodes) > 1),
subroots AS (
    SELECT source, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k
    FROM up WHERE len(nodes) = 1),
top AS (
    SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda pos: sha256(array_to_string(nodes[pos + 1:pos + 3], '')))
    FROM top WHERE len(nodes) > 1),
places AS (
    SELECT doc_id, up.level AS step, nodes, (i // (3 ** up.level)::BIGINT) AS pos
    FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source
    JOIN up ON up.source IS NOT DISTINCT FROM s.source AND len(nodes) > 1
    UNION ALL
    SELECT doc_id, height + top.level, nodes, (k // (3 ** top.level)::BIGINT)
    FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source JOIN top ON len(nodes) > 1),
siblings AS (
    SELECT doc_id, step, array_to_string(nodes[pos - pos % 3 + 1:pos], '') AS lefts,
           array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '') AS rights
    FROM places),
paths AS (
    SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof,
           list({{'l': lefts, 'r': rights}} ORDER BY step) AS path
    FROM siblings GROUP BY doc_id),
fold AS (
    SELECT doc_id, 0 AS step, seen AS h FROM leaves
    UNION ALL
    SELECT fold.doc_id, step + 1, sha256(path[step + 1].l || h || path[step + 1].r)
    FROM fold JOIN paths USING (doc_id) WHERE step < len(path))
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
LEFT JOIN paths p ON p.doc_id = l.doc_id
JOIN fold f ON f.doc_id = l.doc_id AND f.step = coalesce(len(p.path), 0)
CROSS JOIN (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1) r
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL["op12_ranked_lexical_search"] = f"""
WITH doc_terms AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(terms) AS n FROM doc_terms WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM sizes, totals),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
