"""The corpus operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracklot.llm.bpe import op11_bpe
from tracklot.llm.conversation_trie import op13_conversation_trie
from tracklot.llm.fingerprints import op6_fingerprints
from tracklot.llm.html_text import op2_html_text
from tracklot.llm.licenses import op9_licenses
from tracklot.llm.line_dedup import op3_line_dedup
from tracklot.llm.mixing import op10_mixing
from tracklot.llm.near_dups import op4_near_duplicates
from tracklot.llm.packing import op5_packing
from tracklot.llm.pii import op7_pii
from tracklot.llm.quality import op8_quality
from tracklot.llm.token_ids import op1_token_ids
from tracklot.llm.vector_codes import ENTRIES, PARTS, ROUNDS, op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_html_text": op2_html_text,
        "op3_line_dedup": op3_line_dedup,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_licenses": op9_licenses,
        "op10_mixing": op10_mixing,
        "op11_bpe": op11_bpe,
        "op12_vector_codes": op12_vector_codes,
        "op13_conversation_trie": op13_conversation_trie,
    }


#: All pairs that share a shingle, links on exact sets, and the smallest id reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""


def _vector_codes() -> str:
    """Every part against every entry, in five assignments and four updates; lists of doubles hold the integers exactly."""
    ctes = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, ints[part * (len(ints) // {PARTS}) + 1:(part + 1) * (len(ints) // {PARTS})] AS x FROM v, range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        d = "CAST(list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e) AS BIGINT)"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min({d} * {ENTRIES} + entry) AS k FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)")
        if r < ROUNDS:
            ctes.append(f"m{r} AS (SELECT part, entry, list(c ORDER BY pos) AS e FROM (SELECT part, k % {ENTRIES} AS entry, pos, floor(sum(x[pos]) / count(*)) AS c FROM a{r}, range(1, (SELECT max(len(x)) FROM p) + 1) t(pos) GROUP BY ALL) GROUP BY part, entry)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""WITH {", ".join(ctes)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(CAST(e[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}, range(1, (SELECT max(len(x)) FROM p) + 1) t(pos))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, books"""


#: crc32 of a decimal number: its characters, and eight shifts (-1) after each.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END, 4294967295::BIGINT), 4294967295)"
#: Prefixes are their turns' digests joined, so a subtree is all keys that start with the node's.
CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i AS seq, role, text FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT conv_id, 8 + i, role, text FROM t JOIN c USING (conv_id) WHERE i > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS depth, sha256(len(role) || ':' || role || text) AS own, strlen(text) AS bytes FROM r),
k AS (SELECT conv_id, depth, string_agg(own, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS key, bytes FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, CASE depth WHEN 0 THEN NULL WHEN 1 THEN '' ELSE left(key, depth * 65 - 66) END AS up FROM k GROUP BY key, depth),
kids AS (SELECT up AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, max_by(key, depth) AS key FROM k GROUP BY conv_id) GROUP BY key),
under AS (SELECT s.key, count(*) FILTER (WHERE l.n IS NULL) AS n_leaves, CAST(sum(t.saved) AS BIGINT) AS saved_tokens FROM n s JOIN n t ON starts_with(t.key, s.key) LEFT JOIN kids l ON l.key = t.key GROUP BY s.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, under.n_leaves, under.saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON p.key = n.up LEFT JOIN kids ON kids.key = n.key LEFT JOIN ends ON ends.key = n.key JOIN under ON under.key = n.key"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query and runs on whole tables; the tests hold the others against brute force."""
    return {"op4_near_duplicates": NEAR_DUPLICATES, "op12_vector_codes": _vector_codes(), "op13_conversation_trie": CONVERSATION_TRIE}
