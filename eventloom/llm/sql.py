"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": OP3, "op6_chat_format": OP6, "op7_nn_descent_dedup": OP7, "op8_ngram_jaccard": OP8}


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, {1 + 10 * part}, 10) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)"
    for part in range(4)
    for shift in range(35, -1, -5)
)
OP3 = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
first_of AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS original FROM hashed)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM first_of
"""


#: formatted_chars follows from the template: what a turn, a block and each escaped character add.
OP6 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 0 ELSE 1 END AS opens,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|<sep>|\[/?INST\]')) AS text_chars,
    length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '</?s>|<sep>|\[/?INST\]')) AS role_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens = 1 THEN 20 + role_chars ELSE 5 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


#: Every pair of a label by brute force. Where labels are small enough for the audit to see all of them, recall is 1.
OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS x FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""


#: Intersections of all pairs of distinct sets that share a shingle.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5_number_lower(array_to_string(words[i:i + 4], ' '))))) WHEN len(words) > 0 THEN [md5_number_lower(array_to_string(words, ' '))] ELSE [] END AS found FROM w
), sets AS (SELECT min(doc_id) AS rep, found, len(found) AS n FROM s WHERE len(found) > 0 GROUP BY found
), t AS (SELECT rep, n, unnest(found) AS h FROM sets
), pairs AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.h = b.h AND a.rep < b.rep AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY 1)
SELECT doc_id, len(s.found) AS n_shingles, CASE WHEN rep IS NULL THEN doc_id ELSE least(rep, coalesce(c, rep)) END AS component_id
FROM s LEFT JOIN sets ON s.found = sets.found LEFT JOIN least USING (rep)
"""
