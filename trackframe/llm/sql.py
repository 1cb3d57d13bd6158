"""SQL for the queries of this folder that SQL can express on whole tables.

Fingerprints, tokenizers, an index with bounds, run hashes and regular expressions with
spans have no counterpart there; tests hold those queries against brute force.
"""

from __future__ import annotations

OP2_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP5_CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN {'turn': turn, 'role': role, 'text': text} END AS alone FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(sha256(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))), '' ORDER BY turn, role, text) AS prints,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id, alone),
k AS (SELECT DISTINCT substr(prints, 1, 64 * g.k) AS prefix FROM (SELECT prints, unnest(range(1, n_turns)) AS k FROM c) g)
SELECT conv_id, n_turns, rendered FROM (SELECT *, row_number() OVER (PARTITION BY prints ORDER BY conv_id) AS copy FROM c)
WHERE copy = 1 AND prints NOT IN (SELECT prefix FROM k)
"""

#: Terms of documents and items as lists; all sums in whole numbers.
OP13_LEXICAL_SEARCH = r"""
WITH t AS (SELECT d.rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM t),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
p AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM f JOIN w USING (term) JOIN i USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_WARC, "op5_chat": OP5_CHAT, "op13_lexical_search": OP13_LEXICAL_SEARCH}
