"""DuckDB SQL of the queries whose work SQL can express at length."""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE
low AS (SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(range(0, 8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) AS c
    FROM range(0, 256) AS bytes(b))),
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key
    FROM conversations),
hashed AS (
    SELECT source.*, xor(4294967295::BIGINT, list_reduce(
               list_transform(range(1, octet_length(key) + 1), lambda i: ('0x' || substr(hex(key), 2 * i - 1, 2))::BIGINT),
               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS kind
    FROM source, low),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
           rtrim(text, E' \t\n\x0b\x0c\r') AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial
    FROM damaged),
faulty AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM placed),
ends AS (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id),
-- the best repair of the first i rows by the last role kept: nothing, system, user, assistant; an insertion may follow at once
steps AS (
    SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS qn, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS qs,
           {'c': 3, 'a': 'I', 't': E'user:\n'} AS qu, {'c': 6, 'a': 'II', 't': E'user:\nassistant:\n'} AS qa
    FROM (SELECT DISTINCT conv_id FROM ends)
    UNION ALL
    SELECT conv_id, i, qn, qs, qu, list_min([qa, {'c': qu.c + 3, 'a': qu.a || 'I', 't': qu.t || E'assistant:\n'}])
    FROM (
        SELECT conv_id, i, qn, qs, qa,
               list_min([qu, {'c': qn.c + 3, 'a': qn.a || 'I', 't': qn.t || E'user:\n'}, {'c': qs.c + 3, 'a': qs.a || 'I', 't': qs.t || E'user:\n'},
                         {'c': qa.c + 3, 'a': qa.a || 'I', 't': qa.t || E'user:\n'}].list_filter(lambda x: x.c IS NOT NULL)) AS qu
        FROM (
            SELECT conv_id, i, {'c': qn.c + 4, 'a': qn.a || 'D', 't': qn.t} AS qn,
                   list_min([{'c': qs.c + 4, 'a': qs.a || 'D', 't': qs.t}, CASE WHEN free AND initial = 's' THEN {'c': qn.c + more, 'a': qn.a || 'K', 't': qn.t || line} END].list_filter(lambda x: x.c IS NOT NULL)) AS qs,
                   list_min([{'c': qu.c + 4, 'a': qu.a || 'D', 't': qu.t}].list_concat(
                       CASE WHEN free THEN list_transform([qn, qs, qa], lambda q: CASE WHEN initial = 'u' THEN {'c': q.c + more, 'a': q.a || 'K', 't': q.t || line}
                            ELSE {'c': q.c + more + 3, 'a': q.a || 'R', 't': q.t || 'user:' || text || E'\n'} END) END).list_filter(lambda x: x.c IS NOT NULL)) AS qu,
                   list_min([{'c': qa.c + 4, 'a': qa.a || 'D', 't': qa.t},
                       CASE WHEN NOT free THEN NULL WHEN initial = 'a' THEN {'c': qu.c + more, 'a': qu.a || 'K', 't': qu.t || line}
                            ELSE {'c': qu.c + more + 3, 'a': qu.a || 'R', 't': qu.t || 'assistant:' || text || E'\n'} END].list_filter(lambda x: x.c IS NOT NULL)) AS qa
            FROM (
                SELECT s.conv_id, r.i, s.qn, s.qs, s.qu, s.qa, r.initial, r.text, r.role || ':' || r.text || E'\n' AS line,
                       r.fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END AS more
                FROM steps AS s JOIN faulty AS r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))))
, done AS (
    SELECT s.conv_id, list_min([s.qn, s.qa]) AS best
    FROM steps AS s JOIN ends AS e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.i = e.n),
told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done AS d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

LEXICAL_SEARCH = r"""
WITH found AS (
    SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
held AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM found GROUP BY doc, term),
sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM held GROUP BY doc),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term),
impacts AS (
    SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact
    FROM held JOIN sizes USING (doc) JOIN weights USING (term), corpus),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)),
times AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY item_id, term),
scores AS (SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(q * impact)::BIGINT AS score FROM times JOIN impacts USING (term) GROUP BY item_id, doc)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 20"""
