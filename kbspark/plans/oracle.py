"""DuckDB SQL for every registered query: the independent oracle the Spark plans are checked
against. Entity derivations are written once as CTE text and composed per query."""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-01-15 00:00:00'"

CTE = {}

CTE["kb_users"] = """kb_users AS (
  SELECT user_id,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) END AS external_id,
    CASE user_id % 3 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'VK' ELSE 'GOOGLE' END AS provider,
    user_id % 7 AS company_id,
    CASE user_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'EXTERNAL' ELSE 'SYSTEM' END AS user_type,
    'BASE' AS role
  FROM (SELECT DISTINCT user_id FROM events) u)"""

CTE["kb_documents"] = """kb_documents AS (
  SELECT d.doc_id AS document_id, d.doc_id % 7 AS company_id,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.doc_id % 50 END AS owner_id,
    CASE d.doc_id % 5 WHEN 0 THEN 'TEXT_INPUT' WHEN 1 THEN 'FILE' WHEN 2 THEN 'URI' WHEN 3 THEN 'WEB_SCRAPING'
      ELSE 'CONFLUENCE' END AS source_type,
    'doc ' || CAST(d.doc_id AS VARCHAR) AS title,
    CASE d.doc_id % 3 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' ELSE 'RESTRICTED' END AS access_level,
    false AS is_hot,
    (l.quality = 1) AS is_approved,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 720 AS INTEGER)) AS created_at,
    d.text AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CTE["kb_grants"] = """kb_grants AS (
  SELECT event_id AS grant_id, event_id % (SELECT coalesce(max(doc_id) + 1, 1) FROM documents) AS document_id, user_id, 'READER' AS access_role,
    CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN NULL ELSE false END AS is_revoked,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS expires_at
  FROM events)"""

CTE["kb_chunks"] = """kb_sents AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')), lambda s: s <> '') AS s
  FROM documents),
kb_chunks AS (
  SELECT doc_id * 1000000 + i // 3 AS chunk_id, doc_id AS document_id, i // 3 AS chunk_idx,
    array_to_string(list_slice(s, i + 1, i + 5), ' ') AS chunk_text
  FROM (SELECT doc_id, s, unnest(range(0, len(s), 3)) AS i FROM kb_sents))"""

CTE["kb_embeddings"] = """kb_places AS (
  SELECT chunk_id, document_id AS d, chunk_idx AS i, unnest(range(0, (document_id + chunk_idx) % 3 + 1)) AS j FROM kb_chunks),
kb_embeddings AS (
  SELECT chunk_id * 3 + j AS embedding_id, chunk_id, j AS subchunk_idx, embedding AS vector,
    CASE WHEN (d + i + j) % 10 = 9 THEN 'FAILED' WHEN (d + i + j) % 10 = 8 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
    CASE WHEN (d + i + j) % 10 = 9 THEN 3 ELSE 1 END AS attempts
  FROM kb_places JOIN embeddings ON vec_id = (d * 31 + i * 17 + j * 7) % (SELECT coalesce(max(vec_id) + 1, 1) FROM embeddings))"""

CTE["kb_questions"] = """kb_questions AS (
  SELECT b.item_id AS query_id, b.item_id AS user_id, b.text AS question, e.embedding AS query_vector
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT coalesce(max(vec_id) + 1, 1) FROM embeddings))"""

CTE["kb_callers"] = """kb_callers AS (
  SELECT q.query_id, q.user_id, u.company_id, u.user_type, u.provider, u.external_id
  FROM kb_questions q LEFT JOIN kb_users u ON u.user_id = q.user_id)"""

CTE["live_grants"] = f"""live_grants AS (
  SELECT user_id, document_id FROM kb_grants
  WHERE is_revoked = false AND (expires_at IS NULL OR expires_at >= {AS_OF_SQL}))"""

CTE["callers"] = """callers AS (
  SELECT DISTINCT user_id, company_id, user_type FROM kb_callers WHERE user_id IS NOT NULL)"""

CTE["list_access"] = """list_access AS (
  SELECT DISTINCT c.user_id, d.document_id
  FROM kb_documents d JOIN callers c ON
      (d.access_level = 'PUBLIC' AND d.is_approved = true AND d.company_id = c.company_id)
   OR d.owner_id = c.user_id
   OR (d.access_level = 'INTERNAL' AND c.user_type = 'INTERNAL' AND d.company_id = c.company_id)
   OR EXISTS (SELECT 1 FROM live_grants g WHERE g.user_id = c.user_id AND g.document_id = d.document_id))"""

CTE["point_access"] = """point_access AS (
  SELECT DISTINCT c.user_id, d.document_id
  FROM kb_documents d CROSS JOIN callers c
  WHERE CASE
    WHEN d.access_level = 'PUBLIC' THEN coalesce(d.is_approved, false) AND coalesce(c.company_id = d.company_id, false)
    WHEN coalesce(d.owner_id = c.user_id, false) THEN true
    WHEN d.access_level = 'INTERNAL' THEN coalesce(c.user_type = 'INTERNAL' AND c.company_id = d.company_id, false)
    ELSE EXISTS (SELECT 1 FROM live_grants g WHERE g.user_id = c.user_id AND g.document_id = d.document_id)
  END)"""

CTE["question_access"] = """question_access AS (
  SELECT DISTINCT q.query_id, a.document_id FROM kb_questions q JOIN list_access a ON a.user_id = q.user_id)"""

CTE["qvec"] = """qvec AS (SELECT query_id, CAST(query_vector AS DOUBLE[]) AS q FROM kb_questions)"""
CTE["evec"] = """evec AS (
  SELECT embedding_id, chunk_id, subchunk_idx, CAST(vector AS DOUBLE[]) AS v
  FROM kb_embeddings WHERE status = 'COMPLETED')"""

_COS = ("round(CASE WHEN list_dot_product(e.v, e.v) = 0 OR list_dot_product(qv.q, qv.q) = 0 THEN 1.0 "
        "ELSE 1.0 - list_dot_product(e.v, qv.q) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(qv.q, qv.q))) "
        "END, 9)")


def _dists(with_access: bool) -> str:
    acc_join = "JOIN question_access a ON a.document_id = c.document_id JOIN qvec qv ON qv.query_id = a.query_id" \
        if with_access else "CROSS JOIN qvec qv"
    return f"""dists AS (
  SELECT qv.query_id, c.chunk_id, c.document_id, c.chunk_idx, c.chunk_text, e.embedding_id, e.subchunk_idx,
    {_COS} AS dist
  FROM kb_chunks c JOIN evec e ON e.chunk_id = c.chunk_id {acc_join})"""


_STATS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY dist, subchunk_idx, embedding_id) AS rn
  FROM dists),
stats AS (
  SELECT query_id, chunk_id, document_id, chunk_idx, chunk_text, min(dist) AS best_distance,
    round(avg(dist), 9) AS avg_distance, count(*) AS match_count
  FROM ranked WHERE rn <= 3 GROUP BY query_id, chunk_id, document_id, chunk_idx, chunk_text),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_distance, chunk_id) AS chunk_rank
  FROM stats QUALIFY chunk_rank <= 20),
scored AS (
  SELECT *, round(0.6 * (1 - best_distance) + 0.3 * (1 - avg_distance) + 0.1 * (match_count / 3.0), 6) AS score
  FROM top)"""


def with_ctes(names: list[str], body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body


ACCESS_BASE = ["kb_users", "kb_documents", "kb_grants", "kb_questions", "kb_callers", "live_grants", "callers"]

SQL: dict[str, str] = {}

SQL["access_list_policy"] = with_ctes(ACCESS_BASE + ["list_access"], "SELECT user_id, document_id FROM list_access")
SQL["access_point_policy"] = with_ctes(ACCESS_BASE + ["point_access"], "SELECT user_id, document_id FROM point_access")
SQL["access_policy_diff"] = with_ctes(ACCESS_BASE + ["list_access", "point_access"], """
SELECT user_id, document_id, 'list_only' AS visible_in FROM (SELECT * FROM list_access EXCEPT ALL SELECT * FROM point_access)
UNION ALL
SELECT user_id, document_id, 'point_only' AS visible_in FROM (SELECT * FROM point_access EXCEPT ALL SELECT * FROM list_access)""")

SQL["requested_docs_filter"] = with_ctes(ACCESS_BASE + ["list_access", "question_access"], """,
requests AS (
  SELECT query_id, CASE WHEN query_id % 4 = 0 THEN NULL
                        ELSE [query_id * 7919 % n, query_id * 3 * 7919 % n, query_id * 7 * 7919 % n] END AS doc_ids
  FROM kb_questions, (SELECT coalesce(max(doc_id) + 1, 1) AS n FROM documents) b)
SELECT a.query_id, a.document_id FROM question_access a JOIN requests r ON r.query_id = a.query_id
WHERE r.doc_ids IS NULL OR list_contains(r.doc_ids, a.document_id)""")

RETRIEVE_ACCESS = ACCESS_BASE + ["list_access", "question_access"] + ["kb_chunks", "kb_embeddings", "qvec", "evec"]

SQL["vector_distance"] = with_ctes(RETRIEVE_ACCESS, """
SELECT qv.query_id, e.embedding_id,
  """ + _COS + """ AS cosine_distance,
  round(sqrt(list_sum(list_transform(list_zip(e.v, qv.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS l2_distance,
  len(e.v) AS dim
FROM kb_chunks c JOIN evec e ON e.chunk_id = c.chunk_id JOIN question_access a ON a.document_id = c.document_id
JOIN qvec qv ON qv.query_id = a.query_id""")

SQL["retrieve_topk"] = with_ctes(RETRIEVE_ACCESS, ",\n" + _dists(True) + ",\n" + _STATS + """
SELECT query_id, chunk_id, document_id, chunk_idx, chunk_text, best_distance, avg_distance, match_count, chunk_rank
FROM top""")

SQL["retrieve_scored"] = with_ctes(RETRIEVE_ACCESS, ",\n" + _dists(True) + ",\n" + _STATS + """
SELECT query_id, chunk_id, document_id, chunk_idx, best_distance, avg_distance, match_count, chunk_rank, score
FROM scored WHERE score >= 0.25""")


SQL["retrieve_with_access"] = with_ctes(RETRIEVE_ACCESS, ",\n" + _dists(True) + ",\n" + _STATS + """
SELECT query_id, chunk_id, document_id, chunk_idx, chunk_text, best_distance, avg_distance, match_count, chunk_rank, score
FROM scored WHERE score >= 0.15""")


B = "[ \\t\\r\\n\\f]"
STRIP = "regexp_replace({x}, '^" + B + "+|" + B + "+$', '', 'g')"

CTE["doc_sents"] = """doc_sents AS (
  SELECT doc_id AS document_id,
    list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])""" + B + """+', '\\1' || chr(1), 'g'), chr(1)),
                               lambda s: """ + STRIP.format(x="s") + """), lambda s: s <> '') AS s
  FROM documents)"""

CTE["doc_chunks"] = """doc_chunks AS (
  SELECT document_id, i // 3 AS chunk_idx, list_slice(s, i + 1, i + 5) AS cs,
    array_to_string(list_slice(s, i + 1, i + 5), ' ') AS chunk_text
  FROM (SELECT document_id, s, unnest(range(0, len(s), 3)) AS i FROM doc_sents))"""

CTE["chunk_units"] = """chunk_units AS (
  SELECT document_id, chunk_idx,
    regexp_extract_all(""" + STRIP.format(x="chunk_text") + """, '[^ \\t\\r\\n\\f]+""" + B + """*') AS u
  FROM doc_chunks)"""

CTE["chunk_windows"] = """chunk_windows AS (
  SELECT document_id, chunk_idx, u, unnest(range(0,
    CAST(CASE WHEN len(u) = 0 THEN 0 ELSE (greatest(ceil((len(u) - 254) / 222.0), 0) + 1) * 222 END AS BIGINT), 222)) AS s
  FROM chunk_units)"""

SQL["sentence_chunks"] = with_ctes(["doc_sents", "doc_chunks"], """
SELECT document_id, chunk_idx, len(cs) AS n_sentences, chunk_text, 2 AS overlap FROM doc_chunks""")

SQL["token_subchunks"] = with_ctes(["doc_sents", "doc_chunks", "chunk_units", "chunk_windows"], """
SELECT document_id, chunk_idx, s // 222 AS subchunk_idx, s AS token_start,
  len(list_slice(u, s + 1, s + 254)) AS n_tokens,
  """ + STRIP.format(x="array_to_string(list_slice(u, s + 1, s + 254), '')") + """ AS subchunk_text
FROM chunk_windows""")

SQL["chunk_metadata"] = with_ctes(["doc_sents", "doc_chunks"], """
SELECT sha256(CAST(document_id AS VARCHAR) || '|' || CAST(chunk_idx AS VARCHAR)) AS chunk_uid,
  CAST(document_id AS VARCHAR) AS document_id, false AS is_hot, chunk_idx AS position
FROM doc_chunks""")

_HTML = "html"
_HTML = "regexp_replace(" + _HTML + ", '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ["script", "style", "noscript", "nav"]:
    _HTML = "regexp_replace(" + _HTML + ", '(?is)<" + _tag + "[^>]*>.*?</" + _tag + ">', ' ', 'g')"
_HTML = "regexp_replace(" + _HTML + ", '<[^>]*>', ' ', 'g')"
for _e, _c in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"),
               ("&middot;", "·"), ("&amp;", "&")]:
    _HTML = "replace(" + _HTML + ", '" + _e + "', '" + _c + "')"
_HTML = STRIP.format(x="regexp_replace(" + _HTML + ", '" + B + "+', ' ', 'g')")
SQL["page_text"] = "SELECT page_id, url, " + _HTML + " AS text, length(" + _HTML + ") AS n_chars FROM pages"


# ------------------------------------------------------------------------------- answering
CTE["retrieved"] = _dists(True) + ",\n" + _STATS + """,
retrieved AS (SELECT * FROM scored WHERE score >= 0.15)"""

CTE["ctx"] = """ctx_docs AS (
  SELECT query_id, document_id, min(chunk_rank) AS first_rank, count(*) AS n_chunks,
    list(struct_pack(chunk_idx := coalesce(chunk_idx, 0), chunk_id := chunk_id, chunk_text := chunk_text)
         ORDER BY coalesce(chunk_idx, 0), chunk_id, chunk_text) AS chunks
  FROM retrieved GROUP BY query_id, document_id),
ctx AS (
  SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS doc_rank,
    n_chunks, chunks FROM ctx_docs)"""

_N = "(query_id * 1000 + document_id)"
_CERT = "['high', 'MEDIUM', 'low', 'contradicts'][(({n} + {j}) % 4) + 1]"
_TAG = "CAST(query_id AS VARCHAR) || '-' || CAST(document_id AS VARCHAR)"
_BODY = ("""'{"answer": "answer ' || """ + _TAG + """ || '", "reasoning": "doc ' || CAST(document_id AS VARCHAR) ||
  '", "can_answer": true, "new_facts": [{"fact": "fact ' || """ + _TAG + """ || '-a", "certainty": "' ||
  CASE WHEN """ + _N + """ % 13 = 0 THEN 'certain' ELSE """ + _CERT.format(n=_N, j=0) + """ END ||
  '", "reasoning": "seen in ' || CAST(document_id AS VARCHAR) || '"}, ' ||
  CASE WHEN """ + _N + """ % 11 = 0 THEN '{"fact": "fact ' || """ + _TAG + """ || '-b"}'
       ELSE '{"fact": "fact ' || """ + _TAG + """ || '-b", "certainty": "' || """ + _CERT.format(n=_N, j=1) + """ || '"}' END ||
  '], "updated_facts": [{"id": "' || CAST(1 + doc_rank % 3 AS VARCHAR) || '", "fact": "' ||
  CASE WHEN """ + _N + """ % 3 = 0 THEN '' ELSE 'revised ' || """ + _TAG + """ END ||
  '", "certainty": "' || """ + _CERT.format(n=_N, j=2) + """ || '", "reasoning": ""}]}'""")
_REPLY = ("CASE WHEN " + _N + " % 7 = 0 THEN 'Sorry, no structured answer {' || CAST(" + _N + " AS VARCHAR) "
          "WHEN " + _N + " % 5 = 0 THEN 'Here is the result: ' || " + _BODY + " || ' Hope it helps.' "
          "ELSE " + _BODY + " END")
_FACT_T = '{"id": "VARCHAR", "fact": "VARCHAR", "certainty": "VARCHAR", "reasoning": "VARCHAR"}'
_REPLY_T = ('{"answer": "VARCHAR", "reasoning": "VARCHAR", "can_answer": "BOOLEAN", "new_facts": [' + _FACT_T +
            '], "updated_facts": [' + _FACT_T + ']}')
_BAD = "len(list_filter(coalesce(d.{k}, []), lambda f: NOT (f.fact IS NOT NULL AND f.certainty IS NOT NULL AND lower(f.certainty) IN ('high', 'medium', 'low', 'contradicts'))))"
_CLEAN = ("list_transform(coalesce(d.{k}, []), lambda f: struct_pack(id := f.id, fact := f.fact, "
          "certainty := lower(f.certainty), reasoning := coalesce(f.reasoning, '')))")

CTE["replies"] = """replies_raw AS (
  SELECT query_id, document_id, doc_rank, chunks, """ + _REPLY + """ AS reply_text FROM ctx),
replies_b AS (
  SELECT *, instr(reply_text, '{') AS st, length(reply_text) - instr(reverse(reply_text), '}') + 1 AS en,
    instr(reverse(reply_text), '}') AS rv FROM replies_raw),
replies_j AS (
  SELECT *, CASE WHEN st > 0 AND rv > 0 AND en >= st THEN substring(reply_text, st, en - st + 1) END AS body
  FROM replies_b),
replies_p AS (
  SELECT *, CASE WHEN body IS NOT NULL AND json_valid(body) THEN json_transform(body, '""" + _REPLY_T + """') END AS d
  FROM replies_j),
replies AS (
  SELECT query_id, document_id, doc_rank, chunks, reply_text,
    coalesce(d IS NOT NULL AND """ + _BAD.format(k="new_facts") + """ = 0 AND """ + _BAD.format(k="updated_facts") + """ = 0, false) AS valid,
    d FROM replies_p),
replies_v AS (
  SELECT query_id, document_id, doc_rank, chunks, valid,
    CASE WHEN valid THEN coalesce(d.answer, '') ELSE '' END AS answer,
    CASE WHEN valid THEN coalesce(d.reasoning, '') ELSE '' END AS reasoning,
    CASE WHEN valid THEN coalesce(d.can_answer, false) ELSE false END AS can_answer,
    CASE WHEN valid THEN """ + _CLEAN.format(k="new_facts") + """ ELSE [] END AS new_facts,
    CASE WHEN valid THEN """ + _CLEAN.format(k="updated_facts") + """ ELSE [] END AS updated_facts
  FROM replies)"""

CTE["fold"] = """newf AS (
  SELECT query_id, doc_rank, pos, new_facts[pos] AS f
  FROM (SELECT query_id, doc_rank, new_facts, unnest(range(1, len(new_facts) + 1)) AS pos FROM replies_v)),
created AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, pos) AS VARCHAR) AS fact_id,
    doc_rank AS created_rank, f.fact AS fact, f.certainty AS certainty, f.reasoning AS reasoning
  FROM newf WHERE f.certainty <> 'contradicts'),
updf AS (
  SELECT query_id, doc_rank AS u_rank, upos, updated_facts[upos] AS u
  FROM (SELECT query_id, doc_rank, updated_facts, unnest(range(1, len(updated_facts) + 1)) AS upos FROM replies_v)),
valid_upd AS (
  SELECT u.query_id, u.u_rank, u.upos, u.u.id AS fact_id, u.u.fact AS u_fact, u.u.certainty AS u_certainty,
    u.u.reasoning AS u_reasoning
  FROM updf u JOIN created c ON c.query_id = u.query_id AND c.fact_id = u.u.id
  WHERE u.u.id IS NOT NULL AND trim(u.u.id) <> '' AND c.created_rank <= u.u_rank),
deleted AS (SELECT DISTINCT query_id, fact_id FROM valid_upd WHERE u_certainty = 'contradicts'),
latest AS (
  SELECT query_id, fact_id,
    arg_max(u_fact, u_rank * 100000 + upos) FILTER (WHERE coalesce(u_fact, '') <> '') AS u_fact,
    arg_max(u_certainty, u_rank * 100000 + upos) FILTER (WHERE coalesce(u_certainty, '') <> '') AS u_certainty,
    arg_max(u_reasoning, u_rank * 100000 + upos) FILTER (WHERE coalesce(u_reasoning, '') <> '') AS u_reasoning
  FROM valid_upd WHERE u_certainty <> 'contradicts' GROUP BY query_id, fact_id),
folded AS (
  SELECT c.query_id, c.fact_id, c.created_rank, coalesce(l.u_fact, c.fact) AS fact,
    coalesce(l.u_certainty, c.certainty) AS certainty, coalesce(l.u_reasoning, c.reasoning) AS reasoning
  FROM created c LEFT JOIN latest l ON l.query_id = c.query_id AND l.fact_id = c.fact_id
  WHERE NOT EXISTS (SELECT 1 FROM deleted x WHERE x.query_id = c.query_id AND x.fact_id = c.fact_id))"""

CTE["used"] = """used AS (
  SELECT u.query_id, d.used_documents, u.used_chunks FROM
    (SELECT query_id, string_agg(CAST(c.chunk_id AS VARCHAR), ',' ORDER BY doc_rank, c.chunk_idx) AS used_chunks
     FROM (SELECT query_id, doc_rank, unnest(chunks) AS c FROM ctx) GROUP BY query_id) u
    JOIN (SELECT query_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY doc_rank) AS used_documents
          FROM ctx GROUP BY query_id) d ON d.query_id = u.query_id)"""

CTE["answer"] = """answer AS (
  SELECT q.query_id, coalesce(la.final_result, '') AS final_result, coalesce(fs.n_facts, 0) AS n_facts,
    CAST(round(least(1.0, coalesce(fs.n_facts, 0) * 0.2), 6) AS DOUBLE) AS confidence, coalesce(fs.reasoning, '') AS reasoning,
    coalesce(u.used_documents, '') AS used_documents, coalesce(u.used_chunks, '') AS used_chunks
  FROM kb_questions q
  LEFT JOIN (SELECT query_id, arg_max(answer, doc_rank) AS final_result FROM replies_v GROUP BY query_id) la
    ON la.query_id = q.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n_facts,
                    string_agg(reasoning, chr(10) ORDER BY CAST(fact_id AS BIGINT)) AS reasoning
             FROM folded GROUP BY query_id) fs ON fs.query_id = q.query_id
  LEFT JOIN used u ON u.query_id = q.query_id)"""

CTE["conv_hist"] = """conv_ranked AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age
  FROM conversations),
conv_hist AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history
  FROM conv_ranked WHERE age <= 20 GROUP BY conv_id)"""

CTE["q_hist"] = """q_hist AS (
  SELECT q.query_id, q.user_id, q.question,
    CASE WHEN h.history IS NULL THEN 'user: ' || q.question ELSE h.history || chr(10) || 'user: ' || q.question END
      AS dialog_history
  FROM kb_questions q LEFT JOIN conv_hist h ON h.conv_id = q.user_id)"""

ANSWER_BASE = RETRIEVE_ACCESS + ["retrieved", "ctx"]
SQL["context_by_document"] = with_ctes(ANSWER_BASE, """
SELECT query_id, document_id, doc_rank, n_chunks,
  array_to_string(list_transform(chunks, lambda c: CAST(c.chunk_id AS VARCHAR)), ',') AS chunk_ids,
  to_json(list_transform(chunks, lambda c: struct_pack(chunk_id := c.chunk_id, chunk_text := c.chunk_text)))::VARCHAR
    AS context_json
FROM ctx""")
SQL["used_ids"] = with_ctes(ANSWER_BASE + ["used"], "SELECT query_id, used_documents, used_chunks FROM used")
SQL["reply_parse"] = with_ctes(ANSWER_BASE + ["replies"], """
SELECT query_id, document_id, doc_rank, valid, answer, reasoning, can_answer,
  len(new_facts) AS n_new_facts, len(updated_facts) AS n_updated_facts FROM replies_v""")
SQL["fact_fold"] = with_ctes(ANSWER_BASE + ["replies", "fold"], """
SELECT query_id, fact_id, created_rank, fact, certainty, reasoning FROM folded""")
SQL["answer_summary"] = with_ctes(ANSWER_BASE + ["replies", "fold", "used", "answer"], """,
listed AS (SELECT query_id, to_json(list(struct_pack(id := fact_id, fact := fact, certainty := certainty, reasoning := reasoning)
  ORDER BY CAST(fact_id AS BIGINT)))::VARCHAR AS facts FROM folded GROUP BY query_id)
SELECT a.query_id, CASE WHEN bad THEN 'Error processing request' ELSE final_result END AS final_result,
  CASE WHEN bad THEN '[]' ELSE coalesce(facts, '[]') END AS facts, CASE WHEN bad THEN 0 ELSE n_facts END AS n_facts,
  CASE WHEN bad THEN 0.0 ELSE confidence END AS confidence,
  CASE WHEN bad THEN 'model unavailable for question ' || CAST(a.query_id AS VARCHAR) ELSE reasoning END AS reasoning,
  CASE WHEN bad THEN '' ELSE used_documents END AS used_documents, CASE WHEN bad THEN '' ELSE used_chunks END AS used_chunks,
  'table' AS llm_provider, 100 + a.query_id * 7 AS processing_time_ms, '[]' AS warnings, false AS truncated
FROM (SELECT *, query_id % 10 = 9 AS bad FROM answer) a LEFT JOIN listed l ON l.query_id = a.query_id""")
SQL["fact_fold_model_loop"] = with_ctes(ANSWER_BASE + ["replies", "fold"], """,
last_answer AS (SELECT query_id, arg_max(answer, doc_rank) AS final_result FROM replies_v GROUP BY query_id)
SELECT f.query_id, f.fact_id, f.fact, f.certainty, f.reasoning, a.final_result
FROM folded f JOIN last_answer a ON a.query_id = f.query_id
UNION ALL
SELECT a.query_id, NULL, NULL, NULL, NULL, a.final_result FROM last_answer a
WHERE NOT EXISTS (SELECT 1 FROM folded f WHERE f.query_id = a.query_id)""")

CTE["before"] = """docs_r AS (SELECT query_id, doc_rank FROM replies_v),
deleted_at AS (SELECT query_id, fact_id, min(u_rank) AS deleted_rank FROM valid_upd
               WHERE u_certainty = 'contradicts' GROUP BY query_id, fact_id),
alive_b AS (
  SELECT d.query_id, d.doc_rank, c.fact_id, c.fact, c.certainty, c.reasoning
  FROM docs_r d JOIN created c ON c.query_id = d.query_id AND c.created_rank < d.doc_rank
  LEFT JOIN deleted_at x ON x.query_id = c.query_id AND x.fact_id = c.fact_id
  WHERE x.deleted_rank IS NULL OR x.deleted_rank >= d.doc_rank),
latest_b AS (
  SELECT d.query_id, d.doc_rank, v.fact_id,
    arg_max(v.u_fact, v.u_rank * 100000 + v.upos) FILTER (WHERE coalesce(v.u_fact, '') <> '') AS u_fact,
    arg_max(v.u_certainty, v.u_rank * 100000 + v.upos) FILTER (WHERE coalesce(v.u_certainty, '') <> '') AS u_certainty,
    arg_max(v.u_reasoning, v.u_rank * 100000 + v.upos) FILTER (WHERE coalesce(v.u_reasoning, '') <> '') AS u_reasoning
  FROM docs_r d JOIN valid_upd v ON v.query_id = d.query_id AND v.u_rank < d.doc_rank
  WHERE v.u_certainty <> 'contradicts' GROUP BY d.query_id, d.doc_rank, v.fact_id),
before AS (
  SELECT a.query_id, a.doc_rank,
    list(struct_pack(id := a.fact_id, fact := coalesce(l.u_fact, a.fact), certainty := coalesce(l.u_certainty, a.certainty),
                     reasoning := coalesce(l.u_reasoning, a.reasoning)) ORDER BY CAST(a.fact_id AS BIGINT)) AS pf
  FROM alive_b a LEFT JOIN latest_b l ON l.query_id = a.query_id AND l.doc_rank = a.doc_rank AND l.fact_id = a.fact_id
  GROUP BY a.query_id, a.doc_rank)"""

SQL["request_json"] = with_ctes(ANSWER_BASE + ["replies", "fold", "before", "conv_hist", "q_hist"], """
SELECT r.query_id, r.document_id, r.doc_rank,
  to_json(struct_pack(task := 'Analyze document for relevant information', question := h.question,
    document_context := list_transform(r.chunks, lambda c: struct_pack(chunk_id := c.chunk_id, chunk_text := c.chunk_text)),
    previous_facts := coalesce(b.pf, []),
    previous_answer := coalesce(lag(r.answer) OVER (PARTITION BY r.query_id ORDER BY r.doc_rank), ''),
    dialog_history := h.dialog_history))::VARCHAR AS request
FROM replies_v r LEFT JOIN before b ON b.query_id = r.query_id AND b.doc_rank = r.doc_rank
JOIN q_hist h ON h.query_id = r.query_id""")

SQL["prompt_render"] = with_ctes(ANSWER_BASE + ["conv_hist", "q_hist"], """
SELECT c.query_id, c.document_id,
  replace(replace(replace(replace('Context:' || chr(10) || '{context}' || chr(10) || chr(10) || 'History:' || chr(10) ||
    '{history}' || chr(10) || chr(10) || 'Date: {date}' || chr(10) || chr(10) || 'Question: {question}' || chr(10) ||
    'Answer with JSON only.',
    '{context}', array_to_string(list_transform(c.chunks, lambda x: x.chunk_text), chr(10) || chr(10))),
    '{history}', h.dialog_history), '{date}', '2024-01-15'), '{question}', h.question) AS prompt
FROM ctx c JOIN q_hist h ON h.query_id = c.query_id""")

SQL["dialog_history"] = with_ctes(["conv_hist"], "SELECT conv_id, n_turns, history FROM conv_hist")
SQL["dialog_compact"] = with_ctes(["conv_hist"], """,
parts AS (
  SELECT conv_id,
    count(*) FILTER (WHERE age <= 10) AS n_recent, count(*) FILTER (WHERE age > 10) AS n_old,
    string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE age <= 10) AS recent,
    string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE age > 10) AS old
  FROM conv_ranked WHERE age <= 20 GROUP BY conv_id)
SELECT conv_id, n_recent, n_old,
  CASE WHEN n_old > 0 THEN 'summary of ' || CAST(n_old AS VARCHAR) || ' earlier messages: ' ||
    regexp_replace(old, '""" + B + """+', ' ', 'g') || chr(10) || recent ELSE recent END AS history
FROM parts""")
SQL["dialog_append"] = with_ctes(ANSWER_BASE + ["replies", "fold", "used", "answer"], """,
last_turn AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
ex AS (
  SELECT q.user_id AS conv_id, q.question, a.final_result AS answer,
    row_number() OVER (PARTITION BY q.user_id ORDER BY q.query_id) - 1 AS k
  FROM kb_questions q JOIN answer a ON a.query_id = q.query_id)
SELECT ex.conv_id, coalesce(l.last, -1) + 1 + 2 * ex.k AS turn, 'user' AS role, ex.question AS text
FROM ex LEFT JOIN last_turn l ON l.conv_id = ex.conv_id
UNION ALL
SELECT ex.conv_id, coalesce(l.last, -1) + 2 + 2 * ex.k AS turn, 'system' AS role, coalesce(ex.answer, '') AS text
FROM ex LEFT JOIN last_turn l ON l.conv_id = ex.conv_id""")


# ------------------------------------------------------------------------------- group & concat
_SEP = """SELECT o_custkey, o_orderstatus,
  string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS order_keys,
  string_agg(o_orderpriority, '    ' ORDER BY o_orderkey) AS priorities,
  string_agg(CAST(o_totalprice AS VARCHAR), chr(10) ORDER BY o_orderkey) AS o_totalprice
FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
GROUP BY o_custkey, o_orderstatus"""
SQL["group_concat_separator"] = _SEP


def _na(x):
    v = STRIP.format(x="CAST(" + x + " AS VARCHAR)")
    return "coalesce(nullif(" + v + ", ''), 'N/A')"


SQL["group_concat_template"] = """SELECT conv_id,
  string_agg(CASE WHEN text IS NOT NULL THEN CAST(p_text AS VARCHAR) || '. [' || """ + _na("role") + """ || '] ' || text || chr(10) END,
             '' ORDER BY turn) AS transcript,
  string_agg(CASE WHEN role IS NOT NULL THEN """ + _na("turn") + """ || ':' END, '' ORDER BY turn) AS turn_tags
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text IS NULL ORDER BY turn) AS p_text FROM conversations)
WHERE conv_id IS NOT NULL GROUP BY conv_id"""

SQL["grouped_records"] = """SELECT CAST(o_custkey AS VARCHAR) || ' | ' || o_orderstatus AS text,
  to_json(struct_pack(o_custkey := o_custkey, o_orderstatus := o_orderstatus, order_keys := order_keys,
                      priorities := priorities, o_totalprice := o_totalprice))::VARCHAR AS data
FROM (""" + _SEP + ")"




# ------------------------------------------------------------------------------- mixing
def _u(x):
    return "(('0x' || substr(md5(" + x + "), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


CTE["mix"] = """mix AS (
  SELECT doc_id, lang AS dataset,
    CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT doc_id, lang, """ + _u("CAST(doc_id AS VARCHAR) || ':split'") + """ AS u FROM documents))"""

CTE["mix_index"] = """mix_local AS (
  SELECT doc_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS local_index FROM mix),
mix_sizes AS (SELECT dataset, count(*) AS n_rows FROM mix GROUP BY dataset),
mix_off AS (
  SELECT dataset, n_rows,
    CAST(coalesce(sum(n_rows) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
  FROM mix_sizes),
mix_index AS (
  SELECT l.doc_id, l.dataset, l.local_index, o.n_rows,
    o.offset + (((l.local_index - o.offset) % o.n_rows) + o.n_rows) % o.n_rows AS global_index
  FROM mix_local l JOIN mix_off o ON o.dataset = l.dataset)"""

SQL["mixing_weights"] = with_ctes(["mix"], """,
s AS (SELECT split, dataset, count(*) AS n_rows FROM mix GROUP BY split, dataset)
SELECT split, dataset, n_rows,
  round(pow(1.0 / (n_rows + 1e-6), 0.3) / sum(pow(1.0 / (n_rows + 1e-6), 0.3)) OVER (PARTITION BY split), 9) AS weight
FROM s""")

SQL["mixing_index"] = with_ctes(["mix", "mix_index"], "SELECT doc_id, dataset, local_index, global_index FROM mix_index")

SQL["mixing_sample"] = with_ctes(["mix", "mix_index"], """,
w AS (SELECT dataset, n_rows, pow(1.0 / (n_rows + 1e-6), 0.3) / sum(pow(1.0 / (n_rows + 1e-6), 0.3)) OVER () AS weight
      FROM mix_sizes),
m AS (SELECT dataset, n_rows, weight * n_rows AS mass FROM w),
b AS (SELECT dataset, n_rows,
        (sum(mass) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - mass) / sum(mass) OVER () AS lo,
        sum(mass) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(mass) OVER () AS hi
      FROM m),
d AS (SELECT global_index AS draw, """ + _u("CAST(global_index AS VARCHAR) || ':mix:d'") + """ AS u1,
        """ + _u("CAST(global_index AS VARCHAR) || ':mix:r'") + """ AS u2 FROM mix_index),
p AS (SELECT d.draw, b.dataset, CAST(floor(d.u2 * b.n_rows) AS BIGINT) AS local_index
      FROM d JOIN b ON d.u1 >= b.lo AND d.u1 < b.hi)
SELECT p.draw, p.dataset, p.local_index, i.doc_id FROM p JOIN mix_index i ON i.dataset = p.dataset AND i.local_index = p.local_index""")

CTE["split_index"] = """split_local AS (
  SELECT split, doc_id, dataset, row_number() OVER (PARTITION BY split, dataset ORDER BY doc_id) - 1 AS local_index FROM mix),
split_sizes AS (SELECT split, dataset, count(*) AS n_rows FROM mix GROUP BY split, dataset),
split_off AS (
  SELECT split, dataset, n_rows, CAST(coalesce(sum(n_rows) OVER (
    PARTITION BY split ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
  FROM split_sizes),
split_index AS (
  SELECT l.split, l.doc_id, l.dataset, l.local_index, o.n_rows,
    o.offset + (((l.local_index - o.offset) % o.n_rows) + o.n_rows) % o.n_rows AS global_index
  FROM split_local l JOIN split_off o ON o.split = l.split AND o.dataset = l.dataset)"""

SQL["mixing_index_by_split"] = with_ctes(["mix", "split_index"], "SELECT split, doc_id, dataset, local_index, global_index FROM split_index")

SQL["mixing_sample_by_split"] = with_ctes(["mix", "split_index"], """,
m AS (SELECT split, dataset, n_rows, n_rows * pow(1.0 / (n_rows + 1e-6), 0.3)
        / sum(pow(1.0 / (n_rows + 1e-6), 0.3)) OVER (PARTITION BY split) AS mass FROM split_sizes),
b AS (SELECT split, dataset, n_rows,
        (sum(mass) OVER (PARTITION BY split ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - mass)
          / sum(mass) OVER (PARTITION BY split) AS lo,
        sum(mass) OVER (PARTITION BY split ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          / sum(mass) OVER (PARTITION BY split) AS hi
      FROM m),
d AS (SELECT split, global_index AS draw, """ + _u("split || ':' || CAST(global_index AS VARCHAR) || ':mix:d'") + """ AS u1,
        """ + _u("split || ':' || CAST(global_index AS VARCHAR) || ':mix:r'") + """ AS u2 FROM split_index),
p AS (SELECT d.split, d.draw, b.dataset, CAST(floor(d.u2 * b.n_rows) AS BIGINT) AS local_index
      FROM d JOIN b ON d.split = b.split AND d.u1 >= b.lo AND d.u1 < b.hi)
SELECT p.split, p.draw, p.dataset, p.local_index, i.doc_id
FROM p JOIN split_index i ON i.split = p.split AND i.dataset = p.dataset AND i.local_index = p.local_index""")

SQL["sample_rows"] = with_ctes(["mix"], """
SELECT dataset, sample_rank, doc_id FROM (
  SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY md5(CAST(doc_id AS VARCHAR) || ':sample'), doc_id)
    AS sample_rank FROM mix) WHERE sample_rank <= 3""")

# ------------------------------------------------------------------------------- QA data
CTE["qa_ex"] = """qa_t AS (
  SELECT conv_id, turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
  FROM conversations),
qa_ex AS (
  SELECT conv_id, turn, coalesce(prev_text, '') AS context, text AS question, next_text AS answer_text
  FROM qa_t WHERE role = 'user' AND next_role = 'assistant')"""


def _toks(x):
    return "list_filter(regexp_split_to_array(" + STRIP.format(x="coalesce(" + x + ", '')") + ", '" + B + "+'), lambda t: t <> '')"


def _ids(x):
    return "list_transform(" + _toks(x) + ", lambda t: CAST((('0x' || substr(md5(t), 1, 6))::UBIGINT % 32000) + 2 AS INTEGER))"


def _enc(ids, n):
    body = "list_concat(" + ids + "[1:" + str(n - 1) + "], [1])"
    return "list_concat(" + body + ", list_transform(range(" + str(n) + " - len(" + body + ")), lambda x: 0))"


_INPUT = "'[КОНТЕКСТ]' || coalesce(context, '') || '[ВОПРОС]' || coalesce(question, '')"
SQL["qa_format"] = with_ctes(["qa_ex"], "SELECT conv_id, turn, " + _INPUT + " AS input_text, answer_text AS target_text FROM qa_ex")
SQL["qa_pad_mask"] = with_ctes(["qa_ex"], """,
enc AS (SELECT conv_id, turn, """ + _enc(_ids(_INPUT), 396) + """ AS input_ids, """ + _enc(_ids("answer_text"), 32) + """ AS target_ids FROM qa_ex)
SELECT conv_id, turn, array_to_string(input_ids, ' ') AS input_ids,
  CAST(len(list_filter(input_ids, lambda x: x <> 0)) AS BIGINT) AS n_attended,
  array_to_string(list_transform(target_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels,
  array_to_string(list_transform(target_ids, lambda x: CASE WHEN x = 0 THEN '0' ELSE '1' END), '') AS labels_attention_mask,
  array_to_string(target_ids, ' ') AS labels_unmasked
FROM enc""")
SQL["qa_length_filter"] = with_ctes(["qa_ex"], """
SELECT conv_id, turn, context, question, answer_text FROM (
  SELECT *, row_number() OVER (PARTITION BY context, question ORDER BY conv_id, turn) AS rn FROM qa_ex
  WHERE len(""" + _toks("context") + """) <= 256 AND len(""" + _toks("question") + """) <= 64) WHERE rn = 1""")
SQL["qa_length_max"] = with_ctes(["qa_ex"], """
SELECT count(*) AS n_examples, max(len(""" + _toks("context") + """)) AS max_context_tokens,
  max(len(""" + _toks("question") + """)) AS max_question_tokens, max(len(""" + _toks("answer_text") + """)) AS max_answer_tokens
FROM qa_ex""")
SQL["qa_nested_load"] = with_ctes(["qa_ex"], """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, context, question, answer_text FROM qa_ex""")
SQL["qa_jsonl_load"] = """SELECT 'Is document ' || CAST(d.doc_id AS VARCHAR) || ' good?' AS question,
  CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS answer_text
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

# ------------------------------------------------------------------------------- GLEU
def _grams(t):
    parts = ["list_transform(range(0, len(" + t + ") - " + str(n) + " + 1), lambda i: '" + str(n) + ":' || array_to_string("
             + t + "[i + 1:i + " + str(n) + "], ' '))" for n in range(1, 5)]
    return "flatten([" + ", ".join(parts) + "])"


def _ncount(t):
    return "(" + " + ".join("greatest(len(" + t + ") - " + str(n) + " + 1, 0)" for n in range(1, 5)) + ")"


CTE["gleu"] = """gp AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS pair_id, text AS hypothesis,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations),
gt AS (SELECT pair_id, """ + _toks("hypothesis") + """ AS h, """ + _toks("reference") + """ AS r FROM gp WHERE reference IS NOT NULL),
gtot AS (SELECT pair_id, greatest(""" + _ncount("h") + ", " + _ncount("r") + """) AS total FROM gt),
gg AS (SELECT pair_id, unnest(""" + _grams("h") + """) AS g, 1 AS hh, 0 AS rr FROM gt
       UNION ALL SELECT pair_id, unnest(""" + _grams("r") + """) AS g, 0 AS hh, 1 AS rr FROM gt),
gc AS (SELECT pair_id, g, sum(hh) AS ch, sum(rr) AS cr FROM gg GROUP BY pair_id, g),
gm AS (SELECT pair_id, CAST(sum(least(ch, cr)) AS BIGINT) AS matches FROM gc GROUP BY pair_id),
gleu AS (SELECT t.pair_id, coalesce(m.matches, 0) AS matches, CAST(t.total AS BIGINT) AS total
         FROM gtot t LEFT JOIN gm m ON m.pair_id = t.pair_id)"""

SQL["gleu_pair"] = with_ctes(["gleu"], """
SELECT pair_id, matches, total, round(CASE WHEN total > 0 THEN matches / total ELSE 0.0 END, 6) AS gleu FROM gleu""")
SQL["gleu_corpus"] = with_ctes(["gleu"], """
SELECT count(*) AS n_pairs, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(total) AS BIGINT) AS total,
  round(CASE WHEN sum(total) > 0 THEN sum(matches) / sum(total) ELSE 0.0 END, 6) AS gleu FROM gleu""")

# ------------------------------------------------------------------------------- vector index
SQL["vector_l2_topk"] = with_ctes(["kb_questions"], """
SELECT query_id, rank, vec_id, l2_distance FROM (
  SELECT q.query_id, e.vec_id,
    round(sqrt(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])),
                                       lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS l2_distance,
    row_number() OVER (PARTITION BY q.query_id ORDER BY
      round(sqrt(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])),
                                         lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9), e.vec_id) AS rank
  FROM embeddings e CROSS JOIN kb_questions q WHERE length(trim(q.question)) > 0) WHERE rank <= 4""")
SQL["vector_ivf_all_cells"] = with_ctes(["kb_questions"], """
SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.query_id, e.vec_id, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])), 9) AS distance
    FROM embeddings e CROSS JOIN kb_questions q)) WHERE rank <= 20""")
SQL["index_conditional_update"] = "SELECT vec_id, label, len(embedding) AS dim FROM embeddings"

# ------------------------------------------------------------------------------- audits
CTE["kb_companies"] = """kb_companies AS (
  SELECT company_id, 'company ' || CAST(company_id AS VARCHAR) AS name FROM (SELECT DISTINCT company_id FROM kb_users))"""


def _uniq(table, cte, keys):
    nn = " AND ".join(k + " IS NOT NULL" for k in keys)
    return ("SELECT '" + table + "' AS table_name, 'unique(" + ", ".join(keys) + ")' AS rule, count(*) AS n_violations FROM "
            "(SELECT " + ", ".join(keys) + " FROM " + cte + " WHERE " + nn + " GROUP BY " + ", ".join(keys)
            + " HAVING count(*) > 1)")


SQL["audit_unique"] = with_ctes(["kb_users", "kb_documents", "kb_chunks", "kb_embeddings", "doc_sents", "doc_chunks"], "\n" + "\nUNION ALL\n".join([
    _uniq("users", "kb_users", ["user_id"]), _uniq("users", "kb_users", ["provider", "external_id"]),
    _uniq("documents", "kb_documents", ["document_id"]), _uniq("document_chunks", "kb_chunks", ["chunk_id"]),
    _uniq("document_chunks", "kb_chunks", ["document_id", "chunk_idx"]),
    _uniq("sentence_chunks", "doc_chunks", ["document_id", "chunk_idx"]),
    _uniq("chunk_embeddings", "kb_embeddings", ["embedding_id"]), _uniq("documents_text", "documents", ["text"])]))


def _orph(table, child, fk, parent, pk, pname):
    return ("SELECT '" + table + "' AS table_name, '" + fk + " -> " + pname + "." + pk + "' AS rule, count(*) AS n_violations "
            "FROM " + child + " c WHERE c." + fk + " IS NOT NULL AND NOT EXISTS (SELECT 1 FROM " + parent + " p WHERE p." + pk
            + " = c." + fk + ")")


SQL["audit_orphans"] = with_ctes(["kb_users", "kb_companies", "kb_documents", "kb_chunks", "kb_embeddings", "kb_grants"],
                                 "\n" + "\nUNION ALL\n".join([
    _orph("users", "kb_users", "company_id", "kb_companies", "company_id", "companies"),
    _orph("documents", "kb_documents", "company_id", "kb_companies", "company_id", "companies"),
    _orph("documents", "kb_documents", "owner_id", "kb_users", "user_id", "users"),
    _orph("document_chunks", "kb_chunks", "document_id", "kb_documents", "document_id", "documents"),
    _orph("chunk_embeddings", "kb_embeddings", "chunk_id", "kb_chunks", "chunk_id", "document_chunks"),
    _orph("access_grants", "kb_grants", "document_id", "kb_documents", "document_id", "documents"),
    _orph("access_grants", "kb_grants", "user_id", "kb_users", "user_id", "users")]))


def _dom(table, cte, rules):
    return "\nUNION ALL\n".join("SELECT '" + table + "' AS table_name, '" + name + "' AS rule, count(*) FILTER (WHERE NOT coalesce("
                                + cond + ", false)) AS n_violations FROM " + cte for name, cond in rules)


SQL["audit_domain"] = with_ctes(["kb_users", "kb_documents", "kb_chunks", "kb_embeddings"], "\n" + "\nUNION ALL\n".join([
    _dom("documents", "kb_documents", [
        ("access_level in domain", "access_level IN ('RESTRICTED', 'INTERNAL', 'PUBLIC')"),
        ("source_type in domain", "source_type IN ('TEXT_INPUT', 'FILE', 'URI', 'WEB_SCRAPING', 'CONFLUENCE')"),
        ("title length <= 512", "title IS NULL OR length(title) <= 512"), ("title not null", "title IS NOT NULL"),
        ("public is approved", "access_level <> 'PUBLIC' OR coalesce(is_approved, false)")]),
    _dom("users", "kb_users", [
        ("provider in domain", "provider IN ('INTERNAL', 'VK', 'YANDEX', 'GOOGLE')"),
        ("user_type in domain", "user_type IN ('UNKNOWN', 'INTERNAL', 'EXTERNAL', 'SYSTEM')"),
        ("role in domain", "role IN ('BASE', 'MANAGER', 'MODERATOR', 'ADMIN', 'API')"),
        ("external_id length <= 255", "external_id IS NULL OR length(external_id) <= 255")]),
    _dom("chunk_embeddings", "kb_embeddings", [
        ("status in domain", "status IN ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED')"),
        ("vector dim = 64", "len(vector) = 64"), ("vector not null", "vector IS NOT NULL")])]))

SQL["cascade_delete"] = with_ctes(["kb_users", "kb_companies", "kb_documents", "kb_chunks", "kb_embeddings", "kb_grants"], """,
u_left AS (SELECT * FROM kb_users WHERE company_id IS NULL OR company_id <> 0),
u_gone AS (SELECT user_id FROM kb_users WHERE company_id = 0),
d_left AS (SELECT document_id, CASE WHEN owner_id IN (SELECT user_id FROM u_gone) THEN NULL ELSE owner_id END AS owner_id
           FROM kb_documents WHERE company_id <> 0),
c_left AS (SELECT * FROM kb_chunks WHERE document_id IN (SELECT document_id FROM d_left)),
e_left AS (SELECT * FROM kb_embeddings WHERE chunk_id IN (SELECT chunk_id FROM c_left)),
g_left AS (SELECT * FROM kb_grants WHERE document_id IN (SELECT document_id FROM d_left)
           AND user_id IN (SELECT user_id FROM u_left))
SELECT 'companies' AS table_name, (SELECT count(*) FROM kb_companies) AS n_before,
  (SELECT count(*) FROM kb_companies WHERE company_id <> 0) AS n_remaining, CAST(0 AS BIGINT) AS n_null_owner
UNION ALL SELECT 'users', (SELECT count(*) FROM kb_users), (SELECT count(*) FROM u_left), 0
UNION ALL SELECT 'documents', (SELECT count(*) FROM kb_documents), (SELECT count(*) FROM d_left),
  (SELECT count(*) FROM d_left WHERE owner_id IS NULL)
UNION ALL SELECT 'chunks', (SELECT count(*) FROM kb_chunks), (SELECT count(*) FROM c_left), 0
UNION ALL SELECT 'embeddings', (SELECT count(*) FROM kb_embeddings), (SELECT count(*) FROM e_left), 0
UNION ALL SELECT 'grants', (SELECT count(*) FROM kb_grants), (SELECT count(*) FROM g_left), 0""")

SQL["conform_schema"] = with_ctes(["kb_chunks", "kb_embeddings"], """
SELECT embedding_id, chunk_id, subchunk_idx,
  'chunk' AS embedding_scope, 'unknown' AS embedding_model, 0 AS overlap, 'PENDING' AS status, 0 AS attempts,
  CAST(NULL AS VARCHAR) AS error_message, len(vector) AS dim FROM kb_embeddings""")

# ------------------------------------------------------------------------------- ingestion
CTE["requests"] = """requests AS (
  SELECT doc_id AS request_id, text, 'doc ' || CAST(doc_id AS VARCHAR) AS title,
    ['TEXT_INPUT', 'FILE', 'URI', 'WEB_SCRAPING', 'CONFLUENCE'][doc_id % 5 + 1] AS source_type,
    ['PUBLIC', 'INTERNAL', 'RESTRICTED'][doc_id % 3 + 1] AS access_level
  FROM documents),
validated AS (
  SELECT *, CASE
      WHEN NOT coalesce(access_level IN ('RESTRICTED', 'INTERNAL', 'PUBLIC'), false) THEN 'unknown access level'
      WHEN access_level = 'PUBLIC' AND NOT (access_level = 'RESTRICTED') THEN 'Public documents must be approved'
      WHEN title IS NULL OR trim(title) = '' THEN 'title is required'
      WHEN length(title) > 512 THEN 'title is longer than 512 characters'
      WHEN NOT coalesce(source_type IN ('TEXT_INPUT', 'FILE', 'URI', 'WEB_SCRAPING', 'CONFLUENCE'), false) THEN 'unknown source type'
    END AS error
  FROM requests)"""

SQL["ingest_status"] = with_ctes(["requests"], """
SELECT request_id AS doc_id, title, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error,
  error IS NULL AS has_document_id FROM validated""")

SQL["embedding_status"] = with_ctes(["kb_chunks", "kb_embeddings"], """
SELECT status, count(*) AS n_vectors, CAST(max(attempts) AS BIGINT) AS max_attempts, count(DISTINCT chunk_id) AS n_chunks
FROM kb_embeddings GROUP BY status""")

_INGEST = with_ctes(["requests", "doc_sents", "doc_chunks", "chunk_units", "chunk_windows"], """,
ok AS (SELECT request_id FROM validated WHERE error IS NULL),
nc AS (SELECT document_id, count(*) AS n_chunks FROM doc_chunks GROUP BY document_id),
nv AS (SELECT document_id, count(*) AS n_vectors FROM chunk_windows GROUP BY document_id)
SELECT ok.request_id AS doc_id, coalesce(nc.n_chunks, 0) AS n_chunks, coalesce(nv.n_vectors, 0) AS n_vectors
FROM ok LEFT JOIN nc ON nc.document_id = ok.request_id LEFT JOIN nv ON nv.document_id = ok.request_id""")
SQL["ingest_batch"] = _INGEST
SQL["ingest_stream"] = _INGEST

_ETOKS = "list_filter(regexp_split_to_array(lower(" + STRIP.format(x="coalesce(t, '')") + "), '" + B + "+'), lambda x: x <> '')"
SQL["ingest_embeddings"] = with_ctes(["doc_sents", "doc_chunks", "chunk_units", "chunk_windows"], """,
w AS (SELECT document_id, chunk_idx, s // 222 AS subchunk_idx,
        """ + STRIP.format(x="array_to_string(list_slice(u, s + 1, s + 254), '')") + """ AS t FROM chunk_windows),
b AS (SELECT document_id, chunk_idx, subchunk_idx,
        list_transform(""" + _ETOKS + """, lambda x: CAST(('0x' || substr(md5(x), 1, 8))::UBIGINT % 64 AS INTEGER)) AS bk FROM w),
c AS (SELECT document_id, chunk_idx, subchunk_idx, list_transform(range(64), lambda i: len(list_filter(bk, lambda x: x = i))) AS cnt
      FROM b)
SELECT document_id, chunk_idx, subchunk_idx, CAST(64 AS BIGINT) AS dim,
  CAST(CASE WHEN list_sum(list_transform(cnt, lambda x: x * x)) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm,
  CAST(cnt[1] AS BIGINT) AS bucket0_count, CAST(list_sum(list_transform(cnt, lambda x: x * x)) AS BIGINT) AS sum_sq_counts
FROM c""")

# ------------------------------------------------------------------------------- importance
CTE["imp"] = """imp AS (
  SELECT doc_id AS document_id, count(*) OVER (PARTITION BY fp) - 1 AS importance FROM (
    SELECT doc_id, sha256(lower(regexp_replace(""" + STRIP.format(x="coalesce(text, '')") + """, '""" + B + """+', ' ', 'g'))) AS fp
    FROM documents))"""
CTE["similar"] = """words AS (
  SELECT doc_id AS document_id, list_filter(string_split(lower(regexp_replace(""" + STRIP.format(x="coalesce(text, '')") + """, '""" + B + """+', ' ', 'g')), ' '),
    lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT document_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT document_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT document_id, count(*) AS n FROM grams GROUP BY document_id),
common AS (SELECT a.document_id AS x, b.document_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.document_id <> b.document_id GROUP BY ALL),
near AS (SELECT x, count(*) AS n FROM common JOIN sizes p ON p.document_id = x JOIN sizes q ON q.document_id = y WHERE 5 * c >= 4 * (p.n + q.n - c) GROUP BY x),
imp AS (SELECT doc_id AS document_id, coalesce(n, 0) AS importance FROM documents LEFT JOIN near ON x = doc_id)"""
SQL["importance_similar"] = with_ctes(["similar"], "SELECT document_id, importance FROM imp")
SQL["importance_exact"] = with_ctes(["imp"], "SELECT document_id, importance FROM imp")
_SELECTION = """,
r AS (SELECT d.document_id, d.created_at, i.importance,
        list_filter([CASE WHEN i.importance > 0.5 THEN 'important' END,
                      CASE WHEN d.created_at < TIMESTAMP '2024-01-10 00:00:00' AND i.importance > 0.5 THEN 'selected' END,
                      CASE WHEN d.created_at > TIMESTAMP '2024-01-20 00:00:00' AND i.importance < 0.5 THEN 'moderate' END],
                     lambda x: x IS NOT NULL) AS rs
      FROM kb_documents d JOIN imp i ON i.document_id = d.document_id)
SELECT document_id, created_at, importance, array_to_string(rs, ',') AS reasons FROM r WHERE len(rs) > 0"""
SQL["training_selection"] = with_ctes(["kb_documents", "imp"], _SELECTION)
SQL["training_selection_similar"] = with_ctes(["kb_documents", "similar"], _SELECTION)
SQL["rag_only_new"] = with_ctes(["kb_documents"], """
SELECT document_id, created_at,
  CASE WHEN created_at > TIMESTAMP '2024-01-28 00:00:00' THEN 'retrieval_only' ELSE 'training_candidate' END AS route,
  (SELECT count(*) FROM kb_documents WHERE created_at > TIMESTAMP '2024-01-28 00:00:00') >= 100 AS mass_reached
FROM kb_documents""")
SQL["recent_window"] = with_ctes(["kb_documents"], """
SELECT document_id, created_at FROM kb_documents
WHERE created_at >= (SELECT max(created_at) FROM kb_documents) - INTERVAL 3 DAY""")

# ------------------------------------------------------------------------------- report
CTE["monthly"] = """monthly0 AS (
  SELECT r.r_name, CAST(date_trunc('month', o.o_orderdate) AS TIMESTAMP) AS month, count(*) AS n_orders,
    round(sum(o.o_totalprice), 2) AS revenue
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, month),
monthly AS (
  SELECT a.*, b.revenue AS prev_revenue, round(a.revenue - b.revenue, 2) AS revenue_change
  FROM monthly0 a LEFT JOIN monthly0 b ON b.r_name = a.r_name AND b.month = a.month - INTERVAL 1 MONTH)"""
SQL["order_dynamics"] = with_ctes(["monthly"], "SELECT r_name, month, n_orders, revenue, prev_revenue, revenue_change FROM monthly")
SQL["problem_regions"] = with_ctes(["monthly"], """,
last AS (SELECT * FROM monthly WHERE month = (SELECT max(month) FROM monthly))
SELECT r_name, month, n_orders, revenue, revenue_change, round((SELECT avg(revenue_change) FROM last), 2) AS avg_change,
  coalesce(revenue_change < (SELECT avg(revenue_change) FROM last), false) AS is_problem FROM last""")



CTE["fragments"] = """sel AS (
  SELECT d.document_id FROM kb_documents d JOIN imp i ON i.document_id = d.document_id
  WHERE d.created_at < TIMESTAMP '2024-01-10 00:00:00' AND i.importance > 0.5),
fc AS (SELECT c.document_id, c.chunk_idx, c.chunk_text FROM doc_chunks c WHERE c.document_id IN (SELECT document_id FROM sel)),
fb AS (SELECT document_id, chunk_idx,
         list_transform(list_filter(regexp_split_to_array(lower(""" + STRIP.format(x="coalesce(chunk_text, '')") + """), '""" + B + """+'),
                                    lambda x: x <> ''),
                        lambda x: CAST(('0x' || substr(md5(x), 1, 8))::UBIGINT % 64 AS INTEGER)) AS bk FROM fc),
fcnt AS (SELECT document_id, chunk_idx,
           list_transform(range(64), lambda i: CAST(len(list_filter(bk, lambda x: x = i)) AS DOUBLE)) AS cnt FROM fb),
fv AS (SELECT document_id, chunk_idx,
         CASE WHEN list_sum(list_transform(cnt, lambda x: x * x)) > 0
              THEN list_transform(cnt, lambda x: x / sqrt(list_sum(list_transform(cnt, lambda y: y * y))))
              ELSE list_transform(cnt, lambda x: 0.0) END AS v FROM fcnt),
fcomp AS (SELECT document_id, i, avg(v[i + 1]) AS m FROM (SELECT document_id, v, unnest(range(64)) AS i FROM fv)
          GROUP BY document_id, i),
fcent AS (SELECT document_id, list(m ORDER BY i) AS c FROM fcomp GROUP BY document_id),
fd AS (SELECT v.document_id, v.chunk_idx,
         round(CASE WHEN list_dot_product(v.v, v.v) = 0 OR list_dot_product(c.c, c.c) = 0 THEN 1.0
               ELSE 1.0 - list_dot_product(v.v, c.c) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(c.c, c.c)))
               END, 9) AS dist
       FROM fv v JOIN fcent c ON c.document_id = v.document_id)"""
SQL["selected_fragments"] = with_ctes(["kb_documents", "imp", "doc_sents", "doc_chunks", "fragments"], """
SELECT document_id, chunk_idx, fragment_rank, round(dist, 6) AS centroid_distance FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY dist, chunk_idx) AS fragment_rank FROM fd)
WHERE fragment_rank <= 2""")

SQL["conform_chunks"] = with_ctes(["doc_sents", "doc_chunks"], """
SELECT document_id * 1000000 + chunk_idx AS chunk_id, document_id, chunk_idx % 2 = 0 AS is_hot, chunk_idx,
  'sentence' AS chunk_scope, 0 AS overlap, length(chunk_text) AS text_length FROM doc_chunks""")

SQL["dialog_stream"] = SQL["dialog_history"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
