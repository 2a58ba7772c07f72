"""The same results in SQL, from the tables alone.

Where a query parses model answers, the expected row follows from the
document's kind, its text and its words; nothing here parses an answer.
"""

from __future__ import annotations

from workload.inputs import CHUNKS, KINDS, MANY_CHUNKS, PART_ROWS, WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_FOUND = "NULL"
for _word in reversed(WORDS):
    _hit = f"CASE WHEN list_contains(tokens, {_text(_word)}) THEN [{_text(_word)}] ELSE [] END"
    _FOUND = _hit if _FOUND == "NULL" else f"list_concat({_hit}, {_FOUND})"
_URL = "'https://posts.example/reviewer/status/' || doc_id"

_DOCS = rf"""
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS item_id, text, lang, source,
         CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id,
         doc_id % {KINDS} AS kind, {_URL} AS url,
         regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS tokens
  FROM documents
),
posts AS (
  SELECT *, CASE WHEN len(found) > 0 THEN 'DELETE' ELSE 'KEEP' END AS flagged
  FROM (SELECT *, {_FOUND} AS found FROM docs)
)"""

_STRIPPED = "replace(replace(text, '```json', ''), '```', '')"

# One row per answer line. n is the line's number within the post.
_ANSWERS = f"""{_DOCS},
answers AS (
  SELECT *, 1 AS n FROM posts WHERE kind <> 7
  UNION ALL
  SELECT *, 2 AS n FROM posts WHERE kind = 12
),
parsed AS (
  SELECT doc_id, chunk_id, kind, n, found,
         CASE WHEN kind NOT IN (6, 8) THEN item_id END AS item_id,
         CASE WHEN kind IN (6, 8) THEN NULL WHEN kind = 11 THEN '' ELSE url END AS url,
         CASE WHEN kind IN (6, 8) THEN 'bad_line' WHEN kind = 5 THEN 'no_text'
              WHEN kind IN (2, 3, 4) THEN 'bad_verdict' END AS fail_reason,
         CASE WHEN kind = 9 THEN NULL WHEN kind = 10 THEN 'N/A'
              WHEN n = 2 THEN (CASE WHEN flagged = 'DELETE' THEN 'KEEP' ELSE 'DELETE' END)
              ELSE flagged END AS deletion,
         CASE WHEN kind <> 14 THEN array_to_string(list_sort(found), ',') END AS words,
         {_STRIPPED} AS reason, lang || ',' || source AS topics
  FROM answers
),
good AS (SELECT * FROM parsed WHERE fail_reason IS NULL)"""

_RULE_REASON = "CASE WHEN len(found) > 0 THEN 'Contains forbidden words' ELSE 'No forbidden words' END"
_LABEL_REASON = "'label, quality ' || quality"
_LABEL_DELETION = "CASE WHEN toxic = 1 THEN 'DELETE' ELSE 'KEEP' END"

_MIXED = f"""{_DOCS},
mixed AS (
  SELECT p.item_id, p.chunk_id, p.url, l.doc_id IS NOT NULL AS labelled,
         CASE WHEN l.doc_id IS NOT NULL THEN {_LABEL_DELETION} ELSE flagged END AS deletion,
         CASE WHEN l.doc_id IS NOT NULL THEN {_LABEL_REASON} ELSE {_RULE_REASON} END AS reason
  FROM posts p LEFT JOIN labels l ON l.doc_id = p.doc_id
)"""

# The prompt as a model must get it, written out for the criteria of the queries.
_HEAD = """
        Analyze this tweet and determine if it should be flagged for deletion.

        Tweet: \""""
_TAIL = """"

        Criteria for flagging
        Forbidden words: license, token, apache, mit
Topics to exclude: Legal notices, Access data
Tone requirements: Plain language
Additional instructions: Look for 100% of the words above

        CRITICAL INSTRUCTIONS:
        1. Respond ONLY with valid JSON - no markdown, no code blocks, no explanations
        2. Do NOT wrap your response in ```json or ``` tags
        3. Use double quotes for all strings
        4. Ensure "deletion" is EXACTLY either "DELETE" or "KEEP" (all caps)
        5. If no explicit words found, use empty array []
        6. All arrays must be properly formatted


        Example of VALID response:
        {
        "explicit_words": ["damn"],
        "reason_for_flag": "Contains mild profanity",
        "topic_of_tweet": ["complaint", "frustration"],
        "deletion": "DELETE"
        }

        Example of VALID response (no issues):
        {
        "explicit_words": [],
        "reason_for_flag": "Tweet is clean and appropriate",
        "topic_of_tweet": ["technology", "news"],
        "deletion": "KEEP"
        }

        Now analyze the tweet above and respond with ONLY the JSON object
        """
_PROMPT = f"{_text(_HEAD)} || text || {_text(_TAIL)}"

_ODD = """
odd AS (
  SELECT doc_id, doc_id % 7 AS o, CAST(doc_id AS VARCHAR) AS num FROM documents
),
ids AS (
  SELECT doc_id,
         CASE o WHEN 0 THEN 'n' || num WHEN 1 THEN 'n' || num WHEN 2 THEN NULL WHEN 3 THEN NULL
                WHEN 4 THEN ' ' || chr(160) || num || chr(9) WHEN 5 THEN 'unknown' ELSE num END AS item_id,
         CASE o WHEN 0 THEN 'n' || num WHEN 1 THEN 'n' || num WHEN 2 THEN NULL WHEN 3 THEN NULL
                WHEN 4 THEN num WHEN 5 THEN 'unknown' ELSE num END AS store_key
  FROM odd
)"""

ORACLES = {
    "scan_archive": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(doc_id - {PART_ROWS} * (doc_id // {PART_ROWS}) AS INTEGER) AS pos,
               text AS item_text FROM documents""",
    "scan_responses": "SELECT unnest(string_split(text, chr(10))) AS line FROM documents",
    "resolve_id": f"""
        WITH {_ODD} SELECT doc_id, item_id, store_key, coalesce(item_id, 'unknown') AS request_key FROM ids""",
    "drop_invalid_ids": f"""
        WITH {_ODD} SELECT doc_id, item_id,
          CASE WHEN item_id IS NULL OR item_id = 'unknown' THEN 'no_id' ELSE 'kept' END AS outcome FROM ids""",
    "build_url": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, {_URL} AS tweet_url FROM documents",
    "assign_chunk": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id FROM documents""",
    "select_chunk": f"""
        SELECT CAST(doc_id % {CHUNKS} AS INTEGER) AS chosen, CAST(doc_id AS VARCHAR) AS item_id FROM documents""",
    "render_prompt": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, {_PROMPT} AS prompt FROM documents",
    "build_requests": f"""
        SELECT CAST(doc_id AS VARCHAR) AS key, {_URL} AS tweet_url, {_PROMPT} AS prompt,
               CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id FROM documents""",
    "score_rules": f"""
        WITH {_DOCS} SELECT item_id, array_to_string(list_sort(found), ',') AS words, flagged AS deletion FROM posts""",
    "score_with_client": f"""
        WITH {_DOCS} SELECT item_id, url AS item_url, array_to_string(list_sort(found), ',') AS words,
                            flagged AS deletion FROM posts""",
    "response_lines": f"""
        WITH {_ANSWERS} SELECT chunk_id, item_id, item_id IS NOT NULL AS carries_key FROM parsed""",
    "extract_text": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_URL} END AS item_url,
               text AS answer FROM documents""",
    "validate_verdict": f"""
        WITH {_ANSWERS} SELECT item_id, fail_reason IS NULL AS is_verdict FROM parsed WHERE item_id IS NOT NULL""",
    "parse_verdict": f"""
        WITH {_ANSWERS} SELECT item_id, url AS item_url, words, reason, topics, deletion,
          CASE WHEN kind = 13 THEN 'confidence,note' ELSE '' END AS extra_keys,
          CASE WHEN kind = 13 THEN '{{"by":"a","at":[1]}}' END AS note, chunk_id FROM good""",
    "response_stats": f"""
        WITH {_ANSWERS} SELECT chunk_id, count(*) FILTER (fail_reason IS NULL) AS n_ok,
          count(*) FILTER (fail_reason IS NOT NULL) AS n_failed, count(*) AS n_total FROM parsed GROUP BY chunk_id""",
    "failures_by_reason": f"""
        WITH {_ANSWERS} SELECT 'parse' AS stage, fail_reason, count(*) AS n_lines, count(item_id) AS n_ids
        FROM parsed WHERE fail_reason IS NOT NULL GROUP BY fail_reason""",
    "failed_ids": f"""
        WITH {_ANSWERS} SELECT chunk_id, item_id, 'parse' AS stage, fail_reason FROM parsed
        WHERE fail_reason IS NOT NULL AND item_id IS NOT NULL""",
    "collect_responses": f"""
        WITH {_ANSWERS} SELECT item_id, coalesce(fail_reason, 'verdict') AS outcome,
          CASE WHEN fail_reason IS NULL THEN deletion END AS deletion FROM parsed""",
    "store_latest": f"WITH {_MIXED} SELECT item_id, deletion, reason FROM mixed",
    "store_upsert": f"""
        WITH {_ANSWERS} SELECT item_id AS store_key, arg_max(struct_pack(d := deletion), n).d AS deletion,
          count(*) AS n_rows FROM good GROUP BY item_id""",
    "store_clear": f"SELECT CAST(doc_id AS VARCHAR) AS item_id, {_LABEL_DELETION} AS deletion FROM labels",
    "store_compact": f"WITH {_MIXED} SELECT item_id, deletion, 'r2-compact' AS run_id FROM mixed",
    "pending_anti_join": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id, text AS item_text
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "cached_semi_join": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "cached_lookup": f"WITH {_MIXED} SELECT item_id, chunk_id, deletion, reason FROM mixed WHERE labelled",
    "missing_items": f"""
        WITH {_DOCS} SELECT item_id, chunk_id FROM posts WHERE kind BETWEEN 2 AND 8""",
    "cache_stats": f"""
        WITH {_MIXED} SELECT chunk_id, count(*) AS n_total, count(*) FILTER (NOT labelled) AS n_uncached,
          count(*) FILTER (labelled) AS n_cached FROM mixed GROUP BY chunk_id""",
    "merge_dedupe": """
        SELECT CAST(conv_id AS VARCHAR) AS item_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) = 1""",
    "merge_by_chunk": """
        SELECT CAST(conv_id AS VARCHAR) AS item_id,
               CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS INTEGER) AS chunk_id,
               min(turn) AS turn
        FROM conversations GROUP BY ALL""",
    "keep_last": """
        SELECT CAST(conv_id AS VARCHAR) AS item_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "report_csv": f"""
        WITH {_ANSWERS} SELECT chunk_id, url AS tweet_url, deletion FROM good
        WHERE deletion IS DISTINCT FROM 'N/A' AND url <> ''""",
    "report_full": f"""
        WITH {_ANSWERS} SELECT chunk_id, item_id AS tweet_id, url AS tweet_url, deletion, reason,
          CASE WHEN kind = 14 THEN 'none'
               WHEN len(found) = 0 THEN '[]'
               ELSE '["' || array_to_string(found, '","') || '"]' END AS words_json,
          CASE WHEN kind = 13 THEN CAST(0.5 AS DOUBLE) END AS confidence FROM good""",
    "chunk_completeness": f"""
        WITH {_DOCS} SELECT CAST(r.range AS INTEGER) AS chunk_id FROM range({MANY_CHUNKS}) r
        WHERE r.range NOT IN (SELECT doc_id % {MANY_CHUNKS} FROM posts WHERE flagged = 'DELETE')""",
    "coverage_stats": f"""
        WITH {_MIXED},
        all_posts AS (
          SELECT p.chunk_id, p.kind, l.doc_id IS NOT NULL AS labelled FROM posts p LEFT JOIN labels l ON l.doc_id = p.doc_id
        )
        SELECT chunk_id, count(*) AS n_total, count(*) FILTER (NOT labelled) AS n_uncached,
          count(*) FILTER (labelled) AS n_cached,
          CAST(coalesce(sum(CASE WHEN labelled OR kind BETWEEN 2 AND 8 THEN 0 WHEN kind = 12 THEN 2 ELSE 1 END), 0) AS BIGINT) AS n_ok,
          count(*) FILTER (NOT labelled AND kind BETWEEN 2 AND 8 AND kind <> 7) AS n_failed,
          count(*) FILTER (labelled OR kind NOT BETWEEN 2 AND 8) AS n_merged,
          count(*) FILTER (NOT labelled AND kind BETWEEN 2 AND 8) AS n_missing
        FROM all_posts GROUP BY chunk_id""",
    "run_audit": f"WITH {_MIXED} SELECT item_id, chunk_id, url AS tweet_url, deletion, reason FROM mixed",
    "merge_reports": f"WITH {_MIXED} SELECT url AS tweet_url, deletion FROM mixed",
    # The answers of the first run stay, of two lines the last one; the rest
    # gets the rule's verdict.
    "run_audit_rerun": f"""
        WITH {_ANSWERS}
        SELECT item_id, arg_max(struct_pack(d := deletion), n).d AS deletion, any_value(reason) AS reason
        FROM good GROUP BY item_id
        UNION ALL
        SELECT item_id, flagged AS deletion, {_RULE_REASON} AS reason FROM posts WHERE kind BETWEEN 2 AND 8""",
    "score_resumed": f"WITH {_DOCS} SELECT item_id, CAST(1 AS BIGINT) AS n_answers, flagged AS deletion FROM posts",
    "score_with_failures": f"""
        WITH {_DOCS} SELECT item_id, chunk_id, CASE WHEN chunk_id NOT IN (2, 3) THEN flagged END AS deletion,
          CASE WHEN chunk_id IN (2, 3) THEN 'submit_failed' END AS fail_reason,
          CAST(CASE chunk_id WHEN 2 THEN 3 WHEN 3 THEN 1 END AS INTEGER) AS attempt FROM posts""",
    "match_dictionary": r"""
        WITH words AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        entries AS (
          SELECT DISTINCT w[i] || ' ' || w[i + 1] AS entry
          FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)
        ),
        docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        pairs AS (
          SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS entry
          FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs WHERE len(w) > 1)
        ),
        found AS (
          SELECT doc_id, count(*) AS n, string_agg(entry, ',' ORDER BY entry) AS listed
          FROM pairs JOIN entries USING (entry) GROUP BY doc_id
        )
        SELECT CAST(d.doc_id AS VARCHAR) AS item_id, CAST(coalesce(n, 0) AS INTEGER) AS n_found, md5(coalesce(listed, '')) AS found_md5
        FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "collect_two_streams": f"WITH {_ANSWERS} SELECT item_id, deletion FROM good UNION ALL SELECT item_id, deletion FROM good",
    "assign_chunk_parts": f"""
        SELECT CAST(n % {MANY_CHUNKS} AS INTEGER) AS chunk_id, count(*) AS n_posts
        FROM (SELECT row_number() OVER () - 1 AS n FROM documents) GROUP BY ALL""",
    "empty_chunks": """
        WITH posts AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 13 WHEN 'de' THEN 26 ELSE 39 END AS chunk FROM documents)
        SELECT CAST(r.range AS INTEGER) AS chunk_id, CAST(3 AS BIGINT) AS n_outputs, count(chunk) AS n_rows
        FROM range(50) r LEFT JOIN posts ON chunk = r.range GROUP BY r.range""",
    "merge_ordered": f"""
        SELECT row_number() OVER (ORDER BY doc_id % {CHUNKS}) - 1 AS number, CAST(doc_id % {CHUNKS} AS INTEGER) AS chunk_id FROM documents""",
    "merge_written": f"WITH {_MIXED} SELECT url AS tweet_url, deletion FROM mixed",
    "merge_report_files": f"""
        WITH {_DOCS} SELECT url AS tweet_url, CASE WHEN chunk_id <> 2 THEN flagged END AS deletion FROM posts""",
    "audit_from_archive": f"WITH {_DOCS} SELECT item_id, url AS tweet_url, flagged AS deletion, {_RULE_REASON} AS reason FROM posts",
    "audit_new_criteria": f"WITH {_DOCS} SELECT item_id, flagged AS deletion, {_RULE_REASON} AS reason FROM posts",
    "retry_what_is_missing": f"WITH {_DOCS} SELECT item_id FROM posts WHERE kind IN (6, 7, 8)",
}
ORACLES["requests_jsonl"] = ORACLES["build_requests"]
