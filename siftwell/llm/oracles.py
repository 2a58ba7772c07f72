"""SQL for the queries that SQL can express; the others are tested against brute force, round trips or held-out accuracy."""

from __future__ import annotations

from siftwell.llm.quality import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of words as texts, whether a window is found twice, and the words that such windows cover.
_PASSAGES = rf"""
    WITH words AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
      FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents)
    ),
    windows AS (
      SELECT doc_id, p, word, md5(string_agg(word, ' ') OVER o) AS h, count(*) OVER o AS n
      FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
    ),
    marked AS (SELECT *, n = 35 AND count(*) FILTER (n = 35) OVER (PARTITION BY h) > 1 AS again FROM windows),
    covered AS (
      SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM marked
    )
    SELECT d.doc_id, count(p) AS n_words, count(p) FILTER (gone) AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
    FROM documents d LEFT JOIN covered c USING (doc_id) GROUP BY d.doc_id"""

_PHRASES = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ),
    cut AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut),
    runs AS (
      SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4
      FROM words WINDOW o AS (PARTITION BY id ORDER BY p)
    ),
    every AS (
      SELECT lang, w1 AS phrase, 1 AS m FROM runs
      UNION ALL SELECT lang, concat_ws(' ', w1, w2), 2 FROM runs WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 3 FROM runs WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4), 4 FROM runs WHERE w4 IS NOT NULL
    ),
    f AS (SELECT lang, phrase, m, count(*) AS a, string_split(phrase, ' ') AS w FROM every GROUP BY lang, phrase, m HAVING count(*) >= 30),
    cuts AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    scored AS (
      SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score
      FROM cuts c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
    ),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    parts AS (
      SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS part
      FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS n FROM f WHERE m > 2))
    ),
    longer AS (SELECT lang, part, max(a) AS most FROM parts GROUP BY lang, part),
    kept AS (
      SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase
      WHERE g.most IS NULL OR CAST(100 AS HUGEINT) * g.most < CAST(80 AS HUGEINT) * s.a
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
    totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

#: From the last row to the first: for each state of the pattern the cheapest edits of what follows, least audit first.
_REPAIR = r"""
    WITH RECURSIVE
    crcs AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
    ),
    sums AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce(
          list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
      FROM conversations, crcs
    ),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM sums WHERE kind <> 0)
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    judged AS (
      SELECT *, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_initial,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
      FROM placed
    ),
    faulty AS (
      SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
      FROM judged
    ),
    steps AS (
      SELECT conv_id, i, initial, role || ':' || text AS line, text,
        fault IN ('blank', 'duplicate') AS out, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM faulty
    ),
    best AS (
      SELECT conv_id, max(i) + 1 AS i,
        {'c': 0, 'a': '', 'l': CAST(NULL AS VARCHAR)} AS s0, {'c': 10, 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:'} AS s1,
        {'c': 5, 'a': 'I', 'l': 'assistant:'} AS s2, {'c': 0, 'a': '', 'l': CAST(NULL AS VARCHAR)} AS s3
      FROM steps GROUP BY conv_id
      UNION ALL
      SELECT conv_id, i,
        list_min([b0, {'c': 5 + u.c, 'a': 'I' || u.a, 'l': concat_ws(chr(10), 'user:', u.l)}]),
        list_min([b1, {'c': 5 + u.c, 'a': 'I' || u.a, 'l': concat_ws(chr(10), 'user:', u.l)}]), u, v
      FROM (
        SELECT *, list_min([b2, {'c': 5 + b3.c, 'a': 'I' || b3.a, 'l': concat_ws(chr(10), 'assistant:', b3.l)}]) AS u,
          list_min([b3, {'c': 5 + b2.c, 'a': 'I' || b2.a, 'l': concat_ws(chr(10), 'user:', b2.l)}]) AS v
        FROM (
          SELECT r.conv_id, r.i,
            list_min(list_filter([
              {'c': 2 + s0.c, 'a': 'D' || s0.a, 'l': s0.l},
              CASE WHEN NOT out AND initial = 's' THEN {'c': more + s1.c, 'a': 'K' || s1.a, 'l': concat_ws(chr(10), line, s1.l)} END,
              CASE WHEN NOT out AND initial = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 'l': concat_ws(chr(10), line, s2.l)} END,
              CASE WHEN NOT out THEN {'c': more + 1 + s2.c, 'a': 'R' || s2.a, 'l': concat_ws(chr(10), 'user:' || text, s2.l)} END], lambda x: x IS NOT NULL)) AS b0,
            list_min(list_filter([
              {'c': 2 + s1.c, 'a': 'D' || s1.a, 'l': s1.l},
              CASE WHEN NOT out AND initial = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 'l': concat_ws(chr(10), line, s2.l)} END,
              CASE WHEN NOT out THEN {'c': more + 1 + s2.c, 'a': 'R' || s2.a, 'l': concat_ws(chr(10), 'user:' || text, s2.l)} END], lambda x: x IS NOT NULL)) AS b1,
            list_min(list_filter([
              {'c': 2 + s2.c, 'a': 'D' || s2.a, 'l': s2.l},
              CASE WHEN NOT out AND initial = 'a' THEN {'c': more + s3.c, 'a': 'K' || s3.a, 'l': concat_ws(chr(10), line, s3.l)} END,
              CASE WHEN NOT out THEN {'c': more + 1 + s3.c, 'a': 'R' || s3.a, 'l': concat_ws(chr(10), 'assistant:' || text, s3.l)} END], lambda x: x IS NOT NULL)) AS b2,
            list_min(list_filter([
              {'c': 2 + s3.c, 'a': 'D' || s3.a, 'l': s3.l},
              CASE WHEN NOT out AND initial = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 'l': concat_ws(chr(10), line, s2.l)} END,
              CASE WHEN NOT out THEN {'c': more + 1 + s2.c, 'a': 'R' || s2.a, 'l': concat_ws(chr(10), 'user:' || text, s2.l)} END], lambda x: x IS NOT NULL)) AS b3
          FROM best JOIN steps r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i - 1
        )
      )
    ),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM faulty GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.s0.c, 0) AS BIGINT) AS cost,
      coalesce(b.s0.a, '') AS audit, sha256(coalesce(b.s0.l, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1"""

#: Turns with what the template adds to them; the extra conversation's texts are control strings.
_CHAT = r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ),
    placed AS (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS begins,
        length(text) + len(regexp_extract_all(text, '<~*\|')) AS chars, length(role) + len(regexp_extract_all(role, '<~*\|')) AS role_chars
      FROM turns
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars + CASE WHEN begins THEN length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END) AS BIGINT) AS formatted_chars
    FROM placed GROUP BY conv_id"""


def _quality() -> str:
    """The rules with the bounds of the table in use, written out."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS for w in line.split()}))
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {blank}) <> '') AS lines
      FROM documents
    ),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
    windows AS (
      SELECT doc_id, p, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
      FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)
    ),
    marked AS (SELECT *, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) > 1 AS again FROM windows),
    covered AS (
      SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM marked
    ),
    counted AS (SELECT doc_id, count(*) FILTER (inside) AS repeated, count(*) FILTER (lower(word) IN ({stop})) AS stops FROM covered GROUP BY doc_id),
    measured AS (
      SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words, coalesce(stops, 0) AS stops,
        len(list_filter(lines, lambda x: left(ltrim(x, {blank}), 1) IN ('-', '*', chr(8226)))) AS bullets,
        len(list_filter(lines, lambda x: right(rtrim(x, {blank}), 3) = '...' OR right(rtrim(x, {blank}), 1) = chr(8230))) AS ellipses
      FROM texts t LEFT JOIN counted c USING (doc_id)
    ),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols <= 0.5 * n_words AND stops >= 0.005 * n_words
        AND n_dup_lines <= 0.5 * n_lines AND bullets <= 0.9 * n_lines AND ellipses <= 0.5 * n_lines AS kept
    FROM judged"""


ORACLES: dict[str, str] = {
    "op6_chat_formatting": _CHAT,
    "op9_quality_rules": _quality(),
    "op11_son_collocations": _PHRASES,
    "op12_path_repair": _REPAIR,
    "op13_prefix_suffix_trees": _PASSAGES,
}
