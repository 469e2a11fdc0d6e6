"""DuckDB statements that give the rows of registered queries."""

from __future__ import annotations

from virosieve.llm import quality_rules

OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1#\2', 'g')) AS role_chars,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1#\2', 'g')) AS text_chars
  FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + length('[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM sized
GROUP BY conv_id
"""


def _op9(limits: quality_rules.Limits = quality_rules.DEFAULT) -> str:
    half = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) / 2 ELSE 0 END"
    both = lambda p, q: f"({half(p, q)} + {half(q, p)})"
    shown = ["[A-Z]", "[0-9]", r"[!\x22''()+,./:;=?@\[\x5C\]^_`{}~-]", "[#*$%&|<>]"]
    classes = [f"len(regexp_extract_all(t, '{c}'))" for c in shown]
    k = range(quality_rules.CLASSES)
    class_terms = " + ".join(both(f"(k{i} / size)", f"r{i}") for i in k)
    return rf"""
WITH langs AS (
  SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {limits.max_languages}
), texts AS (
  SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM langs) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), counted AS (
  SELECT doc_id, lang, t, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(coalesce(array_to_string(words, ''), '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM split
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM counted)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), shares AS (
  SELECT doc_id, lang, CAST(length(t) AS DOUBLE) AS size, {", ".join(f"{c} AS k{i}" for i, c in enumerate(classes))},
         length(t) - word_chars AS k4, length(t) - ({" + ".join(classes)}) - (length(t) - word_chars) AS k5
  FROM counted
), lowered AS (
  SELECT doc_id, lang, lower(unnest(words)) AS word FROM counted
), totals AS (
  SELECT lang, count(*) AS n FROM lowered GROUP BY lang HAVING count(*) >= {limits.min_reference_words}
), common AS (
  SELECT lang, word, n, CAST(c AS DOUBLE) / n AS q FROM (
    SELECT lang, word, count(*) AS c, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM lowered GROUP BY lang, word
  ) JOIN totals USING (lang) WHERE rank <= {limits.common_words}
), all_q AS (
  SELECT lang, sum(q) AS all_q FROM common GROUP BY lang
), class_reference AS (
  SELECT lang, {", ".join(f"sum(k{i}) / sum(size) AS r{i}" for i in k)} FROM shares JOIN totals USING (lang) GROUP BY lang HAVING sum(size) > 0
), class_distances AS (
  SELECT doc_id, CASE WHEN size > 0 THEN sqrt(greatest(least({class_terms}, 1), 0)) END AS class_distance
  FROM shares JOIN class_reference USING (lang)
), runs AS (
  SELECT doc_id, lang, q, CAST(count(*) AS DOUBLE) / any_value(n_words) AS p
  FROM lowered JOIN common USING (lang, word) JOIN (SELECT doc_id, n_words FROM counted) USING (doc_id) GROUP BY doc_id, lang, word, q
), seen AS (
  SELECT doc_id, sum(p) AS p, sum(q) AS q, sum({both("p", "q")}) AS terms FROM runs GROUP BY doc_id
), word_distances AS (
  SELECT doc_id, CASE WHEN n_words > 0 THEN sqrt(greatest(least(coalesce(terms, 0) + (all_q - coalesce(q, 0)) / 2
         + {both("greatest(1 - coalesce(p, 0), 0)", "greatest(1 - all_q, 0)")}, 1), 0)) END AS word_distance
  FROM counted JOIN all_q USING (lang) LEFT JOIN seen USING (doc_id)
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         n_words < {limits.min_words} OR 100 * coalesce(n_repeat_words, 0) > {limits.max_repeat_percent} * n_words AS base_failed,
         coalesce(class_distance, 0) <= {limits.max_class_distance}
           AND coalesce(word_distance, 0) <= {limits.max_word_distance} + 1 / sqrt(greatest(n_words, 1)) AS near
  FROM counted LEFT JOIN repeated USING (doc_id) LEFT JOIN class_distances USING (doc_id) LEFT JOIN word_distances USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged
"""


OP11 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), phrases AS (
  SELECT lang, size, words[i:i + size - 1] AS w FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(words)
), counts AS (
  SELECT lang, size, w, count(*) AS f FROM phrases GROUP BY lang, size, w HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT c.lang, c.size, c.w, c.f AS a, k, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n,
         CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts) c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.w = c.w[1:k]
  JOIN counts y ON y.lang = c.lang AND y.w = c.w[k + 1:c.size]
), candidates AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a AS longer, w[s:s + z - 1] AS w FROM (SELECT *, unnest(range(2, size)) AS z FROM candidates), (SELECT unnest([1, 2, 3, 4]) AS s)
  WHERE s + z - 1 <= size
)
SELECT lang, row_number() OVER best AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, score
FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = c.lang AND i.w = c.w AND 100 * i.longer >= 100 * c.a)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' '))
QUALIFY row_number() OVER best <= 2000
"""

OP12 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


def llm_oracles() -> dict[str, str]:
    return {"op11_collocations": OP11, "op12_hard_negatives": OP12, "op7_chat_formatting": OP7, "op9_distribution_quality_rules": _op9()}
