"""DuckDB SQL for the queries of the training-data operators that SQL can express.

The others rest on tables or iterations that SQL has no form for: hundreds of rules (2), markup (3), a tokenizer's
merges (4, 9), a checksum (12), every window of every text as a row (6), slot bookkeeping (7), and scores that are iterated over graphs (8, 10). Tests hold those against
brute-force versions.
"""

from __future__ import annotations

from .chat import TURN_END, TURN_START
from .quality import BOILERPLATE, MARKS, SEPARATORS, SYMBOLS, LineRules
from .queries import MARKED

_R = LineRules()
_SPACE = r"[\x20\x09-\x0D]+"
_SETS = f"""w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) END AS f FROM w)"""


def _has_phrase(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in BOILERPLATE) + ")"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda z: z <> '')"


def _share(test: str, percent: int) -> str:
    return f"(n >= {_R.min_rule_words} AND {test} * 100 > n * {percent})"


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE {_SETS},
  c AS (SELECT f, min(doc_id) AS class_id, len(f) AS n FROM s WHERE len(f) > 0 GROUP BY f),
  x AS (SELECT class_id, n, unnest(f) AS g FROM c),
  p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x AS a JOIN x AS b ON a.g = b.g AND a.class_id < b.class_id GROUP BY ALL),
  e AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 90 * (na + nb - k)),
  r AS (SELECT class_id AS node, class_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
  m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.f) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.f = c.f LEFT JOIN m ON c.class_id = m.node""",
    "op5_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, {_words("t")} AS w FROM d),
  g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  q AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, ls[i] AS x, coalesce(ls[i + 1], '') AS y, {_words("ls[i]")} AS v FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
  f AS (SELECT doc_id, x, y, len(v) AS n, len(list_filter(v, lambda z: regexp_matches(z, '[#*$%&|<>]'))) AS symbols, len(list_filter(v, lambda z: len(regexp_extract_all(z, '\\p{{Lu}}')) > 1 AND NOT regexp_matches(z, '\\p{{Ll}}'))) AS caps,
    len(list_filter(v, lambda z, i: i > 1 AND z = v[i - 1])) AS echo, len(list_filter(v, lambda z: list_contains([{", ".join(f"'{p}'" for p in SEPARATORS)}], z))) AS seps FROM l),
  o AS (SELECT doc_id, sum(n) FILTER (WHERE {_share("symbols", _R.max_symbol_words_pct)} OR {_share("caps", _R.max_caps_words_pct)} OR {_share("echo", _R.max_echo_words_pct)} OR (seps >= {_R.min_separators} AND seps * 6 >= n) OR {_has_phrase("x")}
      OR (n >= {_R.min_unmarked_words} AND NOT regexp_matches(x, '[{MARKS}]') AND NOT regexp_matches(trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^[\\p{{Ll}}\\p{{Lo}}]'))) AS lost,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS dups FROM f GROUP BY doc_id),
  a AS (SELECT w.doc_id, len(w) AS n, length(array_to_string(w, '')) AS chars, length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS symbols, dups, coalesce(n_repeat, 0) AS n_repeat, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN q ON w.doc_id = q.doc_id LEFT JOIN o ON w.doc_id = o.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
  n < {_R.min_base_words} OR 100 * n_repeat > {_R.max_repeat_pct} * n AS base_failed, NOT (n < {_R.min_base_words} OR 100 * n_repeat > {_R.max_repeat_pct} * n) AND lost * 100 <= n * {_R.max_lost_pct} AS kept, CAST(lost AS BIGINT) AS n_lost_words FROM a""",
    "op11_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '{MARKED}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
  m AS (SELECT conv_id, string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant') AS trained,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS lines, count(*) AS n_turns,
    sum({len(TURN_START) + len(TURN_END) + 3} + length(regexp_replace(role, '([<>\\\\])', '\\1\\1', 'g')) + length(regexp_replace(text, '([<\\\\])', '\\1\\1', 'g'))) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(coalesce(trained, '')) AS loss_chars, sha256(coalesce(trained, '')) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM m""",
    "op13_filter_audit": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
  w AS (SELECT *, {_words("t")} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
  l AS (SELECT doc_id, CAST(bool_or(quality = 1) AS INTEGER) AS good, CAST(bool_or(toxic = 1) AS INTEGER) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
  o AS (SELECT '' AS o, 0 AS seen, 0 AS step, 0 AS bit UNION ALL SELECT o || chr(65 + i), seen | bit, step + 1, 1 << i FROM o, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE (seen | bit) & (1 << i) = 0 AND step < 5),
  s AS (SELECT a.o AS filter_order, b.step, b.bit, b.seen FROM o AS a JOIN o AS b ON a.step = 5 AND b.step > 0 AND starts_with(a.o, b.o)),
  r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (seen | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & seen = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & seen <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & seen = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & seen = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
