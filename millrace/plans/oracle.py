"""DuckDB SQL for the screening queries that SQL can express."""

from __future__ import annotations

from . import inline, phone_sql, taxonomy
from .queries import STARTS
from ..operators.detect import INJECTION_PHRASES, ODD_DIGITS, ODD_LETTERS
from ..sources.policy import REPLY_FIELD, Policy, regions

_EMAIL = r"[[:alnum:]._%+-]{1,64}@[ \t]{0,3}[[:alnum:].-]{1,255}[.][[:alpha:]]{2,24}"
_D = "[0-9LMNPQRSTUVlmnpqrstuv]"
_FISCAL = rf"\b[A-Za-z]{{6}}{_D}{{2}}[ABCDEHLMPRSTabcdehlmprst]{_D}{{2}}[A-Za-z]{_D}{{3}}[A-Za-z]\b"
_IBAN = r"\b[A-Za-z]{2}[0-9]{2}(?:[ \x{A0}]?[A-Za-z0-9]){11,30}\b"
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _pattern(text: str) -> str:
    """The first injection phrase of a text without format characters."""
    phrase = f"trim(regexp_replace(lower({text}), '{_SPACE}', ' ', 'g'))"
    group = lambda words: "(" + "|".join(words) + ")"
    whens = " ".join(f"WHEN regexp_matches({phrase}, '\\b{group(v)}\\b{'.{0,40}' + chr(92) + 'b' + group(o) + chr(92) + 'b' if o else ''}') THEN '{n}'" for n, v, o in INJECTION_PHRASES)
    return f"CASE {whens} END"


def _addresses(text: str) -> str:
    return f"[regexp_replace(lower(a), '[ \\t]', '', 'g') for a in regexp_extract_all({text}, '{_EMAIL}')]"


def _private(text: str, allowed: str) -> str:
    return f"len([a for a in {_addresses(text)} if NOT list_contains({allowed}, a)]) > 0"


def _fiscal(text: str) -> str:
    digits, letters = list(ODD_DIGITS), list(ODD_LETTERS)
    odd = f"CASE WHEN ascii(c) < 58 THEN {digits}[ascii(c) - 47] ELSE {letters}[ascii(c) - 64] END"
    even = "CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 65 END"
    value = f"list_sum([CASE WHEN i % 2 = 1 THEN {odd.replace('(c)', '(upper(x)[i])')} ELSE {even.replace('(c)', '(upper(x)[i])')} END for i in range(1, 16)])"
    return f"len([x for x in regexp_extract_all({text}, '{_FISCAL}') if {value} % 26 = ascii(upper(x)[16]) - 65]) > 0"


def _iban(text: str) -> str:
    plain = "upper(regexp_replace(x, '[ \\x{A0}]', '', 'g'))"
    turned = f"({plain}[5:] || {plain}[:4])"
    steps = f"list_transform(range(1, len({plain}) + 1), lambda i: CAST(ascii({turned}[i]) AS BIGINT))"
    rest = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {steps}), lambda acc, c: CASE WHEN c < 58 THEN (acc * 10 + c - 48) % 97 ELSE (acc * 100 + c - 55) % 97 END)"
    return f"len([x for x in regexp_extract_all({text}, '{_IBAN}') if len({plain}) BETWEEN 15 AND 34 AND {rest} = 1]) > 0"


def _kinds(text: str, allowed: str) -> str:
    return f"concat_ws('+', CASE WHEN {_private(text, allowed)} THEN 'email' END, CASE WHEN {_fiscal(text)} THEN 'codice_fiscale' END, CASE WHEN {_iban(text)} THEN 'iban' END)"


_HELP = "['helpdesk@example.org']"
_USER = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
_SAID = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def _screened(source: str, limit: int) -> str:
    """Verdicts of the input stage over a table with a text column."""
    return f"""(SELECT *, CASE WHEN length(text) > {limit} THEN 'message_length' WHEN pattern IS NOT NULL THEN 'prompt_injection' WHEN kinds <> '' THEN 'personal_data' END AS verdict
      FROM (SELECT *, {_pattern("text")} AS pattern, {_kinds("text", _HELP)} AS kinds FROM {source} AS s) AS p)"""


def _reply(verdict: str) -> str:
    return getattr(Policy(), REPLY_FIELD[verdict]).replace("{help_desk_email}", Policy().help_desk_email)


_LABELS = inline.label_rows()
_TEXTS = f"(SELECT CAST(-msg_id AS BIGINT) AS doc_id, text FROM {inline.MESSAGES} AS m UNION ALL SELECT doc_id, text FROM documents)"
_ASKED = f"(SELECT CAST(-msg_id AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, text FROM {inline.MESSAGES} AS m UNION ALL SELECT * FROM {_USER} AS u)"
_LOG = "(SELECT event_id AS seq, event_type AS summary, user_id AS source, CASE WHEN event_type = 'error' THEN 'error ' || user_id % 3 END AS reason FROM events)"
_ERRORS = f"(SELECT CAST(-id AS BIGINT) AS doc_id, model, error, token FROM {inline.ERRORS} AS e UNION ALL SELECT doc_id, 'm/a', coalesce(text, ''), '' FROM documents)"
_STARTS = f"(SELECT conv_id * 1000 + turn AS k, policy_id FROM (VALUES {', '.join(map(str, STARTS))}) AS v(conv_id, turn, policy_id))"

#: Weights of toxic words from the documents outside each fold (-1: all), and held-out tones of the labelled documents.
_TONE_WORDS = """(WITH d AS (SELECT d.doc_id, toxic, d.doc_id % 5 AS own, list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS words FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id),
  w AS (SELECT own, toxic, unnest(words) AS word FROM d), f AS (SELECT unnest([0, 1, 2, 3, 4, -1]) AS fold),
  z AS (SELECT fold, count(*) FILTER (WHERE toxic = 1) AS d1, count(*) FILTER (WHERE toxic = 0) AS d0 FROM f JOIN d ON own <> fold GROUP BY fold),
  c AS (SELECT fold, word, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM f JOIN w ON own <> fold GROUP BY fold, word),
  k AS (SELECT c.fold, word, CAST(round(1000 * (ln((n1 + 1) / (d1 + 2)) - ln((n0 + 1) / (d0 + 2)) - 2 * sqrt(1 / (n1 + 1) + 1 / (n0 + 1)))) AS BIGINT) AS weight FROM c JOIN z ON c.fold = z.fold WHERE n1 + n0 >= 3)
  SELECT CAST(fold AS BIGINT) AS fold, word, weight FROM k WHERE weight >= 2000)"""
_TONE = f"""(WITH d AS (SELECT d.doc_id, CAST(toxic AS BIGINT) AS toxic, d.doc_id % 5 AS fold, list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS words FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id),
  p AS (SELECT doc_id, sum(weight) AS points FROM (SELECT doc_id, fold, unnest(words) AS word FROM d) AS w JOIN {_TONE_WORDS} AS t ON w.fold = t.fold AND w.word = t.word GROUP BY doc_id)
  SELECT d.doc_id, toxic, coalesce(points, 0) / (coalesce(points, 0) + 3000) AS score FROM d LEFT JOIN p ON d.doc_id = p.doc_id)"""
_SHARES = ", ".join(f"({m}, '{model}', {n}, '{label}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, (model, shares) in enumerate(inline.SHARES.items()) for n, (label, a, b) in enumerate(shares))
_SCORES = f"(SELECT CAST(-msg_id AS BIGINT) AS msg_id, model, ord, label, score FROM {inline.SCORES} AS x UNION ALL SELECT doc_id * 4 + m, model, ord, label, a + b * score FROM {_TONE} AS t, (VALUES {_SHARES}) AS v(m, model, ord, label, a, b))"


def _coverage(rows: list[tuple]) -> str:
    """Summaries of policies (policy_id, limit, input detectors, output detectors, patterns, injection and tone classifier, region,
    device)."""
    text = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    values = ", ".join(f"({', '.join(map(text, r))})" for r in rows)
    return f"""WITH p AS (SELECT *, i <> '' AS has_i, o <> '' AS has_o FROM (VALUES {values}) AS v(policy_id, lim, i, o, pat, ci, co, region, device)),
        d AS (SELECT '{taxonomy.models("injection")[0]}' AS mi, '{taxonomy.models("offensive")[0]}' AS mo)
        SELECT CAST(policy_id AS BIGINT) AS policy_id,
          concat_ws(', ', CASE WHEN lim > 0 THEN 'limits(max ' || lim || ' chars)' ELSE 'limits(disabled)' END,
            CASE WHEN has_i OR has_o THEN 'privacy(' || CASE WHEN has_i THEN 'input=' || i || ', input_region=' || region ELSE 'input=disabled' END || ', ' || CASE WHEN has_o THEN 'output=' || o || ', output_region=IT' ELSE 'output=disabled' END || ')' ELSE 'privacy(disabled)' END,
            CASE WHEN pat OR ci THEN 'security(' || concat_ws('+', CASE WHEN pat THEN 'patterns' END, CASE WHEN ci THEN 'classifier ' || mi || '@0.85' END) || ')' ELSE 'security(disabled)' END,
            CASE WHEN co THEN 'tone(classifier ' || mo || '@0.60)' ELSE 'tone(disabled)' END) AS summary,
          concat_ws(', ', CASE WHEN lim = 0 THEN 'limits' END, CASE WHEN NOT has_i AND NOT has_o THEN 'privacy' END, CASE WHEN NOT has_i AND has_o THEN 'privacy(input)' END, CASE WHEN has_i AND NOT has_o THEN 'privacy(output)' END, CASE WHEN NOT pat AND NOT ci THEN 'security' END) AS uncovered,
          CASE WHEN lim = 0 OR NOT has_i OR NOT has_o OR NOT (pat OR ci) THEN 'WARNING' ELSE 'INFO' END AS level,
          concat_ws('+', CASE WHEN lim > 0 THEN 'length' END, CASE WHEN pat THEN 'injection_patterns' END, CASE WHEN has_i THEN 'personal_data' END) AS checks,
          concat_ws(',', CASE WHEN ci THEN mi END, CASE WHEN co THEN mo END) AS models,
          device || '|' || concat_ws(',', CASE WHEN co THEN mo END, CASE WHEN ci THEN mi END) AS signature FROM p, d"""


_ALL, _MOST = "email+codice_fiscale+iban+phone", "email+codice_fiscale+iban"
_COVERAGE = _coverage(
    [
        (0, 1000, _ALL, _ALL, True, False, False, "IT", "cpu"), (1, 0, _ALL, "", True, False, False, "IT", "cpu"), (2, 1000, "", "", True, False, False, "IT", "cpu"),
        (3, 1000, "", _ALL, False, False, True, "IT", "cpu"), (4, 1000, _ALL, _ALL, True, True, True, "FR", "gpu0"), (5, 1000, _ALL, _ALL, False, False, False, "IT", "cpu"),
    ]
)
_VERSIONS = _coverage(
    [
        (0, 60, _MOST, _MOST, True, False, False, "IT", "cpu"), (1, 200, _MOST, _MOST, True, False, False, "IT", "cpu"), (2, 1000, _ALL, _ALL, True, False, False, "IT", "cpu"),
        (3, 100, _MOST, _MOST, False, False, False, "FR", "cpu"), (4, 1000, _ALL, _ALL, True, False, False, "IT", "cpu"), (5, 0, _MOST, _MOST, True, False, False, "IT", "cpu"),
    ]
)


def _changes(table: str, value: str, order: str, by: str = "") -> str:
    """Rows whose value differs from the one before; the first differs."""
    w = f"({f'PARTITION BY {by} ' if by else ''}ORDER BY {order})"
    return f"(SELECT * FROM (SELECT *, lag({value}) OVER {w} AS b, row_number() OVER {w} AS n FROM {table} AS q) AS t WHERE n = 1 OR {value} IS DISTINCT FROM b)"


def _rearmed(table: str, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, lag(reason) OVER (ORDER BY {order}) AS b FROM {table} AS q) AS t WHERE reason IS NOT NULL AND reason IS DISTINCT FROM b)"


_SIGNS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _token(n: str) -> str:
    return " || ".join(f"{_SIGNS}[CAST({n} % 1679616 // {36**k} % 36 + 1 AS BIGINT)]" for k in (3, 2, 1, 0))


def _in_force() -> str:
    """The first user turns and cases under each version: limit, patterns, addresses that are allowed, replies."""
    default = Policy()
    reply = lambda f, desk: getattr(default, f).replace("{help_desk_email}", desk)
    desk = default.help_desk_email
    rows = []
    for n, limit, patterns, allowed, own in ((0, 60, True, desk, {}), (1, 200, True, "info@agency.gov", {"message_too_long": "Too long, write to info@agency.gov."}), (2, 1000, True, desk, {}), (3, 100, False, f"a@b.org,{desk}", {}), (4, 1000, True, desk, {}), (5, 0, True, desk, {"personal_data_detected": "No private data, please."})):
        told = [own.get(f, reply(f, allowed.split(",")[-1])) for f in ("message_too_long", "prompt_injection_detected", "personal_data_detected")]
        rows.append(f"({n}, {limit}, {str(patterns).lower()}, string_split('{allowed}', ','), {', '.join(repr(t) for t in told)})")
    return f"""WITH a AS (SELECT CASE WHEN conv_id < 0 THEN conv_id + 50 ELSE conv_id END AS conv_id, turn, text FROM {_ASKED} AS q),
        h AS (SELECT a.*, s.policy_id FROM (SELECT *, conv_id * 1000 + turn AS k FROM a) AS a ASOF JOIN {_STARTS} AS s ON a.k >= s.k),
        k AS (SELECT *, {_kinds("text", "allowed")} AS kinds, CASE WHEN patterns THEN {_pattern("text")} END AS pattern FROM h JOIN (VALUES {", ".join(rows)}) AS v(id, lim, patterns, allowed, r_length, r_injection, r_personal) ON h.policy_id = v.id),
        w AS (SELECT *, CASE WHEN lim > 0 AND length(text) > lim THEN 'message_length' WHEN pattern IS NOT NULL THEN 'prompt_injection' WHEN kinds <> '' THEN 'personal_data' END AS verdict FROM k)
        SELECT conv_id, turn, CAST(policy_id AS BIGINT) AS policy_id, verdict, CASE WHEN verdict IS NOT NULL THEN {_case("verdict", taxonomy.CATEGORY_OF, "uncategorized")} END AS category, kinds,
        CASE verdict WHEN 'message_length' THEN 'length=' || length(text) || ' chars (limit ' || lim || ')' WHEN 'prompt_injection' THEN 'detector=custom, pattern=' || pattern WHEN 'personal_data' THEN 'detected=' || kinds ELSE '' END AS detail,
        CASE verdict WHEN 'message_length' THEN r_length WHEN 'prompt_injection' THEN r_injection WHEN 'personal_data' THEN r_personal END AS reply FROM w"""


def _policy_checks() -> str:
    listed = ", ".join(f"'{r}'" for r in sorted(regions()))
    digits = lambda x: f"length(regexp_replace({x}, '[^0-9]', '', 'g'))"
    return f"""WITH e AS (SELECT event_id, event_type AS kind, user_id AS u, value FROM events)
        SELECT event_id, concat_ws(',', CASE WHEN u % 4 IN (2, 3) THEN 'classifier_device' END, CASE WHEN u % 2 <> 0 THEN 'help_desk_email' END, CASE WHEN upper(kind[1:2]) NOT IN ({listed}) THEN 'input_phone_region' END,
          CASE WHEN floor(value) < 3 THEN 'max_message_chars' END, CASE WHEN kind = 'view' THEN 'message_too_long' END, CASE WHEN u % 3 = 1 THEN 'offensive_input_classifier_model' END,
          CASE WHEN value / 16 NOT BETWEEN 0 AND 1 THEN 'prompt_injection_classifier_threshold' END, CASE WHEN {digits("CAST(u * 100 AS VARCHAR)")} < 5 OR (kind <> 'error' AND u % 5 = 0) THEN 'public_service_contacts' END) AS bad_fields FROM e"""


_GUARD, _TONE_MODEL = "meta-llama/Llama-Prompt-Guard-2-86M", "IMSyPP/hate_speech_multilingual"
_GATED, _FRAIL = "deepset/deberta-v3-base-injection", "textdetox/bert-multilingual-toxicity-classifier"
#: Turns with their tone by the weights of all documents; blank ones are not asked about.
_SPOKEN = f"""(WITH t AS (SELECT * FROM {_ASKED} AS a UNION ALL SELECT CAST(conv_id AS BIGINT), 1, text FROM {inline.RUDE} AS r),
  w AS (SELECT conv_id, turn, md5(text) AS m, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'))) AS word FROM t),
  p AS (SELECT conv_id, turn, m, sum(weight) AS points FROM w JOIN (SELECT * FROM {_TONE_WORDS} AS k WHERE fold = -1) AS k ON w.word = k.word GROUP BY ALL)
  SELECT t.*, coalesce(regexp_matches(text, '\\S'), false) AS asked, coalesce(points, 0) / (coalesce(points, 0) + 3000) AS s FROM t LEFT JOIN p ON t.conv_id = p.conv_id AND t.turn = p.turn AND md5(t.text) = p.m)"""
_MARKERS = "401|403|gated|awaiting a review|not authorized|restricted|authenticated|access to model"
_US = phone_sql.found_numbers("(SELECT doc_id, text FROM documents)", "US")

ORACLE_SQL: dict[str, str] = {
    "length_guard": f"""SELECT conv_id, turn, length(text) AS n_chars, CASE WHEN length(text) > 200 THEN 'message_length' END AS at_200,
        CASE WHEN length(text) > 1000 THEN 'message_length' END AS at_1000, CAST(NULL AS VARCHAR) AS at_0 FROM {_USER} AS u""",
    "email_kinds": f"SELECT doc_id, CAST(len({_addresses('text')}) AS BIGINT) AS n_addresses, array_to_string({_addresses('text')}, ',') AS addresses FROM documents",
    "email_allowlist": f"SELECT doc_id, {_private('text', chr(91) + chr(39) + 'a@b.org' + chr(39) + ', ' + chr(39) + 'helpdesk@example.org' + chr(39) + chr(93))} AS private FROM {_TEXTS} AS m",
    "injection_pattern": f"SELECT conv_id, turn, {_pattern('text')} AS pattern FROM (SELECT CAST(msg_id AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, text FROM {inline.MESSAGES} AS m UNION ALL SELECT * FROM {_USER} AS u) AS t",
    "fiscal_code_valid": f"SELECT doc_id, {_fiscal('text')} AS has_code FROM {_TEXTS} AS m",
    "iban_valid": f"SELECT doc_id, {_iban('text')} AS has_iban FROM {_TEXTS} AS m",
    "pii_kinds": f"SELECT doc_id, {_kinds('text', _HELP)} AS kinds FROM documents",
    "verdict_precedence": f"SELECT conv_id, turn, verdict, CASE WHEN verdict IS NOT NULL THEN {_case('verdict', taxonomy.CATEGORY_OF, 'uncategorized')} END AS category, kinds, pattern, verdict IS NOT NULL AS has_reply FROM {_screened(_ASKED, 60)} AS s",
    "stream_screen": f"SELECT conv_id, turn, verdict, CASE WHEN verdict IS NOT NULL THEN {_case('verdict', taxonomy.CATEGORY_OF, 'uncategorized')} END AS category FROM {_screened(_USER, 200)} AS s",
    "unicode_fold": f"""SELECT doc_id, md5(folded) AS folded_md5, md5(phrase) AS phrase_md5 FROM (VALUES (CAST(-1 AS BIGINT), 'mario@example.org', 'mario@example.org'), (-2, 'ignore the rules', 'ignore the rules'), (-3, 'Straße  x', 'strasse x'), (-4, 'fineprint', 'fineprint'), (-5, 'plain', 'plain')) AS t(doc_id, folded, phrase)
        UNION ALL SELECT doc_id, md5(text), md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{_SPACE}', ' ', 'g'))) FROM documents""",
    "classifier_fail_open": f"""SELECT conv_id, turn, '{_TONE_MODEL}' AS model, text IS NOT NULL AS ran, CAST(NULL AS VARCHAR) AS error_kind, coalesce(asked AND s * 0.75 + s * 0.25 >= 0.6, false) AS triggered FROM {_SPOKEN} AS u
        UNION ALL SELECT conv_id, turn, '{_GATED}', text IS NOT NULL AND NOT asked, CASE WHEN asked THEN 'load' END, false FROM {_SPOKEN} AS u""",
    "output_replace": f"""WITH a AS (SELECT CAST(msg_id AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, text FROM {inline.MESSAGES} AS m UNION ALL SELECT * FROM {_SAID} AS u),
        k AS (SELECT *, {_kinds("text", _HELP)} <> '' AS bad FROM a)
        SELECT conv_id, turn, CASE WHEN bad THEN 'output_personal_data' END AS verdict, CASE WHEN bad THEN '{_reply("output_personal_data")}' WHEN conv_id % 2 = 1 THEN text END AS text,
        CASE WHEN bad THEN '{_reply("output_personal_data")}' ELSE text END AS content, CASE WHEN NOT bad THEN 'source ' || conv_id END AS why FROM k""",
    "taxonomy_counts": f"""WITH v AS (SELECT verdict FROM {_screened(_USER, 200)} AS s UNION ALL SELECT CASE WHEN {_kinds("text", _HELP)} <> '' THEN 'output_personal_data' END FROM {_SAID} AS o
        UNION ALL SELECT verdict FROM {_screened("(SELECT text FROM documents)", 5000)} AS d),
        n AS (SELECT CASE WHEN verdict IS NULL THEN 'none' ELSE {_case("verdict", taxonomy.STAGE_OF, "unknown")} END AS stage, CASE WHEN verdict IS NULL THEN 'none' ELSE {_case("verdict", taxonomy.CATEGORY_OF, "uncategorized")} END AS category, coalesce(verdict, 'allowed') AS verdict FROM v)
        SELECT stage, category, verdict, count(*) AS n_messages FROM n GROUP BY ROLLUP (stage, category, verdict)""",
    "offensive_sum": f"""WITH l AS (SELECT * FROM {_LABELS} AS q WHERE guard = 'offensive'), s AS (SELECT * FROM {_SCORES} AS x WHERE model IN (SELECT model FROM l)),
        m AS (SELECT s.*, coalesce(l.semantic, s.label) AS meaning FROM s LEFT JOIN l ON s.model = l.model AND s.label = l.raw_label),
        k AS (SELECT * FROM m WHERE (model, upper(meaning)) IN (SELECT (model, upper(semantic)) FROM l WHERE blocks)),
        t AS (SELECT msg_id, sum(score) AS total, arg_max(meaning, struct_pack(a := score, b := -ord)) FILTER (WHERE score > 0) AS label FROM k GROUP BY msg_id)
        SELECT i.msg_id, coalesce(total, 0.0) >= 0.60 AS triggered, label, CAST(coalesce(total, 0.0) AS DOUBLE) AS score FROM (SELECT DISTINCT msg_id FROM s) AS i LEFT JOIN t ON i.msg_id = t.msg_id""",
    "injection_top": f"""WITH l AS (SELECT * FROM {_LABELS} AS q WHERE guard = 'injection'), s AS (SELECT *, upper(trim(label)) AS raw FROM {_SCORES} AS x WHERE model IN (SELECT model FROM l) AND ord = 0)
        SELECT msg_id, coalesce(semantic = 'MALICIOUS', false) AND score >= 0.85 AS triggered, coalesce(semantic, raw) AS label, score FROM s LEFT JOIN l ON s.model = l.model AND s.raw = l.raw_label""",
    "label_reachability": f"""WITH l AS (SELECT * FROM {_LABELS} AS q), d AS (SELECT * FROM {inline.DECLARED} AS x UNION ALL SELECT DISTINCT 'offensive', model, ord, label FROM {_SCORES} AS y WHERE model = '{inline.SEEN_MODEL}')
        SELECT guard, model, bool_or(EXISTS (SELECT 1 FROM l WHERE l.guard = d.guard AND l.model = d.model AND blocks AND (upper(raw_label) = upper(d.label) OR (d.guard = 'offensive' AND upper(semantic) = upper(d.label))))) AS reachable,
        string_agg(label, ',' ORDER BY idx) AS declared FROM d GROUP BY guard, model""",
    "blocking_classes": f"""WITH l AS (SELECT * FROM {_LABELS} AS q), r AS (SELECT s.model, count(DISTINCT msg_id) AS n FROM {_SCORES} AS s JOIN l ON s.model = l.model AND s.label = l.raw_label WHERE blocks AND score >= 0.25 GROUP BY s.model)
        SELECT guard, l.model, string_agg(DISTINCT CASE WHEN blocks THEN upper(semantic) END, ',' ORDER BY CASE WHEN blocks THEN upper(semantic) END) AS blocking, count(*) AS n_labels, coalesce(any_value(n), 0) AS n_messages FROM l LEFT JOIN r ON l.model = r.model GROUP BY guard, l.model""",
    "summary_changes": f"SELECT 'all' AS scope, seq, summary FROM {_changes(_LOG, 'summary', 'seq')} AS a UNION ALL SELECT 'source', seq, summary FROM {_changes(_LOG, 'summary', 'seq', 'source')} AS b",
    "once_per_key": f"SELECT min(seq) AS seq, summary, source FROM {_LOG} AS q GROUP BY summary, source",
    "rearm": f"SELECT seq, reason FROM {_rearmed(_LOG, 'seq')} AS r",
    "turn_tokens": f"SELECT conv_id, turn, {_token('k')} AS turn_token FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) AS n",
    "redact": f"""SELECT doc_id, md5(regexp_replace(CASE WHEN token = '' THEN error ELSE replace(error, token, '[masked]') END, 'hf_[A-Za-z0-9]{{8,}}', '[masked]', 'g')) AS error_md5
        FROM (SELECT CAST(-id AS BIGINT) AS doc_id, error, token FROM {inline.ERRORS} AS e UNION ALL SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' hf_abcdEFGH0123' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE '' END FROM documents) AS x""",
    "access_marker": f"SELECT doc_id, regexp_matches(lower(error), '{_MARKERS}') AS access, regexp_matches(lower(error), '{_MARKERS}') AS advised FROM {_ERRORS} AS e",
    "cache_keys": """WITH k AS (SELECT 'm/' || event_type AS model, CAST(user_id % 3 - 1 AS INTEGER) AS device FROM events), y AS (SELECT *, CASE WHEN device = -1 THEN model ELSE model || '::device=' || device END AS key FROM k)
        SELECT key, model, device, CASE WHEN key IN ('m/error', 'm/view') THEN '' ELSE key END AS stale, count(*) AS n FROM y GROUP BY ALL""",
    "contacts_parse": f"""WITH c AS (SELECT doc_id, text AS raw FROM documents UNION ALL SELECT CAST(-id AS BIGINT), raw FROM {inline.CONTACTS} AS c),
        p AS (SELECT doc_id, [y for y in [regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g') for x in regexp_split_to_array(coalesce(raw, ''), '[,\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')] if y <> ''] AS e FROM c)
        SELECT doc_id, CAST(len(e) AS BIGINT) AS n, md5(array_to_string(e, '|')) AS entries_md5, array_to_string(list_sort(list_distinct(list_append([lower(x) for x in e if contains(x, '@') AND length(x) < 80], 'help@desk.org'))), '|') AS allowed FROM p""",
    "policy_checks": _policy_checks(),
    "coverage_summary": f"""SELECT c.*, coalesce(n, 0) AS n_turns FROM ({_COVERAGE}) AS c LEFT JOIN
        (SELECT policy_id, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS k FROM conversations) AS a ASOF JOIN {_STARTS} AS s ON a.k >= s.k GROUP BY policy_id) AS h ON c.policy_id = h.policy_id""",
    "guard_log": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {_screened(_USER, 200)} AS q),
        e AS (SELECT verdict, CASE verdict WHEN 'message_length' THEN 'limits' WHEN 'prompt_injection' THEN 'security' WHEN 'personal_data' THEN 'privacy' END AS category,
          CASE verdict WHEN 'message_length' THEN 'length=' || length(text) || ' chars (limit 200)' WHEN 'prompt_injection' THEN 'detector=custom, pattern=' || pattern WHEN 'personal_data' THEN 'detected=' || kinds ELSE '' END AS detail,
          CASE WHEN verdict IS NULL THEN 'length+injection_patterns+personal_data' END AS checks, '000' || '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[k + 1] AS turn FROM s)
        SELECT CASE WHEN verdict IS NULL THEN 'input_allowed' ELSE 'input_blocked' END AS kind, 'INFO' AS level, 'input' AS stage, category, verdict, detail, checks, turn,
          concat_ws(', ', CASE WHEN verdict IS NULL THEN 'input allowed' ELSE 'input blocked' END, 'stage=input', 'category=' || category, 'verdict=' || verdict, nullif(detail, ''), 'checks=' || checks, 'turn=' || turn) AS line FROM e""",
    "threshold_sweep": f"""WITH s AS (SELECT score, toxic AS truth FROM {_TONE} AS q), t AS (SELECT unnest([0.25, 0.5, 0.6, 0.85]) AS threshold)
        SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= threshold AND truth = 1) AS true_refusals, count(*) FILTER (WHERE score >= threshold AND truth = 0) AS false_refusals,
        count(*) FILTER (WHERE score < threshold AND truth = 1) AS missed FROM s, t GROUP BY threshold""",
}


ORACLE_SQL |= {
    "classifier_verdicts": f"""WITH s AS (SELECT *, verdict IS NULL AND turn % 4 <> 0 AS looked, s * 0.75 + s * 0.25 AS tone FROM {_screened(_SPOKEN, 200)} AS q),
        i AS (SELECT *, looked AND asked AND s >= 0.85 AS bad FROM s),
        v AS (SELECT *, looked AND NOT bad AS toned, looked AND NOT bad AND asked AND tone >= 0.6 AS rude FROM i),
        f AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN verdict WHEN bad THEN 'prompt_injection' WHEN rude THEN 'offensive_input' END AS final FROM v)
        SELECT conv_id, turn, final AS verdict, CASE WHEN final IS NOT NULL THEN {_case("final", taxonomy.CATEGORY_OF, "uncategorized")} END AS category,
        CASE WHEN verdict = 'message_length' THEN 'length=' || length(text) || ' chars (limit 200)' WHEN verdict = 'prompt_injection' THEN 'detector=custom, pattern=' || pattern WHEN verdict = 'personal_data' THEN 'detected=' || kinds
          WHEN bad THEN 'detector=classifier, model={_GUARD}, label=MALICIOUS, score=' || printf('%.3f', s) || ', threshold=0.85'
          WHEN rude THEN 'detector=classifier, model={_TONE_MODEL}, label=offensive, score=' || printf('%.3f', tone) || ', threshold=0.60' ELSE '' END AS detail,
        'length+injection_patterns+personal_data' || CASE WHEN looked THEN '+injection_classifier' ELSE '' END || CASE WHEN toned THEN '+offensive_input' ELSE '' END AS checks FROM f""",
    "output_log": f"""WITH k AS (SELECT {_kinds("text", _HELP)} AS kinds FROM {_SAID} AS a)
        SELECT CASE WHEN kinds <> '' THEN 'output_blocked' ELSE 'output_allowed' END AS kind, CASE WHEN kinds <> '' THEN 'privacy' END AS category, CASE WHEN kinds <> '' THEN 'output_personal_data' END AS verdict,
        CASE WHEN kinds <> '' THEN 'detected=' || kinds ELSE '' END AS detail, CASE WHEN kinds = '' THEN 'email+codice_fiscale+iban' END AS checks, count(*) AS n FROM k GROUP BY ALL""",
    "guard_announcements": f"""WITH w AS (SELECT verdict FROM {_screened(_USER, 200)} AS q),
        c AS (SELECT *, lag(summary) OVER (ORDER BY policy_id) AS b FROM ({_COVERAGE}) AS q),
        r AS ({ORACLE_SQL["rearm"]}),
        e AS (SELECT * FROM (VALUES
          ('injection_unavailable', 'WARNING', 'input', 'guard=injection, model={_GATED}, error=RuntimeError: 401 gated [masked], patterns go on'),
          ('offensive_unavailable', 'WARNING', 'input', 'guard=offensive, model={_TONE_MODEL}, error=RuntimeError: 401 gated [masked], no guard covers tone'),
          ('inference_failed', 'WARNING', 'input', 'guard=offensive, model={_FRAIL}, error=ValueError'),
          ('injection_label_mismatch', 'WARNING', NULL, 'model={_GATED}, declared=LABEL_0,LABEL_1, expected=INJECTION'),
          ('offensive_label_mismatch', 'WARNING', NULL, 'model={_TONE_MODEL}, declared=LABEL_0,LABEL_1, expected=OFFENSIVE,VIOLENT'),
          ('injection_label_unmapped', 'WARNING', NULL, 'model={_GUARD}, label=MALICIOUS'),
          ('model_loading', 'INFO', NULL, 'model=m/a'), ('model_cache_hit', 'INFO', NULL, 'model=m/b'), ('model_released', 'INFO', NULL, 'model=m/b, device=cpu'),
          ('model_load_failed', 'WARNING', NULL, 'model=m/a, error=RuntimeError: 401 gated [masked], Access to this model has to be granted: accept its terms at https://huggingface.co/m/a, set an access token in the policy and restart; or choose a model without access control.')
        ) AS v(kind, level, stage, detail))
        SELECT kind, level, stage, CAST(NULL AS VARCHAR) AS verdict, detail, CAST(1 AS BIGINT) AS n FROM e
        UNION ALL SELECT 'no_reply_configured', 'WARNING', 'input', 'message_length', '', count(*) FROM w WHERE verdict = 'message_length' HAVING count(*) > 0
        UNION ALL SELECT 'guards_active', level, NULL, NULL, summary || CASE WHEN uncovered <> '' THEN '; no guard covers: ' || uncovered ELSE '' END, count(*) FROM c WHERE b IS NULL OR b <> summary GROUP BY ALL
        UNION ALL SELECT 'settings_fallback', 'WARNING', NULL, NULL, 'reason=' || reason, count(*) FROM r GROUP BY ALL""",
    "process_tokens": f"SELECT conv_id, turn, {_token('k')} AS turn_token FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations) AS n",
    "policy_in_force": _in_force(),
    "policy_announcements": f"""WITH v AS ({_VERSIONS}), r AS (SELECT conv_id, turn, summary, CASE s.policy_id WHEN 2 THEN 'ValueError: max_message_chars: not a number of at least 0' WHEN 4 THEN 'no stored settings' END AS reason
          FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS k FROM conversations) AS a ASOF JOIN {_STARTS} AS s ON a.k >= s.k JOIN v ON s.policy_id = v.policy_id)
        SELECT 'guards_active' AS kind, conv_id, turn, md5(summary) AS told FROM {_changes("r", "summary", "conv_id, turn")} AS a UNION ALL SELECT 'settings_fallback', conv_id, turn, md5(reason) FROM {_rearmed("r", "conv_id, turn")} AS b""",
    "phone_kinds": " UNION ALL ".join(f"SELECT '{r}' AS region, * FROM ({phone_sql.found_numbers(f'(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {phone_sql.CASES} AS k UNION ALL SELECT doc_id, text FROM documents)', r)}) AS {r}" for r in ("IT", "US")),
    "allowlist_tables": f"""WITH a AS (SELECT doc_id, {_addresses("text")} AS found FROM documents),
        listed AS (SELECT unnest([x for x in found if length(x) % 2 = 0]) AS x FROM a UNION SELECT 'order' || l_orderkey || '.' || l_linenumber || '@example.org' FROM lineitem),
        n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(found) AS x FROM a) AS y WHERE x NOT IN (SELECT x FROM listed) GROUP BY doc_id),
        lines AS (SELECT '+1' || (c_custkey % 700 + 200) || '555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS x FROM customer),
        p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(numbers, ',')) AS x FROM ({_US}) AS u WHERE numbers <> '') AS y WHERE NOT ends_with(x, '5') AND x NOT IN (SELECT x FROM lines) GROUP BY doc_id)
        SELECT a.doc_id, coalesce(n.n, 0) AS n_addresses, coalesce(p.n, 0) AS n_phones FROM a LEFT JOIN n ON a.doc_id = n.doc_id LEFT JOIN p ON a.doc_id = p.doc_id""",
    "stream_announcements": f"""SELECT source, seq AS place, {_token("n")} AS token, n = 1 OR summary IS DISTINCT FROM b AS value_announced, reason IS NOT NULL AND reason IS DISTINCT FROM br AS reason_announced
        FROM (SELECT *, row_number() OVER w AS n, lag(summary) OVER w AS b, lag(reason) OVER w AS br FROM {_LOG} AS q WINDOW w AS (PARTITION BY source ORDER BY seq)) AS t""",
    "stream_bursts": """WITH e AS (SELECT user_id AS source, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS first FROM events WHERE event_type = 'error'),
        b AS (SELECT *, sum(first) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT source, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n_events FROM b GROUP BY source, burst""",
    "stream_log": f"""SELECT 'input' AS stage, kind, category, verdict, detail, count(*) AS n FROM (SELECT CASE WHEN verdict IS NULL THEN 'input_allowed' ELSE 'input_blocked' END AS kind, verdict,
          CASE WHEN verdict IS NOT NULL THEN {_case("verdict", taxonomy.CATEGORY_OF, "uncategorized")} END AS category,
          CASE verdict WHEN 'message_length' THEN 'length=' || length(text) || ' chars (limit 200)' WHEN 'prompt_injection' THEN 'detector=custom, pattern=' || pattern WHEN 'personal_data' THEN 'detected=' || kinds ELSE '' END AS detail FROM {_screened(_USER, 200)} AS q) AS e GROUP BY ALL""",
    "verdict_tallies": f"""SELECT stage, category, verdict, count(*) AS n_messages, true AS agrees FROM (SELECT CASE WHEN verdict IS NULL THEN 'none' ELSE {_case("verdict", taxonomy.STAGE_OF, "unknown")} END AS stage,
          CASE WHEN verdict IS NULL THEN 'none' ELSE {_case("verdict", taxonomy.CATEGORY_OF, "uncategorized")} END AS category, coalesce(verdict, 'allowed') AS verdict FROM {_screened(_USER, 200)} AS q) AS v GROUP BY ROLLUP (stage, category, verdict)""",
    "tone_words": f"SELECT * FROM {_TONE_WORDS} AS t",
    "refusals_by_hour": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, 'input' AS stage, event_type AS verdict, count(*) AS n_events FROM events GROUP BY ALL",
    "stream_answers": f"""SELECT conv_id, turn, CASE WHEN bad THEN 'output_personal_data' END AS verdict, CASE WHEN bad THEN 'output' END AS verdict_stage, md5(CASE WHEN bad THEN '{_reply("output_personal_data")}' ELSE text END) AS content_md5
        FROM (SELECT *, {_kinds("text", _HELP)} <> '' AS bad FROM {_SAID} AS a) AS k""",
}
