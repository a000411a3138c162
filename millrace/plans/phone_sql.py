"""DuckDB SQL for phone numbers: the plans' rows spelled out as a table and joined by code, length and group borders."""

from __future__ import annotations

from ..operators.phone import BREAKS, CANDIDATE, LEAST_DIGITS, MOST_DIGITS
from ..sources.numbering import KINDS, Plan, abroad_prefix, plan_of_region, plans

#: Texts with numbers as people write them, some of them no numbers at all.
CASES = """(SELECT * FROM (VALUES
 (-1, 'call 06 1234567'), (-2, 'on 01.02.2026 or 01-02-2026'), (-3, '+39 050 509111'), (-4, '01.02.03.04 and 06.123.456'), (-5, '347 1234567 or 347 123 4567'),
 (-6, '0039 050 509111'), (-7, '+44 20 7946 0000, +44 (0)20 7946 0000'), (-8, '+33 1 23 45 67 89 but not +33 123 45 67 89'), (-9, '050509111/061234567'), (-10, '39 347 1234567'),
 (-11, 'x061234567 061234567x'), (-12, '4111 1111 1111 1111'), (-13, '+355 67 212 3456'), (-14, '800 123 456 - 06 1234567'), (-15, '+800 1234 5678'), (-16, NULL), (-17, ''),
 (-18, '+7 8 912 345-67-89'), (-19, '+55 11 98765-4321'), (-20, '(06) 1234567'), (-21, '06-12-34567'), (-22, '10.0.0.255 at 2026-11-27 10:20'), (-23, '+1 911 555 0100, +1 212 555 0100'),
 (-24, '1-212-555-0100 and 011 39 06 1234567'), (-25, '(212) 555-0100'), (-26, '212.555.0100'), (-27, '2125550100 3471234567'), (-28, '+689 40 12 34 56'), (-29, '+99 123 456 789'),
 (-30, '+36 06 1 234 5678'), (-31, '06 1234567  050 509111'), (-32, '+49 30 1234567. 06 1234567'), (-33, '+380 50 123 45 67'), (-34, '+91 98765 43210'), (-35, '+3 90 6123 4567'), (-36, '0 6 1234567'),
 (-37, '+263 71 234 5678 +86 138 1234 5678'), (-38, '9007199254740993 123456789012345678901234'), (-39, '+44 7911 123456'), (-40, '+39.06.1234567')
) AS v(doc_id, text))"""


def _rows(plan: Plan) -> list[tuple]:
    """(code, kind's place, kind, leading digits, least, most, borders or null for any)."""
    order = list(KINDS.values())
    out = []
    for row in plan.rows:
        if row.any_groups:
            out.append((plan.code, order.index(row.kind), row.kind, row.lead, *row.sizes[0], None))
            continue
        for sizes in row.splits():
            borders = [sum(sizes[: k + 1]) for k in range(len(sizes) - 1)]
            out.append((plan.code, order.index(row.kind), row.kind, row.lead, sum(sizes), sum(sizes), borders))
    return out


def _table(chosen: list[Plan]) -> str:
    rows = ", ".join(f"('{c}', {o}, '{k}', '^(?:{lead})', {a}, {b}, {f'CAST({x} AS BIGINT[])' if x is not None else 'CAST(NULL AS BIGINT[])'})" for p in chosen for c, o, k, lead, a, b, x in _rows(p))
    return f"(VALUES {rows}) AS r(code, ord, kind, lead, least, most, borders)"


def _trunks(chosen: list[Plan]) -> str:
    return f"(VALUES {', '.join(f"('{p.code}', '{p.trunk}', {str(p.optional).lower()})" for p in chosen)}) AS t(code, trunk, optional)"


def found_numbers(source: str, region: str) -> str:
    """(doc_id, n_numbers, types, numbers) of a table (doc_id, text), for each row."""
    everywhere, home = list(plans().values()), plan_of_region()[region]
    re2 = lambda x: x.replace(r"\u00A0", r"\x{A0}")
    apart = f"^(?:{abroad_prefix(region)})-?([1-9].*)$"
    return f"""WITH s AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM {source} AS q),
  c AS (SELECT row_id, unnest(x) AS run, generate_subscripts(x, 1) AS run_at FROM (SELECT row_id, regexp_extract_all(text, '{re2(CANDIDATE)}') AS x FROM s)),
  l AS (SELECT row_id, run_at, 0 AS level, [run] AS pieces FROM c WHERE NOT regexp_matches(run, '^[A-Za-z]|[A-Za-z]$')
    UNION ALL SELECT row_id, run_at, 1, regexp_split_to_array(run, '{re2(BREAKS[0])}') FROM c WHERE NOT regexp_matches(run, '^[A-Za-z]|[A-Za-z]$')
    UNION ALL SELECT row_id, run_at, 2, regexp_split_to_array(run, '{re2(BREAKS[1])}') FROM c WHERE NOT regexp_matches(run, '^[A-Za-z]|[A-Za-z]$')),
  p AS (SELECT row_id, run_at, level, unnest(pieces) AS raw, generate_subscripts(pieces, 1) AS place FROM l),
  g AS (SELECT *, regexp_replace(regexp_replace(raw, '[^0-9]+', '-', 'g'), '^-|-$', '', 'g') AS d FROM p WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN {LEAST_DIGITS} AND {MOST_DIGITS}),
  a AS (SELECT *, CASE WHEN contains(raw, '+') THEN d WHEN regexp_matches(d, '{apart}') THEN regexp_extract(d, '{apart}', 1) END AS abroad FROM g),
  -- every way to read it: 0 with a country code, 1 national, 2 with the own country code and no plus sign
  w AS (SELECT row_id, run_at, level, place, 0 AS way, abroad AS d FROM a WHERE abroad IS NOT NULL UNION ALL SELECT row_id, run_at, level, place, 1, d FROM a WHERE abroad IS NULL
    UNION ALL SELECT row_id, run_at, level, place, 2, d FROM a WHERE abroad IS NULL AND starts_with(d, '{home.code}')),
  n AS (SELECT row_id, run_at, level, place, way, replace(d, '-', '') AS digits, list_transform(range(1, len(string_split(d, '-'))), lambda k: CAST(list_sum(list_transform(string_split(d, '-')[1:k], lambda x: length(x))) AS BIGINT)) AS cuts FROM w),
  t AS (SELECT * FROM {_trunks(everywhere)}),
  o AS (SELECT n.*, t.code, t.trunk, CASE way WHEN 1 THEN 0 ELSE length(t.code) END AS after_code, v.cut FROM n JOIN t ON CASE way WHEN 1 THEN t.code = '{home.code}' ELSE starts_with(digits, t.code) END,
    (VALUES (false), (true)) AS v(cut) WHERE CASE WHEN v.cut THEN t.trunk <> '' AND starts_with(substr(digits, CASE way WHEN 1 THEN 1 ELSE length(t.code) + 1 END), t.trunk) ELSE way <> 1 OR t.trunk = '' OR t.optional END),
  b AS (SELECT *, after_code + CASE WHEN cut THEN length(trunk) ELSE 0 END AS skip FROM o),
  m AS (SELECT *, substr(digits, CAST(skip + 1 AS BIGINT)) AS nsn, [x - skip for x in cuts if x > skip] AS own FROM b WHERE len([x for x in cuts if x < skip AND x <> after_code]) = 0),
  f AS (SELECT row_id, run_at, level, place, way, '+' || m.code || nsn AS e164, kind, ord FROM m JOIN {_table(everywhere)} ON m.code = r.code AND length(nsn) BETWEEN least AND most AND regexp_matches(nsn, lead)
    WHERE CASE WHEN borders IS NULL THEN len([x for x in list_zip(list_append(own, length(nsn)), list_prepend(0, own)) if x[1] - x[2] < 2]) = 0
      ELSE list_has_all(borders, own) AND (trunk = '' OR len(own) = 0 OR list_contains(own, borders[1])) END),
  e AS (SELECT row_id, run_at, level, place, arg_min(struct_pack(e := e164, k := kind), way * 100 + ord) AS x FROM f GROUP BY ALL),
  h AS (SELECT e.* FROM e JOIN (SELECT row_id, run_at, min(level) AS level FROM e GROUP BY ALL) AS z ON e.row_id = z.row_id AND e.run_at = z.run_at AND e.level = z.level),
  y AS (SELECT row_id, count(*) AS n_numbers, string_agg(DISTINCT x.k, '+' ORDER BY x.k) AS types, string_agg(x.e, ',' ORDER BY run_at, place) AS numbers FROM h GROUP BY row_id)
SELECT s.doc_id, coalesce(n_numbers, 0) AS n_numbers, coalesce(types, '') AS types, coalesce(numbers, '') AS numbers FROM s LEFT JOIN y ON s.row_id = y.row_id"""
