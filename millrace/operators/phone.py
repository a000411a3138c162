"""Phone numbers in text: candidates, the numbering plan that accepts them, their E.164 form and kind, all in the JVM.

A candidate is a run of digits parted by at most two blanks or marks. Its separators become ``-``, and one expression
per kind of number, compiled from the plans, tests leading digits, length and grouping together: separators may stand only
where the plan ends a group, so a group is never split, while groups may run together; where a trunk prefix exists, the
first group stands apart or no group does. That keeps out dates and numbers such as 01.02.2026, 01.02.03.04 or 06.123.456
and finds 06 1234567. A candidate that no plan accepts is tried in pieces, as when two numbers stand side by side.

Numbers start with a plus sign or the region's prefix for calls abroad and a country code, or are national numbers of the
region, with its trunk prefix. An unknown region has no national numbers. A null text has none at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.numbering import abroad_prefix, codes_pattern, international, national, plan_of_region, trunk_cuts

NUMBERS = "array<struct<raw:string,e164:string,kind:string>>"
#: Blanks and marks that may part digits, two at most in a row.
BLANK = r" \u00A0"
#: A letter that touches a run of digits is taken along, and rules it out.
CANDIDATE = rf"[A-Za-z]?\+?[(]?[0-9](?:[{BLANK}./()-]{{0,2}}[0-9])*[A-Za-z]?"
#: Digits of a number, a prefix for calls abroad included.
LEAST_DIGITS, MOST_DIGITS = 5, 19
#: Where a run may hold several numbers: at clear breaks, or else at every blank.
BREAKS = (rf"/| - |[{BLANK}]{{2}}|[.] ", f"[{BLANK}]")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(groups: Column, table: tuple[tuple[str, str], ...]) -> Column:
    none = F.lit(None).cast("string")
    return F.coalesce(none, *[F.when(groups.rlike(p), k) for k, p in table])


def _without_trunk(code: Column, rest: Column) -> Column:
    return reduce(lambda done, cut: F.when(code.rlike(f"^(?:{'|'.join(cut[1])})$"), F.regexp_replace(rest, cut[0], "")).otherwise(done), trunk_cuts().items(), rest)


def parsed(raw: Column, region: str, grouped: bool = True) -> Column:
    """struct(raw, e164, kind) of a number as written; e164 and kind are null where no plan accepts it."""
    plan = plan_of_region().get(region)
    own = plan.code if plan else ""
    apart = f"^(?:{abroad_prefix(region)})-?(?=[1-9])"

    def judge(groups: Column) -> Column:
        abroad = F.when(raw.contains("+"), groups).when(groups.rlike(apart), F.regexp_replace(groups, apart, ""))
        home = F.when(abroad.isNull(), _kind(groups, national(region)))
        # a national number may carry its own country code without a plus sign, if it is none as it stands
        full = F.coalesce(abroad, F.when(home.isNull() & groups.startswith(own), groups)) if own else abroad
        return _let(_let(F.struct(home.alias("home"), full.alias("full")), told), lambda f: F.struct(raw.alias("raw"), F.when(f["kind"].isNotNull(), e164(groups, f["full"])).alias("e164"), f["kind"].alias("kind")))

    def told(f: Column) -> Column:
        return F.struct(f["full"].alias("full"), F.coalesce(f["home"], _kind(f["full"], international())).alias("kind"))

    def e164(groups: Column, full: Column) -> Column:
        digits = F.translate(full, "-", "")
        code = F.regexp_extract(digits, f"^{codes_pattern()}", 0)
        there = F.concat(F.lit("+"), code, _without_trunk(code, F.substring(digits, F.length(code) + 1, F.length(digits))))
        here = F.concat(F.lit("+" + own), _without_trunk(F.lit(own), F.translate(groups, "-", "")))
        return F.when(full.isNotNull(), there).otherwise(here)

    dashes = F.regexp_replace(F.regexp_replace(raw, "[^0-9]+", "-"), "^-|-$", "")
    return _let(dashes if grouped else F.translate(dashes, "-", ""), judge)


def numbers(folded: Column, region: str) -> Column:
    """Numbers found as structs (raw, e164, kind), in order."""
    sized = lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(LEAST_DIGITS, MOST_DIGITS)
    accepted = lambda pieces: F.filter(F.transform(F.filter(pieces, sized), lambda x: parsed(F.trim(x), region)), lambda n: n["e164"].isNotNull())

    def of_run(run: Column) -> Column:
        levels = F.array(F.array(run), F.split(run, BREAKS[0]), F.split(run, BREAKS[1]))
        return F.coalesce(F.get(F.filter(F.transform(levels, accepted), lambda found: F.size(found) > 0), F.lit(0)), F.array().cast(NUMBERS))

    runs = F.filter(F.regexp_extract_all(folded, F.lit(CANDIDATE), 0), lambda x: ~x.rlike("^[A-Za-z]|[A-Za-z]$"))
    return F.when(folded.rlike(r"[0-9](?:[  ./()-]{0,2}[0-9]){4}"), F.flatten(F.transform(runs, of_run))).otherwise(F.array().cast(NUMBERS))


def allowed_numbers(contacts: Column, region: str) -> Column:
    """E.164 forms of the listed numbers, however they are grouped; addresses and entries that no plan accepts are dropped."""
    plain = F.filter(contacts, lambda c: ~c.contains("@"))
    return F.array_distinct(F.array_compact(F.transform(plain, lambda c: parsed(c, region, grouped=False)["e164"])))


def private_numbers(folded: Column, region: str, allowed: Column) -> Column:
    return F.filter(numbers(folded, region), lambda x: ~F.array_contains(allowed, x["e164"]))


def number_types(private: Column) -> Column:
    """Sorted distinct types of the numbers found."""
    return F.array_sort(F.array_distinct(F.transform(private, lambda x: F.coalesce(x["kind"], F.lit("unknown")))))
