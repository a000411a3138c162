"""Numbering plans: country codes, trunk prefixes, and what national numbers look like and how their digits are grouped.

A line of ``PLANS`` is ``code | regions | trunk | rows``. The trunk prefix stands before a national number (``0``), may stand
there (``0?``) or does not exist. A row is ``kind leading-digits grouping, grouping``: a grouping lists the sizes of the
groups, each a number or a range; ``*7-9`` takes 7 to 9 digits in any groups of two or more. A number that fits rows of
several kinds is of the one that stands first in ``KINDS``. Lines without rows take ``REST`` of their zone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import product

#: Short names of the kinds of number; kinds with narrow leading digits come first.
KINDS = {
    "t": "toll_free", "p": "premium_rate", "s": "shared_cost", "n": "personal_number", "a": "uan", "v": "voip", "m": "mobile", "f": "fixed_line", "fm": "fixed_line_or_mobile", "u": "unknown",
}

#: The world's country codes by zone, with the plans of larger countries.
PLANS = r"""
1 | US AG AI AS BB BM BS CA DM DO GD GU JM KN KY LC MP MS PR SX TC TT VC VG VI | 1? | t 8(?:00|33|44|55|66|77|88) 3 3 4; p 900 3 3 4; fm [2-9](?:[02-8]\d|1[02-9]) 3 3 4
20 | EG | 0 | m 1[0125] 2 8, 3 3 4; t 800 3 3 4; f [23] 1 7-8; f [4-9] 2 6-7
27 | ZA | 0 | t 80 2 3 4; m [678] 2 3 4; f [1-5] 2 3 4
211 | SS | 0 |
212 | MA EH | 0 | m [67] 3 6, 1 2 2 2 2; f 5 3 6, 1 2 2 2 2
213 | DZ | 0 | m [567] 3 2 2 2; f [1-4] 2 2 2 2
216 | TN | | m [2459] 2 3 3; f [37] 2 3 3
218 | LY | 0 |
220 | GM | |
221 | SN | | m 7 2 3 2 2; f 3 2 3 2 2
222 | MR | |
223 | ML | |
224 | GN | |
225 | CI | |
226 | BF | |
227 | NE | |
228 | TG | |
229 | BJ | |
230 | MU | |
231 | LR | 0 |
232 | SL | 0 |
233 | GH | 0 | m [25] 2 3 4; f 3 2 3 4
234 | NG | 0 | m [789] 3 3 4, 3 3 3; f [1-9] 1 3 4, 2 3 3
235 | TD | |
236 | CF | |
237 | CM | | m 6 1 2 2 2 2; f 2 1 2 2 2 2
238 | CV | |
239 | ST | |
240 | GQ | |
241 | GA | |
242 | CG | |
243 | CD | 0 |
244 | AO | | m 9 3 3 3; f 2 3 3 3
245 | GW | |
246 | IO | |
247 | AC | |
248 | SC | |
249 | SD | 0 |
250 | RW | 0 |
251 | ET | 0 | m 9 2 3 4; f [1-59] 2 3 4
252 | SO | 0 |
253 | DJ | |
254 | KE | 0 | m [17] 3 6, 3 3 3; f [2-6] 2 5-7; t 800 3 6
255 | TZ | 0 | m [67] 3 3 3; f 2 2 3 4
256 | UG | 0 | m 7 3 6; f [2-4] 3 6
257 | BI | |
258 | MZ | | m 8 2 3 4, 2 3 3; f 2 2 3 3
260 | ZM | 0 |
261 | MG | 0 |
262 | RE YT | 0 | m 6 3 2 2 2; f 2 3 2 2 2
263 | ZW | 0 |
264 | NA | 0 |
265 | MW | 0 |
266 | LS | |
267 | BW | |
268 | SZ | |
269 | KM | |
290 | SH TA | |
291 | ER | 0 |
297 | AW | |
298 | FO | |
299 | GL | |
30 | GR | | t 800 3 3 4; m 69 3 3 4; f 21 2 4 4; f 2 3 3 4, 4 6
31 | NL | 0 | t 800 3 4, 3 7; p 90[069] 3 4, 3 7; m 6[1-58] 1 8, 1 4 4, 1 2 2 2 2; f (?:1[035]|2[0346]|3[03568]|4[0356]|5[0358]|7) 2 3 4, 2 3 2 2; f [1-5] 3 3 3, 3 2 2 2
32 | BE | 0 | m 4[5-9] 3 2 2 2; t 800 3 2 3; p 90 3 2 3; f [2349] 1 3 2 2; f [15-8] 2 2 2 2
33 | FR | 0 | m [67] 1 2 2 2 2; t 80 3 2 2 2, 1 2 2 2 2; s 8 3 2 2 2, 1 2 2 2 2; v 9 1 2 2 2 2; f [1-5] 1 2 2 2 2
34 | ES | | t [89]00 3 3 3; p 80[367] 3 3 3; s 90 3 3 3; m [67] 3 3 3, 3 2 2 2; f [89] 3 3 3, 2 3 2 2, 3 2 2 2
350 | GI | |
351 | PT | | t 80 3 3 3; m 9[1-36] 3 3 3; f 2[12] 2 3 4; f 2 3 3 3
352 | LU | | t 800 3 2 3; m 6 3 3 3; u [2-579] *5-11
353 | IE | 0 | t 1800 4 3 3; m 8[3-9] 2 3 4; f 1 1 3 4; f [24-9] 2 3 4, 2 5, 2 3 3
354 | IS | | t 800 3 4; m [678] 3 4; f [45] 3 4
355 | AL | 0 | m 6 2 3 4; f 4 1 3 4; f [2358] 2 3 3, 3 5
356 | MT | | m [79] 4 4; f 2 4 4
357 | CY | | t 800 2 6; m 9 2 6; f 2 2 6
358 | FI AX | 0 | t 800 3 4-6; m 4[0-6]|50 2 3-7, 2 3 3-4, 3 3-6; f [1-689] 1 3-8, 2 3-8
359 | BG | 0 | t 800 3 5; m 8[7-9]|98 2 3 3-4; f 2 1 3 3-4; f [3-7] 2 3 2-3, 3 3 2-3
36 | HU | 06 | t 80 2 3 3; m [237]0|31 2 3 4; f 1 1 3 4; f [2-9] 2 3 3
370 | LT | 0 | t 800 3 5; m 6 3 5, 3 2 3; f 5 1 3 4; f [34] 2 6, 3 5
371 | LV | | t 80 2 3 3; m 2 2 3 3; f 6 2 3 3
372 | EE | | t 800 3 4-7; m 5 4 3-4; f [3-7] 3 4
373 | MD | 0 | t 800 3 2 3; m [67] 3 2 3; f 22 2 3 3; f 2 3 2 3
374 | AM | 0 | m [49] 2 6; f [1-3] 2 6, 3 5
375 | BY | 8? | m 25|29|33|44 2 3 2 2; f 1|2[1-4] 2 3 2 2, 3 2 2 2, 4 2 3
376 | AD | |
377 | MC | 0? | m 6 1 2 2 2 2; m 4 2 3 3; f 9 2 2 2 2
378 | SM | | f 0549 4 6; m 6 2 2 2 2; u [5-7] *6-10
380 | UA | 0 | t 800 3 3 3; m 39|50|6[3678]|7[37]|9[1-9] 2 3 4, 2 3 2 2; f [3-6] 2 3 4, 2 3 2 2, 4 5
381 | RS | 0 | t 800 3 3 3; m 6 2 3 3-5, 2 5-8; f [1-3] 2 3 3-4, 2 5-7
382 | ME | 0 | t 80 2 3 3; m 6 2 3 3; f [2-5] 2 3 3
383 | XK | 0 | m 4 2 3 3; f [23] 2 3 3
385 | HR | 0 | t 800 3 2-3 2-3; m 9 2 3 3-4; f 1 1 4 3; f [2-5] 2 3 3
386 | SI | 0 | t 80 2 4; m 3[0147]|4|5[01]|6|7[01] 2 3 3; f [1-57] 1 3 2 2
387 | BA | 0 | m 6 2 3 3-4; f [3-5] 2 3 3
389 | MK | 0 | m 7 2 3 3; f 2 1 3 4; f [34] 2 3 3
39 | IT VA | | t 80[03] 3 3, 3 3 3; n 1(?:78|99) 3 3 3-4; s 84[08] 3 3, 3 3 3; p 89 3 3-6; v 55 2 4 4; m 3 3 3 3-4; f 0[26] 2 4-6, 2 3-4 4, 2 4 5; f 0[13-57-9][0159] 3 3-6, 3 3-4 4; f 0[13-57-9][2-46-8] 4 2-6, 4 3 4
40 | RO | 0 | t 800 3 3 3; m 7 3 3 3; f 21 2 3 4; f [23] 3 3 3, 3 6
41 | CH | 0 | t 800 3 3 3; p 90[016] 3 3 3; s 84[0248] 3 3 3; m 7[4-9] 2 3 2 2; f (?:2[12467]|3[1-4]|4[134]|5[256]|6[12]|71|8[17]|91) 2 3 2 2
420 | CZ | | t 800 3 3 3; p 90 3 3 3; m 60[1-8]|7[0237]|79 3 3 3; f [2-5] 3 3 3
421 | SK | 0 | t 800 3 3 3; m 9 3 3 3; f 2 1 3 3 2; f [3-5] 2 3 2 2
423 | LI | | m 6|7 3 3 3, 3 2 2; f [23] 3 2 2
43 | AT | 0 | t 800 3 3-7; p 900 3 3-7; m 6(?:5[0-3579]|6|7[0-7]|8[0-8]|99) 3 4-10, 3 3 4-5; f 1 1 4-11, 1 3 4; f (?:316|463|512|662|732) 3 3-9; f [2-57] 4 3-9
44 | GB GG IM JE | 0 | t 80[08] 3 3 4, 3 6-7; s 84[2-5] 3 3 4; s 87 3 3 4; p 9 3 3 4; a 3[0347] 3 3 4; m 7[1-57-9] 4 6, 4 3 3; f 2[03489] 2 4 4; f 11|1\d1 3 3 4; f 1[2-9] 4 5-6, 4 3 3
45 | DK | | t 80 2 2 2 2; p 90 2 2 2 2; fm [2-9] 2 2 2 2
46 | SE | 0 | t 20 2 2-3 2-3; m 7[02369] 2 3 2 2; f 8 1 2-3 2-3 2, 1 3 3 2; f (?:1[013689]|2[0136]|3[1356]|4[0246]|54|6[03]|90) 2 2-3 2 2; f [1-69] 3 2-3 2, 3 2 2 2
47 | NO SJ | | t 80[01] 3 2 3; p 82[09] 3 2 3; m [49] 3 2 3, 2 2 2 2; f [2-37] 2 2 2 2; f [56] 2 2 2 2
48 | PL | | t 800 3 3 3; s 801 3 3 3; m 45|5[0137]|6[069]|7[2389]|88 3 3 3; f [1-9] 2 3 2 2
49 | DE | 0 | t 800 3 7-9; s 180 3 5-7, 4 3-5; p 900 3 7; m 1(?:5|6[023]|7) 3 7-8, 4 7; f (?:[34]0|69|89) 2 4-9; f [2-9] 3 4-8, 4 3-7, 5 3-6
500 | FK | |
501 | BZ | |
502 | GT | |
503 | SV | |
504 | HN | |
505 | NI | |
506 | CR | |
507 | PA | |
508 | PM | 0 |
509 | HT | |
51 | PE | 0 | m 9 3 3 3; f 1 1 7, 1 3 4; f [4-8] 2 6
52 | MX | | fm [2-9] 2 4 4, 3 3 4
53 | CU | 0 |
54 | AR | 0 | t 800 3 3 4; m 9 1 2 4 4, 1 3 3 4, 1 4 2 4; f 11 2 4 4; f [2-3] 3 3 4, 4 2 4
55 | BR | 0? | t 800 3 3 4; m [1-9][1-9] 2 5 4; f [1-9][1-9] 2 4 4
56 | CL | | t 800 3 3 3; m 9 1 4 4; f 2 1 4 4; f [3-7] 2 3 4
57 | CO | 0? | m 3 3 7, 3 3 4; f 60 3 7, 3 3 4
58 | VE | 0 | m 4 3 7; f 2 3 7
590 | GP BL MF | 0 | m 69 3 2 2 2; f 5 3 2 2 2
591 | BO | 0? |
592 | GY | |
593 | EC | 0 | m 9 2 3 4; f [2-7] 1 3 4
594 | GF | 0 |
595 | PY | 0 |
596 | MQ | 0 |
597 | SR | |
598 | UY | 0 | m 9 2 3 3; f [24] 4 4
599 | CW BQ | |
60 | MY | 0 | m 1 2 3-4 4; f 3 1 4 4; f [4-79] 1 3 4; f 8 2 3 3
61 | AU CC CX | 0 | t 180 4 3 3; s 13 4 3 3, 2 2 2; m 4 3 3 3; f [2378] 1 4 4
62 | ID | 0 | m 8 3 3-4 3-5, 2 7-10; f 21 2 5-8; f [2-79] 3 5-8
63 | PH | 0 | m 9 3 3 4; f 2 1 4 4, 1 3 4; f [3-8] 2 3 4
64 | NZ | 0 | t 80 3 3 3-4; m 2 2 3 3-5; f [34679] 1 3 4
65 | SG | | t 1?800 4 3 4, 3 3 4; m [89] 4 4; f [36] 4 4
66 | TH | 0 | m [689] 2 3 4; f 2 1 3 4; f [3-57] 2 3 3
670 | TL | |
672 | NF | |
673 | BN | |
674 | NR | |
675 | PG | |
676 | TO | |
677 | SB | |
678 | VU | |
679 | FJ | |
680 | PW | |
681 | WF | |
682 | CK | |
683 | NU | |
685 | WS | |
686 | KI | |
687 | NC | |
688 | TV | |
689 | PF | |
690 | TK | |
691 | FM | |
692 | MH | |
7 | RU KZ | 8? | t 80[04] 3 3 2 2, 3 3 4; m 9|7[07] 3 3 2 2, 3 3 4; f [3-8] 3 3 2 2, 3 3 4, 4 6, 4 2 2 2
81 | JP | 0 | t 120 3 3 3; m [789]0 2 4 4; v 50 2 4 4; f [36] 1 4 4; f [1-9] 2 3-4 4, 3 2 4, 2 3 4
82 | KR | 0 | m 1 2 3-4 4; f 2 1 3-4 4; f [3-6] 2 3-4 4
84 | VN | 0 | m [35789] 2 3 4, 3 3 3, 2 3 2 2; f 2[48] 2 4 4; f 2 3 4 3, 3 3 4
850 | KP | 0 |
852 | HK | | t 800 3 3 3; m [4-79] 4 4; f [238] 4 4
853 | MO | |
855 | KH | 0 |
856 | LA | 0 |
86 | CN | 0 | m 1[3-9] 3 4 4; f (?:10|2) 2 4 4, 2 8; f [3-9] 3 3-4 4, 3 7-8
880 | BD | 0 | m 1 4 6; u [2-9] *7-9
886 | TW | 0 | t 80 3 3 3; m 9 3 3 3; f 2 1 4 4; f [3-8] 1 3 4
90 | TR | 0 | t 800 3 3 4; m 5 3 3 4, 3 3 2 2; f [2-4] 3 3 4, 3 3 2 2
91 | IN | 0? | t 1800 4 3 3-4; m [6-9] 5 5, 4 3 3; f (?:11|2[02]|33|4[04]|79|80) 2 4 4; f [1-8] 3 3 4, 4 3 3
92 | PK | 0 | m 3 3 7; f (?:2[125]|4[0-246-9]|5[1-35-7]|6[1-8]|7[14]|8[16]|91) 2 7, 2 8; f [2-9] 3 6-7
93 | AF | 0 |
94 | LK | 0 | m 7 2 3 4; f [1-689] 2 3 4
95 | MM | 0 |
960 | MV | |
961 | LB | 0 |
962 | JO | 0 | m 7 1 4 4; f [2-6] 1 3 4
963 | SY | 0 |
964 | IQ | 0 |
965 | KW | | m [569] 4 4, 3 5; f [12] 4 4
966 | SA | 0 | t 800 3 3 4; m 5 2 3 4; f 1 2 3 4
967 | YE | 0 |
968 | OM | | m [79] 4 4; f 2 2 6
970 | PS | 0 |
971 | AE | 0 | t 800 3 2-9; m 5 2 3 4; f [2-4679] 1 3 4
972 | IL | 0 | m 5 2 3 4; v 7 2 3 4; f [2-489] 1 3 4
973 | BH | | m [36] 4 4; f 1 4 4
974 | QA | | m [3567] 4 4; f 4 4 4
975 | BT | |
976 | MN | 0? |
977 | NP | 0 |
98 | IR | 0 | m 9 3 3 4, 2 4 4; f [1-8] 2 4 4
992 | TJ | |
993 | TM | |
994 | AZ | 0 |
995 | GE | 0? |
996 | KG | 0 |
998 | UZ | |
"""

#: Rows of the other countries, by the zone's first digit.
REST = {"2": "u [1-9] *7-9", "3": "u [2-9] *6-9", "5": "u [2-9] *6-9", "6": "u [2-9] *5-8", "8": "u [1-9] *7-10", "9": "u [1-9] *7-9"}

#: Codes of no country.
WORLDWIDE = {"800": "t", "808": "s", "870": "u", "878": "n", "881": "u", "882": "u", "883": "u", "888": "a", "979": "p"}
WORLDWIDE_GROUPS = "*7-12"

#: What is dialled before a country code, where it is not 00.
ABROAD = {"1": "011", "7": "810", "61": "0011", "62": "00[17-9]", "65": "0[0-3]\\d", "66": "00[1-9]", "81": "010", "82": "00[1-9]", "852": "00(?:30|[126-9])?", "886": "0[025-79]", "57": "00[579]?"}


@dataclass(frozen=True)
class Row:
    """One kind of number of a plan: its leading digits and one grouping (sizes as (least, most)), or any groups."""

    kind: str
    lead: str
    sizes: tuple[tuple[int, int], ...]
    any_groups: bool = False

    def pattern(self, trunk: bool) -> str:
        """Over digits with ``-`` between groups. A group may not be parted; groups may run together, but where a trunk
        prefix exists the first group stands apart or none does."""
        # leading digits may reach into the next group
        ahead = "(?=" + re.sub(r"(\[[^\]]+\]|\\d|\d)", r"(?:\1-?)", self.lead) + ")"
        if self.any_groups:
            low, high = self.sizes[0]
            return ahead + rf"(?=(?:-?\d){{{low},{high}}}$)\d{{2,}}(?:-\d{{2,}})*"
        parts = [rf"\d{{{a}}}" if a == b else rf"\d{{{a},{b}}}" for a, b in self.sizes]
        if trunk and len(parts) > 1:
            return ahead + f"(?:{parts[0]}-{'-?'.join(parts[1:])}|{''.join(parts)})"
        return ahead + "-?".join(parts)

    def splits(self) -> list[tuple[int, ...]]:
        """Every choice of sizes, spelled out."""
        return list(product(*[range(a, b + 1) for a, b in self.sizes]))


@dataclass(frozen=True)
class Plan:
    code: str
    regions: tuple[str, ...]
    trunk: str
    optional: bool
    rows: tuple[Row, ...]


def _rows(text: str) -> tuple[Row, ...]:
    found = []
    for row in filter(None, (r.strip() for r in text.split(";"))):
        kind, lead, groupings = row.split(" ", 2)
        for grouping in groupings.split(","):
            sizes = tuple((int(a), int(b or a)) for a, b in re.findall(r"(\d+)(?:-(\d+))?", grouping))
            found.append(Row(KINDS[kind], lead, sizes, "*" in grouping))
    return tuple(found)


@cache
def plans() -> dict[str, Plan]:
    """By country code. No code is the beginning of another."""
    found = {}
    for line in PLANS.strip().splitlines():
        # leading digits may hold alternatives, so only the first three bars part the columns
        code, regions, trunk, rows = (x.strip() for x in line.split("|", 3))
        found[code] = Plan(code, tuple(regions.split()), trunk.rstrip("?"), trunk.endswith("?"), _rows(rows or REST[code[0]]))
    for code, kind in WORLDWIDE.items():
        found[code] = Plan(code, (), "", False, _rows(f"{kind} \\d {WORLDWIDE_GROUPS}"))
    return found


@cache
def plan_of_region() -> dict[str, Plan]:
    return {r: p for p in plans().values() for r in p.regions}


def abroad_prefix(region: str) -> str:
    """What is dialled in a region before a country code, as an expression."""
    plan = plan_of_region().get(region)
    return ABROAD.get(plan.code, "00") if plan else "00"


@cache
def codes_pattern() -> str:
    """All country codes as one expression that branches digit by digit."""

    def branch(rests: frozenset[str]) -> str:
        heads = sorted({r[0] for r in rests if r})
        if not heads:
            return ""
        parts = [h + branch(frozenset(r[1:] for r in rests if r and r[0] == h)) for h in heads]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(frozenset(plans()))


def _by_kind(rows: tuple[Row, ...], trunk: bool) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row.kind, []).append(row.pattern(trunk))
    return found


@cache
def international() -> tuple[tuple[str, str], ...]:
    """(kind, expression) over ``code-groups``, for all codes. A trunk prefix may stand after the code."""
    listed: dict[str, list[str]] = {}
    for plan in plans().values():
        for kind, patterns in _by_kind(plan.rows, bool(plan.trunk)).items():
            trunk = f"(?:{plan.trunk}-?)?" if plan.trunk else ""
            listed.setdefault(kind, []).append(f"{plan.code}-?{trunk}(?:{'|'.join(patterns)})")
    return tuple((k, f"^(?:{'|'.join(listed[k])})$") for k in KINDS.values() if k in listed)


@cache
def national(region: str) -> tuple[tuple[str, str], ...]:
    """(kind, expression) over groups as dialled within a region; none for an unknown region."""
    plan = plan_of_region().get(region)
    if plan is None:
        return ()
    before = f"(?:{plan.trunk}-?)?" if plan.optional else f"{plan.trunk}-?" if plan.trunk else ""
    listed = _by_kind(plan.rows, bool(plan.trunk))
    return tuple((k, f"^{before}(?:{'|'.join(listed[k])})$") for k in KINDS.values() if k in listed)


@cache
def trunk_cuts() -> dict[str, tuple[str, ...]]:
    """Expression that cuts a trunk prefix off the digits after a country code → the codes it is for."""
    found: dict[str, list[str]] = {}
    for plan in plans().values():
        if plan.trunk:
            # a national number may start like its trunk prefix, and is told by its length then
            clear = not any(re.match(f"(?:{r.lead})", plan.trunk.ljust(6, "0")) or re.match(f"(?:{r.lead})", plan.trunk.ljust(6, "5")) for r in plan.rows)
            sizes = sorted({sum(s) for r in plan.rows for s in r.splits()})
            found.setdefault(f"^{plan.trunk}" + ("" if clear else rf"(?=(?:{'|'.join(rf'\d{{{n}}}' for n in sizes)})$)"), []).append(plan.code)
    return {k: tuple(v) for k, v in found.items()}
