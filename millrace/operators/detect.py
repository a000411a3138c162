"""Detectors as column expressions over folded text: length, injection phrases, addresses, fiscal codes, IBANs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.taxonomy import MESSAGE_LENGTH, PROMPT_INJECTION

#: Fixed values: (name, verbs, objects) of the injection phrases, in order; without objects the phrase stands alone.
INJECTION_PHRASES = (
    ("override_instructions_en", "ignore disregard forget override bypass".split(), ("instructions", "rules", "guardrails", "safety", "system prompt", "prompt")),
    ("reveal_prompt_en", ("reveal", "show", "display", "print", "tell me"), ("system prompt", "hidden prompt", "developer instructions", "internal instructions")),
    ("jailbreak_mode_en", ("developer mode", "jailbreak", "do anything now"), ()),
    ("override_instructions_it", "ignora disattiva scavalca aggira sovrascrivi".split(), ("istruzioni", "regole", "guardrail", "vincoli", "prompt di sistema", "prompt")),
    ("reveal_prompt_it", ("rivela", "mostra", "stampa", "dimmi"), ("prompt di sistema", "prompt nascosto", "istruzioni sviluppatore", "istruzioni interne")),
    ("jailbreak_mode_it", ("modalita sviluppatore", "modalità sviluppatore"), ()),
)
MAX_GAP = 40

#: An address has up to 64 signs before the at sign, up to three blanks after it, a host of up to 255 signs
#: and a last label of 2 to 24 letters.
ADDRESS = r"[\p{Alnum}._%+-]{1,64}@[ \t]{0,3}[\p{Alnum}.-]{1,255}[.]\p{Alpha}{2,24}"

#: A fiscal code is six letters, the year, the month's letter, the day, a letter and three digits for the
#: place, and a check letter; letters from L to V without O may stand for digits.
_DIGIT, _MONTH = "[0-9L-NP-V]", "[A-EHLMPR-T]"
FISCAL_CODE = rf"(?i)\b[A-Z]{{6}}{_DIGIT}{{2}}{_MONTH}{_DIGIT}{{2}}[A-Z]{_DIGIT}{{3}}[A-Z]\b"
#: Country, two check digits, 11 to 30 signs that single blanks may part.
IBAN = r"\b[A-Za-z]{2}[0-9]{2}(?:[ \u00A0]?[A-Za-z0-9]){11,30}\b"

#: The fiscal code's odd places, for 0-9 and then A-Z.
ODD_DIGITS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
ODD_LETTERS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)

KINDS = ("email", "codice_fiscale", "iban", "phone")


def injection_regex(verbs: tuple, objects: tuple) -> str:
    head = rf"\b(?:{'|'.join(verbs)})\b"
    return head + rf".{{0,{MAX_GAP}}}\b(?:{'|'.join(objects)})\b" if objects else head


def _holds_any(text: Column, words: tuple) -> Column:
    """Plain searches, which cost a fraction of an expression's and rule most texts out."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def length_verdict(text: Column, limit: Column | int) -> Column:
    """On the raw text, in code points; a limit of 0 or less turns it off."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when((limit > 0) & (F.length(text) > limit), MESSAGE_LENGTH)


def injection_pattern(phrase: Column, enabled: bool = True) -> Column:
    """Name of the first phrase that matches, in order."""
    if not enabled:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when((_holds_any(phrase, o) if o else F.lit(True)) & _holds_any(phrase, v) & phrase.rlike(injection_regex(v, o)), name) for name, v, o in INJECTION_PHRASES])


def injection_verdict(phrase: Column, enabled: bool = True) -> Column:
    return F.when(injection_pattern(phrase, enabled).isNotNull(), PROMPT_INJECTION)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def addresses(folded: Column) -> Column:
    """Addresses found, lower-cased and without inner spaces; texts without an at sign are not looked at."""
    found = F.transform(_all(folded, ADDRESS), lambda a: F.lower(F.translate(a, " \t", "")))
    return F.when(F.contains(folded, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def has_private_address(folded: Column, allowed: Column) -> Column:
    return F.exists(addresses(folded), lambda a: ~F.array_contains(allowed, a))


def valid_fiscal_code(candidate: Column) -> Column:
    """The sixteenth letter against the sum over the fifteen before it."""
    up = F.upper(candidate)
    odd_digits, odd_letters = (F.array(*[F.lit(x) for x in t]) for t in (ODD_DIGITS, ODD_LETTERS))

    def value(i: Column) -> Column:
        c = F.ascii(F.substring(up, i, F.lit(1)))
        digit = c < 58
        odd = F.when(digit, F.get(odd_digits, c - 48)).otherwise(F.get(odd_letters, c - 65))
        return F.when(i % 2 == 1, odd).otherwise(F.when(digit, c - 48).otherwise(c - 65))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda acc, i: acc + value(i))
    return (F.length(up) == 16) & F.coalesce(total % 26 == F.ascii(F.substring(up, 16, 1)) - 65, F.lit(False))


def valid_iban(candidate: Column) -> Column:
    """Remainder 1 modulo 97, kept small by folding sign by sign."""
    c = F.upper(F.regexp_replace(candidate, r"[ \u00A0]", ""))
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        a = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(a < 58, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.length(c).between(15, 34) & (rest == 1)


def has_fiscal_code(folded: Column) -> Column:
    return F.exists(_all(folded, FISCAL_CODE), valid_fiscal_code)


def has_iban(folded: Column) -> Column:
    return F.exists(_all(folded, IBAN), valid_iban)


def personal_data_kinds(folded: Column, allowed: Column, phones: Column | None = None, toggles: tuple[bool, bool, bool, bool] = (True,) * 4) -> Column:
    """All kinds found, in fixed order. ``phones``: whether a private number was found."""
    tests = (has_private_address(folded, allowed), has_fiscal_code(folded), has_iban(folded), phones if phones is not None else F.lit(False))
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) if on else F.lit(None).cast("string") for k, t, on in zip(KINDS, tests, toggles, strict=True)]))


def personal_data_verdict(kinds: Column, verdict: str) -> Column:
    return F.when(F.size(kinds) > 0, F.lit(verdict))
