"""Quality rules [native]: line-first cleaning.

Each line is judged on its own (punctuation, symbols, shouting, word repetition, navigation, boilerplate); lines that
fail are removed; a document that loses too large a share of its words is rejected. Only DataFrame functions are used,
and nothing is shuffled: a document is one row from scan to verdict. A rule is tried on the lines of a text only if the
text as a whole holds what every line that fails it must hold.

Defined results: null text counts as empty; an empty text has no words, fails the base rule and is not kept;
repeated rows are judged separately; other columns of the input are ignored by ``quality_signals`` and passed
through untouched by ``clean_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture in four languages. Matching is by substring, so the first letter, whose case
#: varies, is left out.
BOILERPLATE = (
    "cept all cookies", "ead more >>", "erms of use |", "ign up for our newsletter", "kip to content", "kip to main content",
    "lick here to", "nable javascript", "nable JavaScript", "avaScript is disabled", "orem ipsum dolor", "owered by WordPress",
    "rivacy policy |", "rivacy Policy |", "ses cookies to", "ubscribe to our newsletter",
    "lle Cookies akzeptieren", "atenschutzerklärung |", "licken Sie hier", "eiterlesen >>", "ewsletter abonnieren", "um Inhalt springen",
    "ccepter tous les cookies", "olitique de confidentialité |", "liquez ici", "ire la suite >>", "bonnez-vous à notre", "ller au contenu",
    "ceptar todas las cookies", "olítica de privacidad |", "aga clic aquí", "eer más >>", "uscríbete a nuestro", "altar al contenido",
)

#: Words that stand between the entries of a menu, and the marks that set off parts of a sentence.
SEPARATORS = ("|", "»", "›", "•", "·", ">", ">>", "::")
MARKS = ".,;:!?…。、，；：！？"

#: A word of capitals; what a line starts with that goes on a sentence of the line before.
SHOUTED = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
GOES_ON = r"^[\x20\x09-\x0D]*[\p{Ll}\p{Lo}]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules. Shares are of the line's words, percentages are integers."""

    max_symbol_words_pct: int = 30
    max_caps_words_pct: int = 60
    max_echo_words_pct: int = 40
    min_separators: int = 2
    min_unmarked_words: int = 12
    min_rule_words: int = 4
    min_base_words: int = 50
    max_repeat_pct: int = 50
    max_lost_pct: int = 30


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _any_phrase(text: Column) -> Column:
    found = text.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        found = found | text.contains(phrase)
    return found


def _needs(text: Column, words: Column, rules: LineRules) -> Column:
    """A struct of what a text must hold for any of its lines to fail each rule."""
    return F.struct(
        text.rlike("[#*$%&|<>]").alias("symbols"),
        text.rlike(r"\p{Lu}[^\p{Ll}\x20\x09-\x0D]*\p{Lu}").alias("caps"),
        F.exists(F.transform(words, lambda w, i: w == F.get(words, i - 1)), lambda same: F.coalesce(same, F.lit(False))).alias("echo"),
        text.rlike("[|»›•·>]|::").alias("menu"),
        _any_phrase(text).alias("phrase"),
        text.rlike(rf"(?m)^[^{MARKS}\n]{{{2 * rules.min_unmarked_words - 1},}}$").alias("unmarked"),
    )


def _line_fails(line: Column, after: Column, needs: Column, rules: LineRules) -> Column:
    """Whether a line is removed; ``after`` is the next one. Lines without words never fail: they hold no text."""

    def judge(words: Column) -> Column:
        n = F.size(words)
        share = lambda part, percent: (n >= rules.min_rule_words) & (F.size(part) * 100 > n * percent)
        separators = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
        # a menu's separators stand between entries of a few words each
        menu = (separators >= rules.min_separators) & (separators * 6 >= n)
        unmarked = (n >= rules.min_unmarked_words) & ~line.rlike(f"[{MARKS}]") & ~F.coalesce(after, F.lit("")).rlike(GOES_ON)
        return (
            (needs["symbols"] & share(F.filter(words, lambda w: w.rlike("[#*$%&|<>]")), rules.max_symbol_words_pct))
            | (needs["caps"] & share(F.filter(words, lambda w: w.rlike(SHOUTED)), rules.max_caps_words_pct))
            | (needs["echo"] & share(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))), rules.max_echo_words_pct))
            | (needs["menu"] & menu)
            | (needs["unmarked"] & unmarked)
            | (needs["phrase"] & _any_phrase(line))
        )

    return let(_words(line), judge)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in ``words``.

    Windows are compared by a 64-bit hash chained over the three words. Most texts repeat a few windows at most, and
    those are found by membership; texts with many repeats sort (hash, place) pairs, n log n for any text.
    """
    zero = F.lit(0).cast("long")
    few = F.lit(24)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, zero, lambda acc, x: acc + x)

    def by_sorting(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        near = F.transform(pairs, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.sort_array(F.filter(near, lambda p: p.isNotNull())), covered)

    def by_membership(hashes: Column, twice: Column) -> Column:
        near = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
        return let(F.filter(near, lambda p: p.isNotNull()), covered)

    def windows(hashes: Column) -> Column:
        pairs = lambda: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, j: h == F.get(s, j + 1))))
        return let(
            twice,
            lambda t: F.when(F.size(t) == 0, zero).when(F.size(t) <= few, by_membership(hashes, t)).otherwise(let(pairs(), by_sorting)),
        )

    def chained(single: Column) -> Column:
        all_places = F.transform(single, lambda h, i: F.xxhash64(h, F.get(single, i + 1), F.get(single, i + 2)))
        return F.slice(all_places, F.lit(1), F.size(single) - 2)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), chained)
    return F.when(F.size(words) < 3, zero).otherwise(let(hashes, windows))


def signals(text: Column, rules: LineRules = LineRules(), with_text: bool = False) -> Column:
    """A struct of every figure and the verdict for one text, and the text without the lines that fail if asked for."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.split(safe, "\n", -1)

    def judged(words: Column) -> Column:
        """The lines that fail, as places; empty at one look for most texts."""
        places = lambda needs: let(
            lines, lambda x: F.filter(F.transform(x, lambda y, i: F.when(_line_fails(y, F.get(x, i + 1), needs, rules), i)), lambda i: i.isNotNull())
        )
        any_need = lambda needs: needs["symbols"] | needs["caps"] | needs["echo"] | needs["menu"] | needs["phrase"] | needs["unmarked"]
        return let(_needs(safe, words, rules), lambda needs: F.when(any_need(needs), places(needs)).otherwise(F.array().cast("array<int>")))

    def figures(words: Column) -> Column:
        return let(
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _repeat_words(words).alias("n_repeat_words"),
                judged(words).alias("failing"),
            ),
            verdict,
        )

    def verdict(f: Column) -> Column:
        n, repeats, failing = f["n_words"], f["n_repeat_words"], f["failing"]
        failed = (n < rules.min_base_words) | (repeats * 100 > n * rules.max_repeat_pct)
        kept_lines = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        lost_words = F.aggregate(let(lines, lambda x: F.transform(failing, lambda i: F.size(_words(F.get(x, i))))), F.lit(0).cast("long"), lambda acc, k: acc + k)
        cleaned = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(failing, i)), "\n")
        return let(
            F.when(F.size(failing) == 0, F.lit(0).cast("long")).otherwise(lost_words),
            lambda lost: F.struct(
                n.alias("n_words"),
                f["word_chars"].alias("word_chars"),
                F.regexp_count(safe, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                let(kept_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeats.alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (lost * 100 <= n * rules.max_lost_pct)).alias("kept"),
                lost.alias("n_lost_words"),
                *([F.when(F.size(failing) == 0, text).otherwise(cleaned).alias("cleaned")] if with_text else []),
            ),
        )

    return let(_words(safe), figures)


def quality_signals(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``documents``: its figures and verdict."""
    return documents.select(F.col("doc_id"), signals(F.col("text"), rules).alias("_q")).select("doc_id", "_q.*")


def clean_documents(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``documents`` that the rules keep, their texts without the lines that fail; other columns stay."""
    # a generator runs its input once; a filter on the verdict would be pushed below and judge every text twice
    kept = let(signals(F.col("text"), rules, with_text=True), lambda q: F.when(q["kept"], F.array(q["cleaned"])).otherwise(F.array().cast("array<string>")))
    return documents.select(*[F.col(c) for c in documents.columns if c != "text"], F.explode(kept).alias("text")).select(*documents.columns)
