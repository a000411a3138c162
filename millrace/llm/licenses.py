"""License scans [native]: ordered signature rules behind a keyword prefilter.

Each text is searched once for each distinct keyword of the rules; only rules whose keyword stands in it run their
regular expression. Detections are intervals with the rule's priority; one that lies inside another of the same or a
higher priority is suppressed. Base phrases are counted on words, apart from the rules. Everything is a DataFrame
expression on one row: no shuffle, no Python, and the cost of a text is linear in its length and its detections.

Defined results: null text is empty; texts without a phrase have null first_word and last_word, empty labels and
score 0; repeated rows are judged separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, matches, running

#: Signs that stand between words: all of ASCII but letters and digits.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE_PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on lower-cased text that holds ``keyword``; a match lies within some 400 characters."""

    name: str
    label: str
    keyword: str
    pattern: str
    priority: int


#: License families: (label, keyword, pattern of the name, identifiers for tags). Templates below turn each into rules.
FAMILIES = (
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?,?\s+(?:version |v)?1\.1", "apache-1.1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)?,?\s*(?:\(?(?:version |v)?\s*2(?:\.0)?\)?)", "apache-2.0"),
    ("mit", "mit", r"(?:the )?mit(?:/x11)?(?= licen[cs]e|\b)", "mit"),
    ("isc", "isc", r"isc(?= licen[cs]e)", "isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|2-clause bsd|bsd[- ]2[- ]clause)", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|3-clause bsd|bsd[- ]3[- ]clause)", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|4-clause bsd|bsd[- ]4[- ]clause)", "bsd-4-clause"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,?\s+(?:version |v)1(?:\.0)?(?!\.?\d)", "gpl-1.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,?\s+(?:as published by the free software foundation[;,]? )?(?:either )?(?:version |v)2(?:\.0)?(?!\.?\d)", "gpl-2.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,?\s+(?:as published by the free software foundation[;,]? )?(?:either )?(?:version |v)3(?:\.0)?(?!\.?\d)", "gpl-3.0"),
    ("gpl-2.0", "gpl", r"\b(?:gnu )?gpl[- ]?v?2(?:\.0)?(?!\.?\d)", "gpl-2.0-only"),
    ("gpl-3.0", "gpl", r"\b(?:gnu )?gpl[- ]?v?3(?:\.0)?(?!\.?\d)", "gpl-3.0-only"),
    ("lgpl-2.0", "general public", r"library general public licen[cs]e,?\s+(?:version |v)2(?:\.0)?", "lgpl-2.0"),
    ("lgpl-2.1", "general public", r"lesser general public licen[cs]e,?\s+(?:version |v)2\.1", "lgpl-2.1"),
    ("lgpl-3.0", "general public", r"lesser general public licen[cs]e,?\s+(?:version |v)3(?:\.0)?", "lgpl-3.0"),
    ("lgpl-2.1", "lgpl", r"\b(?:gnu )?lgpl[- ]?v?2\.1", "lgpl-2.1-only"),
    ("lgpl-3.0", "lgpl", r"\b(?:gnu )?lgpl[- ]?v?3(?:\.0)?", "lgpl-3.0-only"),
    ("agpl-3.0", "affero", r"affero general public licen[cs]e(?:,?\s+(?:version |v)3(?:\.0)?)?", "agpl-3.0"),
    ("agpl-3.0", "agpl", r"\b(?:gnu )?agpl[- ]?v?3(?:\.0)?", "agpl-3.0-only"),
    ("gfdl-1.3", "documentation licen", r"(?:gnu )?free documentation licen[cs]e(?:,?\s+(?:version |v)1\.\d)?", "gfdl-1.3"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,?\s+(?:version |v)?1\.[01]", "mpl-1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,?\s+(?:version |v)?2(?:\.0)?", "mpl-2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e\s*(?:-|,)?\s*(?:version |v)?1(?:\.0)?", "epl-1.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e\s*(?:-|,)?\s*(?:version |v)?2(?:\.0)?", "epl-2.0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?:,?\s+(?:version |v)?1\.0)?", "cddl-1.0"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?:,?\s+(?:version |v)?1\.0)?", "cpl-1.0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?:,?\s+(?:version |v)?1\.\d)?", "eupl-1.2"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[cs]e,?\s+(?:version |v)?1(?:\.0)?", "artistic-1.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,?\s+(?:version |v)?2(?:\.0)?", "artistic-2.0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:\s*[-,]?\s*(?:version |v)?1\.0)?", "bsl-1.0"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?(?= licen[cs]e)", "zlib"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", "wtfpl"),
    ("unlicense", "unlicense", r"\bunlicense\b", "unlicense"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?(?: universal)?", "cc0-1.0"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?:,?\s+(?:version |v)?1\.1)?", "ofl-1.1"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "ms-rl"),
    ("osl-3.0", "open software", r"open software licen[cs]e,?\s+(?:version |v)?3\.0", "osl-3.0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e,?\s+(?:version |v)?3\.0", "afl-3.0"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e(?:,?\s+version 2)?", "psf-2.0"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", "illinois", r"university of illinois(?:/ncsa)? open source licen[cs]e", "ncsa"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e(?:,?\s+(?:version |v)?1\.0)?", "odbl-1.0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?:,?\s+(?:version |v)?1\.0)?", "odc-by-1.0"),
    ("pddl-1.0", "public domain", r"(?:odc )?public domain dedication and licen[cs]e", "pddl-1.0"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?:[-+]?[ms])?(?: licen[cs]e)?", "openrail"),
    ("llama", "community licen", r"llama (?:\d(?:\.\d)? )?community licen[cs]e", "llama2"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:,?\s+(?:version |v)?1\.1)?", "busl-1.1"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?:,?\s+(?:version |v)?1)?", "sspl-1.0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?:,?\s+(?:version |v)?2\.0)?", "elastic-2.0"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl),?\s*(?:version |v)?2", "mulanpsl-2.0"),
    ("ogl-3.0", "open government", r"open government licen[cs]e(?:\s+(?:version |v)?3\.0)?", "ogl-3.0"),
)

#: Creative Commons: suffixes of the label with the long form of their elements.
CC_ELEMENTS = (
    ("by", r"attribution"),
    ("by-sa", r"attribution[- ]share ?alike"),
    ("by-nc", r"attribution[- ]non-?commercial"),
    ("by-nd", r"attribution[- ]no ?deriv(?:s|atives|ative works)"),
    ("by-nc-sa", r"attribution[- ]non-?commercial[- ]share ?alike"),
    ("by-nc-nd", r"attribution[- ]non-?commercial[- ]no ?deriv(?:s|atives|ative works)"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Signatures of license texts and notices: (name, label, keyword, pattern, priority).
TEXTS = (
    ("mit-grant", "mit", "hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files", 3),
    ("mit-notice", "mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 3),
    ("isc-grant", "isc", "with or without fee", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 3),
    ("bsd-redistribution", "bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 3),
    ("bsd-endorse", "bsd-3-clause", "endorse", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", 3),
    ("bsd-advertising", "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 3),
    ("apache-notice", "apache-2.0", "apache.org/licenses", r"you may obtain a copy of the licen[cs]e at\s+https?://www\.apache\.org/licenses/license-2\.0", 3),
    ("apache-express", "apache-2.0", "express or implied", r"distributed on an \"?as is\"? basis,?\s+without warranties or conditions of any kind,? either express or implied", 2),
    ("gpl-notice", "gpl", "free software", r"this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e", 3),
    ("gpl-warranty", "gpl", "without any warranty", r"without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose", 2),
    ("gpl-copy", "gpl", "should have received", r"you should have received a copy of the gnu (?:lesser |affero )?general public licen[cs]e", 2),
    ("gpl-plain", "gpl", "general public", r"gnu general public licen[cs]e", 1),
    ("gpl-short", "gpl", "gpl", r"\bgpl\b", 1),
    ("lgpl-plain", "lgpl", "general public", r"gnu (?:lesser|library) general public licen[cs]e", 2),
    ("mpl-notice", "mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. 2\.0", 3),
    ("zlib-grant", "zlib", "as-is", r"this software is provided ['\"]?as-is['\"]?,? without any express or implied warranty\. in no event will the authors be held liable", 3),
    ("unlicense-grant", "unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 3),
    ("wtfpl-grant", "wtfpl", "what the", r"do what the (?:fuck|f\W{1,3}k) you want to public licen[cs]e", 3),
    ("public-domain", "public-domain", "public domain", r"(?:in|into|to) the public domain", 2),
    ("cc0-waiver", "cc0-1.0", "waive", r"to the extent possible under law,.{1,120}?waived all copyright", 3),
    ("cc-plain", "cc", "creative commons", r"creative commons licen[cs]e", 1),
    ("fair-use", "fair-use", "fair use", r"\bfair use\b", 1),
    ("copyright-sign", "copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:\s?[-–,]\s?(?:19|20)\d\d)*", 1),
    ("copyright-holder", "copyright", "copyright", r"copyright(?:ed)? (?:by|of|held by) [^.\n]{2,60}", 1),
    ("reserved-plain", "reserved", "rights reserved", r"(?:all|some|no) rights reserved", 1),
    ("proprietary", "proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e|proprietary software)", 2),
    ("no-reproduction", "proprietary", "reproduc", r"(?:may not|no part of .{1,60}? may) be reproduced", 2),
    ("noncommercial", "noncommercial", "commercial", r"(?:for )?non-?commercial (?:use|purposes)(?: only)?", 1),
    ("research-only", "noncommercial", "research", r"for research (?:use|purposes) only", 2),
    ("generic-licensed", "licensed", "licen", r"licen[cs]ed under [^.\n]{2,60}", 1),
)


def default_rules() -> tuple[Rule, ...]:
    """The rules in order: texts, then each family's tag, reference and name, then Creative Commons."""
    rules = [Rule(*t) for t in TEXTS]
    leads = r"(?:(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? )"
    # a tag ends where its signs end; a name ends a word, and a version does not go on
    tag_ends, name_ends = r"(?![\w+-]|\.\w)", r"(?!\w|\.\d)"
    for n, (label, keyword, name, tag) in enumerate(FAMILIES):
        rules.append(Rule(f"{tag}-tag", label, "spdx-license-identifier", rf"spdx-license-identifier:\s*{tag.replace('.', '[.]')}(?:-only|-or-later)?{tag_ends}", 3))
        rules.append(Rule(f"{tag}-reference-{n}", label, keyword, rf"\b{leads}{name}(?: licen[cs]e)?{name_ends}", 3))
        rules.append(Rule(f"{tag}-name-{n}", label, keyword, rf"\b{name}(?: licen[cs]e){name_ends}" if label in ("mit", "isc", "zlib") else rf"\b{name}{name_ends}", 2))
    for suffix, long_form in CC_ELEMENTS:
        short = suffix.replace("-", "[- ]")
        for version in CC_VERSIONS:
            v = version.replace(".", r"\.")
            rules.append(Rule(f"cc-{suffix}-{version}", f"cc-{suffix}-{version}", "cc", rf"\bcc[- ]{short}[- ]v?{v}{name_ends}", 3))
            rules.append(Rule(f"cc-{suffix}-{version}-long", f"cc-{suffix}-{version}", "commons", rf"creative commons {long_form} (?:licen[cs]e )?{v}{name_ends}", 3))
            rules.append(Rule(f"cc-{suffix}-{version}-url", f"cc-{suffix}-{version}", "creativecommons.org", rf"creativecommons\.org/licenses/{suffix}/{v}{name_ends}", 3))
        rules.append(Rule(f"cc-{suffix}-any", f"cc-{suffix}", "cc", rf"\bcc[- ]{short}\b(?![- ](?:nc|nd|sa|v?\d))", 2))
    return tuple(rules)


DEFAULT_RULES = default_rules()

#: What a detection of each priority counts for in the score, and a base phrase.
WEIGHTS = {1: 0.5, 2: 0.75, 3: 0.95}
BASE_WEIGHT = 0.5


DETECTIONS = "array<struct<start:int,minus_end:int,minus_priority:int,rule:string,label:string>>"


def _places(text: Column, rule: Column) -> Column:
    """All matches of ``rule`` in ``text`` as structs, places in code points."""

    def located(found: Column) -> Column:
        return F.transform(
            found["hits"],
            lambda h, i: F.struct(
                (F.get(found["ends"], i) - F.length(h)).alias("start"),
                (-F.get(found["ends"], i)).alias("minus_end"),
                (-rule["priority"]).alias("minus_priority"),
                rule["name"].alias("rule"),
                rule["label"].alias("label"),
            ),
        )

    return let(matches(text, rule["pattern"]), located)


def _suppressed(sorted_hits: Column) -> Column:
    """The detections that no other of the same or a higher priority contains. A containing one always comes first.

    For each priority the farthest end of detections of at least that priority is carried along.
    """

    def reach(hits: Column, least: int) -> Column:
        ends = F.transform(hits, lambda x: F.when(x["minus_priority"] <= -least, -x["minus_end"]).otherwise(F.lit(-1)))
        return let(ends, lambda e: running(e, F.lit(-1), F.greatest))

    def kept(both: Column) -> Column:
        def clear(x: Column, i: Column) -> Column:
            before = F.when(x["minus_priority"] == -1, F.get(both["r1"], i - 1)).when(x["minus_priority"] == -2, F.get(both["r2"], i - 1)).otherwise(F.get(both["r3"], i - 1))
            return -x["minus_end"] > F.coalesce(before, F.lit(-1))

        return F.filter(both["hits"], clear)

    return let(sorted_hits, lambda hits: let(F.struct(hits.alias("hits"), reach(hits, 1).alias("r1"), reach(hits, 2).alias("r2"), reach(hits, 3).alias("r3")), kept))


def detections(lowered: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Detections in a lower-cased text, in order of their start."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(r).items()]) for r in rules])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])

    def found(present: Column) -> Column:
        near = F.filter(table, lambda r: F.array_contains(present, r["keyword"]))
        return F.when(F.size(present) == 0, F.array().cast(DETECTIONS)).otherwise(_suppressed(F.sort_array(F.flatten(F.transform(near, lambda r: _places(lowered, r))))))

    return let(F.filter(keywords, lambda k: F.contains(lowered, k)), found)


def _base(words: Column) -> Column:
    """(word number, label) of the places of base phrases."""

    def place(w: Column, i: Column) -> Column:
        out = None
        for phrase, label in BASE_PHRASES:
            fits = w == phrase[0]
            for k, other in enumerate(phrase[1:], 1):
                fits = fits & (F.get(words, i + k) == other)
            hit = F.struct(i.alias("at"), F.lit(label).alias("label"))
            out = F.when(F.coalesce(fits, F.lit(False)), hit) if out is None else out.when(F.coalesce(fits, F.lit(False)), hit)
        return out

    return F.filter(F.transform(words, place), lambda x: x.isNotNull())


def scan(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """A struct of all results for one text."""
    safe = F.coalesce(text, F.lit(""))
    no_base = F.array().cast("array<struct<at:int,label:string>>")

    def gate(lowered: Column) -> Column:
        """Every phrase holds its longest word."""
        near = F.lit(False)
        for phrase, _ in BASE_PHRASES:
            near = near | F.contains(lowered, F.lit(max(phrase, key=len)))
        return near

    def result(found: Column) -> Column:
        base, hits = found["base"], found["hits"]
        at = F.transform(base, lambda x: x["at"])
        weights = F.transform(hits, lambda h: F.when(h["minus_priority"] == -1, WEIGHTS[1]).when(h["minus_priority"] == -2, WEIGHTS[2]).otherwise(WEIGHTS[3]))
        labels = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"])))
        return F.struct(
            found["n"].cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(at).cast("long").alias("first_word"),
            F.array_max(at).cast("long").alias("last_word"),
            F.array_join(labels(base), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(labels(base), labels(hits))), ",").alias("labels"),
            F.coalesce(F.greatest(F.array_max(weights), F.when(F.size(base) > 0, F.lit(BASE_WEIGHT))), F.lit(0.0)).alias("score"),
            F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["rule"], h["start"].cast("string"), (-h["minus_end"]).cast("string"))), ",").alias("detections"),
        )

    def by_words(words: Column, lowered: Column) -> Column:
        return let(
            F.struct(
                F.size(words).alias("n"),
                F.when(gate(lowered), _base(words)).otherwise(no_base).alias("base"),
                detections(lowered, rules).alias("hits"),
            ),
            result,
        )

    return let(ascii_lower(safe), lambda lowered: let(F.filter(F.split(lowered, BETWEEN_WORDS), lambda w: w != ""), lambda words: by_words(words, lowered)))


def scan_documents(documents: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One row per document: doc_id, the base figures, labels, score and the detections (rule:start:end)."""
    return documents.select("doc_id", scan(F.col("text"), rules).alias("_s")).select("doc_id", "_s.*")
