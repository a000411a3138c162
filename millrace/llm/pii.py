"""PII [native]: base patterns, and identifiers found by bootstrapped contexts.

Base spans come from four patterns with checks (address parts, Luhn, digit counts). Tokens that look like identifiers
(four digits or more, an at sign, a key and its value) are instances; the words before them are lexical patterns. Known
from the start are tokens that a base span covers, values of keys that name a secret, and numbers of a card's length
whose check digit is wrong, as a slip in a card number does not make it public. Rounds alternate over the
pattern-instance graph: a pattern scores the share of all its places in the corpus that known entities follow, an
instance the best score of its patterns; instances of patterns that score high become known in the next round. What a
pattern needs is a number of known tokens and a share, both the same at every size. Places are counted over all
documents, in one pass for every pattern that may ever be accepted: a pattern that some of the documents alone show in
more places than its instances can make up for is out, since the others can only add to them. Groupings are combined
map-side, so a frequent pattern costs one row per task.

Only DataFrame functions are used. Defined results: null text is empty; texts without personal data have counts of 0
and an empty span list; equal rows get equal results; rows that share a doc_id are told apart by their text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, matches, only_ids

#: The base patterns in their order. Possessive runs and look-behinds give the leftmost matches without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "identifier")

#: A token with an at sign, at least four digits, or a key and its value.
INSTANCE = r"(?<!\S)(?:(?=[^\s@]*@)|(?=[^\s0-9]*(?:[0-9][^\s0-9]*){4})|(?=[A-Za-z][A-Za-z0-9_.-]{1,30}=[^\s=]))\S+"
KEYED = r"^([A-Za-z][A-Za-z0-9_.-]{1,30}[=:]+)(?=.)"
#: What stands around a value: opening signs, and closing ones up to the last sign that values end in.
OPENING, CLOSING = r"^[\"'(\[{<]+", r"[^\p{L}\p{N}=_/+-]+$"

#: Keys that name a secret or personal number; they are trusted from the start.
TRUSTED_KEYS = (
    "access_key", "access_token", "account", "api_key", "apikey", "auth_token", "client_secret", "iban", "passport", "passwd",
    "password", "pin", "pwd", "secret", "secret_key", "ssn", "tax_id", "token", "username",
)

#: The value that such a key is given, with the signs between; and numbers as long as a card's.
ASSIGNED = r"(?i)(?<![A-Za-z0-9_.-])(?:" + "|".join(sorted(TRUSTED_KEYS, key=len, reverse=True)) + r")[\"']?\s{0,3}[=:]+\s{0,3}\S+"
ASSIGNMENT = r"(?i)^[a-z_]+[\"']?\s{0,3}[=:]+\s{0,3}"
CARD_LENGTH = r"(?<![0-9A-Za-z._-])[0-9](?:[\x20-]?[0-9]){15,18}(?![0-9A-Za-z_-])"

#: Spans, and twice the documents that hold some, up to which they are sent to every executor.
BROADCAST_SPANS = 1_000_000

SPAN = "array<struct<start:int,end:int,hit:string>>"


@dataclass(frozen=True)
class Bootstrap:
    """A pattern needs ``min_support`` different known tokens and ``min_score`` of all its places; one document in
    ``bound_sample`` gives the first bound on places."""

    rounds: int = 2
    min_support: int = 3
    min_score: float = 0.5
    bound_sample: int = 32


def places(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as structs (start, end, hit) in code points, end exclusive."""
    return let(
        matches(text, F.lit(pattern)),
        lambda m: F.transform(m["hits"], lambda h, i: F.struct((F.get(m["ends"], i) - F.length(h)).alias("start"), F.get(m["ends"], i).alias("end"), h.alias("hit"))),
    )


def _valid_ip(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (x.try_cast("int") <= 255))


def _valid_card(hit: Column) -> Column:
    def luhn(digits: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(digits)),
            F.lit(0),
            lambda acc, i: acc + let(F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
        )
        return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(F.reverse(F.regexp_replace(hit, r"[\x20-]", "")), luhn)


def _valid_phone(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)


def base_spans(text: Column) -> Column:
    """A struct of the base spans of each kind."""
    none = F.array().cast(SPAN)
    digits = text.rlike("[0-9]")
    return F.struct(
        F.when(F.contains(text, F.lit("@")), places(text, EMAIL)).otherwise(none).alias("email"),
        F.when(digits, F.filter(places(text, IP), lambda s: _valid_ip(s["hit"]))).otherwise(none).alias("ip"),
        F.when(digits, F.filter(places(text, CARD), lambda s: _valid_card(s["hit"]))).otherwise(none).alias("card"),
        F.when(F.contains(text, F.lit("+")), F.filter(places(text, PHONE), lambda s: _valid_phone(s["hit"]))).otherwise(none).alias("phone"),
    )


INSTANCES = "array<struct<pattern:string,token:string,start:int,end:int,trusted:boolean>>"


def _instance(pattern: Column, value: Column, at: Column, trusted: Column) -> Column:
    """A struct of an instance whose value, with signs around it, starts ``at``."""

    def trimmed(bare: Column) -> Column:
        lead = F.length(value) - F.length(bare)
        token = F.regexp_replace(bare, CLOSING, "")
        return F.struct(pattern.alias("pattern"), token.alias("token"), (at + lead).alias("start"), (at + lead + F.length(token)).alias("end"), trusted.alias("trusted"))

    return let(F.regexp_replace(value, OPENING, ""), trimmed)


def instances(text: Column) -> Column:
    """Identifier-like tokens as structs (pattern, token, start, end, trusted); a key in front belongs to the pattern."""
    none = F.array().cast(INSTANCES)
    no, yes = F.lit(False), F.lit(True)

    def by_words(m: Column) -> Column:
        part = lambda name, i: F.coalesce(F.get(m[name], i), F.lit(""))

        def one(h: Column, i: Column) -> Column:
            # the two words before a hit lie in the gap and, where that is short, in the two hits before
            before = F.concat(part("hits", i - 2), part("gaps", i - 1), part("hits", i - 1), part("gaps", i))
            words = F.lower(F.regexp_replace(F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+)\s+$", 1), r"\s+", " "))
            return let(
                F.regexp_extract(h, KEYED, 1),
                lambda key: _instance(F.when(key != "", F.lower(key)).otherwise(words), F.substr(h, F.length(key) + 1), F.get(m["ends"], i) - F.length(h) + F.length(key), no),
            )

        return F.transform(m["hits"], one)

    def assigned(s: Column) -> Column:
        return let(F.length(F.regexp_extract(s["hit"], ASSIGNMENT, 0)), lambda n: _instance(F.lit(""), F.substr(s["hit"], n + 1), s["start"] + n, yes))

    found = F.concat(
        F.when(text.rlike("[0-9@=]"), let(matches(text, F.lit(INSTANCE)), by_words)).otherwise(none),
        F.when(text.rlike("[=:]"), F.transform(places(text, ASSIGNED), assigned)).otherwise(none),
        F.when(text.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), F.transform(places(text, CARD_LENGTH), lambda s: _instance(F.lit(""), s["hit"], s["start"], yes))).otherwise(none),
    )
    return F.filter(found, lambda x: x["token"] != "")


def _word_pairs(documents: DataFrame) -> DataFrame:
    """(mark): the hash of each two words in a row in all texts."""
    words = F.split(F.lower(F.col("text")), r"\s+")
    pairs = let(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, F.get(w, i + 1)))))
    return documents.select(F.explode(pairs).alias("mark"))


def _counted(marks: DataFrame) -> DataFrame:
    return marks.groupBy("mark").agg(F.count("*").alias("total"))


def discover(documents: DataFrame, found: DataFrame, scratch: Scratch, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """Instances to report: rows of ``found`` (doc_id, mark, pattern, token, start, end, trusted, known) that no base span touches."""
    edges = found.filter("pattern <> ''").groupBy("pattern", "token").agg(F.max(F.col("known") | F.col("trusted")).alias("known"), F.count("*").alias("n"))
    edges = scratch.keep(edges, "edges")
    seeds = found.filter("known or trusted").select("token").distinct()
    known = scratch.keep(seeds, "known")
    eligible = edges.groupBy("pattern").agg(F.count("*").alias("tokens"), F.sum("n").alias("instances"))
    eligible = eligible.filter((F.col("tokens") >= conf.min_support) & F.contains("pattern", F.lit(" "))).withColumn("mark", F.xxhash64("pattern"))
    some = _counted(_word_pairs(documents.filter(F.pmod(F.xxhash64("text"), F.lit(conf.bound_sample)) == 0)))
    eligible = scratch.keep(eligible.join(some, "mark", "left").filter(F.coalesce("total", F.lit(0)) * conf.min_score <= F.col("instances")).select("pattern", "mark"), "eligible")
    totals = eligible.select("pattern", F.lit(0).cast("bigint").alias("total"))
    if eligible.limit(1).count():
        totals = scratch.keep(_counted(only_ids(_word_pairs(documents), eligible, "mark")), "totals").join(eligible, "mark").select("pattern", "total")
    for _ in range(conf.rounds):
        scored = edges.join(known.withColumn("seed", F.lit(True)), "token", "left").groupBy("pattern").agg(
            F.sum(F.when(F.col("seed"), 1).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("hits"),
            F.sum("n").alias("instances"),
        )
        candidates = scored.filter(F.col("support") >= conf.min_support).join(totals, "pattern", "left")
        # patterns of a key have no places but their instances; a worded one that was not counted is out
        counted = F.col("total").isNotNull() | ~F.contains("pattern", F.lit(" "))
        score = F.when(counted, F.col("hits") / F.greatest("instances", F.coalesce("total", "instances"))).otherwise(0.0)
        accepted = scratch.keep(candidates.filter(score >= conf.min_score).select("pattern"), "accepted")
        known = scratch.keep(known.unionByName(edges.join(accepted, "pattern", "left_semi").select("token")).distinct(), "known")
    new = found.filter(~F.col("known")).join(accepted.withColumn("accepted", F.lit(True)), "pattern", "left")
    return new.filter(F.col("trusted") | F.col("accepted"))


def _touches(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def analysed(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, base, seen): base spans and instances of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("mark"), let(text, base_spans).alias("base"), let(text, instances).alias("seen"))


def all_spans(documents: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per document: doc_id, mark, base (struct of base spans) and found (array of discovered spans)."""
    with Scratch(documents.sparkSession) as scratch:
        seen = scratch.keep(analysed(documents), "pii")
        base = F.flatten(F.array(*[F.col(f"base.{k}") for k in KINDS[:4]]))
        rows = seen.filter(F.size("seen") > 0).select("doc_id", "mark", base.alias("spans"), F.explode("seen").alias("x"))
        found = rows.select("doc_id", "mark", "x.*", _touches(F.col("x"), F.col("spans")).alias("known"))
        new = discover(documents.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), found, scratch, conf)
        lists = new.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        a, b = seen.alias("a"), lists.alias("b")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark"))
        return scratch.result(a.join(b, same, "left").select("a.doc_id", "a.mark", "a.base", F.coalesce("b.found", empty).alias("found")), "spans")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find_pii(documents: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_sha256, all spans, and how many were discovered."""
    base = [_listed(k, F.col(f"base.{k}")) for k in KINDS[:4]]
    return all_spans(documents, conf).select(
        "doc_id",
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, _listed("identifier", F.col("found"))), ",").alias("spans"),
        F.size("found").cast("long").alias("n_identifier"),
        (sum((F.size(f"base.{k}") for k in KINDS[:4]), F.size("found"))).cast("long").alias("n_spans"),
    )


def masked(documents: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """``documents`` with every span of their text replaced by its kind in brackets; all columns stay.

    Spans that overlap are replaced together, under the kind listed first. Null text stays null.
    """
    kinds = F.concat(*[F.transform(F.col(f"base.{k}"), lambda s, n=n: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))) for n, k in enumerate(KINDS[:4])],
                     F.transform(F.col("found"), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"))))
    spans = all_spans(documents.select("doc_id", "text"), conf).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.sort_array(kinds).alias("_spans"))
    spans = spans.filter(F.size("_spans") > 0).dropDuplicates(["_doc", "_mark"])
    # texts stay where they are while the spans take some 20 MB at most
    if (spans.agg(F.sum(F.size("_spans") + 2)).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.get(names, s["kind"])))).otherwise(acc["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    replaced = F.aggregate(F.col("_spans"), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col("text"), acc["at"] + 1)))
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = documents.withColumn("_own", mark).join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_mark")), "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(replaced)).select(*documents.columns)
