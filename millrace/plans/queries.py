"""The queries of the screening operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allowlists, detect, events, inforce, phone, scoring, screen, tallies, tone
from ..sources.messages import ROLES, log_stream, read_messages, spread
from ..sources.policy import Policy, policy_frame
from ..sources.policy_rows import bad_fields
from ..sources.shared import shared_folder, stored
from ..streaming.announcements import announced
from ..streaming.screening import refusal_bursts, refusal_windows, screen_stream, start_screening
from . import inline, phone_sql, taxonomy

NO_PHONE = Policy(max_message_chars=60, detect_input_phone=False, detect_output_phone=False)
POLICIES = [
    Policy(),
    replace(Policy(), max_message_chars=0, detect_output_email=False, detect_output_codice_fiscale=False, detect_output_iban=False, detect_output_phone=False),
    replace(Policy(), **{f"detect_{s}_{k}": False for s in ("input", "output") for k in detect.KINDS}),
    replace(Policy(), detect_prompt_injection_custom=False, detect_offensive_input_classifier=True, detect_input_email=False, detect_input_codice_fiscale=False, detect_input_iban=False, detect_input_phone=False),
    replace(Policy(), detect_prompt_injection_classifier=True, detect_offensive_input_classifier=True, input_phone_region="FR", classifier_device="gpu0"),
    replace(Policy(), detect_prompt_injection_custom=False),
]
#: Stored settings as they came to be in force, with the turn from which each holds; one cannot be read, one is empty.
QUIET = {"detect_input_phone": False, "detect_output_phone": False}
VERSIONS = [
    {"max_message_chars": 60, **QUIET},
    {"max_message_chars": 200, "help_desk_email": "info@agency.gov", "message_too_long": "Too long, write to {help_desk_email}.", **QUIET},
    {"max_message_chars": -5, "huggingface_token": "hf_secret0123456789"},
    {"max_message_chars": 100, "detect_prompt_injection_custom": False, "public_service_contacts": "a@b.org", "input_phone_region": "fr", **QUIET},
    None,
    {"max_message_chars": 0, "personal_data_detected": "No private data, please.", **QUIET},
]
STARTS = [(0, 0, 0), (3, 2, 1), (20, 0, 2), (40, 1, 3), (60, 0, 4), (61, 0, 2), (80, 0, 5)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql} AS t")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and the cases beside them under negative ids."""
    cases = _rows(spark, inline.MESSAGES).select((-F.col("msg_id")).cast("long").alias("doc_id"), "text")
    return cases.unionByName(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns, and the cases beside them."""
    cases = _rows(spark, inline.MESSAGES).select((-F.col("msg_id")).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return cases.unionByName(_turns(spark, sf_dir, "user"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of summaries and failures: an event that is an error failed, any other succeeded."""
    rows = _table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("summary"), F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", F.concat(F.lit("error "), (F.col("user_id") % 3).cast("string"))).alias("reason"))


def _tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "labels")
    weights = stored(tone.tone_weights(documents, labels), "weights")
    return stored(tone.tone_scores(documents, labels, weights).filter(F.col("toxic").isNotNull()), "tone")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labelled documents in the label spaces of three models, and the cases beside them."""
    found = _tone(spark, sf_dir)
    cases = _rows(spark, inline.SCORES).select((-F.col("msg_id")).cast("long").alias("msg_id"), "model", "ord", "label", "score")
    return reduce(DataFrame.unionByName, [tone.as_labels(found.select((F.col("doc_id") * 4 + n).alias("msg_id"), "score"), model, shares) for n, (model, shares) in enumerate(inline.SHARES.items())], cases)


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return read_messages(spark, f"{sf_dir}/conversations.parquet", next(stage for stage, r in ROLES.items() if r == role))


def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "user").select(
        "conv_id", "turn", F.length("text").cast("long").alias("n_chars"), detect.length_verdict(F.col("text"), 200).alias("at_200"), detect.length_verdict(F.col("text"), 1000).alias("at_1000"), detect.length_verdict(F.col("text"), 0).alias("at_0")
    )


def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(detect.addresses(F.col("text"))).cast("long").alias("n_addresses"), F.array_join(detect.addresses(F.col("text")), ",").alias("addresses"))


def email_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = T.allowed_addresses(F.lit("helpdesk@example.org"), T.parse_contacts(F.lit("a@b.org, +39050509111")))
    return _texts(spark, sf_dir).select("doc_id", detect.has_private_address(F.col("text"), allowed).alias("private"))


def injection_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rows(spark, inline.MESSAGES).select(F.col("msg_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    both = own.unionByName(_turns(spark, sf_dir, "user"))
    return both.withColumn("_f", T.fold_text("text")).withColumn("_p", F.col("_f.phrase")).select("conv_id", "turn", detect.injection_pattern(F.col("_p")).alias("pattern"))


def fiscal_code_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", detect.has_fiscal_code(F.col("text")).alias("has_code"))


def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", detect.has_iban(F.col("text")).alias("has_iban"))


def pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit("helpdesk@example.org"))
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(detect.personal_data_kinds(F.col("text"), allowed), "+").alias("kinds"))


def verdict_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.screen_input(_asked(spark, sf_dir), NO_PHONE)
    return out.select("conv_id", "turn", "verdict", "category", F.array_join("kinds", "+").alias("kinds"), "pattern", F.col("reply").isNotNull().alias("has_reply"))


def output_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, half of them with their text in the other field, and their sources."""
    own = _rows(spark, inline.MESSAGES).select(F.col("msg_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    answers = own.unionByName(_turns(spark, sf_dir, "assistant")).withColumn("content", F.col("text"))
    answers = answers.withColumns({"text": F.when(F.col("conv_id") % 2 == 1, F.col("text")), "why": F.concat(F.lit("source "), F.col("conv_id").cast("string"))})
    out = screen.replace_refused(screen.screen_output(answers, NO_PHONE))
    return out.select("conv_id", "turn", "verdict", "text", "content", "why")


def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = replace(NO_PHONE, max_message_chars=200)
    asked = screen.screen_input(_turns(spark, sf_dir, "user"), policy)
    said = screen.screen_output(_turns(spark, sf_dir, "assistant"), policy)
    documents = screen.screen_input(spread(_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text"), replace(policy, max_message_chars=5000))
    return screen.verdict_counts(asked.unionByName(said).unionByName(documents))


def offensive_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = taxonomy.label_map(spark)
    scores = _scores(spark, sf_dir).join(F.broadcast(labels.filter("guard = 'offensive'").select("model").distinct()), "model", "left_semi")
    return scoring.offensive_decision(scores, labels, scores.select("msg_id", "model"))


def injection_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = taxonomy.label_map(spark)
    scores = _scores(spark, sf_dir).join(F.broadcast(labels.filter("guard = 'injection'").select("model").distinct()), "model", "left_semi")
    return scoring.injection_decision(scores, labels)


def label_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that models declare in the cases, and those met in the scores of a fourth model's documents."""
    met = _scores(spark, sf_dir).filter(F.col("model") == inline.SEEN_MODEL).select(F.lit("offensive").alias("guard"), "model", F.col("ord").alias("idx"), "label").distinct()
    return scoring.label_reachability(_rows(spark, inline.DECLARED).unionByName(met), taxonomy.label_map(spark))


def blocking_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking classes of each model, and how many scored messages reach one of them with a score of at least 0.25."""
    labels = taxonomy.label_map(spark)
    hit = _scores(spark, sf_dir).filter("score >= 0.25").withColumnRenamed("label", "raw_label").join(F.broadcast(labels.filter("blocks").select("model", "raw_label")), ["model", "raw_label"])
    reached = hit.groupBy("model").agg(F.count_distinct("msg_id").alias("n_messages"))
    classes = labels.groupBy("guard", "model").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("blocks"), F.upper("semantic")))), ",").alias("blocking"), F.count("*").alias("n_labels"))
    return classes.join(reached, "model", "left").select("guard", "model", "blocking", "n_labels", F.coalesce("n_messages", F.lit(0).cast("long")).alias("n_messages"))


def summary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over the whole log, and within each source."""
    log = _log(spark, sf_dir)
    return events.changes(log).select(F.lit("all").alias("scope"), "seq", "summary").unionByName(events.changes(log, by=("source",)).select(F.lit("source").alias("scope"), "seq", "summary"))


def once_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.once_per_key(_log(spark, sf_dir), ("summary", "source")).select("seq", "summary", "source")


def rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rearmed(_log(spark, sf_dir)).select("seq", "reason")


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.turn_tokens(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), ("turn",), ("conv_id",))


def process_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of one counter over all turns, in the order of conversations."""
    return events.turn_tokens(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), ("conv_id", "turn"))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as error texts; every eleventh ends in a token, and some words are the exact token of their row."""
    errors = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 11 == 0, " hf_abcdEFGH0123").otherwise("")).alias("error"), F.when(F.col("doc_id") % 2 == 0, "the").otherwise("").alias("token"))
    cases = _rows(spark, inline.ERRORS).select((-F.col("id")).cast("long").alias("doc_id"), "error", "token")
    return errors.unionByName(cases).select("doc_id", F.md5(T.redact(F.col("error"), F.col("token"))).alias("error_md5"))


def access_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _table(spark, sf_dir, "documents").select("doc_id", F.lit("m/a").alias("model"), F.coalesce("text", F.lit("")).alias("error"))
    cases = _rows(spark, inline.ERRORS).select((-F.col("id")).cast("long").alias("doc_id"), "model", "error")
    return errors.unionByName(cases).select("doc_id", T.is_access_error(F.col("error")).alias("access"), (T.remediation(F.col("model"), F.col("error")) != "").alias("advised"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and devices as events name them, against the keys that are in use."""
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("m/"), "event_type").alias("model"), (F.col("user_id") % 3 - 1).cast("int").alias("device"))
    keyed = rows.withColumn("key", T.cache_key(F.col("model"), F.col("device")))
    parts = T.cache_key_parts(F.col("key"))
    stale = events.stale_keys(F.array(F.col("key"), F.lit("m/error")), F.array(F.lit("m/error"), F.lit("m/view")))
    return keyed.groupBy("key", parts["model"].alias("model"), parts["device"].alias("device"), F.array_join(stale, ",").alias("stale")).agg(F.count("*").alias("n"))


def contacts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as free-text lists of contacts."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")).unionByName(_rows(spark, inline.CONTACTS).select((-F.col("id")).cast("long").alias("doc_id"), "raw"))
    parsed = rows.withColumn("_e", T.parse_contacts(F.col("raw")))
    allowed = F.array_join(F.array_sort(T.allowed_addresses(F.lit("Help@Desk.org"), F.filter("_e", lambda x: F.length(x) < 80))), "|")
    return parsed.select("doc_id", F.size("_e").cast("long").alias("n"), F.md5(F.array_join("_e", "|")).alias("entries_md5"), allowed.alias("allowed"))


def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings as rows, one for each event, and which of their fields break a rule."""
    e = _table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    rows = e.select(
        "event_id", F.concat(kind, F.when(user % 2 == 0, F.lit("@host")).otherwise("@")).alias("help_desk_email"),
        F.concat((user * 100).cast("string"), F.when(kind == "error", F.lit(", a@b.it")).otherwise(F.lit("\n(0)5-55.55")), F.when(user % 5 == 0, F.lit(" ext")).otherwise("")).alias("public_service_contacts"),
        (F.floor("value") - 3).cast("long").alias("max_message_chars"), (F.col("value") / 16).alias("prompt_injection_classifier_threshold"), F.upper(F.substring(kind, 1, 2)).alias("input_phone_region"),
        F.when(user % 4 == 0, "cpu").when(user % 4 == 1, "1").otherwise(F.concat(F.lit("gpu"), (user % 4).cast("string"))).alias("classifier_device"),
        F.when(kind == "view", "  ").otherwise("text").alias("message_too_long"), F.when(user % 3 == 0, F.lit(taxonomy.models("offensive")[0])).when(user % 3 == 1, "other").alias("offensive_input_classifier_model"),
    )
    return bad_fields(rows).select("event_id", F.array_join("bad_fields", ",").alias("bad_fields"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the policies that were in force, and how many turns each held for."""
    starts = spark.createDataFrame(STARTS, "conv_id bigint, turn bigint, policy_id bigint")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    held = inforce.as_of(turns, starts, ("conv_id", "turn"), "policy_id").groupBy("policy_id").agg(F.count("*").alias("n_turns"))
    return events.coverage(policy_frame(spark, POLICIES)).join(held, "policy_id", "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0).cast("long")))


def policy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and cases screened by the settings that each of them read."""
    turns = _asked(spark, sf_dir).withColumn("conv_id", F.when(F.col("conv_id") < 0, F.col("conv_id") + 50).otherwise(F.col("conv_id")))
    starts = spark.createDataFrame(STARTS, "conv_id bigint, turn bigint, policy_id bigint")
    versions = inforce.load_versions(spark, VERSIONS)
    placed = turns.withColumn("place", F.md5("text"))
    out = inforce.screen_in_force(inforce.with_policy(placed, starts, versions, ("conv_id", "turn", "place")), regions=["FR", "IT"])
    return out.select("conv_id", "turn", F.col("policy.policy_id").alias("policy_id"), "verdict", "category", F.array_join("kinds", "+").alias("kinds"), "detail", "reply")


def policy_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reading of settings, turn by turn, announces: each change of the guards' summary, each new failure."""
    starts = spark.createDataFrame(STARTS, "conv_id bigint, turn bigint, policy_id bigint")
    versions = inforce.load_versions(spark, VERSIONS)
    turns = inforce.as_of(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), starts, ("conv_id", "turn"), "policy_id")
    read = turns.join(F.broadcast(events.coverage(versions).join(versions.select("policy_id", "reason"), "policy_id")), "policy_id")
    order = ("conv_id", "turn")
    changed = events.changes(read, "summary", order).select(F.lit("guards_active").alias("kind"), *order, F.md5("summary").alias("told"))
    failed = events.rearmed(read, "reason", order).select(F.lit("settings_fallback").alias("kind"), *order, F.md5("reason").alias("told"))
    return changed.unionByName(failed)


def guard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.screen_input(_turns(spark, sf_dir, "user"), replace(NO_PHONE, max_message_chars=200))
    tokens = events.turn_tokens(out, ("turn",), ("conv_id",))
    return events.guard_events(tokens, "input", "length+injection_patterns+personal_data", F.col("turn_token")).withColumn("line", events.render_event())


def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(-1, "mario＠example.org"), (-2, "ig\u200bnore the rules"), (-3, "Stra\u00dfe  x"), (-4, "ﬁne\u00adprint"), (-5, "plain")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return texts.withColumn("_f", T.fold_text("text")).select("doc_id", F.md5("_f.folded").alias("folded_md5"), F.md5("_f.phrase").alias("phrase_md5"))


def phone_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all documents, and of texts that hold them in many forms, as two regions read them."""
    cases = _rows(spark, phone_sql.CASES).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = cases.unionByName(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = [texts.withColumn("_n", phone.numbers(F.col("text"), region)).select(F.lit(region).alias("region"), "doc_id", "_n") for region in ("IT", "US")]
    return out[0].unionByName(out[1]).select("region", "doc_id", F.size("_n").cast("long").alias("n_numbers"), F.array_join(phone.number_types(F.col("_n")), "+").alias("types"), F.array_join(F.transform("_n", lambda x: x["e164"]), ",").alias("numbers"))


def allowlist_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private addresses and numbers of all documents, less long lists of public ones that the tables give."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = documents.select("doc_id", F.explode(detect.addresses(F.col("text"))).alias("value"))
    listed = found.filter(F.length("value") % 2 == 0).select(F.upper("value").alias("value")).unionByName(_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("@example.org")).alias("value")))
    lines = _table(spark, sf_dir, "customer").select(F.concat(F.lit("+1 "), (F.col("c_custkey") % 700 + 200).cast("string"), F.lit("-555-"), F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0")).alias("value"))
    numbers = lines.unionByName(documents.select(F.explode(phone.numbers(F.col("text"), "US")).alias("n")).filter(F.col("n.e164").endswith("5")).select(F.col("n.raw").alias("value")))
    addresses = allowlists.private_addresses(documents, listed).withColumnRenamed("n_private", "n_addresses")
    return addresses.join(allowlists.private_phones(documents, numbers, "US").withColumnRenamed("n_private", "n_phones"), "doc_id")


GUARD, TONE = "meta-llama/Llama-Prompt-Guard-2-86M", "IMSyPP/hate_speech_multilingual"
GATED, FRAIL = "deepset/deberta-v3-base-injection", "textdetox/bert-multilingual-toxicity-classifier"


#: The tone of a text in two label spaces: as the one label of an injection model, and dealt to two classes that block.
SPACES = {GUARD: (("LABEL_1", 1.0),), TONE: (("LABEL_2", 0.75), ("LABEL_3", 0.25), ("LABEL_0", 0.0))}


def _tone_models(spark: SparkSession, sf_dir: str) -> scoring.Loader:
    return tone.tone_loader(tone.tone_weights(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "labels")), SPACES)


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, the cases, and some in a toxic tone."""
    rude = _rows(spark, inline.RUDE).select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), "text")
    return _asked(spark, sf_dir).unionByName(rude)


def classifier_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tone model over all turns, and a model that cannot be loaded."""
    load = _tone_models(spark, sf_dir)
    meaning = {r[2]: r[3] for r in taxonomy.LABELS if r[1] == TONE}
    out = None
    for key in (TONE, GATED):
        scored = scoring.score_messages(_spoken(spark, sf_dir), key, load)
        decided = scored.withColumn("_d", scoring.decide_row(F.col("scores"), ["OFFENSIVE", "VIOLENT"], meaning, 0.60))
        rows = decided.select("conv_id", "turn", F.lit(key).alias("model"), "ran", "error_kind", (F.col("ran") & F.col("_d.triggered")).alias("triggered"))
        out = rows if out is None else out.unionByName(rows)
    return out


def classifier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All input verdicts, the classifiers' too, by tone; turns divisible by four were answered by another part, others got
    something from it that is no answer, or nothing."""
    replied = F.when(F.col("turn") % 4 == 0, F.create_map(F.lit("output"), F.lit("done"))).when(F.col("turn") % 4 == 1, F.create_map(F.lit("note"), F.lit("seen")))
    policy = replace(NO_PHONE, max_message_chars=200, detect_prompt_injection_classifier=True, detect_offensive_input_classifier=True)
    out = screen.screen_input(_spoken(spark, sf_dir), policy, load=_tone_models(spark, sf_dir), answered=screen.answered_elsewhere(replied, F.lit(True)))
    return out.select("conv_id", "turn", "verdict", "category", "detail", F.array_join("checks", "+").alias("checks"))


def _failing(key: str) -> Callable[[list[str]], list]:
    """Two models fail to load, the third on every text."""

    def frail(texts: list[str]) -> list:
        raise ValueError(f"cannot read {texts[0]}")

    if key in (GATED, TONE):
        raise RuntimeError("401 gated hf_abcdefgh12345678")
    return frail


def guard_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of warning and announcement, counted."""
    turns = _turns(spark, sf_dir, "user")
    failing = replace(NO_PHONE, max_message_chars=200, detect_prompt_injection_classifier=True, prompt_injection_classifier_model=GATED, detect_offensive_input_classifier=True, offensive_input_classifier_model=FRAIL)
    closed = replace(NO_PHONE, max_message_chars=200, detect_offensive_input_classifier=True)
    silent = replace(NO_PHONE, max_message_chars=200, message_too_long=" ")
    log = [("model_loading", "m/a", ""), ("model_load_failed", "m/a", "RuntimeError: 401 gated hf_abcdefgh99"), ("model_cache_hit", "m/b", ""), ("model_released", "m/b", "device=cpu")]
    labels = taxonomy.label_map(spark)
    parts = [
        events.classifier_warnings(screen.screen_input(turns, failing, load=_failing), failing),
        events.classifier_warnings(screen.screen_input(turns, closed, load=_failing), closed),
        events.missing_replies(screen.screen_input(turns, silent), "input"),
        events.active_guards(policy_frame(spark, POLICIES)),
        events.settings_fallbacks(_log(spark, sf_dir)),
        events.label_warnings(_rows(spark, inline.DECLARED), _rows(spark, inline.SCORES), labels),
        events.runtime_events(spark.createDataFrame(log, "kind string, model string, detail string")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "level", "stage", "verdict", "detail").agg(F.count("*").alias("n"))


def output_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.screen_output(_turns(spark, sf_dir, "assistant"), NO_PHONE)
    return events.guard_events(events.turn_tokens(out, ("turn",), ("conv_id",)), "output", turn=F.col("turn_token")).groupBy("kind", "category", "verdict", "detail", "checks").agg(F.count("*").alias("n"))


def stream_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream takes a single file only by one
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    screened = screen_stream(spark, f"{sf_dir}/conversations.parque[t]", "input", replace(NO_PHONE, max_message_chars=200)).select("conv_id", "turn", "verdict", "category")
    start_screening(screened, path, state).awaitTermination()
    return spark.read.schema("conv_id bigint, turn bigint, verdict string, category string").parquet(path)


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a stream: screened, and replaced where they hold personal data."""
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    screened = screen_stream(spark, f"{sf_dir}/conversations.parque[t]", "output", NO_PHONE).withColumn("content", F.col("text"))
    out = screen.replace_refused(screened).select("conv_id", "turn", "verdict", "verdict_stage", F.md5("content").alias("content_md5"))
    start_screening(out, path, state).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _told_in_order(rows: DataFrame, order: str, tell: Callable[[DataFrame], DataFrame], batches: int = 4) -> DataFrame:
    """What a stream tells of a table that arrives in micro-batches in the order of a column (whole numbers, nulls last).

    Each batch is written by all tasks, by a range that reaches the scan, and then the stream runs over it from its
    checkpoint, so that state goes on and a batch may have any number of files.
    """
    spark = rows.sparkSession
    path, out, state = (shared_folder(spark, name) for name in ("events", "stream", "state"))
    low, high = rows.agg(F.min(order), F.max(order)).first()
    place, told = F.col(order), None
    borders = [] if low is None else [low - -k * (high - low + 1) // batches for k in range(1, batches)]
    for k, (start, end) in enumerate(zip([None, *borders], [*borders, None], strict=True)):
        part = rows if start is None else rows.filter((place >= start) | place.isNull() if end is None else place >= start)
        (part if end is None else part.filter(place < end)).write.parquet(f"{path}/part={k}")
        told = tell(spark.readStream.schema(rows.schema).parquet(f"{path}/*"))
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


def stream_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: each source's last value, last failure and counter are kept between micro-batches. Times may
    stand in any order against ids: the watermark stays behind all of them, so that no row is late and no source expires."""
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("place"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"), F.when(F.col("event_type") == "error", F.concat(F.lit("error "), (F.col("user_id") % 3).cast("string"))).alias("reason"))
    span = rows.agg(F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).first()[0] or 0
    return _told_in_order(rows, "place", lambda stream: announced(stream, delay=f"{span + 3600} seconds"))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of errors per source over the events as a stream. A last row far ahead moves the watermark past them all."""
    rows = _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("source"), F.col("event_id").alias("place"), F.col("ts").cast("timestamp").alias("ts"))
    last = rows.agg(F.lit(-1).cast("long").alias("source"), (F.max("place") + 1).alias("place"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    bursts = _told_in_order(rows.unionByName(last), "place", lambda stream: refusal_bursts(stream, "2 hours", delay="1 day").select("source", "start", F.col("n_events")))
    return bursts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def refusals_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as refusals per hour, stage and verdict."""
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("input").alias("stage"), F.col("event_type").alias("verdict"))
    return refusal_windows(rows).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "stage", "verdict", "n_events")


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of a screened stream, written by batch, and the first batch played again."""
    out, state = shared_folder(spark, "log"), shared_folder(spark, "state")
    screened = screen_stream(spark, f"{sf_dir}/conversations.parque[t]", "input", replace(NO_PHONE, max_message_chars=200))
    for _ in range(2):  # without its checkpoint a stream starts over, as after a failure
        log_stream(events.guard_events(screened, "input"), out, state).trigger(availableNow=True).start().awaitTermination()
        state = shared_folder(spark, "state")
    rows = spark.read.parquet(out)
    return rows.groupBy("stage", "kind", "category", "verdict", "detail").agg(F.count("*").alias("n"))


def verdict_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by stage, category and verdict from stored tallies of two halves, the second counted twice, against the whole."""
    path = shared_folder(spark, "tallies")
    out = screen.screen_input(_turns(spark, sf_dir, "user"), replace(NO_PHONE, max_message_chars=200)).select("conv_id", "verdict_stage", "category", "verdict")
    for batch in (0, 1, 1):
        tallies.add_batch(out.filter(F.col("conv_id") % 2 == batch), path, batch)
    stored, whole = tallies.totals(spark.read.parquet(path)), tallies.totals(tallies.tally(out)).withColumnRenamed("n_conversations", "_whole").drop("n_messages")
    same = [stored[c].eqNullSafe(whole[c]) for c in tallies.CELL]
    return stored.join(F.broadcast(whole), reduce(lambda a, b: a & b, same)).select(*[stored[c] for c in tallies.CELL], "n_messages", (F.abs(F.col("n_conversations") - F.col("_whole")) <= 0.1 * F.col("_whole")).alias("agrees"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals by tone against the toxic label at several thresholds, each document scored by weights of the other folds."""
    return scoring.threshold_sweep(_tone(spark, sf_dir).select("score", F.col("toxic").alias("truth")), [0.25, 0.5, 0.6, 0.85])


def tone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of toxic tone and their weights, for each fold and all documents."""
    return tone.tone_weights(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        length_guard, email_kinds, email_allowlist, injection_pattern, fiscal_code_valid, iban_valid, pii_kinds, verdict_precedence, output_replace, taxonomy_counts,
        offensive_sum, injection_top, label_reachability, blocking_classes, summary_changes, once_per_key, rearm, turn_tokens, redact, access_marker, cache_keys,
        contacts_parse, policy_checks, coverage_summary, guard_log, unicode_fold, phone_kinds, classifier_fail_open, stream_screen, threshold_sweep,
        classifier_verdicts, guard_announcements, output_log, process_tokens, policy_in_force, policy_announcements, allowlist_tables, stream_announcements, stream_bursts,
        refusals_by_hour, stream_answers, stream_log, verdict_tallies, tone_words,
    )
}
