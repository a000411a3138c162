"""Phone numbers against their plans, ordered scans and stream state against plain loops, policies in force, tables of
public contacts, tone, tallies, and the event log of a batch that is played again."""

import json
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import fold, fold_text, phrase
from millrace.operators import allowlists, events, inforce, phone, scans, screen, tallies, tone
from millrace.plans import phone_sql
from millrace.sources.messages import log_stream, spread, write_events
from millrace.sources.numbering import codes_pattern, plan_of_region, plans
from millrace.sources.policy import Policy, policy_errors, regions
from millrace.sources.policy_rows import bad_fields
from millrace.streaming.announcements import announced, token_of


# --- phone numbers


def found(spark, texts, region):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", phone.numbers(F.col("text"), region).alias("n"))
    return [[(x.e164, x.kind) for x in r.n] for r in sorted(frame.collect(), key=lambda r: r.id)]


def test_every_region_has_one_plan():
    assert set(plan_of_region()) == set(regions())
    listed = [r for p in plans().values() for r in p.regions]
    assert len(listed) == len(set(listed))
    for code in plans():
        assert not any(other != code and other.startswith(code) for other in plans())


def test_country_codes_are_told_apart(spark):
    import re

    codes = re.compile(f"^{codes_pattern()}")
    for code in plans():
        assert codes.match(code + "123456").group() == code
    assert codes.match("210123") is None and codes.match("9991") is None


def test_grouping(spark):
    no = ["01.02.03.04", "06.123.456", "on 01.02.2026", "01-02-2026", "2026-11-27 10:20", "10.0.0.255", "0 6 1234567", "+3 90 6123 4567", "06-12-34567", "x061234567", "061234567x", "+33 123 45 67 89", ""]
    yes = ["06 1234567", "06 123 4567", "061234567", "(06) 1234567", "+39 06 1234567", "0039-06-1234567", "39 06 1234567"]
    several = ["06 1234567 and 347 1234567", "050509111/061234567", "+39 050 509111. 06 1234567"]
    rome, pisa, mobile = ("+39061234567", "fixed_line"), ("+39050509111", "fixed_line"), ("+393471234567", "mobile")
    assert found(spark, [*no, *yes, *several], "IT") == [*([] for _ in no), *([rome] for _ in yes), [rome, mobile], [pisa, rome], [pisa, rome]]
    french = ["01 23 45 67 89", "01.23.45.67.89", "0123456789", "+33 (0)1 23 45 67 89", "+33 1 23 45 67 89"]
    # without its trunk prefix, or with the first group run into the next while others stand apart
    odd = ["1 23 45 67 89", "0123 45 67 89"]
    assert found(spark, [*french, *odd], "FR") == [*([("+33123456789", "fixed_line")] for _ in french), [], []]
    assert found(spark, ["06 1234567", "+39 06 1234567"], "no such region") == [[], [rome]]


def sample_numbers(rng):
    """Numbers made from every plan's rows, grouped as the plan says, run together, or split elsewhere."""
    out = []
    for plan in plans().values():
        for row in plan.rows:
            digits = "".join(str(rng.randrange(10)) for _ in range(14))
            head = next((h for h in (f"{n:03d}" for n in rng.sample(range(1000), 1000)) if __import__("re").match(f"(?:{row.lead})", h + digits)), None)
            if head is None:
                continue
            sizes = [rng.randint(a, b) for a, b in row.sizes]
            number = (head + digits)[: sum(sizes)]
            cut = sorted(rng.sample(range(1, len(number)), min(2, len(number) - 1)))
            borders = [sum(sizes[: k + 1]) for k in range(len(sizes) - 1)]
            join = lambda at, sep, n=number: sep.join(n[a:b] for a, b in zip([0, *at], [*at, len(n)], strict=True))
            abroad = "+" + plan.code + rng.choice([" ", "-", ""])
            out += [abroad + join(borders, " "), abroad + number, abroad + join(cut, "."), plan.trunk + rng.choice(["", " "]) + join(borders, "-"), "00" + plan.code + " " + join(borders, " ")]
    return out


@pytest.mark.parametrize("region", ["IT", "RU"])
def test_plans_against_sql(spark, region):
    texts = [f"call {n}, please" for n in sample_numbers(random.Random(region))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n, r.t, r.e) for r in frame.select("doc_id", phone.numbers(F.col("text"), region).alias("x")).select("doc_id", F.size("x").alias("n"), F.array_join(phone.number_types(F.col("x")), "+").alias("t"), F.array_join(F.transform("x", lambda v: v["e164"]), ",").alias("e")).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE texts (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: tuple(r[1:]) for r in duck.execute(phone_sql.found_numbers("texts", region)).fetchall()}
    assert got == want
    assert sum(n > 0 for n, _, _ in got.values()) > len(texts) / 4


def test_allowed_numbers_in_any_grouping(spark):
    contacts = F.array(*[F.lit(x) for x in ("050-50.9111", "+39 06 1234567", "a@b.org", "12")])
    assert spark.range(1).select(phone.allowed_numbers(contacts, "IT").alias("x")).first().x == ["+39050509111", "+39061234567"]


# --- ordered scans


def plain_scan(rows):
    """rows (key, order, value) → {order: (n, before, last known)}."""
    state, out = {}, {}
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        n, before, known = state.get(key, (0, None, None))
        known = value if value is not None else known
        out[order] = (n + 1, before, known)
        state[key] = (n + 1, value, known)
    return out


@pytest.mark.parametrize("tasks", [1, 16])
def test_scan(spark, tasks):
    rng = random.Random(tasks)
    rows = [(rng.choice([None, "hot", "hot", "hot", "hot", *"abcdef"]), k, rng.choice([None, None, "x", "y"])) for k in range(700)]
    frame = spark.createDataFrame(rows, "source string, seq bigint, v string").repartition(5)
    for by, plain in (((), [(0, *r[1:]) for r in rows]), (("source",), rows)):
        scan = scans.scanned(frame, ("seq",), by, value="v", known="v", tasks=tasks)
        assert {r.seq: (r.n, r.before, r.last_known) for r in scan.collect()} == plain_scan(plain)
        assert "SinglePartition" not in scan._jdf.queryExecution().executedPlan().toString()
    assert scans.scanned(frame.limit(0), ("seq",), value="v").count() == 0


def test_as_of(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(1000), k) for k in range(300)]
    versions = [(rng.choice("ab"), rng.randrange(1000), f"v{k}") for k in range(20)]
    versions = list({(k, t): v for k, t, v in versions}.items())
    versions = [(*k, v) for k, v in versions]
    left, right = spark.createDataFrame(rows, "k string, t bigint, id bigint"), spark.createDataFrame(versions, "k string, t bigint, version string")
    got = {r.id: r.version for r in scans.as_of(left, right, ("t", "id"), "version", ("k",)).collect()}
    assert got == {i: max(((t2, v) for k2, t2, v in versions if k2 == k and t2 <= t), default=(0, None))[1] for k, t, i in rows}


def test_changes_tokens_and_rearming(spark):
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", None), (4, "a", "x"), (5, "a", "y"), (6, "a", "y")], "seq bigint, summary string, reason string")
    assert [r.seq for r in events.changes(log).orderBy("seq").collect()] == [1, 3, 4]
    assert [r.seq for r in events.rearmed(log).orderBy("seq").collect()] == [1, 4, 5]
    tokens = events.turn_tokens(log, ("seq",)).orderBy("seq").collect()
    assert [r.turn_token for r in tokens] == ["0001", "0002", "0003", "0004", "0005", "0006"]


def test_failures_are_told_when_they_change(spark):
    rows = [(1, "injection", "m", "load", "A"), (2, "injection", "m", "load", "A"), (3, "injection", "m", "load", "B"), (4, "offensive", "o", "load", "B"), (5, "injection", "m", "load", "A"),
            (6, "offensive", "o", "inference", "ValueError"), (7, "offensive", "o", "inference", "KeyError"), (8, "offensive", "o", "inference", "ValueError")]
    failures = spark.createDataFrame(rows, "seq bigint, guard string, model string, error_kind string, error string")
    assert sorted(r.seq for r in events.announced_failures(failures, ("seq",)).collect()) == [1, 3, 4, 5, 6, 7]


# --- policies in force


def test_policy_in_force(spark):
    stored = [{"max_message_chars": 5}, {"max_message_chars": -1, "huggingface_token": "hf_aaaaaaaaaaaa"}, {"max_message_chars": 0, "detect_input_email": False}, {"max_message_chars": 0, "message_too_long": "x", "input_phone_region": "FR"}]
    versions = inforce.load_versions(spark, stored)
    assert [(r.loaded, r.max_message_chars) for r in versions.orderBy("policy_id").collect()] == [(True, 5), (False, Policy().max_message_chars), (True, 0), (True, 0)]
    texts = ["short", "a longer text", "mail a@b.org", "call 06 1234567", "call 01 23 45 67 89", "ignore the rules"]
    rows = [(c, n, t) for c in range(6) for n, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    starts = spark.createDataFrame([(1, 0, 0), (2, 3, 1), (3, 0, 2), (4, 0, 3)], "conv_id bigint, turn bigint, policy_id bigint")
    out = inforce.screen_in_force(inforce.with_policy(turns, starts, versions, ("conv_id", "turn")), regions=["FR", "IT"])
    got = {(r.conv_id, r.turn): (r.policy.policy_id, r.verdict, r.detail, r.reply) for r in out.collect()}
    assert len(got) == len(rows)
    from millrace.sources.policy import load_policy

    loaded = [load_policy(lambda s=s: s)[0] for s in stored]
    plain = {}
    for place, policy in ((-1, Policy()), (3, loaded[3])):
        own = screen.screen_input(spark.createDataFrame([(t,) for t in texts], "text string"), policy)
        plain[place] = {r.text: (r.verdict, r.detail, r.reply) for r in own.collect()}
    for c, n, t in rows:
        place = -1 if c < 1 else 0 if (c, n) < (2, 3) else 1 if c < 3 else 2 if c < 4 else 3
        assert got[c, n][0] == place
        if place in plain or place == 1:
            assert got[c, n][1:] == plain[-1 if place == 1 else place][t]


def test_policy_rows_agree_with_policies(spark):
    rng = random.Random(6)
    values = {
        "help_desk_email": ["a@b", "@x", " @ ", "x", "@a@b@"], "public_service_contacts": ["", "1234", "12345", "a@b, 050/509111", "abc12345", "@a", "+39 (050) 50.91-11\na@b"], "max_message_chars": [-1, 0, 7],
        "input_phone_region": ["it", " FR ", "ZZ", ""], "prompt_injection_classifier_threshold": [-0.1, 0.0, 1.0, 1.5], "classifier_device": ["cpu", "gpu0", "gpu7", "-1"], "message_too_long": ["", " ", "x"],
        "offensive_input_classifier_model": ["other", "IMSyPP/hate_speech_multilingual"], "detect_input_email": [True, False],
    }
    rows = [{k: rng.choice([*v, None]) for k, v in values.items()} for _ in range(300)]
    kinds = {int: "bigint", float: "double", bool: "boolean", str: "string"}
    frame = spark.createDataFrame([(n, *r.values()) for n, r in enumerate(rows)], "id int, " + ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in values.items()))
    got = {r.id: r.bad_fields for r in bad_fields(frame).collect()}
    for n, r in enumerate(rows):
        plain = {k: (int(v) if k == "classifier_device" and v.lstrip("-").isdigit() else v) for k, v in r.items() if v is not None}
        assert got[n] == sorted(policy_errors(plain)), r


# --- streams


def test_stream_state(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abbbb"), k, rng.choice([None, "x", "y"])) for k in range(200)]
    frame = spark.createDataFrame(rows, "source string, place bigint, value string").withColumns({"reason": F.when(F.col("value") == "x", F.lit("x")), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("place") * 60)})
    want, last = {}, {}
    for s, k, v in rows:
        n, value, reason = last.get(s, (0, None, None))
        r = "x" if v == "x" else None
        want[k] = (token_of(n + 1), n == 0 or v != value, r is not None and r != reason)
        last[s] = (n + 1, v, r)
    for k in range(3):  # a query each: state comes back from the checkpoint
        frame.filter(f"place div 70 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = announced(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.place: (r.token, r.value_announced, r.reason_announced) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_announcements_of_a_table_whose_times_start_over(spark, tmp_path):
    """Copies of the events by shifted keys under the same times: no row of the later ones is late."""
    import duckdb

    from millrace.plans.oracle import ORACLE_SQL
    from millrace.plans.queries import stream_announcements

    c = duckdb.connect()
    c.execute(f"COPY (SELECT event_id + 1000 * k AS event_id, ts, user_id + 7 * (k % 2) AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet' AS e, range(5) AS r(k)) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    told = stream_announcements(spark, f"file://{tmp_path}")
    want = c.execute(f"SELECT source, place, token, value_announced, reason_announced FROM ({ORACLE_SQL['stream_announcements']}) AS q ORDER BY place").fetchall()
    assert [tuple(r) for r in told.orderBy("place").select("source", "place", "token", "value_announced", "reason_announced").collect()] == want


def test_one_source_of_a_bucket_expires(spark, tmp_path):
    at = lambda hour: f"2026-01-01 {hour:02d}:00:00"
    batches = [[("a", 1, at(0), "x", None), ("b", 2, at(0), "y", "r"), (None, 3, at(0), None, None)], [("b", 4, at(3), "y", "r"), (None, 5, at(3), None, "q")], [("a", 6, at(4), "x", None), ("b", 7, at(4), "y", None), (None, 8, at(4), "z", "q")]]
    frame, calls = "source string, place bigint, ts string, value string, reason string", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, frame).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = announced(spark.readStream.schema(frame.replace("ts string", "ts timestamp")).parquet(f"{tmp_path}/in/*"), 3_600_000, "0 seconds", buckets=1)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        calls += [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) for x in query.recentProgress) if p["numInputRows"]]
    got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").orderBy("place").collect()]
    assert got == [("a", 1, "0001", True, False), ("b", 2, "0001", True, True), (None, 3, "0001", True, False), ("b", 4, "0002", False, False), (None, 5, "0002", False, True), ("a", 6, "0001", True, False), ("b", 7, "0003", False, False), (None, 8, "0003", True, False)]
    assert calls == [1, 1, 1]  # one call of Python for all sources of a bucket


def test_a_batch_played_again_is_not_doubled(spark, tmp_path):
    rows = spark.createDataFrame([("input", "a", 1), ("output", "b", 2), ("input", "c", 3)], "stage string, kind string, n int")
    for batch in (0, 1, 1, 0):
        write_events(rows, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    rows.write.parquet(str(tmp_path / "in"))
    for state in ("s1", "s2"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        log_stream(stream, str(tmp_path / "again"), str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "again")).count() == 3


# --- texts, contacts, tone, tallies


def test_folding_of_all_signs(spark):
    signs = [chr(c) for c in (*range(0x0, 0x3100), *range(0xA000, 0xA800), *range(0xF900, 0x10000), *range(0x1F600, 0x1F650))]
    texts = [*signs, *[f"a{s}b \x85 {s}́" for s in signs[0x80:0x2100]], "Straße  ÉÀ\tx", "ŒUVRE ß ẞ", "Σας ΣΑΣ", "x y", "日本 ＡＢ", "", " a  b "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", fold_text("text").alias("f"))
    got = {r.id: (r.f.folded, r.f.phrase) for r in frame.collect()}
    assert [t for n, t in enumerate(texts) if got[n] != (fold(t), phrase(fold(t)))] == []
    assert unicodedata.unidata_version


def test_allow_lists_of_any_length(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(k, " / ".join(rng.choice(["a@b.org", "C@D.org", f"u{k}@x.it", "none", "+39 06 1234567", "06 1234567", "050 509111"]) for _ in range(rng.randrange(6)))) for k in range(80)] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    listed = spark.createDataFrame([("A@B.org ",), ("u3@x.it",), (None,), ("u3@x.it",)], "value string")
    numbers = spark.createDataFrame([("0612-34567",), ("junk",), (None,)], "value string")
    for limit in (allowlists.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(allowlists, "BROADCAST_ENTRIES", limit)
        got = {r.doc_id: r.n_private for r in allowlists.private_addresses(frame, listed).collect()}
        assert got == {k: len({w.lower() for w in (t or "").split() if "@" in w} - {"a@b.org", "u3@x.it"}) for k, t in docs}
        phones = {r.doc_id: r.n_private for r in allowlists.private_phones(frame, numbers, "IT").collect()}
        assert phones == {k: int("050 509111" in (t or "")) for k, t in docs}


def test_tone_is_held_out(spark):
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = [rng.choice(plain) for _ in range(40)] + ([rng.choice(["idiot", "scum", "moron"])] if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs += [(1000, None), (1001, "scum scum"), (None, "idiot")]
    frame, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    weights = tone.tone_weights(frame, marks).cache()
    assert {r.word for r in weights.collect()} == {"idiot", "scum", "moron"} and weights.count() > 12
    got = {r.doc_id: (r.toxic, r.score) for r in tone.tone_scores(frame, marks, weights).collect()}
    assert sum((s >= 0.4) == (t == 1) for t, s in got.values() if t is not None) > 390
    assert got[1000] == (None, 0.0) and got[1001][1] > 0.4 and len(got) == 403
    assert "Python" not in tone.tone_scores(frame, marks, weights)._jdf.queryExecution().optimizedPlan().toString()
    assert tone.tone_weights(frame.limit(0), marks).count() == 0


def test_a_model_without_labels_is_an_error(spark):
    from millrace.operators import scoring
    from millrace.plans import taxonomy

    labels = taxonomy.label_map(spark)
    rows = [(1, "meta-llama/Llama-Prompt-Guard-2-86M", 0, " label_1 ", 0.9), (2, "meta-llama/Llama-Prompt-Guard-2-86M", 0, "odd", 0.9)]
    schema = "msg_id bigint, model string, ord int, label string, score double"
    got = {r.msg_id: (r.triggered, r.label) for r in scoring.injection_decision(spark.createDataFrame(rows, schema), labels).collect()}
    assert got == {1: (True, "MALICIOUS"), 2: (False, "ODD")}
    with pytest.raises(Exception, match="no label table for other"):
        scoring.injection_decision(spark.createDataFrame([(1, "other", 0, "LABEL_1", 0.9)], schema), labels).collect()


def test_texts_are_cut_to_what_a_model_reads():
    from millrace.operators import scoring

    class Model:
        window = 3

        def __call__(self, texts):
            seen.append(list(texts))
            return [{"label": "x", "score": 1.0} for _ in texts]

    seen = []
    texts = [" a b  c d", "a b", "é", *["one two three four"] * 200]
    rows = scoring._run_texts(texts, "t/window", lambda key: Model())
    assert [len(c) for c in seen] == [64, 64, 64, 11] and seen[0][:4] == [" a b  c", "a b", "é", "one two three"]
    assert all(r[0] and r[4] >= 0 for r in rows)
    assert [scoring.token_bound(type("M", (), {"window": w})()) for w in (None, 0, 511, 512, 4096, "7")] == [512, 512, 511, 512, 512, 512]
    scoring.release_models(set())


def test_model_events_and_latency_come_back(spark):
    policy = Policy(detect_offensive_input_classifier=True, detect_input_phone=False, detect_output_phone=False, offensive_input_classifier_model="textdetox/bert-multilingual-toxicity-classifier")
    turns = spark.createDataFrame([(1, "fine words"), (2, "scum"), (3, "mail a@b.org")], "msg_id bigint, text string").coalesce(1)

    def load(key):
        return lambda texts: [[{"label": "LABEL_1", "score": 0.9 if "scum" in t else 0.1}] for t in texts]

    out = screen.screen_input(turns, policy, load=load).cache()
    assert {r.msg_id: r.verdict for r in out.collect()} == {1: None, 2: "offensive_input", 3: "personal_data"}
    kinds = {r.kind for r in events.model_events(out).collect()}
    assert kinds & {"model_loaded", "model_cache_hit"} and "model_load_failed" not in kinds
    told = {r.kind + (r.checks or ""): r.latency_ms for r in events.guard_events(out, "input", latency=F.col("inference_ms")).collect()}
    assert told["input_allowedlength+injection_patterns+personal_data+offensive_input"] is not None
    assert out.filter("msg_id = 3").first().inference_ms is None


def test_tallies_add_up(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(500), *rng.choice([("input", "limits", "message_length"), ("input", "privacy", "personal_data"), (None, None, None)])) for _ in range(3000)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, verdict_stage string, category string, verdict string")
    cell = lambda r: (r.stage, r.category, r.verdict, r.n_messages, r.n_conversations)
    whole = sorted(map(cell, tallies.totals(tallies.tally(frame)).collect()), key=str)
    parts = [tallies.tally(frame.filter(f"coalesce(conv_id, 0) % 3 = {k}")) for k in range(3)]
    assert sorted(map(cell, tallies.totals(tallies.merged(*parts)).collect()), key=str) == whole
    for batch in (0, 1, 2, 1):
        tallies.add_batch(frame.filter(f"coalesce(conv_id, 0) % 3 = {batch}"), str(tmp_path / "t"), batch)
    assert sorted(map(cell, tallies.totals(spark.read.parquet(str(tmp_path / "t"))).collect()), key=str) == whole
    total = next(r for r in whole if r[0] is None)
    assert total[3] == 3001 and abs(total[4] - len({r[0] for r in rows} - {None})) < 25


def test_spread_leaves_wide_tables_alone(spark):
    assert spread(spark.range(100).repartition(1)).rdd.getNumPartitions() > 1
    assert spread(spark.range(100).repartition(9)).rdd.getNumPartitions() == 9
