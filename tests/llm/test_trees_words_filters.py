"""Chat formatting, spelling variants and the filter audit against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import audit, chat, spelling

SPACE = r"[\x20\x09-\x0D]+"


# --- reply trees


def plain_paths(nodes, keep):
    """{(tree, leaf): (root, rank, [(role, text)])} of the best branches of each root."""
    by = {}
    for tree, node, parent, role, text, score in sorted(nodes, key=lambda r: (str(r[2]), str(r[3]), str(r[4]))):
        by.setdefault((tree, node), (parent, role or "", text or "", score or 0.0))
    parent_of = {k: v[0] for k, v in by.items() if v[0] is not None and (k[0], v[0]) in by}
    asked = {(t, p) for (t, _), p in parent_of.items()}
    found = defaultdict(list)
    for tree, node in by:
        if (tree, node) in asked:
            continue
        path, seen, at = [], set(), (tree, node)
        while at not in seen:
            seen.add(at)
            path.append(at)
            if at not in parent_of:
                break
            at = (tree, parent_of[at])
        if path[-1] in parent_of:
            continue  # a circle
        score = sum(by[k][3] for k in path) / len(path)
        found[(tree, path[-1][1])].append((-score, node, [by[k][1:3] for k in reversed(path)]))
    out = {}
    for (tree, root), branches in found.items():
        for rank, (_, leaf, turns) in enumerate(sorted(branches, key=lambda b: (round(b[0], 9), b[1]))[:keep], 1):
            out[tree, leaf] = (root, rank, turns)
    return out


MARKS = ["", None, "\\", "\\b", "\\l<", "</turn>\n", "<turn user>\n", "\\### Assistant: </turn> ok", "\n\nx\n", "日本 é", "a" * 3000, "\\\\g>"]
TREE = "tree bigint, node bigint, parent bigint, role string, text string, score double, leaf string, up string, turn string"


def random_trees(seed):
    rng = random.Random(seed)
    rows = []
    for tree in range(6):
        size = rng.choice([1, 2, 7, 40])
        for n in range(size):
            parent = None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - 3), n) if rng.random() < 0.9 else 999
            rows.append((tree, n, parent, rng.choice(["user", "assistant", None, "x>y\\<"]), rng.choice(MARKS), rng.choice([None, 0.0, 1.0, 2.5, -1.0])))
    rows += [(50, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(130)]  # one long thread
    rows += [(60, 1, 2, "user", "a", 1.0), (60, 2, 3, "user", "b", 1.0), (60, 3, 1, "user", "c", 1.0), (60, 4, 3, "user", "below", 1.0), (60, 5, None, "user", "fine", 1.0)]
    return rows


@pytest.mark.parametrize("keep", [1, 3])
def test_reply_trees(spark, keep):
    rows = random_trees(keep)
    frame = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], TREE).repartition(3)
    got = chat.format_trees(frame, chat.Branches(keep)).select("tree", "root", "leaf", "rank", "n_turns", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("mask")).alias("trained"), "mask").collect()
    want = plain_paths(rows, keep)
    assert {(r.tree, r.leaf): (r.root, r["rank"], [tuple(t) for t in r.turns]) for r in got} == want
    for r in got:
        assert r.n_turns == len(r.turns)
        assert r.trained == [t.text for t in r.turns if t.role == "assistant"]
        assert r.formatted.count("</turn>") == len(r.turns)
        for m, text in zip(r["mask"], r.trained, strict=True):
            assert r.formatted[m.start : m.end].replace("\\l", "<").replace("\\b", "\\") == text


def test_reply_trees_without_ids(spark):
    rows = [(None, 1, None, "user", "a", 1.0), (None, 2, 1, "assistant", "b", 1.0), (7, None, None, "user", "lone", 0.0), (7, 1, None, "user", "x", 0.0), (7, 1, None, "user", "x", 0.0), (7, 1, None, "user", "a", 0.0)]
    got = chat.format_trees(spark.createDataFrame([(*r, "c", "c", "c") for r in rows], TREE)).select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert {(r.tree, r.leaf, tuple(t.text for t in r.t)) for r in got} == {(None, 2, ("a", "b")), (7, None, ("lone",)), (7, 1, ("a",))}
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def plain_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        lines = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        trained = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(lines), len(trained), sha(trained))
    return out


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(MARKS)) for c in range(12) for t in rng.sample(range(40), rng.randrange(1, 30))]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (99, None, "user", "late"), (99, 5, "assistant", "x"), (99, 5, "assistant", "x"), (99, 5, "assistant", "a"), (100, 3, "assistant", "y" * 200_000)]
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int, parent string, tree int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(frame).collect()}
    assert got == plain_digests(rows)
    assert chat.chat_digests(frame.limit(0)).count() == 0


def test_chat_plans_hold_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string").cache()
    turns.count()
    seen = []
    plain = chat.Scratch.keep
    try:
        chat.Scratch.keep = lambda self, df, name: (seen.append(df), plain(self, df, name))[1]
        seen.append(chat.chat_digests(turns))
    finally:
        chat.Scratch.keep = plain
    assert len(seen) > 3
    for frame in seen:
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().optimizedPlan().toString())


# --- spelling variants


def plain_words(rows, slip, least_length=7, least_count=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=10):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def grouped(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def variant_words(seed, size=400):
    rng = random.Random(seed)
    words = {}
    for _ in range(size // 8):
        base = "".join(rng.choice("abcdé÷") for _ in range(rng.choice([7, 8, 9, 12])))
        words[base] = rng.choice([2, 20, 400, 9000, 10**12])
        for _ in range(7):
            k = rng.randrange(len(base))
            v = rng.choice([base[:k] + base[k + 1 :], base[:k] + rng.choice("abcz") + base[k:], base[:k] + rng.choice("abcz") + base[k + 1 :]])
            words.setdefault(v, rng.choice([2, 3, 30, 900]))
    words |= {"a" * k: k for k in range(7, 30)} | {"abab" * 50: 5, "abab" * 50 + "a": 50, "b" + "abab" * 50: 700}
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    words = variant_words(seed)
    rows = [(w, n, "x", 1) for w, n in words.items()] + [(None, 9, "x", 1)]
    frame = spark.createDataFrame(rows, "word string, n bigint, key string, place int").repartition(3)
    assert grouped(spelling.variants(frame)) == plain_variants(words)


def test_variants_of_colliding_keys(spark):
    """With keys that nearly all collide, comparing strings still gives the right pairs."""
    words = variant_words(5, 160)
    keys = pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(range(len(words)), pa.int64())], names=["word", "id"])
    rows = [r for b in spelling._key_rows(iter([keys])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    listed = list(words.items())
    near = Counter()
    best = {}
    for group in range(3):
        members = [(place, listed[i][0], listed[i][1]) for key, place, i in rows if key % 3 == group]
        for word, k, other, n in spelling.near_of_group(members):
            near[word] += k
            best[word] = min(best.get(word, (1, "")), (-n, other))
    want = {w: [v for v in words if one_apart(w, v)] for w in words}
    # a pair of words whose two keys fell into one group is still counted once for each key
    assert {w: near[w] for w in words} == {w: len(v) for w, v in want.items()}
    assert {w: b[1] for w, b in best.items()} == {w: min(v, key=lambda x: (-words[x], x)) for w, v in want.items() if v}


def test_deletion_keys_match_plain_strings():
    words = ["abcabca", "a" * 9, "日本é", "x", "\U0001f600bb", "ab" * 40]
    keys, places, of = spelling.deletion_keys(words)
    strings = defaultdict(set)
    for key, place, k in zip(keys.tolist(), places.tolist(), of.tolist(), strict=True):
        w = words[k]
        strings[key].add(w if place == -1 else w[: -2 - place] + w[-1 - place :] if place < 0 else (place, w[:place] + w[place + 1 :]))
    assert all(len(s) == 1 for s in strings.values())
    assert len(strings) == len({s for v in strings.values() for s in v})
    assert Counter(of.tolist()) == {k: 1 + len(w) + len(re.findall(r"(.)\1*", w)) for k, w in enumerate(words)}


def test_key_groups_across_batches():
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 60, 300), np.full(200, 61), rng.integers(62, 70, 30)]))
    for size in (1, 7, 64, 600):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size])], names=["key"]) for a in range(0, len(keys), size)]
        out = [[t.column(0).to_pylist()[a:b] for a, b in zip(s.tolist(), [*s[1:].tolist(), t.num_rows], strict=True)] for t, s in spelling._groups(iter(batches))]
        groups = [g for part in out for g in part]
        assert [g[0] for g in groups] == sorted(set(keys.tolist())) and [len(g) for g in groups] == [n for _, n in sorted(Counter(keys.tolist()).items())]


def test_words_of_documents(spark):
    rng = random.Random(8)
    stems = ["Wonderful", "müßiggang", "ÉLÉGANTE", "x÷y×zabcd", "short", "z" * 40, "tolerance", "Tolerance"]
    rows = [(k, " ".join(rng.choice(stems) for _ in range(rng.randrange(60))) + rng.choice(["", "1", "-", "\n"]) + "endingword") for k in range(60)]
    rows += [(None, "wonderful endingword"), (61, None), (62, ""), (3, "wonderful " * 3000), (3, "wonderful " * 3000), (70, "q" * 20000), (71, "q" * 20000)]
    frame = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id bigint, text string, n int, word string").repartition(3)
    words = plain_words(rows, 31)
    assert {r.word: r.n for r in spelling.word_counts(frame, slip=31).collect()} == words
    assert grouped(spelling.variants(spelling.word_counts(frame, slip=31))) == plain_variants(words)
    assert spelling.variants(spelling.word_counts(frame.limit(0))).count() == 0


def test_roots_of_long_chains(spark):
    n = 12
    rows = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(n)] + [("x", "w05")]
    with spelling.Scratch(spark) as scratch:
        got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string"), scratch).collect()}
    assert got == {w: f"w{n:02d}" for w, _ in rows}


# --- filter audit


def plain_audit(docs, labels):
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc, text, part in docs:
        t = text or ""
        words = [w for w in re.split(SPACE, t) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and doc > first[t],
        }
        rows.append((part or "", {f for f, x in fails.items() if x}, doc in good, doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(kept), len(removed), sum(f in r[1] for r in own) - len(removed), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "Gamma", "DELTA", "a#b", "x|y", "plain", "text", "ÉCOLE", *[f"w{k}" for k in range(300)]]
    texts = [None, "", " \n ", *[" ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.choice([3, 199, 200, 201, 400]))) for _ in range(25)]]
    docs = [(k, rng.choice(texts), rng.choice(["s0", "s0", "s1", None, ""])) for k in range(120)]
    docs += [(3, docs[3][1], "s1"), (None, texts[5], "s0"), (None, texts[5], "s0"), (200, "only ÉÈ é", "alone"), (-5, texts[6], "s1"), (300, "one " * 60_000, "long")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(d, t, s, 1, "x", True) for d, t, s in docs], "doc_id bigint, text string, source string, n int, part string, A boolean").repartition(4)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in audit.audit_documents(frame, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.audit_documents(frame.limit(0), marks).count() == 0
    assert {r.good_lost for r in audit.audit_documents(frame, marks.limit(0)).collect()} == {0}


def test_audit_of_other_flags(spark):
    """Two flags: four rows a part."""
    rows = [("p", True, False, 1, 0), ("p", True, True, 0, 1), ("p", False, False, 1, 0), ("q", False, True, 0, 0)]
    frame = spark.createDataFrame(rows, "part string, x boolean, y boolean, good bigint, toxic bigint")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.interactions(frame, ("x", "y")).collect()}
    assert got["p", "xy", 1] == (1, 2, 0, 1, 3) and got["p", "xy", 2] == (1, 0, 1, 0, 1) and got["q", "yx", 1] == (0, 1, 0, 1, 2) and len(got) == 8
