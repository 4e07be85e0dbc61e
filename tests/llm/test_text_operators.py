"""Brute-force and edge-case tests of the operators on texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from commune.llm import chat, decontaminate, licenses, pieces, polyhash, quality, simhash, toxicity
from commune.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string"


def docs_of(spark, texts, ids=None):
    """Documents with further columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 0, 0.5, "k") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " ", "\n", "x", "a b", "a b c", "A b\tC", "word " * 30_000, "y" * 100_000, "ÄÖ é 日本", "a b c", None]


# --- SimHash ---------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\v\f\r" else c
                                for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """doc_id -> smallest doc_id reachable over links of at most two bits."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query_equals_brute_force(spark):
    rows = simhash.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(fps)


@pytest.mark.parametrize("crowd", [0, 1, 2, 32])
def test_near_pairs_keep_all_links_whatever_is_crowded(spark, crowd):
    rnd = random.Random(crowd)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        for _ in range(40):
            f = b
            for _ in range(rnd.randint(0, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    table_ = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    from commune.llm.components import connected_components
    got = {r.node % 2 ** 64: r.root % 2 ** 64 for r in connected_components(simhash.near_pairs(table_, crowd)).collect()}
    want = brute_components({k: f for k, f in enumerate(fps)})
    by_got, by_want = {}, {}
    for k, f in enumerate(fps):
        by_got.setdefault(got.get(f, f), set()).add(f)
        by_want.setdefault(want[k], set()).add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_simhash_odd_rows(spark):
    ids = [5, 3, 9, 7, 1, 2, 4, 6, 8, 10, 11, 4, None]
    got = simhash.components(docs_of(spark, ODD, ids)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {3}
    assert simhash.components(docs_of(spark, [], [])).count() == 0
    docs = docs_of(spark, ODD, ids)
    kept = simhash.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        {r.component_id for r in got if r.component_id is not None})


# --- toxicity and quality --------------------------------------------------------------------

def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out six toxic rows only
    rows = toxicity.query(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, t in scored if t], [s for s, t in scored if not t]
    ranked = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert ranked > 0.9


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    words = "one two three four five six seven eight nine ten".split()
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(words + ["awful"] * (i % 2)) for _ in range(80)) for i in range(60)]
    model = toxicity.fit(docs_of(spark, texts), labels)
    got = toxicity.classify(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = docs_of(spark, [], [])
    assert toxicity.classify(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    none = toxicity.fit(docs_of(spark, texts), labels.where("toxic = 0"))
    assert {r.score for r in toxicity.classify(docs_of(spark, ["a"]), none).collect()} == {0.0}


def test_quality_learns_ordered_grades(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = [(r.keep, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([k for k, q in kept if q]) > 0.95
    assert np.mean([k for k, q in kept if not q]) < 0.5
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_acceptable <= 1 for r in rows)


def test_cumulative_link_orders_thresholds():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(900, 4)).astype(np.float32)
    y = np.digitize(x[:, 0] + 0.3 * rnd.normal(size=900), [-0.5, 0.5])
    m = quality.fit_cumulative(x, y, np.ones(900))
    assert m.thresholds[0] < m.thresholds[1] and m.weights[0] > max(map(abs, m.weights[1:]))


def test_quality_odd_rows(spark):
    labels = table(spark, SF, "labels")
    model = quality.fit(table(spark, SF, "documents"), labels)
    got = quality.classify(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    assert all(r.p_acceptable == 0 and not r.keep for r, t in zip(got, ODD) if not (t or "").strip())
    one = quality.fit(table(spark, SF, "documents"), labels.limit(0))
    assert [r.keep for r in quality.classify(docs_of(spark, ["a", ""]), one).collect()] == [True, False]


# --- SentencePiece ---------------------------------------------------------------------------

def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rnd = random.Random(3)
    parts = ["a", "b", " ", "  ", "the", "ing", "é", "\n", "日", "\t", "1", "!!", "&&&", "🎉", "▁", "ß", " the"]
    texts = [t or "" for t in ODD[:8]] + ["x" * 3000, "é" * 500] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    e = pieces.Encoder(pieces.load_vocabulary())
    got = [np.frombuffer(b, "<i4").tolist() for b in e.encode(texts)]
    assert got == [sp.encode(t) for t in texts]
    assert [pieces.decode(g, e.v) for g in got] == [t.replace("▁", " ") for t in texts]


def test_pieces_columns(spark):
    docs = docs_of(spark, ODD)
    ids = docs.select("doc_id", pieces.encode_column(F.col("text")).alias("ids"))
    back = ids.select(pieces.decode_column(F.col("ids")).alias("t")).collect()
    assert [r.t for r in back] == [t or "" for t in ODD]
    whole = pieces.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(whole) == len(texts) and all(r.round_trip for r in whole)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in whole)


# --- fingerprints ----------------------------------------------------------------------------

def test_prefix_hash_answers_spans():
    a, b = "the quick brown fox jumps", "see the quick brown dog"
    x, y = polyhash.PrefixHash(polyhash.code_points(a)), polyhash.PrefixHash(polyhash.code_points(b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common_extension(i, y, j) == n
            assert x.equal(i, y, j, n)
    assert x.joined(4, y, 7) == polyhash.PrefixHash(polyhash.code_points(a[:4] + b[:7])).span(0, 11)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_fingerprints_equal_brute_force(spark, buckets):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in polyhash.fingerprint_edited(docs, buckets).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        r, e = got[i], polyhash._Doc(0, edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.edited_fingerprint == polyhash.as_text(e.hash.span(0, e.hash.n), e.sketch)
        assert r.near_edited == polyhash.likeness(polyhash.sketch_of(r.fingerprint),
                                                  polyhash.sketch_of(r.edited_fingerprint))
        assert r.near_next == polyhash.likeness(polyhash.sketch_of(r.fingerprint),
                                                polyhash.sketch_of(got[rows[(k + 1) % len(rows)][0]].fingerprint))
    assert len(got) == len(rows)


def test_fingerprint_odd_rows(spark):
    ids = [5, 3, 9, 7, 1, 2, 4, 6, 8, 10, 11, 4, None]
    got = polyhash.fingerprint_edited(docs_of(spark, ODD, ids)).collect()
    assert len(got) == len(ODD)
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    single = polyhash.fingerprint_edited(docs_of(spark, ["abcdefgh"])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert polyhash.fingerprint_edited(docs_of(spark, [], [])).count() == 0


# --- licenses --------------------------------------------------------------------------------

def test_license_spans(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"]
    texts = [f"Ünï before. {gpl} after", f"x {gpl.replace('licensed', 'now licensed')} y", "no notice here",
             f"{gpl}\n{licenses.TEMPLATES['MIT']} {gpl}", gpl.upper(), None, ""]
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [list(r.licenses) for r in rows] == [["GPL-3.0"], ["GPL-3.0"], [], ["GPL-3.0", "MIT"], ["GPL-3.0"], [], []]
    m = rows[0].matches[0]
    assert texts[0][m.first_char:m.end_char] == gpl.rstrip(".") and m.coverage == 1.0
    assert rows[3].n_matches == 3


def brute_coverage(template, words):
    """Longest common subsequence of the template and any stretch of words near its size."""
    best = 0
    for i in range(len(words)):
        part = words[i:i + len(template) + 4]
        row = [0] * (len(part) + 1)
        for t in template:
            prev = 0
            for j, w in enumerate(part, 1):
                prev, row[j] = row[j], max(row[j], row[j - 1], prev + (t == w))
        best = max(best, row[-1])
    return best / max(len(template), 1)


def test_license_scan_finds_what_brute_force_finds(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(5)
    names = list(licenses.TEMPLATES)
    for _ in range(150):
        name = rnd.choice(names)
        words = licenses.TEMPLATES[name].split()
        if rnd.random() < 0.5 and len(words) > 12:
            words[rnd.randrange(len(words))] = "changed"
        text = " ".join(["filler"] * rnd.randint(0, 9) + words + ["filler"] * rnd.randint(0, 9))
        found = {m[0]: m[1] for m in scanner.scan(text)}
        tokens = licenses.normalized(text).split()
        want = brute_coverage(scanner.words[name], tokens)
        assert (want >= licenses.MIN_COVERAGE) == (name in found)
        if name in found:
            assert abs(found[name] - want) < 1e-9


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_scan_finds_changed_dropped_and_added_words(name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(name)
    template = list(scanner.words[name])
    spare = int(len(template) * (1 - licenses.MIN_COVERAGE))
    for _ in range(25):
        words = [[w] for w in template]
        for at in rnd.sample(range(len(words)), rnd.randint(0, min(spare + 1, len(words)))):
            words[at] = rnd.choice([[], [b"changed"]])
        for at in rnd.sample(range(len(words)), min(rnd.randint(0, 4), len(words))):
            words[at] = words[at] + [b"added"]
        filler = [b"filler"] * rnd.randint(0, 9)
        tokens = filler + [w for part in words for w in part] + filler
        want = brute_coverage(scanner.words[name], tokens)
        found = {m[1] for m in scanner.scan(b" ".join(tokens).decode()) if m[0] == name}
        assert found == ({want} if want >= licenses.MIN_COVERAGE else set())


@pytest.mark.parametrize("text, name, coverage", [
    ("Distributed under the MIT License", "MIT", 4 / 5),
    ("Licensed under Apache License, Version 2.0", "Apache-2.0", 7 / 8),
    ("Licensed under the Apache Software License, Version 2.0", "Apache-2.0", 1.0)])
def test_license_scan_finds_broken_short_notices(text, name, coverage):
    assert [(m[0], m[1]) for m in licenses.Scanner(licenses.TEMPLATES).scan(text)] == [(name, coverage)]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("times", [2, 3])
def test_license_scan_finds_each_repeat(name, times):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    size = len(scanner.words[name])
    found = [m[1:4] for m in scanner.scan(" ".join([licenses.TEMPLATES[name]] * times)) if m[0] == name]
    assert found == [(1.0, k * size, (k + 1) * size) for k in range(times)]


@pytest.mark.parametrize("text, spans", [
    ("Released under the License. Under the MIT License.", [(0.8, 0, 4), (0.8, 4, 8)]),
    ("Released under the MIT License under the MIT License", [(1.0, 0, 5), (0.8, 5, 9)]),
    ("Released under MIT License, released under the License, released the MIT License",
     [(0.8, 0, 4), (0.8, 4, 8), (0.8, 8, 12)]),
    ("Released a b c under the MIT License", [(1.0, 0, 8)])])
def test_license_scan_tells_broken_repeats_apart(text, spans):
    assert [m[1:4] for m in licenses.Scanner(licenses.TEMPLATES).scan(text)] == spans


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_variants_are_told_apart(name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = f"filler {licenses.TEMPLATES[name]} filler"
    assert [m[:2] for m in licenses.best_matches(scanner, text)] == [(name, 1.0)]


def test_license_scan_knows_near_variants_and_keeps_neighbours(spark):
    texts = ["Licensed under CC BY-NC-SA 4.0", licenses.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
             "Licensed under the Apache License, Version 2.0 or under the MIT License"]
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [list(r.licenses) for r in rows] == [["CC-BY-NC-SA-4.0"], ["GPL-2.0-header"], ["Apache-2.0", "MIT"]]


def test_winnowing_guarantee():
    rnd = random.Random(2)
    words = [str(rnd.randrange(50)).encode() for _ in range(200)]
    places = {p for _, p in licenses.winnow(words)}
    span = licenses.SHINGLE + licenses.WINDOW - 1
    for i in range(len(words) - span + 1):
        assert any(i <= p <= i + span - licenses.SHINGLE for p in places)


# --- chat ------------------------------------------------------------------------------------

def test_chat_round_trip_of_hostile_texts(spark):
    rnd = random.Random(4)
    parts = ["\\", "###", "</turn>", "\n", "e", "t", "h", "c", ": ", "#", "<", " ", "日", "\\e", "\\t", "User"]
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 5)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
            role = rnd.choice(["user", "assistant", "system", "tool: x", None, "", "=", "User"])
            rows.append((c, t, role, text, "extra", True))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, valid boolean")
    made = chat.format_chats(turns)
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("t"),
                                             chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in range(60):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(x.role, x.text) for x in got[c].t] == mine
        assert got[c].loss == "".join(t for role, t in mine if role == "assistant")


def test_chat_order_of_roles(spark):
    orders = [("system", "user", "assistant"), ("user",), ("assistant", "user"), ("user", "user"), ("system",),
              ("user", "assistant", "system")]
    turns = spark.createDataFrame([(c, t, r, "x") for c, o in enumerate(orders) for t, r in enumerate(o)],
                                  "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.valid for r in chat.format_chats(turns).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
    assert chat.format_chats(turns.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------------

def test_decontamination_edges_and_both_joins(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, "solo"), (3, "two words"), (4, None), (5, "..."),
                                   (6, " ".join(words[:20])), (None, "nameless item here")],
                                  "item_id bigint, text string")
    texts = [" ".join(["x"] * 30 + words[:13] + ["y"] * 30), " ".join(words[:12]), "a solo b", "Two, WORDS!", None, "",
             "nameless item here", " ".join(words[:20]) + " " + " ".join(words[5:20]), "Solo " * 50, "two words"]
    docs = docs_of(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 3])
    key = lambda rows: sorted(map(tuple, rows))
    small = key(decontaminate.decontaminate(docs, items).collect())
    large = key(decontaminate.decontaminate(docs, items, broadcast_mb=0).collect())
    assert small == large and len(small) == len(texts)
    got = {(r[0], r[1]): r for r in small}
    ids = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0, 73][2:] == (13, 2, ids("1,6"), True)
    assert got[1, 12][2:] == (0, 0, ids(""), False)
    assert got[2, 3][2:] == (1, 1, ids("2"), True)
    assert got[4, 0][2:] == (0, 0, ids(""), False)
    assert got[6, 3][2:] == (3, 0, ids(""), True)
    assert got[7, 35][2:] == (35, 2, ids("1,6"), True)
    assert got[8, 50][2:] == (50, 1, ids("2"), True)
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
