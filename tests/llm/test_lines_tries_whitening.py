"""Line dedup, the conversation trie and whitening against brute force, and their defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from commune.llm import linededup, prefixtrie, whitening
from tests.conftest import SF001, SF01

DOCS = "doc_id BIGINT, text STRING"
TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def run_sql(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    return sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in res.fetchall())


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- line dedup ---------------------------------------------------------------------------

def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_dedup(rows, min_chars=40, min_docs=5):
    lines = [(k, i, (text or "").split("\n")) for k, (i, text) in enumerate(rows)]
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for _, i, ls in lines:
        for x in ls:
            if i is not None and len(key(x)) >= min_chars:
                docs[key(x)].add(i)
    last = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for _, i, ls in lines:
        kept = [x for x in ls if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def line_cases():
    shared = ["This Line is shared by MANY documents of the table, all over",
              "\t another common line with odd spaces \x0b and É Umlaute ÄÖÜ inside it \r", "x" * 39, "y" * 40,
              "中文" * 20, " " + "z" * 45 + " "]
    rng = random.Random(3)
    rows = []
    for i in range(40):
        mine = [f"unique line of document number {i} that nobody else has at all"] + rng.sample(shared, 3)
        mine += [shared[0].upper()] * (i % 3) + [""] * (i % 2)
        rng.shuffle(mine)
        rows.append((i, "\n".join(mine)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (None, None), (7, shared[0] + "\nagain"),
             (103, "\n".join([shared[0]] * 3 + ["q" * 100_000])), (5, rows[5][1]), (-4, shared[3])]
    return rows


@pytest.mark.parametrize("floor", [1, 10_000])
def test_line_dedup_is_brute_force(spark, floor, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_FLOOR", floor)
    rows = line_cases()
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, out), key=key) == sorted(plain_dedup(rows), key=key)


def test_line_dedup_small_threshold_and_columns(spark):
    rows = [(1, "aa\nbb", 9, "l"), (2, "bb \nCC", 8, None), (3, None, None, "l")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, row_id INT, `key` STRING")
    out = linededup.dedup_lines(df, min_chars=1, min_docs=2)
    assert out.columns == ["doc_id", "text", "row_id", "key", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "aa", 9, "l", 2, 1), (2, "bb \nCC", 8, None, 2, 0),
                                                 (3, "", None, "l", 1, 0)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_matches_sql(spark):
    assert spark_rows(linededup.query(spark, SF01)) == run_sql(linededup.ORACLE_SQL, SF01, "documents")


# --- conversation trie ----------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(seqs.items()):
        h = zlib.crc32(str(c).encode()) % 4
        full = seqs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + s[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += value
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                  for p, m in members.items())


def by_key(rows):
    return sorted(tuple(r) for r in rows)


def conversation_cases(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        texts = ["hello there"] if kind < .4 else []
        texts += [rng.choice(["yes", "no way", "tell me  more\n now", "", " "]) for _ in range(rng.randrange(6))]
        for k, t in enumerate(texts or ["only"]):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", t))
    rows += [(-7, None, None, None), (-7, 3, "user", None), (-20, 0, "user", "hello there"), (10 ** 15, 0, None, "x y"),
             (None, 1, "user", "lost"), (41, 0, "user", "extra of an old turn number"), (20_000, 5, "tool", "w " * 5000)]
    rows += [(30_000, k, "user", f"turn {k % 50}") for k in range(700)]
    rng.shuffle(rows)
    return rows


def ordered_ties(rows):
    """Rows whose turn numbers don't repeat, so that the order of ties doesn't matter."""
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("block,floor", [(4096, 10_000), (3, 1)])
def test_trie_is_brute_force(spark, block, floor, monkeypatch):
    rows = ordered_ties(conversation_cases(90, block))
    partial = prefixtrie._partials

    def small_blocks(batches):
        prefixtrie.BLOCK_ROWS = block
        return partial(batches)

    monkeypatch.setattr(prefixtrie, "_partials", small_blocks)
    monkeypatch.setattr(prefixtrie, "HOT_FLOOR", floor)
    df = spark.createDataFrame(rows, TURNS)
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(df))).collect()
    assert by_key(got) == by_key(plain_trie(rows))


def test_trie_edges(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(df))).count() == 0
    # Repeated turn numbers follow each other in an order of their own; nothing is lost.
    rows = [(21, 1, "user", "a b"), (21, 1, "user", "a b"), (21, 1, "assistant", "c"), (21, None, None, None)]
    out = prefixtrie.trie(prefixtrie.sequences(spark.createDataFrame(rows, TURNS))).collect()
    assert max(r.depth for r in out) == 4 and {r.n_convs for r in out} == {1}
    extra = spark.createDataFrame([(1, 0, "user", "x", 5)], TURNS + ", words INT")
    assert prefixtrie.trie(prefixtrie.sequences(extra)).count() == 2


def test_trie_matches_sql(spark):
    assert [str(r) for r in spark_rows_with_nulls(prefixtrie.query(spark, SF01))] == [
        str(r) for r in run_sql_with_nulls(prefixtrie.ORACLE_SQL, SF01, "conversations")]


def spark_rows_with_nulls(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def run_sql_with_nulls(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in res.fetchall()), key=str)


def test_extents_by_range_minima():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 17, 64):
        lcp = rng.integers(0, 4, m)
        row, depth = np.repeat(np.arange(m), 5), np.tile(np.arange(5), m)
        left, right = prefixtrie.extents(lcp, row, depth)
        for r, d, a, b in zip(row, depth, left, right):
            x = r
            while x > 0 and lcp[x] >= d:
                x -= 1
            y = r
            while y + 1 < m and lcp[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)


# --- whitening ------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["random", "multiple", "clustered", "rank", "indefinite"])
def test_spectrum_slicing_equals_dense_eigenvalues(kind):
    rng = np.random.default_rng(7)
    n = 40
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    e = {"random": rng.gamma(1, 5, n), "multiple": np.repeat([9.0, 4.0, 1.0, 0.5], 10),
         "clustered": 5 + 1e-7 * np.arange(n), "rank": np.r_[3.0, 2.0, 1.0, np.zeros(n - 3)],
         "indefinite": rng.standard_normal(n)}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    dense = np.sort(np.linalg.eigvalsh(v))[::-1]
    pairs = whitening.leading_pairs(v, 32)
    wanted = dense[:32][dense[:32] > whitening.ZERO * dense[0] * 10]
    assert len(pairs) == len(wanted)
    assert np.allclose([p.value for p in pairs], wanted, rtol=1e-10, atol=1e-12)
    x = np.stack([p.vector for p in pairs], axis=1)
    assert np.abs(x.T @ x - np.eye(len(pairs))).max() < 1e-9
    assert np.abs(v @ x - x * [p.value for p in pairs]).max() < 1e-9 * dense[0]


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            a = rng.integers(-2, 3, (n, n)).astype(float)
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.inertia(a) == (e > 0).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


def plain_whitening(vectors, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = ((n * x - s) / n).astype(float)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return n, deviation, centred @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_is_brute_force(spark):
    import pyarrow.parquet as pq
    rows = pq.read_table(f"{SF001}/embeddings.parquet").to_pylist()
    n, deviation, white, explained = plain_whitening([r["embedding"] for r in rows])
    got = whitening.query(spark, SF001).collect()
    assert len(got) == n * white.shape[1] and {r.n for r in got} == {n}
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    w = np.zeros_like(white)
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        w[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((w * white).sum(0))
    assert np.abs(w * sign - white).max() < 1e-6
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, n INT"
    big = 2 ** 60 + 1
    rows = [(big, [1.0, 2.0, 0.5], 1), (None, [0.5, 1.0, 0.25], 1), (3, [2.0, -1.0, 0.0], None), (3, [2.0, -1.0, 0.0], None),
            (4, None, 1), (5, [1.0, None, 2.0], 1), (6, [float("nan")] * 3, 1), (7, [float("inf"), 0.0, 0.0], 1),
            (8, [1.0], 1), (9, [], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in got) == {big: 2, None: 2, 3: 4}
    assert {r.n for r in got} == {4} and max(r.component for r in got) == 2
    same = [(k, [1.0, 2.0], 0) for k in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0)], schema)).count() == 0


def test_lines_are_cut_and_hashed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    line = "a line that stands in all of the documents of this table"
    docs = spark.createDataFrame([(k, f"{line}\nown {k}") for k in range(8)], "doc_id BIGINT, text STRING")
    lost = linededup.dropped_lines(docs.mapInPandas(counted, docs.schema)).collect()
    assert sorted((r.doc_id, r.drop) for r in lost) == [(k, [0]) for k in range(7)]
    assert read.value == 8
