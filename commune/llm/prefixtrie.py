"""Conversation prefix trie: member intervals by range minima over sorted common prefixes.

A conversation is its turns in order (null turn numbers first; equal ones by a digest of role and
text). Each distinct sequence of first turns is a node of the trie, the empty one its root. A node
knows its members, children, leaves and the tokens that a shared prefix cache saves in its subtree.

Method. Conversations are sorted by the digests of their turns, so a node's members are
neighbours. Tasks take ranges of that order, in blocks. In a block, a sparse table over the
lengths of common prefixes (LCP) of neighbouring rows answers any range minimum, and each prefix,
taken at the first row that shows it, binary-searches the left and right ends of its interval
independently of all others: the furthest rows up to which the minimum stays at its depth or more.
There is no stack. What a node counts is then a difference of running sums:

* members: the length of the interval; the smallest member: a second sparse table;
* leaves: rows whose next neighbour doesn't start with them;
* saved tokens: every node's words times its members, less every node's words once. The first is
  the sum of the member rows' words from the node's depth on, the second counts of each row only
  the turns beyond its common prefix with the row before.

All of these add up over blocks, so a node that spans blocks or tasks is put together by one
map-side combined aggregate, however hot it is: equal conversations are ordered by id and lie in as many
tasks as they fill. Only the seams between tasks need care: a task takes its first row for new
and its last for a leaf, and the first and last rows of neighbouring tasks (two per task) give
the rows that take back what was counted too much.

``ends_sha256`` reads a node's conversations in ascending order of their ids. They are neighbours
in the sort, so blocks write them as text of bounded length, and the texts of a node are hashed
one after the other.

Defined results: a null role or text is empty; rows without a conv_id are in no conversation; rows
that repeat a turn number follow each other; a conversation of any length is one row of digests.
An empty table gives no rows (no conversation, no root). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commune.llm.common import cut, give_back, table, text_or_empty
from commune.operators.skew import hot_threshold, lookup
from commune.session import shuffle_partitions

#: Characters of a turn's digest in a sort key.
DIGEST = 32
#: Rows and turns of a block.
BLOCK_ROWS, BLOCK_TURNS = 4096, 100_000
#: Children from which a node is a hot key of the join with its children; it changes no result.
HOT_FLOOR = 10_000
#: A rebuilt conversation starts with up to three turns of the first one of its twenty.
GROUP, HEADS = 20, 4
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_PARTIAL = ("kind int, h1 bigint, h2 bigint, p1 bigint, p2 bigint, depth bigint, conv bigint, members bigint, "
            "leaves bigint, words bigint, new_words bigint, ids string, pid int, first_key string, last_key string, "
            "last_words array<bigint>")
_NODE, _ENDS, _SEAM = 0, 1, 2


# --- sequences ------------------------------------------------------------------------------

def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation the array of struct(digest, words) of its turns in order."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "words"))).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"),
                                                                         t["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from the first conversation of its group."""
    host = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = seqs.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("host"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    rows = seqs.select("conv_id", "turns", host.alias("host"), h.alias("h")).join(heads, "host", "left")
    empty = F.slice("turns", 1, 0)
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")),
                                           F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


# --- a block of sorted rows -----------------------------------------------------------------

def common_turns(a: str, b: str) -> int:
    """Turns that two keys share from the start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:high * DIGEST] == b[:high * DIGEST]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * DIGEST:middle * DIGEST] == b[low * DIGEST:middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """table[k][i]: the minimum of values[i : i + 2**k]."""
    levels = [values]
    while 2 * (1 << (len(levels) - 1)) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:len(last) - half], last[half:]))
    return levels


def range_minimum(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of values[left .. right], both ends included."""
    out = np.empty(len(left), levels[0].dtype)
    size = np.floor(np.log2(right - left + 1)).astype(int)
    for k in np.unique(size):
        at = size == k
        out[at] = np.minimum(levels[k][left[at]], levels[k][right[at] - (1 << k) + 1])
    return out


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows [left, right] around ``row`` that share its first ``depth`` turns.

    lcp[i] is the LCP of rows i - 1 and i (lcp[0] isn't read). Each pair searches on its own.
    """
    left, right = row.copy(), row.copy()
    last = len(lcp) - 1
    if last < 1:
        return left, right
    levels = sparse_table(lcp)
    for k in range(len(levels) - 1, -1, -1):
        step, table_ = 1 << k, levels[k]
        ok = right + step <= last
        ok[ok] = table_[right[ok] + 1] >= depth[ok]
        right[ok] += step
        ok = left - step >= 0
        ok[ok] = table_[left[ok] - step + 1] >= depth[ok]
        left[ok] -= step
    return left, right


def _link(before: bytes, digest: str) -> bytes:
    return hashlib.blake2b(before + digest.encode(), digest_size=16).digest()


_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()


def _ids(chain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(chain), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Block:
    """Rows that follow each other in the sort: keys, words per turn, conversation ids."""

    def __init__(self, chain: list[bytes], before: str | None):
        self.keys: list[str] = []
        self.words: list[np.ndarray] = []
        self.ids: list[int] = []
        self.turns = 0
        #: Node ids along the path of the row before the block, and its key.
        self.chain, self.before = chain, before

    def add(self, key: str, words: np.ndarray, conv: int) -> None:
        self.keys.append(key)
        self.words.append(words)
        self.ids.append(conv)
        self.turns += len(words) + 1

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_ROWS or self.turns >= BLOCK_TURNS

    def close(self, following: str | None) -> pd.DataFrame:
        """Node and ends rows of the block, whose next row in the task has the key ``following``."""
        keys, m = self.keys, len(self.keys)
        sizes = np.array([len(k) // DIGEST for k in keys])
        lcp = np.array([-1 if self.before is None else common_turns(self.before, keys[0]),
                        *(common_turns(a, b) for a, b in zip(keys, keys[1:]))])
        after = np.append(lcp[1:], -1 if following is None else common_turns(keys[-1], following))
        # A prefix is taken at the first row of the block that shows it.
        shown = lcp.copy()
        shown[0] = -1
        row = np.repeat(np.arange(m), sizes - shown)
        start = np.repeat(np.cumsum(sizes - shown) - (sizes - shown), sizes - shown)
        depth = np.arange(len(row)) - start + shown[row] + 1
        node, parent = [], []
        chain = self.chain
        for i in range(m):
            del chain[max(int(lcp[i]), 0) + 1:]
            for d in range(len(chain), int(sizes[i]) + 1):
                chain.append(_link(chain[-1], keys[i][(d - 1) * DIGEST:d * DIGEST]))
            first = int(shown[i]) + 1
            node += chain[first:]
            parent += chain[first - 1:-1] if first else [_ROOT, *chain[:-1]]
        left, right = extents(lcp, row, depth)
        members = right - left + 1
        # Running sums: of all words by turn, of rows' words, of their new words, of leaves.
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        by_turn = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.words]))]).astype(np.int64)

        def from_depth(r: np.ndarray, d: np.ndarray) -> np.ndarray:
            """Words of row r's turns from depth d on (from the first, for the root)."""
            return by_turn[offsets[r + 1]] - by_turn[np.minimum(offsets[r] + np.maximum(d, 1) - 1, offsets[r + 1])]

        def running(values: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(values)])

        every = np.arange(m)
        totals, news = running(from_depth(every, np.ones(m, int))), running(from_depth(every, lcp + 1))
        leaves = running(after < sizes)
        before_depth = from_depth(left, np.ones(len(left), int)) - from_depth(left, depth)
        out = pd.DataFrame({
            "depth": depth, "conv": range_minimum(sparse_table(np.array(self.ids, np.int64)), left, right),
            "members": members, "leaves": leaves[right + 1] - leaves[left],
            "words": totals[right + 1] - totals[left] - members * before_depth,
            "new_words": news[right + 1] - news[left + 1] + from_depth(left, np.maximum(depth, lcp[left] + 1))})
        out["h1"], out["h2"] = _ids(node)
        out["p1"], out["p2"] = _ids(parent)
        out["kind"] = _NODE
        # Conversations that end at a node: the run of equal keys at the first of its rows.
        at = np.flatnonzero(depth == sizes[row])
        firsts = row[at]
        stops = np.append(firsts[1:], m)
        ends = out.iloc[at][["h1", "h2"]].copy()
        ends["kind"], ends["conv"] = _ENDS, [self.ids[i] for i in firsts]
        ends["ids"] = [",".join(map(str, self.ids[i:j])) for i, j in zip(firsts, stops)]
        # Shaped before they meet: a missing value would turn ids into floating point.
        return pd.concat([_shaped(out), _shaped(ends)], ignore_index=True)


def _shaped(rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in _PARTIAL.split(", ")]
    out = pd.DataFrame(index=rows.index)
    for c in names:
        if c in ("ids", "first_key", "last_key", "last_words"):
            out[c] = rows[c] if c in rows else None
        else:
            out[c] = rows[c].astype("Int64") if c in rows else pd.array([pd.NA] * len(rows), dtype="Int64")
    return out


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Node, ends and seam rows of a task's sorted rows."""
    block, pid, first, last = Block([_ROOT], None), None, None, None
    for b in batches:
        for key, words, conv, p in zip(b["key"], b["words"], b["conv_id"], b["pid"]):
            if block.full():
                yield block.close(key)
                block = Block(block.chain, block.keys[-1])
            block.add(key, np.asarray(words, np.int64), int(conv))
            if pid is None:
                pid, first = int(p), key
            last = (key, words)
    if pid is not None:
        yield block.close(None)
        yield _shaped(pd.DataFrame({"kind": [_SEAM], "pid": [pid], "first_key": [first], "last_key": [last[0]],
                                    "last_words": [np.asarray(last[1], np.int64)]}))
    give_back()


def _corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that take back what two tasks counted on either side of their seam."""
    for b in batches:
        for key, before, words in zip(b["first_key"], b["before_key"], b["before_words"]):
            shared, ended = common_turns(before, key), len(before) // DIGEST
            chain = [_ROOT]
            for d in range(1, shared + 1):
                chain.append(_link(chain[-1], key[(d - 1) * DIGEST:d * DIGEST]))
            w = np.asarray(words, np.int64)[:shared]
            again = np.concatenate([np.cumsum(w[::-1])[::-1], [0]])  # words of turns d .. shared, at d - 1
            depth = np.arange(shared + 1)
            rows = pd.DataFrame({"depth": depth, "members": 0, "words": 0, "kind": _NODE,
                                 "new_words": -again[np.maximum(depth - 1, 0)],
                                 "leaves": -1 if shared >= ended else 0})
            rows["h1"], rows["h2"] = _ids(chain)
            rows["p1"], rows["p2"] = _ids([_ROOT, *chain[:-1]])
            yield _shaped(rows)


# --- the trie ---------------------------------------------------------------------------------

def _ends_hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ids; a node's rows follow each other, and only the hash is held."""
    node, digest = None, None
    for b in batches:
        out = []
        for h1, h2, ids in zip(b["h1"], b["h2"], b["ids"]):
            if (h1, h2) == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (h1, h2), hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["h1", "h2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["h1", "h2", "ends_sha256"])


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of ``seqs(conv_id, turns)``: one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    partitions = shuffle_partitions(seqs.sparkSession)
    rows = seqs.select(F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"),
                       F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id")
    # Written, so that every reader sees the same ranges.
    ordered = cut(rows.repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id"))
    partial = cut(ordered.withColumn("pid", F.spark_partition_id()).mapInPandas(_partials, _PARTIAL))
    tasks = Window.orderBy("pid")  # one row per task
    seams = partial.where(F.col("kind") == _SEAM).select("pid", "first_key", "last_key", "last_words").select(
        "first_key", F.lag("last_key").over(tasks).alias("before_key"), F.lag("last_words").over(tasks).alias("before_words"))
    taken_back = seams.where("before_key is not null").mapInPandas(_corrections, _PARTIAL)
    counted = partial.where(F.col("kind") == _NODE).unionByName(taken_back)
    nodes = cut(counted.groupBy("h1", "h2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv").alias("conv_id"),
        F.sum("members").alias("n_convs"), F.sum("leaves").alias("n_leaves"),
        (F.sum("words") - F.sum("new_words")).alias("saved_tokens")))
    ends = (partial.where(F.col("kind") == _ENDS).select("h1", "h2", F.col("conv").alias("first"), "ids")
            .repartition(partitions, "h1", "h2").sortWithinPartitions("h1", "h2", "first")
            .mapInPandas(_ends_hash, "h1 bigint, h2 bigint, ends_sha256 string"))
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    full = (nodes.join(children.withColumnsRenamed({"p1": "h1", "p2": "h2"}), ["h1", "h2"], "left")
            .join(ends, ["h1", "h2"], "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))))
    full = cut(full)
    total = full.count()
    parents = full.where("n_children > 0").select(
        F.col("h1").alias("p1"), F.col("h2").alias("parent_h2"), F.col("conv_id").alias("parent_conv_id"),
        (F.col("n_children") > hot_threshold(total, partitions, HOT_FLOOR)).alias("hot"))
    below = lookup(full.where("depth > 0"), parents, "p1").where(F.col("p2") == F.col("parent_h2"))
    top = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return below.select(*_OUT).unionByName(top.select(*_OUT))


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, strlen(coalesce(role, '')) || ':' || strlen(coalesce(text, '')) || ':' || coalesce(role, '')
         || coalesce(text, '') AS enc,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'e': enc, 'w': words} ORDER BY turn NULLS FIRST, enc) AS s FROM turns GROUP BY conv_id),
checked AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           range(1, 1 + length(conv_id::VARCHAR)),
           lambda i: list_concat([ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT],
                            [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
           lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e)
                            ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(p.s, 1, c.h), []), list_slice(c.s, c.h + 1, len(c.s))) AS s
  FROM checked c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(s) AS size, d, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS words,
         sha256(array_to_string(list_transform(s[1:d], lambda x: x.e), '')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(s[1:d - 1], lambda x: x.e), '')) END AS parent
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, parent),
paths AS (
  SELECT DISTINCT a.d AS top_d, a.node AS top, b.d, b.node
  FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.d >= a.d),
below AS (
  SELECT p.top_d, p.top, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves,
         sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM paths p JOIN nodes n ON n.d = p.d AND n.node = p.node
  LEFT JOIN children c ON c.d = p.d AND c.node = p.node GROUP BY p.top_d, p.top)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
       b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.top_d = n.d AND b.top = n.node
LEFT JOIN children c ON c.d = n.d AND c.node = n.node
LEFT JOIN nodes q ON q.d = n.d - 1 AND q.node = n.parent
"""
