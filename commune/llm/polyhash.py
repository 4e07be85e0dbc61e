"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for a text's code points c, the modular prefix array
H[i] = sum(c[j] * B**j for j < i) mod p. The hash of any span follows from two entries, so spans
compare in constant time, longest common extensions need a binary search, and the hash of a
concatenation is put together without reading the texts again.

A fingerprint is the whole text's hash (two moduli, 62 bits) and a sketch: the ``SKETCH``
smallest distinct mixed hashes of all spans of ``SPAN`` code points (a shorter text is one
span). The likeness of two fingerprints is the bottom-k estimate of the Jaccard likeness of
their span sets; equal texts have equal fingerprints and likeness 1.

``fingerprint_edited`` compares each text with an edit of it that takes its end from the next
document. Ids are split into buckets at approximate quantiles, and every bucket also receives
the first row of the next one, so no sort or window spans the table.

Defined results: null and empty texts have length 0, an empty sketch, likeness 1 to each other
and 0 to others. The next row is that with the next (doc_id, text); after the last comes the
first. A row without an id has no place in that order and is its own next document. Repeated
rows stay. A single row is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commune.llm.common import table, text_or_empty

#: Moduli and bases of the two hashes.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
SPAN, SKETCH = 16, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of a base and of its inverse modulo p, extended by doubling."""

    def __init__(self, p: int, base: int):
        self.p, self.base, self.inverse = p, base, pow(base, -1, p)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            p = np.uint64(self.p)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, self.p)) % p])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, self.p)) % p])


_POWERS = tuple(_Powers(p, b) for p, b in zip(MODULI, BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of a text's code points, one per modulus."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix = []
        # A code point of 0 must count, too: "a" and "a\0" differ.
        c = points.astype(np.uint64) + np.uint64(1)
        for w in _POWERS:
            w.reach(self.n + 1)
            h = np.zeros(self.n + 1, np.uint64)
            # Terms are below 2**31, so the running sum fits 64 bits for up to 2**33 code points.
            np.cumsum(c * w.up[:self.n] % np.uint64(w.p), out=h[1:])
            self.prefix.append(h % np.uint64(w.p))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of code points i to j, the same wherever the span stands."""
        return tuple((int(h[j]) - int(h[i])) * int(w.down[i]) % w.p for h, w in zip(self.prefix, _POWERS))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common prefix of the suffixes at i and j."""
        most = min(self.n - i, other.n - j)
        return bisect_left(range(1, most + 1), True, key=lambda k: not self.equal(i, other, j, k))

    def spans(self, width: int) -> np.ndarray:
        """The first modulus' hashes of all spans of ``width`` code points (one span if shorter)."""
        h, w = self.prefix[0], _POWERS[0]
        p = np.uint64(w.p)
        if self.n <= width:
            return (h[-1:] + p) % p if self.n else h[:0]
        return (h[width:] + p - h[:-width]) % p * w.down[:self.n - width + 1] % p

    def joined(self, keep: int, other: PrefixHash, take: int) -> tuple[int, ...]:
        """The hash of the first ``keep`` code points followed by the first ``take`` of ``other``."""
        return tuple((int(h[keep]) + int(w.up[keep]) * int(g[take])) % w.p
                     for h, g, w in zip(self.prefix, other.prefix, _POWERS))


def sketch(spans: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` smallest distinct mixed span hashes."""
    mixed = (spans * _MIX) >> np.uint64(32)
    share = 4 * SKETCH
    while len(mixed) > share:
        low = np.unique(mixed[mixed < (share << 32) // len(mixed)])
        if len(low) >= SKETCH:
            return low[:SKETCH]
        share *= 8
    return np.unique(mixed)[:SKETCH]


def as_text(whole: tuple[int, ...], mixed: np.ndarray) -> str:
    return f"{whole[0]:08x}{whole[1]:08x}:" + mixed.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bottom-k estimate of the Jaccard likeness of the span sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    # A sketch below its size holds all spans; the union is known up to the smaller full sketch's end.
    union = np.union1d(a, b)[:SKETCH]
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.partition(":")[2]), ">u4").astype(np.uint64)


class _Doc:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.points = code_points(text)
        self.hash = PrefixHash(self.points)
        self.spans = self.hash.spans(SPAN)
        self.sketch = sketch(self.spans)

    def against(self, other: _Doc) -> tuple:
        """The result row of this document and the next one."""
        n = self.hash.n
        take = min(n // 4, other.hash.n)
        keep = n - n // 4
        whole = self.hash.joined(keep, other.hash, take)
        # Spans inside the kept part are known; the others lie in its end and the new tail.
        if keep >= SPAN:
            tail = np.concatenate([self.points[keep - SPAN + 1:keep], other.points[:take]])
            kept = self.spans[:keep - SPAN + 1] if n > SPAN else self.spans
            fresh = PrefixHash(tail).spans(SPAN) if len(tail) >= SPAN else self.spans[:0]
            mixed = sketch(np.concatenate([kept, fresh]))
        else:
            mixed = sketch(PrefixHash(np.concatenate([self.points[:keep], other.points[:take]])).spans(SPAN))
        edited = self.text[:keep] + other.text[:take]
        return (self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(self.hash.span(0, n), self.sketch), as_text(whole, mixed),
                likeness(self.sketch, mixed), likeness(self.sketch, other.sketch))


_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result rows of buckets that stand sorted one after the other, each closed by the next one's first row."""
    before, bucket = None, None
    for b in batches:
        out = []
        for at, doc_id, text, closing in zip(b["bucket"], b["doc_id"], b["text"], b["closing"]):
            doc = _Doc(None if pd.isna(doc_id) else int(doc_id), text)
            if at < 0:
                out.append(doc.against(doc))
                continue
            if before is not None and at == bucket:
                out.append(before.against(doc))
            before, bucket = None if closing else doc, at
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})


def fingerprint_edited(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per document: its and its edited text's fingerprints and their likenesses."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    steps = [k / buckets for k in range(1, buckets)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in steps]), 10 * buckets)).first()[0]
    cuts = sorted(set(cuts or []))
    if cuts:
        # Position among the sorted cuts, by a sorted-array search in one expression per row.
        bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        bucket = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    else:
        bucket = F.lit(0)
    placed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket))
    # The first row of each bucket closes the bucket before it: one row per bucket.
    least = {r.bucket: r.id for r in placed.where("bucket >= 0").groupBy("bucket")
             .agg(F.min("doc_id").alias("id")).collect()}
    order = sorted(least)
    closes = spark.createDataFrame([(least[b], order[k - 1]) for k, b in enumerate(order)],
                                   "doc_id bigint, closes int")
    closing = (docs.join(F.broadcast(closes), "doc_id").groupBy("doc_id", "closes").agg(F.min("text").alias("text"))
               .select("doc_id", "text", F.col("closes").alias("bucket"), F.lit(True).alias("closing")))
    rows = placed.withColumn("closing", F.lit(False)).unionByName(closing)
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("text"), F.lit(buckets))).otherwise(F.col("bucket"))
    return (rows.repartition(parts, spread).sortWithinPartitions("bucket", "closing", "doc_id", "text")
            .mapInPandas(_rows, _SCHEMA))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edited(table(spark, sf_dir, "documents"))
