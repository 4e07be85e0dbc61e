"""Benchmark decontamination by a prefix-filtered set join on shingles of words.

Words are runs of ASCII letters, digits and any non-ASCII character after lower-casing A-Z. A
window is ``window`` consecutive words of a benchmark item; an item of fewer words (but not
none) is one window. A document word inside any occurrence of a window is hit.

Plan, all in DataFrame operators:
1. Items give shingles (``SHINGLE`` consecutive words, fewer in a shorter item). Their rarity
   is counted over all documents: words are exploded inside one generated stage, hashed with
   their successors and probed against the shingles of the items.
2. Containment must be whole, so the necessary prefix of a window is one shingle: the rarest.
   Windows that share their rarest shingle at one place of an item form one anchor.
3. A second pass joins document shingles with anchors. The place in the document and in the
   item fix where each window would start; starts before the document or ends beyond it fall
   away (positional and length bounds), and the rest is verified word by word.
4. Verified starts, per document: the union of the windows, the items, the verdict.

The anchors are broadcast after their size is counted (``BROADCAST_MB``); a larger benchmark
is joined by a shuffle on the shingle hash, where each probing row carries only the words
that its windows can cover. The results are the same. Nothing is capped.

Defined results: null and empty texts have no words: n_words 0, not contaminated; a null text
or item text hits nothing. Rows that repeat a doc_id are judged each on its own. Items without
an id hit words and aren't listed. Repeated items are listed once. No items, no hits; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import cut, table, text_or_empty

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Largest anchor table that is broadcast, by its counted size.
BROADCAST_MB = 64
#: A document is contaminated if at least this share of its words is hit.
MIN_SHARE = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    text = text_or_empty(text)
    # lower() works on bytes where all characters are ASCII; elsewhere only A-Z may change.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _hash_at(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + k) for k in range(size)])


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(uid, doc_id, words, n, pos, key): a row per document word and shingle size that fits.

    A document without words has one row with a null position.
    """
    rows = docs.select("uid", "doc_id", "words", F.size("words").alias("n"),
                       F.posexplode_outer("words").alias("pos", "word"))
    if len(sizes) == 1:
        return rows.withColumn("key", _hash_at("words", F.col("pos"), sizes[0]))
    return rows.select("uid", "doc_id", "words", "n", "pos", F.explode(F.array(
        *[_hash_at("words", F.col("pos"), s) for s in sizes])).alias("key"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words, size, start, length, at, key): a row per window and shingle place in it."""
    w = (items.where(F.size("words") > 0)
         .withColumn("length", F.least(F.lit(window), F.size("words")))
         .withColumn("size", F.least(F.lit(SHINGLE), F.col("length")))
         .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))))
         .withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - F.col("size")))))
    key = None
    for s in range(SHINGLE, 0, -1):
        h = _hash_at("words", F.col("at"), s)
        key = h if key is None else F.when(F.col("size") == s, h).otherwise(key)
    return w.withColumn("key", key)


def _anchors(shingles: DataFrame, rarity: DataFrame) -> DataFrame:
    """(item, words, length, at, key, starts): windows by their rarest shingle.

    Ties go to the smaller hash, then to the earlier place.
    """
    rarest = F.min(F.struct(F.coalesce(F.col("seen"), F.lit(0)).alias("seen"), "key", "at"))
    per_window = (shingles.join(rarity, "key", "left").groupBy("item", "words", "length", "start")
                  .agg(rarest.alias("r")))
    return per_window.groupBy("item", "words", "length", F.col("r.at").alias("at"), F.col("r.key").alias("key")).agg(
        F.sort_array(F.collect_set("start")).alias("starts"))


def _verified(words: Column, pos: Column, n: Column, shift: Column) -> Column:
    """Document starts of the anchor's windows that occur: bounds first, then the words."""
    where = F.filter(F.col("starts"), lambda s: (pos - F.col("at") + s >= 0)
                     & (pos - F.col("at") + s + F.col("length") <= n)
                     & (F.slice(words, shift - F.col("at") + s + 1, F.col("length"))
                        == F.slice(F.col("item_words"), s + 1, F.col("length"))))
    return F.transform(where, lambda s: pos - F.col("at") + s)


def _hits(docs: DataFrame, anchors: DataFrame, sizes: list[int], window: int, broadcast: bool) -> DataFrame:
    """(uid, doc_id, n, item, length, found): the first row of every document, and every verified anchor."""
    rows = _positions(docs, sizes)
    anchors = anchors.withColumnRenamed("words", "item_words")
    if broadcast:
        # Rows that meet no anchor end inside the generated stage: array functions with lambdas
        # run outside it and would copy the document's words for every row.
        j = rows.join(F.broadcast(anchors), "key", "left").where(
            F.col("at").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
        found = _verified(F.col("words"), F.col("pos"), F.col("n"), F.col("pos"))
        # No filter on ``found``: it would be merged with the one above and leave the stage, too.
        return j.select("uid", "doc_id", "n", "item", "length",
                        F.when(F.col("at").isNotNull(), found).alias("found"))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    near = rows.select("uid", "doc_id", "n", "pos", "key", (F.col("pos") - first).alias("shift"),
                       F.slice("words", first + 1, 2 * window - 1).alias("near")).where(F.col("pos").isNotNull())
    j = near.join(anchors, "key")
    found = _verified(F.col("near"), F.col("pos"), F.col("n"), F.col("shift"))
    out = j.select("uid", "doc_id", "n", "item", "length", found.alias("found")).where(F.size("found") > 0)
    null = F.lit(None)
    each = docs.select("uid", "doc_id", F.size("words").alias("n"), null.cast(anchors.schema["item"].dataType)
                       .alias("item"), null.cast("int").alias("length"), null.cast("array<int>").alias("found"))
    return each.unionByName(out)


def _covered(spans: Column) -> Column:
    """Words in the union of the spans (start, length), which are sorted by start."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("sum"),
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc["sum"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``documents``."""
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                            words_column(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").alias("item"), words_column(F.col("text")).alias("words")).distinct()
    shingles = cut(_windows(items, window))
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect()) or [SHINGLE]
    keys = shingles.select("key").distinct()
    size_of = shingles.agg(F.countDistinct("key")).first()[0]
    small = size_of * 64 <= broadcast_mb * 2 ** 20
    probe = F.broadcast(keys) if small else keys
    rarity = cut(_positions(docs, sizes).select("key").join(probe, "key").groupBy("key")
                 .agg(F.count(F.lit(1)).alias("seen")))
    anchors = cut(_anchors(shingles, rarity))
    mb = (anchors.agg(F.sum(64 + 24 * F.size("words") + F.aggregate(
        "words", F.lit(0), lambda a, x: a + F.octet_length(x)) + 8 * F.size("starts"))).first()[0] or 0) / 2 ** 20
    hits = _hits(docs, anchors, sizes, window, mb <= broadcast_mb)
    span = F.explode_outer("found")
    per_doc = (hits.select("uid", "doc_id", "n", "item", "length", span.alias("start"))
               .groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                   F.collect_set(F.when(F.col("start").isNotNull(),
                                                        F.struct("start", "length"))).alias("spans"),
                                   F.collect_set(F.when(F.col("start").isNotNull(), F.col("item"))).alias("items")))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = _covered(F.array_sort("spans")).cast("bigint")
    return per_doc.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(MIN_SHARE) * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, all their columns unchanged; rows without an id stay.

    Rows that repeat an id are one document, contaminated if any of them is.
    """
    judged = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = judged.where("contaminated").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
    FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iw),
dw AS (
  SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS win FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, s, dw.l AS l FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win),
nh AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM hit)) GROUP BY doc_id),
ni AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
