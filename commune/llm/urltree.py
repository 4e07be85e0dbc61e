"""URL filter: host and path rules, and a path-template tree per host for what no rule decides.

Rules. A rule fits its host and all subdomains if the path starts with the rule's path; of the
rules that fit, the longest (then the larger string) wins.

Tree. Per host, paths are split into segments. Level by level, over counts of (host, template
so far, segment) rather than rows:
* a segment that looks variable (it holds a digit) is generalised by its shape: runs of digits
  become ``#``;
* a segment that is rare among its siblings, under a parent with many different ones, becomes
  the wildcard ``*``;
* sibling branches with enough labelled rows are merged if they are statistically similar: the
  mostly bad ones, and the mostly good ones, into one branch each (``~bad``, ``~good``), as far
  as their share doesn't differ significantly from that of their side (two-sided z-test).
  A branch without labelled rows is never merged with a labelled one: no labels are no
  evidence of likeness.
A path ends in ``$``, so that a page and its descendants are different templates. The levels
follow the deepest path; nothing is cut.

Verdict. Labels are given per row (1 bad, 0 good, null none). A template is rejected if its
smoothed labelled purity (bad + prior * weight) / (labelled + weight) reaches ``reject``. In
the query, rows that a rule decides are the labelled ones.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule,
and is judged as host '' like any other. Repeated rows are judged alike, each of them. Hot
hosts and templates are counted by partial aggregation; the verdict table is broadcast if it is
counted to be small, and else joined on hashes that spread hot templates over ``SALTS`` parts.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import cut, table

#: (rule, verdict) of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Siblings above which rare segments are generalised, and the share that is rare.
MANY_SIBLINGS, RARE_SHARE = 20, 0.01
#: Labelled rows of a branch needed for merging; two-sided z value of a significant difference.
MIN_LABELLED, Z_DIFFERENT = 5, 2.58
#: Smoothing (rows of weight, share of bad ones) and the purity from which a template is rejected.
SMOOTH_ROWS, PRIOR, REJECT = 4.0, 0.25, 0.7
#: Templates up to which the verdict table is broadcast; parts of a hot template beyond it.
BROADCAST_ROWS, SALTS = 200_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_column(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that decides, or null: the longest one is asked first."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _share(bad: Column, labelled: Column) -> Column:
    return (bad + F.lit(PRIOR * SMOOTH_ROWS)) / (labelled + F.lit(SMOOTH_ROWS))


def _segments(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.concat(parts, F.array(F.lit("$")))


def build_tree(urls: DataFrame) -> DataFrame:
    """(host, path_key, template, purity, labelled, rejected) per distinct shaped path of ``urls``.

    ``urls`` has (host, path, label). ``path_key`` is the path with its digit runs generalised:
    rows that share it take the same way through the tree.
    """
    leaves = (urls.groupBy("host", path_key("path").alias("path_key"))
              .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("bad"),
                   F.count("label").alias("labelled")))
    nodes = cut(leaves.select("host", "path_key", F.lit("").alias("template"), _segments(F.col("path_key")).alias("segments"),
                              "n", "bad", "labelled"))
    depth = nodes.agg(F.max(F.size("segments"))).first()[0] or 0
    done = None
    for _ in range(depth):
        deeper = cut(_descend(nodes))
        ended = deeper.where(F.size("segments") == 0)
        done = ended if done is None else done.unionByName(ended)
        nodes = deeper.where(F.size("segments") > 0)
    if done is None:
        done = nodes
    purity = done.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("labelled").alias("tl"))
    purity = purity.select("host", "template", _share(F.col("tb"), F.col("tl")).alias("purity"),
                           F.col("tl").alias("labelled"))
    return (done.select("host", "path_key", "template").join(purity, ["host", "template"])
            .withColumn("rejected", F.col("purity") >= REJECT))


def _descend(nodes: DataFrame) -> DataFrame:
    head = F.element_at("segments", 1)
    open_ = nodes.withColumn("seg", head)
    branch = open_.groupBy("host", "template", "seg").agg(
        F.sum("n").alias("bn"), F.sum("bad").alias("bb"), F.sum("labelled").alias("bl"))
    known = F.col("bl") >= MIN_LABELLED
    # Siblings that are mostly bad and siblings that are mostly good are pooled apart.
    worse = F.col("bb") * 2 > F.col("bl")
    pooled = [x for side, of in (("1", known & worse), ("0", known & ~worse)) for x in (
        F.sum(F.when(of, F.col("bb")).otherwise(0)).alias("pb" + side),
        F.sum(F.when(of, F.col("bl")).otherwise(0)).alias("pl" + side), F.count_if(of).alias("known" + side))]
    parent = branch.groupBy("host", "template").agg(
        F.sum("bn").alias("pn"), F.count(F.lit(1)).alias("kinds"), *pooled)
    of_side = lambda c: F.when(worse, F.col(c + "1")).otherwise(F.col(c + "0"))
    p = of_side("pb") / F.greatest(of_side("pl"), F.lit(1))
    spread = F.sqrt(F.col("bl") * p * (1 - p))
    alike = known & (of_side("known") > 1) & (
        F.abs(F.col("bb") - F.col("bl") * p) <= F.lit(Z_DIFFERENT) * spread + F.lit(1e-9))
    merged = F.when(worse, "~bad").otherwise("~good")
    rare = (F.col("kinds") > MANY_SIBLINGS) & (F.col("bn") < F.lit(RARE_SHARE) * F.col("pn"))
    names = branch.join(parent, ["host", "template"]).select(
        "host", "template", "seg", F.when(F.col("seg") == "$", F.lit("$")).when(alike, merged)
        .when(rare, F.lit("*")).otherwise(F.col("seg")).alias("name"))
    return (open_.join(names, ["host", "template", "seg"])
            .select("host", "path_key", F.concat_ws("/", "template", "name").alias("template"),
                    F.slice("segments", 2, F.greatest(F.size("segments") - 1, F.lit(0))).alias("segments"),
                    "n", "bad", "labelled"))


def path_key(path: str) -> Column:
    """The path with runs of digits generalised."""
    return F.regexp_replace(path, r"\d+", "#")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of ``pages``."""
    rows = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict)
    tree = cut(build_tree(rows.select("host", "path", (F.col("by_rule") == "block").cast("int").alias("label"))))
    rows = rows.withColumn("path_key", path_key("path"))
    if tree.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(tree), ["host", "path_key"], "left")
    else:
        # Rows of a hot template go to SALTS parts, each of which meets its own copy of the row.
        salted = tree.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, ["host", "path_key", "salt"], "left")
    by_tree = F.when(F.col("rejected"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"),
                         "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
