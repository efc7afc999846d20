"""URL filters: longest-match rules, and a path-template tree for what no rule fits.

The tree is built per host from aggregated counts, level by level to the
deepest path, so a host that holds most of the pages costs no more than its
distinct paths. Segments that vary by form (numbers, dates, hexadecimal names)
become ``*`` at once; a node with more than ``FANOUT`` different children has
those with fewer than ``SUPPORT`` pages become ``*``. The rules' verdicts label
templates; a template is a head (its first segment) and a tail.

Branches (heads) of a host are merged if they are statistically alike: their
pages spread over tails as those of all the host's branches do (chi-square
within ``Z`` standard deviations of its mean), and the labelled rate of their
tail does not differ from that of all branches (|z| <= ``Z``; no labels do not
differ). A template is rejected if its smoothed purity, (blocked + 1) /
(labelled + 2), is ``PURITY`` or more, counted over

* its own labels, where its branch is unlike the others;
* the merged branches' labels of its tail, where it has labels itself or
  ``AGREE`` merged branches have (one alone tells nothing of its siblings);
* the merged branches' labels of all tails, where ``AGREE`` of them have any;
* nothing else: then it stays at 1/2 and is allowed.

Defined cases: a null URL or one without ``://`` has empty host and path, no
rule and is allowed; repeated rows each get the verdict and count each as a
label; an empty table gives an empty result; columns other than ``page_id`` and
``url`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import materialise, release

FANOUT, SUPPORT, Z, PURITY, AGREE = 20, 10, 1.96, 0.9, 2
#: Room for rounding in the chi-square test.
SLACK = 1e-6
VARIABLE = r"^([0-9]+([._-][0-9]+)*|[0-9a-f]{8,}|[0-9a-f-]{36})(\.[a-z0-9]{1,5})?$"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _matched(rules: list[Rule], host: Column, path: Column, value: int | None) -> Column:
    """Of the longest rule that fits: its verdict (``value`` 0) or its text."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])
        out = F.when(fits, F.lit(rule[0] if value == 0 else rule[1] + rule[2])).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict (and template, purity) of each row of ``pages``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("rule", _matched(rules, F.col("host"), F.col("path"), 1)).withColumn("_said", _matched(rules, F.col("host"), F.col("path"), 0))
    parts = F.transform(F.array_remove(F.split("path", "/"), ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    rows = rows.withColumn("_key", F.array_join(parts, "/"))

    block, labelled = F.sum((F.col("_said") == "block").cast("long")), F.count("_said")
    tree = templates(rows.groupBy("host", "_key").agg(F.coalesce(block, F.lit(0)).alias("_block"), labelled.alias("_labelled"), F.count(F.lit(1)).alias("_pages")))
    rows = rows.join(tree, ["host", "_key"], "left")
    other = F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_said", other).alias("verdict"), "template", "purity")


def templates(leaves: DataFrame) -> DataFrame:
    """host, _key, template and purity, from the counts (_block, _labelled, _pages) of each host's generalised paths."""
    tree = materialise(leaves.withColumn("template", F.lit("")), "paths")
    part = F.split("_key", "/")
    deepest = tree.agg(F.max(F.size(part))).first()[0] or 0
    for level in range(deepest):
        grown = tree.withColumn("_part", F.coalesce(F.get(part, F.lit(level)), F.lit("")))
        children = grown.where("_part <> ''").groupBy("host", "template", "_part").agg(F.sum("_pages").alias("_n"))
        wide = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_fan")).where(F.col("_fan") > FANOUT)
        rare = children.where(F.col("_n") < SUPPORT).join(wide, ["host", "template"]).select("host", "template", "_part", "_n")
        grown = grown.join(rare, ["host", "template", "_part"], "left")
        longer = F.concat("template", F.lit("/"), F.when(F.col("_n").isNotNull(), F.lit("*")).otherwise(F.col("_part")))
        grown = grown.withColumn("template", F.when(F.col("_part") != "", longer).otherwise(F.col("template"))).drop("_n", "_part")
        before, tree = tree, materialise(grown, "paths")  # each level reads the one before twice
        release(before)
    return tree.join(purities(tree), ["host", "template"]).select("host", "_key", "template", "purity")


def purities(tree: DataFrame) -> DataFrame:
    """host, template and purity of each template, from the counts of its paths."""
    nodes = tree.groupBy("host", "template").agg(F.sum("_block").alias("b"), F.sum("_labelled").alias("l"), F.sum("_pages").alias("n"))
    nodes = nodes.withColumn("head", F.regexp_extract("template", "^/([^/]*)", 1)).withColumn("tail", F.regexp_replace("template", "^/[^/]*", ""))
    nodes = materialise(nodes, "templates")
    tails = nodes.groupBy("host", "tail").agg(F.sum("n").alias("tn"), F.sum("b").alias("pb"), F.sum("l").alias("pl"))
    heads = nodes.groupBy("host", "head").agg(F.sum("n").alias("hn"))
    hosts = tails.groupBy("host").agg(F.sum("tn").alias("all"), F.count(F.lit(1)).alias("_tails"))
    both = nodes.join(tails, ["host", "tail"]).join(heads, ["host", "head"]).join(hosts, "host")
    # Chi-square of a branch's tails against the host's: sum of n^2 / (hn * tn / all), less hn; absent tails add nothing.
    spread = F.sum(F.col("n").cast("double") * F.col("n") * F.col("all") / (F.col("hn").cast("double") * F.col("tn"))) - F.first("hn")
    free = F.first("_tails") - 1
    like = both.groupBy("host", "head").agg((spread <= free + Z * F.sqrt(2.0 * free) + SLACK).alias("_like"))
    # |b/l - p| <= Z sqrt(p (1 - p) / l), squared and cleared of divisions, p = pb / pl
    gap = F.col("b") * F.col("pl") - F.col("pb") * F.col("l")
    same = gap.cast("double") * gap <= Z * Z * F.col("pb") * (F.col("pl") - F.col("pb")) * F.col("l")
    nodes = nodes.join(tails.drop("tn"), ["host", "tail"]).join(like, ["host", "head"]).withColumn("alike", F.col("_like") & same)
    nodes = materialise(nodes.select("host", "template", "head", "tail", "b", "l", "alike"), "alike")
    said = nodes.where("alike and l > 0")
    merged = said.groupBy("host", "tail").agg(F.sum("b").alias("mb"), F.sum("l").alias("ml"), F.count(F.lit(1)).alias("mk"))
    whole = said.groupBy("host").agg(F.sum("b").alias("wb"), F.sum("l").alias("wl"), F.count_distinct("head").alias("wk"))
    rate = lambda b, l: (F.col(b) + 1) / (F.col(l) + 2)  # noqa: E731, E741
    purity = F.when(~F.col("alike"), rate("b", "l")).when((F.col("l") > 0) | (F.col("mk") >= AGREE), rate("mb", "ml")).when(F.col("wk") >= AGREE, rate("wb", "wl")).otherwise(0.5)
    return nodes.join(merged, ["host", "tail"], "left").join(whole, "host", "left").select("host", "template", purity.alias("purity"))
