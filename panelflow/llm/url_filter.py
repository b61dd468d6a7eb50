"""URL filters: host rules, then a path-template tree.

Rules decide first: a rule ``host/path`` fits its host and all subdomains
if the url's path starts with the rule's path, and the longest rule wins.
Every other url is judged by the template tree of its host:

1. *Generalise*: digit runs, long hex strings and UUIDs of a path segment
   become ``*``.  A node of the tree is a prefix of the generalised segments,
   of any length, with the labelled and the blocked urls below it.
2. *Merge*: a node's children are sorted by their blocked share; each joins
   the group before it unless a two-sample test on its own counts and those
   of the group's member with the most labels finds a difference.  Children
   that cannot be told apart, such as titles with a label or two each, end up
   in one group: a wildcard that the labels support.  Children without
   labels are in no group.
3. *Reject*: the blocked share of a node's group, smoothed towards the share
   of its parent's group, and so on up to the host and all hosts, is its
   purity; a template is blocked where it exceeds one half.

Labels are the verdicts of the rules on the urls they fit (or any 0/1
column of the caller).  Urls are parsed once, into narrow rows in the shared
folder.  Everything after that runs on one row per host and template or
node, made with map-side partial sums; of a node's children, those with
equal counts are one entry, so a node with very many children is a short
list.  The verdicts are joined back to the urls by template, a join that
Spark can split where a template holds a third of all urls.

Defined results: a null url or one without ``://`` has empty host and
path, fits no rule and is judged by the template of the empty host; every
input row gives one output row (repeated rows and null ids included);
extra columns (``html``) are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))

VARIABLE = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}|[0-9]+"
CHI2 = 3.84             # squared normal quantile of the merge test (5 percent)
PRIOR = 8.0             # pseudo-count of the smoothed purity
REJECT_ABOVE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    name, _, rest = rule.partition("/")
    on_host = (F.col("host") == name) | F.col("host").endswith("." + name)
    return on_host & F.col("path").startswith("/" + rest)


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, r in sorted(rules, key=lambda x: len(x[1])):     # the longest ends outermost
        rule, says = F.when(_fits(r), r).otherwise(rule), F.when(_fits(r), action).otherwise(says)
    return rule, says


def lexical_template(p: Column) -> Column:
    """array<string>: the path's segments, variable parts as ``*``."""
    return F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, VARIABLE, "*"))


def node_keys(segs: Column) -> Column:
    """array<string>: a digest of each prefix of the segments, the empty one first."""
    return F.aggregate(segs, F.array(F.lit("")), lambda acc, s: F.concat(
        acc, F.array(F.md5(F.concat_ws("/", F.element_at(acc, -1), s)))))


def sibling_groups(children: Column) -> Column:
    """Groups (last, n, b) of children (share, n, b, k) sorted by share, then n:
    ``k`` children have ``b`` of ``n`` labels blocked.  ``last`` is the share
    and count of a group's last child, n and b are the group's sums."""
    whole = F.lit(0).cast("long")
    key = "struct<share:double,n:bigint>"
    zero = F.struct(whole.alias("n"), whole.alias("b"), whole.alias("rn"), whole.alias("rb"), F.lit(None).cast(key).alias("last"),
                    F.array().cast(f"array<struct<last:{key},n:bigint,b:bigint>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        both = (acc["rn"] + x["n"]).cast("double")      # rn, rb: the group's member with the most labels
        share = (acc["rb"] + x["b"]) / F.greatest(both, F.lit(1.0))
        gap = x["share"] - F.try_divide(acc["rb"].cast("double"), acc["rn"].cast("double"))
        apart = F.coalesce(gap * gap * x["n"] * acc["rn"] > F.lit(CHI2) * share * (1.0 - share) * both, F.lit(False))
        leads = apart | (x["n"] > acc["rn"])
        add_n, add_b = x["k"] * x["n"], x["k"] * x["b"]
        return F.struct(
            F.when(apart, add_n).otherwise(acc["n"] + add_n).alias("n"), F.when(apart, add_b).otherwise(acc["b"] + add_b).alias("b"),
            F.when(leads, x["n"]).otherwise(acc["rn"]).alias("rn"), F.when(leads, x["b"]).otherwise(acc["rb"]).alias("rb"),
            F.struct(x["share"].alias("share"), x["n"].alias("n")).alias("last"),
            F.when(apart, F.concat(acc["done"], F.array(F.struct(acc["last"].alias("last"), acc["n"].alias("n"), acc["b"].alias("b")))))
            .otherwise(acc["done"]).alias("done"))

    return F.aggregate(children, zero, step, lambda acc: F.concat(
        acc["done"], F.array(F.struct(acc["last"].alias("last"), acc["n"].alias("n"), acc["b"].alias("b")))))


def template_verdicts(judged: DataFrame) -> DataFrame:
    """(host, tpl, purity, template_verdict) from rows (host, segs, label),
    label 1 = blocked, 0 = allowed, null = not labelled."""
    leaves = judged.withColumn("tpl", F.array_join("segs", "/")).groupBy("host", "tpl", "segs").agg(
        F.count("label").alias("nl"), F.coalesce(F.sum("label"), F.lit(0)).alias("nb")).withColumn("keys", node_keys(F.col("segs")))
    # one row per template and level; level 0 is the host
    steps = leaves.select("host", "tpl", "nl", "nb", "keys", F.posexplode("keys").alias("d", "node")) \
        .withColumn("parent", F.get("keys", F.col("d") - 1)).drop("keys")
    nodes = steps.groupBy("host", "d", "parent", "node").agg(F.sum("nl").alias("n"), F.sum("nb").alias("b"))
    share = F.col("b").cast("double") / F.col("n").cast("double")
    alike = nodes.where("d > 0 and n > 0").groupBy("host", "d", "parent", "n", "b").agg(F.count(F.lit(1)).alias("k"))
    groups = alike.groupBy("host", "d", "parent").agg(F.array_sort(F.collect_list(
        F.struct(share.alias("share"), "n", "b", "k"))).alias("children")) \
        .select("host", "d", "parent", sibling_groups(F.col("children")).alias("groups"))
    own = F.get(F.filter("groups", lambda g: (g["last"]["share"] > share) | ((g["last"]["share"] == share) & (g["last"]["n"] >= F.col("n")))), F.lit(0))
    placed = nodes.where("d > 0 and n > 0").join(groups, ["host", "d", "parent"]).select(
        "host", "d", "node", own.alias("g")).select("host", "d", "node", F.col("g.n").alias("gn"), F.col("g.b").alias("gb"))
    path_groups = steps.where("d > 0").join(placed, ["host", "d", "node"]).groupBy("host", "tpl").agg(
        F.array_sort(F.collect_list(F.struct("d", "gn", "gb"))).alias("levels"))
    hosts = nodes.where("d = 0").select("host", F.col("n").alias("hn"), F.col("b").alias("hb"))
    overall = hosts.groupBy(F.lit(1).alias("one")).agg(((F.sum("hb") + 1.0) / (F.sum("hn") + 2.0)).alias("all_share"))
    shares = hosts.withColumn("one", F.lit(1)).join(overall, "one").select(
        "host", ((F.col("hb") + PRIOR * F.col("all_share")) / (F.col("hn") + PRIOR)).alias("host_share"))
    purity = F.aggregate(F.coalesce("levels", F.array().cast("array<struct<d:int,gn:bigint,gb:bigint>>")), F.col("host_share"),
                         lambda up, level: (level["gb"] + PRIOR * up) / (level["gn"] + PRIOR))
    return leaves.select("host", "tpl").join(path_groups, ["host", "tpl"], "left").join(shares, "host").withColumn("purity", purity).select(
        "host", "tpl", "purity", F.when(F.col("purity") > REJECT_ABOVE, "block").otherwise("allow").alias("template_verdict"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    rule, says = fitting_rule(rules)
    parsed = shared_table(
        pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        .withColumn("rule", rule).withColumn("says", says).withColumn("segs", lexical_template(F.col("path"))), "urls")
    label = F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0)
    verdicts = template_verdicts(parsed.select("host", "segs", label.cast("long").alias("label")))
    return parsed.withColumn("tpl", F.array_join("segs", "/")).join(verdicts, ["host", "tpl"]).select(
        "page_id", "host", "path", "rule", F.coalesce("says", "template_verdict").alias("verdict"),
        F.col("tpl").alias("template"), F.round("purity", 6).alias("purity"))
