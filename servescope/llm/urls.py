"""Url verdicts by rules and by a tree of path templates per host.

A rule is a host and a path prefix; it fits the host and its subdomains, and the longest fitting rule
decides. Pages that a rule decides are the labelled ones for the tree. The tree is built level by level
on aggregated patterns, never on pages:

1. Digits and long hexadecimal strings are one wildcard each, ``{n}`` and ``{x}``.
2. A branch is tested if it holds ``LEAST`` labelled pages. Tested branches of a node whose share of
   blocked pages does not differ from that of the others (two-proportion test at 5 %) are merged into
   ``*``; one that differs keeps its segment, and so do wildcards.
3. A branch that cannot be tested is never merged with tested ones: it ends as ``?``, and its pages take
   no verdict from their host.
4. A node is split further as long as it holds ``LEAST`` labelled pages and pages without a label, or
   labels of both kinds, however long its paths are; no share of its parent and no depth ends it. Where
   all pages have the same label, nothing can differ further down, and the segments left are ``*``.

Pages that end untested are judged one step further up, by a tree of the same rules over the paths of all
hosts. There a host is one observation, its share of blocked pages in the branch, however many pages it
has: a branch is tested if ``LEAST`` hosts have labels in it. So a single host says nothing about others.

A template is rejected if its share of blocked pages (hosts), smoothed by ``WEIGHT`` pages (hosts) of which
half are blocked, reaches ``REJECT``; templates of branches untested in both trees are not.

A hot host costs its number of distinct patterns, aggregated before they move. Null urls and urls without
``://`` have an empty host and path, form one pattern and are judged like any other. Repeated rows count as
often as they occur and get the same verdict; rules of equal length that fit one page cannot differ but in
their order, and the first wins. Null ids are carried; other columns are ignored; an empty table is empty.
Paths of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servescope.session import cut

# fixed values: host, path, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LEAST = 5
DIFFERS = 3.84  # chi-square of one degree of freedom at 5 %
WEIGHT = 4
REJECT = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of ``pages(page_id, url)``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).select(
        "page_id", F.translate(F.regexp_extract("url", pattern, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("url", pattern, 2).alias("path"))


def fitting_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``, null if none fits. A rule list is a parameter
    of some hundred entries."""
    picked = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        picked = F.when(fits, value) if picked is None else picked.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if picked is None else picked


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, blocked_share, learned_from`` per page; the template
    and share are those of the host's tree (``host``) or of the tree over all hosts (``all hosts``), the
    share is null for pages of branches untested in both."""
    shape = "regexp_replace(regexp_replace(s, '(?i)[0-9a-f]{8,}', '{x}'), '[0-9]+', '{n}')"
    judged = cut(parsed(pages).withColumn("fit", fitting_rule(rules)).selectExpr(
        "page_id", "host", "path", "fit.rule AS rule", "fit.verdict AS said", f"transform(split(path, '/', -1), s -> {shape}) AS g"))
    patterns = judged.groupBy("host", "g").agg(
        F.count(F.lit(1)).alias("n"), F.count("said").alias("lab"), F.count_if(F.col("said") == "block").alias("bad"))
    own = cut(path_templates(patterns))
    # the tree over all hosts learns from all patterns, and judges those left over
    common = path_templates(patterns, per_host=False).join(own.where("blocked_share IS NULL").select("host", "g"), ["host", "g"], "left_semi")
    common = common.where("blocked_share IS NOT NULL").selectExpr("host", "g", "template AS wide", "blocked_share AS wide_share")
    templates = own.join(common, ["host", "g"], "left").selectExpr(
        "host", "g", "coalesce(wide, template) AS template", "coalesce(wide_share, blocked_share) AS blocked_share",
        "CASE WHEN wide IS NOT NULL THEN 'all hosts' WHEN blocked_share IS NOT NULL THEN 'host' END AS learned_from")
    verdict = F.expr(f"coalesce(said, CASE WHEN blocked_share >= {REJECT} THEN 'block' ELSE 'allow' END)")
    return judged.join(templates, ["host", "g"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "blocked_share", "learned_from")


def _sums(patterns: DataFrame, by: list[str]) -> DataFrame:
    """``n, lab, bad`` of each group, counted in pages, or in hosts if groups span them."""
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    if "host" in by:
        return patterns.groupBy(*by).agg(*sums)
    hosts = patterns.groupBy(*by, "host").agg(*sums)
    return hosts.selectExpr(*by, "1L AS n", "CAST(lab > 0 AS LONG) AS lab", "CASE WHEN lab > 0 THEN bad / lab ELSE 0D END AS bad").groupBy(*by).agg(*sums)


def path_templates(patterns: DataFrame, per_host: bool = True) -> DataFrame:
    """``host, g, template, blocked_share`` per pattern ``(host, g, n, lab, bad)``, by a tree for each host
    or one over all; ``g`` starts with what stands before the first slash."""
    node, found = ["host", "template"] if per_host else ["template"], []
    state, level = cut(patterns.withColumn("template", F.lit(""))), 1
    while not state.isEmpty():
        nodes = _sums(state, node)
        # pages of a node that is labelled throughout, and alike, have their verdict
        splits = f"lab >= {LEAST} AND (lab < n OR bad > 0 AND bad < lab)"
        state = state.join(nodes.select(*node, F.expr(f"lab >= {LEAST}").alias("tested"), F.expr(splits).alias("splits")), node)
        left = f"array_join(transform(slice(g, {level + 1}, size(g)), s -> CASE WHEN s RLIKE '[{{]' THEN concat('/', s) ELSE '/*' END), '')"
        found.append(state.where("NOT splits").selectExpr(
            "host", "g", "n", "lab", "bad", f"concat(template, CASE WHEN tested THEN {left} ELSE '/?' END) AS template", "tested"))
        going = state.where("splits").withColumn("seg", F.expr(f"get(g, {level})"))
        found.append(going.where("seg IS NULL").select("host", "g", "n", "lab", "bad", "template", "tested"))
        going = going.where("seg IS NOT NULL").drop("tested", "splits")
        branch = _sums(going, [*node, "seg"]).withColumn("tested", F.expr(f"lab >= {LEAST}"))
        total = branch.where("tested").groupBy(*node).agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
        pooled = "all_bad / all_lab"
        z2 = (f"pow(bad / lab - (all_bad - bad) / (all_lab - lab), 2)"
              f" / greatest({pooled} * (1 - {pooled}) * (1 / lab + 1 / (all_lab - lab)), 1e-12)")
        name = (f"CASE WHEN NOT tested THEN '/?' WHEN seg RLIKE '[{{]' THEN concat('/', seg) WHEN all_lab = lab THEN '/*' "
                f"WHEN {z2} >= {DIFFERS} THEN concat('/', seg) ELSE '/*' END")
        named = branch.join(total, node, "left").select(*node, "seg", "tested", F.expr(name).alias("step"))
        stepped = cut(going.join(named, [*node, "seg"]).withColumn("template", F.concat("template", "step")).drop("seg", "step"))
        found.append(stepped.where("NOT tested").select("host", "g", "n", "lab", "bad", "template", "tested"))
        state, level = stepped.where("tested").drop("tested"), level + 1
    schema = "host string, g array<string>, n long, lab long, bad long, template string, tested boolean"
    leaves = reduce(DataFrame.unionByName, found) if found else patterns.sparkSession.createDataFrame([], schema)
    leaves = cut(leaves)
    share = F.when(F.col("tested"), (F.col("bad") + WEIGHT / 2) / (F.col("lab") + WEIGHT))
    rated = _sums(leaves, [*node, "tested"]).select(*node, "tested", share.alias("blocked_share"))
    return leaves.select("host", "g", "template", "tested").join(rated, [*node, "tested"]).drop("tested")
