"""URL verdicts from given rules and, where none fits, from a tree of path templates per host.

Path segments with digits are variable and count as one segment. Below each node of a host's tree, a
labelled segment keeps a branch of its own if its share of blocked URLs differs significantly from
that of all other URLs of the node together, or if none of those has a label, so that nothing shows
that the segment does not matter. All other branches are merged into the wildcard branch. A template
is rejected by the share of blocked among its labelled URLs, smoothed towards what its node holds
besides it and so on upwards to the share over all hosts. Branches kept apart lend no labels to others.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurevote.llm.common import written

WILDCARD = "*"
VARIABLE = "#"  # a path holds no such segment, as it ends there
SIGNIFICANT_Z = 2.576
PRIOR_WEIGHT = 5.0
REJECT_SHARE = 0.5


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict, both missing if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _apart(z: float) -> Column:
    """Whether a branch (labelled, blocked) differs from the rest of its node (all_ less its own), by the
    likelihood ratio of two shares against one; it holds for any counts, shares of 0 and 1 included."""
    n, k, all_n, all_k = (F.col(c).cast("double") for c in ("labelled", "blocked", "all_labelled", "all_blocked"))

    def fit(hits: Column, of: Column) -> Column:
        def part(x: Column) -> Column:
            return F.when(x > 0, x * F.log(x / of)).otherwise(0.0)

        return part(hits) + part(of - hits)

    ratio = 2 * (fit(k, n) + fit(all_k - k, all_n - n) - fit(all_k, all_n))
    alone = (all_n == n) & (F.col("all_n") > F.col("n"))
    return (n > 0) & (alone | (ratio > z * z))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = SIGNIFICANT_Z,
    prior_weight: float = PRIOR_WEIGHT,
    reject_share: float = REJECT_SHARE,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, block_share) of every URL; verdicts are allow and block.

    A rule (text, verdict) fits its host and all subdomains if the path starts with the rule's; the
    longest rule wins. URLs that a rule decides are the labelled ones. In a template, * stands for the
    merged branches and # for variable segments kept apart. A missing URL, or one without ://, has empty
    host and path and is judged as a host of its own. Without any labelled URL the share is one half,
    which rejects nothing: a template must be above `reject_share`. Repeated rows are judged alike; other
    columns are left behind.

    One round of jobs for each level of the trees; a node without labels or with one path only is left
    as soon as it is reached, so rounds end where the last labelled paths part, not at the longest path.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    shape = F.transform(
        F.array_remove(F.split("path", "/"), ""),
        lambda s: F.when(s.rlike("[0-9]") | (s == WILDCARD), F.lit(VARIABLE)).otherwise(s),
    )
    judged = parsed.select("id", "host", "path", rule.alias("rule"), says.alias("says"), shape.alias("shape"))

    label = (F.col("says") == "block").cast("long")
    nodes = judged.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("says").alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked")
    )
    nodes = written(nodes)
    # The prior of a node comes from outside of it only: near + far times the share over all hosts, to
    # which no branch kept apart (not `common`) adds its labels.
    first = {"template": F.lit(""), "near": F.lit(0.0), "far": F.lit(1.0), "common": F.lit(True)}
    active = nodes.withColumns(first)
    names = ["host", "shape", "n", "labelled", "blocked", *first]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    settled, level = [], 0
    while True:
        node = ["host", "template"]
        whole = active.groupBy(*node).agg(
            F.count("*").alias("paths"),
            *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")],
        )
        at = written(active.join(whole, node))
        open_node = (F.col("paths") > 1) & (F.col("all_labelled") > 0)
        rest = F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0)))
        below = F.concat(F.array("template"), F.transform(rest, lambda s: F.lit(WILDCARD)))
        settled.append(at.where(~open_node).withColumn("template", F.array_join(below, "/")).select(*names))
        here = at.where(open_node)
        if here.isEmpty():
            break
        # A path that ends here is a branch too, with the empty segment.
        here = here.withColumn("segment", F.coalesce(F.get("shape", F.lit(level)), F.lit("")))
        alls = ["all_n", "all_labelled", "all_blocked"]
        branches = here.groupBy(*node, "segment", *alls).agg(*sums)
        branches = written(branches.select(*node, "segment", _apart(z).alias("own"), "labelled", "blocked"))
        ends = F.col("segment") == ""
        pool = branches.where(~F.col("own")).groupBy(*node).agg(
            *[
                F.sum(F.when(side, F.col(c)).otherwise(0)).alias(f"{name}_{c}")
                for name, side in (("end", ends), ("merged", ~ends))
                for c in ("labelled", "blocked")
            ]
        )
        here = here.join(branches.select(*node, "segment", "own"), [*node, "segment"]).join(pool, node, "left")

        def prior(base: Column, hits: bool) -> Column:
            """Towards what the node holds besides the branch, without branches kept apart."""

            def smoothed(side: str) -> Column:
                seen = F.col(f"{side}_blocked") if hits else F.lit(0)
                return (seen + prior_weight * base) / (F.col(f"{side}_labelled") + prior_weight)

            return F.when(F.col("own"), base).when(ends, smoothed("merged")).otherwise(smoothed("end"))

        branch = F.when(F.col("own"), F.col("segment")).otherwise(F.lit(WILDCARD))
        here = here.withColumns(
            {
                "near": prior(F.col("near"), True),
                "far": prior(F.col("far"), False),
                "common": F.col("common") & ~F.col("own"),
                "template": F.when(ends, F.col("template")).otherwise(F.concat("template", F.lit("/"), branch)),
            }
        )
        settled.append(here.where(ends).select(*names))
        active = here.where(~ends).select(*names)
        level += 1

    nodes = written(reduce(DataFrame.union, settled))
    total = nodes.where("common").agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    outside = F.first("near") + F.first("far") * ((total[0] + 1) / (total[1] + 2))
    share = (F.sum("blocked") + prior_weight * outside) / (F.sum("labelled") + prior_weight)
    shares = nodes.groupBy("host", "template").agg(share.alias("block_share"))
    by_shape = nodes.select("host", "shape", "template").join(shares, ["host", "template"])

    own_says = F.when(F.col("block_share") > reject_share, "block").otherwise("allow")
    return judged.join(by_shape, ["host", "shape"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("says", own_says).alias("verdict"),
        "template",
        "block_share",
    )
