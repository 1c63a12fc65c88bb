"""URL filters: rules first, then a path-template tree per host.

The tree is built level by level with aggregates over the distinct
``(host, path)`` pairs, never over raw rows:

1. *Wildcards.*  Below a node ``(host, template so far)`` with at least ``min_children``
   distinct segments, those with fewer than ``min_support`` distinct paths are variable and
   become ``*`` together; each of the others is a branch for step 2.
2. *Merging.*  A branch whose labelled bad rate does not differ from its
   parent's by a two-proportion z-test (``|z| < z_merge``, or no labels) joins
   its like siblings in one branch ``~``.
3. *Purity.*  A full template's bad share is smoothed towards its host's, which is
   smoothed towards the overall share:
   ``(bad + strength * share above) / (labelled + strength)``.  Templates at or
   above ``reject_at`` are blocked.

Levels go on to the last segment of the deepest path; paths that end, or that are alone below
their node and so keep their segments, leave the loop.  A hot host is not gathered: child and node statistics are partial aggregates, node tables are counted and broadcast
while they are few, and rows are joined by ``(host, path)``.

Edge cases: null urls and urls without ``://`` have an empty host and path (one
node of their own); labels of unknown urls are ignored; an id labelled several
times counts as bad if any label says so; without labels nothing is blocked by the
tree; repeated ids give one row each; an empty table gives an empty table.  Only id and url are
read, so columns with clashing names do no harm.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import cut, measured_side


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest fitting rule, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def template_tree(paths: DataFrame, min_children: int = 8, min_support: float = 4.0, z_merge: float = 1.96) -> DataFrame:
    """Adds ``template`` to ``(host, path, n_labelled, n_bad)`` rows, one per distinct host and path."""
    trimmed = F.regexp_replace("path", "^/", "")
    t = cut(paths.withColumn("segments", F.split(trimmed, "/")).withColumn("template", F.lit("")))
    done = [t.limit(0).drop("segments")]
    level = 0
    while not t.isEmpty():
        t = cut(_one_level(t, level, min_children, min_support, z_merge))
        done.append(t.filter("complete").drop("segments", "complete"))
        t = t.filter(~F.col("complete")).drop("complete")
        level += 1
        if len(done) > 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def _one_level(t: DataFrame, level: int, min_children: int, min_support: float, z_merge: float) -> DataFrame:
    """Every row of ``t`` has a segment at ``level``; ``complete`` rows have their whole template."""
    t = t.withColumn("segment", F.col("segments")[level])
    child = t.groupBy("host", "template", "segment").agg(
        F.count("*").alias("n"), F.sum("n_labelled").alias("lab"), F.sum("n_bad").alias("bad"))
    node = child.groupBy("host", "template").agg(
        F.count("*").alias("children"), F.sum("n").alias("paths"), F.sum("lab").alias("all_lab"),
        F.sum("bad").alias("all_bad"))
    # Nodes are counted, and broadcast while they are few, so that a hot host doesn't meet in one task.
    # Variable segments become * without a row of their own, so this table holds at most
    # paths / min_support rows below wide nodes.
    fixed = child.join(measured_side(cut(node)), ["host", "template"]).filter(
        (F.col("children") < min_children) | (F.col("n") >= min_support))
    share = lambda bad, of: F.try_divide(F.col(bad).cast("double"), F.col(of))  # noqa: E731  null without labels
    pooled = share("all_bad", "all_lab")
    one = F.lit(1.0)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, F.col("lab")) - F.try_divide(one, F.col("all_lab"))))
    differs = (F.col("lab") > 0) & (F.col("lab") < F.col("all_lab")) & (error > 0) & (
        F.abs(share("bad", "lab") - pooled) >= z_merge * error)
    fixed = fixed.select("host", "template", "segment", (F.col("paths") == 1).alias("alone"), F.when(
        (F.col("children") == 1) | F.coalesce(differs, F.lit(False)), F.col("segment")).otherwise(F.lit("~")).alias("label"))
    out = t.join(measured_side(cut(fixed)), ["host", "template", "segment"], "left")
    # The only path below a node has one child at each level from here on.
    alone, size = F.coalesce("alone", F.lit(False)), F.size("segments")
    label = F.when(alone, F.array_join(F.slice("segments", level + 1, size), "/")).otherwise(F.coalesce("label", F.lit("*")))
    return out.withColumns({"template": F.concat("template", F.lit("/"), label), "complete": alone | (size == level + 1)}).drop(
        "segment", "label", "alone")


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id",
                 url_col: str = "url", strength: float = 4.0, reject_at: float = 0.5, **tree: float) -> DataFrame:
    """``(id, host, path, rule, template, p_bad, verdict)`` for every row of ``pages``.

    ``labels`` holds ``(id, bad)`` rows (bad 0/1) for some of the pages; ``rules``
    is a short list from the caller's configuration.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = labels.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("bad").alias("bad"))
    paths = rows.join(known, "id", "left").groupBy("host", "path").agg(
        F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    t = template_tree(paths, **tree)
    by_template = t.groupBy("host", "template").agg(F.sum("n_labelled").alias("lab"), F.sum("n_bad").alias("bad"))
    by_host = t.groupBy("host").agg(F.sum("n_labelled").alias("host_lab"), F.sum("n_bad").alias("host_bad"))
    overall = t.agg(F.sum("n_bad").alias("b"), F.sum("n_labelled").alias("l")).first()
    share = (overall["b"] or 0) / overall["l"] if overall["l"] else 0.0
    host_share = (F.col("host_bad") + strength * share) / (F.col("host_lab") + strength)
    purity = by_template.join(measured_side(cut(by_host)), "host").select(
        "host", "template", ((F.col("bad") + strength * host_share) / (F.col("lab") + strength)).alias("p_bad"))
    judged = t.select("host", "path", "template").join(measured_side(cut(purity)), ["host", "template"])
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    return rows.join(judged, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "template", "p_bad",
        F.coalesce(said, F.when(F.col("p_bad") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
