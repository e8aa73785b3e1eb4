"""URL verdicts: a list of rules, and below it a tree of path templates per host.

The pages that a rule decides are the labels. Per host, a path goes down a tree, one
segment a level. A segment stays as it is if it is frequent below its node and its
share of blocked labels differs from that of its siblings; rare segments are variable,
and those with like shares are alike, so both turn into the wildcard ``*`` and merge. A
template's purity is its share of blocked labels, smoothed towards its parent's, the
host's towards that of all hosts. Templates of a purity from the threshold up are
rejected.

The tree is kept as counts per (host, node, segment), which shuffle as partial sums.
Where counts go back to pages, keys that hold more than one row in ``FREQUENT`` are
broadcast, and only the others are joined by a shuffle: neither a host with a third of
all pages nor a node with millions of children ever comes together in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.session import settle

#: A key is frequent if it holds more than one in so many rows, so there are fewer such
#: keys than this, whatever the data.
FREQUENT = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """Levels of the tree (what lies deeper is one segment more), pages that make a
    segment frequent, standard errors that make shares differ, weight of the parent in
    a purity, and the purity that rejects."""

    levels: int = 4
    support: int = 5
    errors: float = 1.96
    prior: float = 10.0
    threshold: float = 0.5


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is missing or has no ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, whole, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def matching(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _smoothed(blocked: Column, labels: Column, parent: Column, prior: float) -> Column:
    return (blocked + F.lit(prior) * parent) / (labels + F.lit(prior))


def _attach(rows: DataFrame, values: DataFrame, keys: list[str], total: int, scatter: list[str]) -> DataFrame:
    """Rows with the columns that ``values`` has for their keys, nulls if it has none.

    ``values`` has one row per key, and in ``held`` how many of the ``total`` rows have
    it. Rows of frequent keys find theirs by broadcast; they and rows whose last key is
    missing then take part in the shuffle by ``scatter`` instead of coming together.
    """
    names = [c for c in values.columns if c not in keys and c != "held"]
    packed = values.select(*keys, "held", F.struct(*names).alias("of"))
    frequent = F.col("held") * FREQUENT > F.lit(total)
    often = packed.where(frequent).select(*keys, F.col("of").alias("often"))
    seldom = packed.where(~frequent).select(*keys, F.lit(0).cast("long").alias("turn"), F.col("of").alias("seldom"))
    alone = F.col("often").isNotNull() | F.col(keys[-1]).isNull()
    turn = F.when(alone, F.xxhash64(*scatter)).otherwise(F.lit(0).cast("long"))
    both = rows.join(F.broadcast(often), keys, "left").withColumn("turn", turn).join(seldom, [*keys, "turn"], "left")
    return both.select(*rows.columns, *[F.coalesce(f"often.{c}", f"seldom.{c}").alias(c) for c in names])


def templates(paths: DataFrame, tree: Tree) -> DataFrame:
    """``(host, path, n, template, purity)`` of each row ``(host, path, n, labels, blocked)``.

    ``host`` and ``path`` must be different in each row.
    """
    all_hosts = F.broadcast(
        paths.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labels"), F.lit(0)) + 2)).alias("base"))
    )
    total, held = paths.count(), F.count(F.lit(1)).alias("held")
    per_host = paths.groupBy("host").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"), held)
    pieces = F.split(F.expr("substr(path, 2)"), "/", tree.levels + 1)
    now = _attach(paths, per_host, ["host"], total, ["path"]).crossJoin(all_hosts).select(
        "host", "path", "n", "labels", "blocked",
        F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(pieces).alias("pieces"),
        F.lit("").alias("node"),
        _smoothed(F.col("b"), F.col("l"), F.col("base"), tree.prior).alias("purity"),
    )
    now = settle(now, "paths")
    for level in range(tree.levels + 1):
        at = now.withColumn("piece", F.get("pieces", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "labels", "blocked")]
        child = at.where("piece is not null").groupBy("host", "node", "piece").agg(*sums, held)
        whole = child.groupBy("host", "node").agg(F.sum("labels").alias("all_l"), F.sum("blocked").alias("all_b"), held)
        kept = (
            _attach(child, whole, ["host", "node"], total, ["piece"])
            .withColumn("rest_l", F.col("all_l") - F.col("labels"))
            .withColumn("rest_b", F.col("all_b") - F.col("blocked"))
        )
        share = F.col("all_b") / F.col("all_l")
        spread = F.sqrt(share * (1 - share) * (1 / F.col("labels") + 1 / F.col("rest_l")))
        gap = F.abs(F.col("blocked") / F.col("labels") - F.col("rest_b") / F.col("rest_l"))
        # A segment that labels cannot tell from its siblings merges with them.
        told = (F.col("labels") > 0) & (F.col("rest_l") > 0)
        stays = (F.col("n") >= tree.support) & F.when(told, gap > tree.errors * spread)
        kept = kept.select("host", "node", "piece", F.coalesce(stays, F.lit(False)).alias("kept"), "held")
        step = F.when(F.col("piece").isNull(), "").otherwise(
            F.concat(F.lit("/"), F.when(F.col("kept"), F.col("piece")).otherwise("*"))
        )
        moved = _attach(at, kept, ["host", "node", "piece"], total, ["path"]).select(
            "host", "path", "n", "labels", "blocked", "pieces", F.concat("node", step).alias("node"), "purity",
            F.when(F.col("piece").isNotNull(), F.concat("node", step)).alias("inner"),
        )
        moved = settle(moved, "paths")
        found = moved.where("inner is not null").groupBy("host", "inner").agg(
            F.sum("labels").alias("l"), F.sum("blocked").alias("b"), held
        )
        joined = _attach(moved, found, ["host", "inner"], total, ["path"])
        purity = F.when(F.col("inner").isNotNull(), _smoothed(F.col("b"), F.col("l"), F.col("purity"), tree.prior)).otherwise(F.col("purity"))
        now = settle(
            joined.select("host", "path", "n", "labels", "blocked", "pieces", "node", purity.alias("purity")), "paths"
        )
    return now.select("host", "path", "n", F.col("node").alias("template"), "purity")


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every row.

    A rule's verdict stands; where none fits, templates decide. URLs that are missing
    or have no ``://`` have an empty host and path and are pages of that host. Rows
    without a page_id and repeated rows each give a row; an empty table gives none.
    Hosts without labels get the purity that all hosts have together. Further columns
    are ignored.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching(rules, F.col("host"), F.col("path"))
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    judged = settle(judged, "pages")
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    paths = judged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(label).alias("labels"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked")
    )
    found = templates(settle(paths, "paths"), tree).withColumnRenamed("n", "held")
    method = F.when(F.col("purity") >= tree.threshold, "block").otherwise("allow")
    return _attach(judged, found, ["host", "path"], judged.count(), ["page_id"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )
