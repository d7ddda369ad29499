"""URL filtering by rules and a path-template tree.

Rules decide first: the longest rule that fits the host (or a parent domain) and the start of the path.  All
other pages are judged by the tree.  Per host, path segments that are variable by shape (numbers, hex, long
names) or by spread (many rare siblings) become wildcards.  A branch is merged with its siblings when it can't
be told from the rest of them: what follows it has the same distribution, and so has its bad share where both
are labelled.  So labels reach pages without any through the wildcard they share.

A rule that names path segments speaks for that branch alone: its author left the siblings out.  So those segments
keep their names and merge with nothing, and the label counts from the last of them down, not above, where it
would condemn or clear what the rule does not name.

A page's template is rejected when its smoothed labelled purity reaches the threshold.  Purity is
(bad + strength * prior) / (labelled + strength), where the prior of a node is the purity of its parent without
the node's own labels, from the host (whose prior is a setting) down: a template without labels is judged by the
labels around it, and none counts twice.  Labels are the verdicts of the rules, and any labels given by page id.

Counting is by grouping throughout, so a host with most of the pages is combined before it is shuffled; the
tree is built on distinct (host, shape) rows, not on pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, own_columns


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class TreeSettings:
    """depth: segments in a template, deeper ones share a tail; siblings: more than this many make rare ones variable;
    rare: share of the parent's pages below which a sibling is rare; z_bad, z_look: branches whose bad shares, or whose
    distributions of what follows, differ by fewer standard deviations are merged; prior, strength, reject: the host's
    prior, smoothing and threshold."""

    depth: int = 6
    siblings: int = 12
    rare: float = 0.2
    z_bad: float = 1.0
    z_look: float = 3.0
    prior: float = 0.1
    strength: float = 4.0
    reject: float = 0.7


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest rule that fits (name, verdict, scope: path segments it names), or null.  ``rules`` is a short list."""
    out = F.lit(None).cast("struct<name:string,verdict:string,scope:int>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(named_segments(r.path)).alias("scope"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment as a node name: wildcards for variable shapes; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    variable = stem.rlike(r"^[0-9][0-9._,-]*$|^[0-9a-fA-F-]{8,}$|[0-9]{4,}|^.{25,}$")
    return F.concat(F.when(variable, F.lit("*")).otherwise(stem), ending)


def named_segments(path: str) -> int:
    """How many segments of a rule's path stand in it, whole or begun."""
    return sum(1 for s in path.split("/") if s)


def segments(path: Column, depth: int, scope: Column | int = 0) -> Column:
    """Shapes of the non-empty segments, the first ``scope`` as they are; those past ``depth`` are one tail ``**``."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    head = F.transform(F.slice(parts, 1, depth), lambda s, i: F.when(i < scope, s).otherwise(shape(s)))
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def _looks(here: DataFrame, level: int) -> DataFrame:
    """(host, prefix, segment, look): how far what follows a segment is distributed unlike what follows its siblings.

    A two-sample chi-square over the tails, in standard deviations above its mean; 0 where there is one tail only.
    """
    branch, parent = ["host", "prefix", "segment"], ["host", "prefix"]
    tails = here.select(*branch, F.array_join(F.slice("shapes", level + 1, 1 << 20), "/").alias("tail"), "n").groupBy(*branch, "tail").agg(F.sum("n").alias("mine"))
    all_tails = tails.groupBy(*parent, "tail").agg(F.sum("mine").alias("all"))
    sizes = all_tails.groupBy(*parent).agg(F.sum("all").alias("pages"), F.count(F.lit(1)).alias("kinds"))
    mine = tails.join(all_tails, [*parent, "tail"]).join(tails.groupBy(*branch).agg(F.sum("mine").alias("own")), branch).join(sizes, parent)
    rest, theirs = F.col("pages") - F.col("own"), F.col("all") - F.col("mine")
    seen = F.pow(F.col("mine") * F.sqrt(rest / F.col("own")) - theirs * F.sqrt(F.col("own") / rest), 2) / F.col("all")
    summed = mine.where(rest > 0).groupBy(*branch).agg(F.sum(seen).alias("seen"), F.sum(theirs).alias("met"), F.first("own").alias("own"), F.first("pages").alias("pages"), F.first("kinds").alias("kinds"))
    unseen = (F.col("pages") - F.col("own") - F.col("met")) * F.col("own") / (F.col("pages") - F.col("own"))  # tails that only siblings have
    free = F.col("kinds") - 1
    return summed.select(*branch, F.when(free > 0, (F.col("seen") + unseen - free) / F.sqrt(2 * free)).otherwise(F.lit(0.0)).alias("look"))


def _grow(keys: DataFrame, level: int, s: TreeSettings) -> DataFrame:
    """One level of the tree: the segment at ``level`` is added to the prefix, and the node's counts and prior replace its parent's.

    keys: host, shapes, scope, prefix, n, labelled, bad (of the key), node_labelled, node_bad, prior (of the node at prefix).
    Labels count in a node from the level that is their scope; those that begin to count here did not count in the parent.
    """
    here = keys.withColumn("segment", F.when(F.size("shapes") >= level, F.expr(f"element_at(shapes, {level})"))).where("segment is not null")
    of_scope = lambda c, fits: F.sum(F.when(fits, F.col(c)).otherwise(0))
    above, upto = F.col("scope") < level, F.col("scope") <= level
    branches = here.groupBy("host", "prefix", "segment").agg(
        F.sum("n").alias("n"), of_scope("labelled", above).alias("labelled"), of_scope("bad", above).alias("bad"),
        of_scope("labelled", upto).alias("now_labelled"), of_scope("bad", upto).alias("now_bad"), (F.max("scope") >= level).alias("named"),
    )
    parents = branches.groupBy("host", "prefix").agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    rest = F.col("all_labelled") - F.col("labelled")
    pooled = F.col("all_bad") / F.col("all_labelled")
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-4)) * (1 / F.col("labelled") + 1 / rest))
    z = F.abs(F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / rest) / spread
    same_share = F.when((F.col("labelled") > 0) & (rest > 0), z < s.z_bad).otherwise(F.lit(True))
    alike = (F.col("kids") > 1) & same_share & (F.coalesce("look", F.lit(0.0)) < s.z_look)
    variable = (F.col("kids") > s.siblings) & (F.col("n") < F.col("all_n") * s.rare)
    grown = F.when(~F.col("named") & (variable | alike), F.lit("*")).otherwise(F.col("segment"))
    nodes = branches.join(parents, ["host", "prefix"]).join(_looks(here, level), ["host", "prefix", "segment"], "left").select(
        "host", "prefix", "segment", F.concat("prefix", F.lit("/"), grown).alias("grown"), "labelled", "bad", "now_labelled", "now_bad"
    )
    nodes = materialize(nodes, "url-nodes")
    counts = nodes.groupBy("host", "prefix", "grown").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.sum("now_labelled").alias("now_l"), F.sum("now_bad").alias("now_b"))
    left = keys.withColumn("segment", F.when(F.size("shapes") >= level, F.expr(f"element_at(shapes, {level})")))
    joined = left.join(nodes.select("host", "prefix", "segment", "grown"), ["host", "prefix", "segment"], "left").join(counts, ["host", "prefix", "grown"], "left")
    inherited = (F.col("node_bad") - F.col("b") + s.strength * F.col("prior")) / (F.col("node_labelled") - F.col("l") + s.strength)
    deeper = F.col("grown").isNotNull()
    pick = lambda new, old: F.when(deeper, new).otherwise(F.col(old)).alias(old)
    return joined.select(
        "host", "shapes", "scope", pick(F.col("grown"), "prefix"), "n", "labelled", "bad",
        pick(F.col("now_l"), "node_labelled"), pick(F.col("now_b"), "node_bad"), pick(inherited, "prior"),
    )


def template_purity(pages: DataFrame, settings: TreeSettings) -> DataFrame:
    """pages: host, shapes, scope, bad (1, 0 or null where unlabelled) -> host, shapes, scope, template, labelled, bad, purity.

    labelled and bad count the pages at or below the template whose label counts there, so /de is judged with /de/1 and
    /de/2; ``scope`` is the number of segments that a page's rule names (0: none, or no rule).
    """
    keys = pages.groupBy("host", "shapes", "scope").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    keys = materialize(keys, "url-keys")
    whole = lambda c: F.sum(F.when(F.col("scope") == 0, F.col(c)).otherwise(0))
    hosts = keys.groupBy("host").agg(whole("labelled").alias("node_labelled"), whole("bad").alias("node_bad"))
    keys = keys.join(hosts, "host").select("host", "shapes", "scope", F.lit("").alias("prefix"), "n", "labelled", "bad", "node_labelled", "node_bad", F.lit(settings.prior).alias("prior"))
    deepest = keys.agg(F.max(F.size("shapes"))).first()[0] or 0  # depth + 1 at most
    for level in range(1, deepest + 1):
        keys = materialize(_grow(keys, level, settings), "url-templates")
    purity = (F.col("node_bad") + settings.strength * F.col("prior")) / (F.col("node_labelled") + settings.strength)
    return keys.select("host", "shapes", "scope", F.col("prefix").alias("template"), F.col("node_labelled").alias("labelled"), F.col("node_bad").alias("bad"), purity.alias("purity"))


def filter_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, settings: TreeSettings = TreeSettings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule (name or null), verdict, template, purity.

    ``labels`` (id, bad 0/1) adds labels to those of the rules, which count from the host down; a page with a rule is
    labelled by its rule.  The tree is at least as deep as the longest rule's path.

    Edge cases: a null url, or one without ``://``, has empty host and path and is judged like any page of
    the empty host; repeated rows and null ids are kept, and each counts; a host without labels
    has the prior's purity and is allowed; an empty table gives an empty result; other columns are ignored.
    """
    source = own_columns(pages, id_col, url_col).toDF("id", "url")
    parsed = source.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    depth = max([settings.depth, *[named_segments(r.path) for r in rules]])
    ruled = ruled.withColumn("scope", F.coalesce("rule.scope", F.lit(0))).withColumn("shapes", segments(F.col("path"), depth, F.col("scope")))
    bad = F.when(F.col("rule").isNotNull(), (F.col("rule.verdict") == "block").cast("int"))
    if labels is not None:
        given = labels.toDF("label_id", "given").groupBy("label_id").agg(F.max("given").cast("int").alias("given"))
        ruled = ruled.join(given, F.col("id") == F.col("label_id"), "left").withColumn("bad", F.coalesce(bad, "given"))
    else:
        ruled = ruled.withColumn("bad", bad)
    judged = template_purity(ruled.select("host", "shapes", "scope", "bad"), settings)
    found = F.when(F.col("purity") >= settings.reject, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(judged.select("host", "shapes", "scope", "template", "purity"), ["host", "shapes", "scope"]).select(
        F.col("id").alias(id_col), "host", "path", F.col("rule.name").alias("rule"), F.coalesce(F.col("rule.verdict"), found).alias("verdict"), "template", "purity"
    )
