"""URL filter: host and path rules first, else a tree of path templates per host.

Rules (host and path prefix, allow or block) fit a host and its subdomains; the longest fitting one
decides and its verdict is also the label that the trees learn from.

The tree of a host has one level per path segment, as many as the longest path has. Runs of digits
become ``{n}``; at a node with many children that are mostly seen once or twice, the segment is a
variable and all children become ``*``. A branch whose labelled block share does not differ
significantly from what its parent stands for is merged: it and its like become one node ``~``, and
the next level counts their children together. The purity of what is left is the
block share smoothed towards the parent's, from the host's up to all hosts'; a URL is blocked if its
template's purity reaches ``reject``.

All steps are DataFrame expressions, aggregates and joins: URLs are counted into shapes first, the
trees are built over shapes, a written table per level, and the verdicts are joined back.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged with all
such; repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import erase, written

#: Rule, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
MANY, FEW_EACH, WEIGHT, DEVIATIONS, REJECT = 8, 2, 4.0, 1.96, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")),
                       _UPPER, _LOWER)
    return host, F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of a short list, or null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        here = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits = F.when(here, F.lit(rule)).otherwise(fits)
    return fits


def segments(path: Column) -> Column:
    """The path's segments, runs of digits as ``{n}``, empty ones left out."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), lambda s: s != "")


def _at(parts: str, level: int) -> Column:
    """Segment ``level`` (from 1), empty past the end."""
    return F.coalesce(F.get(parts, F.lit(level - 1)), F.lit(""))


def _generalised(shapes: DataFrame, depth: int) -> DataFrame:
    """Column ``general`` (and ``node``): each segment as it is, or ``*`` where its node's children vary."""
    out = written(shapes.withColumns({"node": F.col("host"),
                                      "general": F.array().cast("array<string>")}), "url-shapes")
    for level in range(1, depth + 1):
        here = out.withColumn("s", _at("parts", level))
        some = F.col("s") != ""
        children = here.filter(some).groupBy("node", "s").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("node").agg(F.count(F.lit(1)).alias("kinds"),
                                             F.sum("n").alias("pages"))
        varies = F.coalesce((F.col("kinds") >= MANY)
                            & (F.col("kinds") * FEW_EACH >= F.col("pages")), F.lit(False))
        stands = F.when(varies, F.lit("*")).otherwise(F.col("s"))
        grown = here.join(nodes, "node", "left").withColumns({
            "node": F.when(some, F.concat("node", F.lit("/"), stands)).otherwise(F.col("node")),
            "general": F.when(some, F.array_append("general", stands)).otherwise(F.col("general"))})
        grown = written(grown.select(*out.columns), "url-shapes")
        erase(out)
        out = grown
    return out


def _judged_shapes(shapes: DataFrame, depth: int, weight: float, deviations: float) -> DataFrame:
    """Template and purity of every shape, walking each host's tree from the top."""
    total = shapes.agg(F.sum("allowed"), F.sum("blocked")).first()
    allowed, blocked = (x or 0 for x in total)
    out = shapes.select("host", "shape", "general", "allowed", "blocked", F.col("host").alias(
        "template"), F.lit((blocked + 0.5) / (allowed + blocked + 1.0)).alias("purity"))
    for level in range(depth + 1):
        here = out.withColumn("g", _at("general", level) if level else F.lit("."))
        some = F.col("g") != ""  # a path that has ended keeps what its last node stands for
        seen = here.filter(some).groupBy("template", "g").agg(
            F.sum("blocked").cast("double").alias("b"),
            F.sum(F.col("allowed") + F.col("blocked")).cast("double").alias("m"))
        p, b, m = F.col("purity"), F.col("b"), F.col("m")
        apart = some & (m > 0) & (F.abs(b / F.greatest(m, F.lit(1.0)) - p) > deviations * F.sqrt(
            p * (1.0 - p) / F.greatest(m, F.lit(1.0))))
        own = F.lit(True) if level == 0 else apart
        step = F.concat("template", F.lit("/"), F.when(own, F.col("g")).otherwise(F.lit("~")))
        walked = here.join(seen, ["template", "g"], "left").withColumns({
            "template": F.when(some, step).otherwise(F.col("template")) if level else F.col("template"),
            "purity": F.when(own, (b + weight * p) / (m + weight)).otherwise(p)})
        walked = written(walked.select(*out.columns), "url-templates")
        if level:
            erase(out)
        out = walked
    return out.select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, weight: float = WEIGHT,
          deviations: float = DEVIATIONS, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page's URL."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("string")
    for name, action in rules:
        verdict = F.when(F.col("rule") == name, F.lit(action)).otherwise(verdict)
    parsed = parsed.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn(
        "shape", F.array_join(segments(F.col("path")), "/"))
    shapes = written(parsed.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("by_rule") == "allow", 1))
        .alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
        .withColumn("parts", F.filter(F.split("shape", "/"), lambda s: s != "")), "url-shapes")
    depth = shapes.agg(F.max(F.size("parts"))).first()[0] or 0
    general = _generalised(shapes, depth)
    judged = _judged_shapes(general, depth, weight, deviations)
    erase(shapes, general)
    learned = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"),
        "template", F.bround("purity", 9).alias("purity"))
