"""URL filters: listed rules first, then a path-template tree per host whose templates are judged by labelled purity.

1. A url is cut into host and path. The longest listed rule whose host it belongs to and with whose path its path starts
   gives the verdict; those urls are also the labelled ones.
2. Distinct paths are counted per host and shape (each run of digits becomes ``#``), so that repeated urls weigh no more
   than single ones, and hot hosts shrink to their distinct shapes before anything else is done with them.
3. Level by level, until no segment is left, a node of a host's tree with ``many_children`` rare children (each with at
   most that fraction of the node's paths) is a variable place: its rare children become one wildcard ``*``, and frequent
   ones keep their name. Both sides of the comparison grow with the crawl, so that more paths under each child change nothing.
   Paths below a node of fewer than ``many_children`` shapes need no further level, since no place there can be variable.
4. Sibling templates whose labelled shares of blocked urls do not differ significantly from what the siblings share
   together are merged; the others stand alone. Siblings without labelled urls join if the branch is homogeneous: two
   labelled templates at least, and none that differs.
5. A template (or merged branch) is rejected if its share of blocked urls, smoothed with ``weight`` urls of the overall
   share, reaches ``purity``. Templates without labelled urls keep to the overall share, which alone never rejects.

All of it is DataFrame expressions; per-shape tables are small against the urls and are written to the shared folder. Totals
of siblings are grouped sums joined back (by broadcast while their measured size is small), so that a host with any number of
siblings is summed in parts and never ordered in one task.

Cases: null urls, or without ``://``, have an empty host and path, fit no rule and are allowed; ids may repeat or be null
(each row is judged by its url); an empty path fits no rule (their paths begin with ``/``); extra columns are ignored; an
empty table gives an empty result; two rules of equal length that both fit are told apart by their text (larger wins).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import BROADCAST_LIMIT, LOWER, UPPER, let, materialize

# The listed rules (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class Settings:
    many_children: int = 20
    z: float = 2.0
    weight: float = 4.0
    purity: float = 0.8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/``, ``?``, ``#`` with A-Z lower-cased, path up to ``?`` or ``#``; else empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    part = lambda i: F.when(known, F.regexp_extract(url, pattern, i)).otherwise("")
    return F.translate(part(1), UPPER, LOWER), part(2)


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest of ``rules`` that fits: struct of (length, rule, verdict), or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (a written table of texts) with a broadcast hint while its measured size is within ``limit``."""
    texts = [F.octet_length(f"`{f.name}`") for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = df.agg(F.sum(reduce(add, texts) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _with(rows: DataFrame, per_key: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (one row a key; keys do not hold null)."""
    return rows.join(_small(materialize(per_key, name), limit), keys)


def _templates(shapes: DataFrame, s: Settings, limit: int) -> DataFrame:
    """(host, shape, template) for the distinct shapes of each host, counted in ``n``."""
    rows = shapes.select("host", "shape", "n", F.split("shape", "/", -1).alias("segments"), F.lit("").alias("template"))
    node, done, depth = ["host", "template"], [], 0
    while True:
        depth += 1
        rest = F.array_join(F.slice("segments", depth + 1, F.size("segments")), "/")
        more = F.size("segments") > depth
        nodes = rows.groupBy(*node).agg(F.sum("n").alias("total"), F.count_if(more).alias("shapes"))
        rows = materialize(_with(rows, nodes, node, limit, "url-nodes"), "url-level")
        # a node of fewer shapes has no variable place at or below it: its paths stay as they are
        going = more & (F.col("shapes") >= s.many_children)
        done.append(rows.filter(~going).select("host", "shape", F.when(more, F.concat("template", F.lit("/"), rest)).otherwise(
            F.col("template")).alias("template")))
        rows = rows.filter(going).withColumn("segment", F.get("segments", F.lit(depth)))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        children = rows.groupBy(*node, "segment").agg(F.sum("n").alias("paths"), F.max("total").alias("total"))
        rare = F.col("paths") * s.many_children <= F.col("total")
        children = materialize(children.select(*node, "segment", rare.alias("rare")), "url-children")
        variable = materialize(children.filter("rare").groupBy(*node).agg(F.count(F.lit(1)).alias("k")).filter(
            F.col("k") >= s.many_children).select(*node, F.lit(True).alias("variable")), "url-variable")
        named = children.filter(~F.col("rare")).select(*node, "segment", F.lit(True).alias("named"))  # few a node
        rows = rows.join(_small(variable, limit), node, "left").join(_small(materialize(named, "url-named"), limit), [*node, "segment"], "left")
        wild = F.coalesce("variable", F.lit(False)) & F.col("named").isNull()
        step = F.concat("template", F.lit("/"), F.when(wild, "*").otherwise(F.col("segment")))
        rows = rows.select("host", "shape", "n", "segments", step.alias("template"))


def templates(urls: DataFrame, s: Settings = Settings(), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(host, shape, template, rejected, purity) from rows of (host, path, shape, verdict), verdict null if not labelled."""
    shapes = urls.select("host", "path", "shape", "verdict").distinct().groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    shapes = materialize(shapes, "url-shapes")
    tree = materialize(_templates(shapes, s, limit), "url-tree")
    sums = F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    leaves = tree.join(shapes, ["host", "shape"]).groupBy("host", "template").agg(*sums)
    leaves = materialize(leaves.withColumn("parent", F.regexp_replace("template", r"/[^/]*$", "")), "url-leaves")
    family = ["host", "parent"]
    share = leaves.groupBy(*family).agg(F.try_divide(F.sum("blocked"), F.sum("labelled")).alias("share"))
    spread = F.sqrt(F.col("labelled") * F.col("share") * (1 - F.col("share")))
    alike = (F.col("labelled") > 0) & (F.abs(F.col("blocked") - F.col("labelled") * F.col("share")) <= s.z * spread)
    leaves = _with(leaves, share, family, limit, "url-shares").withColumn("alike", alike)
    counts = leaves.groupBy(*family).agg(F.count_if(F.col("labelled") > 0).alias("n_labelled"), F.count_if("alike").alias("n_alike"))
    leaves = _with(leaves, counts, family, limit, "url-families")
    homogeneous = (F.col("n_labelled") >= 2) & (F.col("n_labelled") == F.col("n_alike"))
    joins = F.col("alike") | ((F.col("labelled") == 0) & homogeneous)
    judged = leaves.withColumn("branch", F.when(joins, "").otherwise(F.col("template"))).select(*family, "branch", "template", "labelled", "blocked")
    branch = [*family, "branch"]
    judged = materialize(judged, "url-branches")
    judged = _with(judged.select(*branch, "template"), judged.groupBy(*branch).agg(*sums), branch, limit, "url-merged")
    overall = shapes.agg(F.try_divide(F.sum("blocked"), F.sum("labelled"))).first()[0] or 0.0
    prior = min(overall, s.purity / 2)
    purity = (F.col("blocked") + s.weight * prior) / (F.col("labelled") + s.weight)
    judged = judged.select("host", "template", purity.alias("purity"), (purity >= s.purity).alias("rejected"))
    return _with(tree, judged, ["host", "template"], limit, "url-judged")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES,
          settings: Settings = Settings(), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per page: its id, host, path, rule (null if none fits), verdict, template and purity (of the method)."""
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    fit = let(F.struct("host", "path"), lambda u: listed(u["host"], u["path"], rules))  # the url is taken apart once
    rows = rows.withColumn("fit", fit).select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
        F.regexp_replace("path", "[0-9]+", "#").alias("shape"))
    tree = materialize(templates(rows.select("host", "path", "shape", "verdict"), settings, limit), "url-templates")
    tree = tree.select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity", "rejected")
    tree = _small(tree, limit)
    out = rows.join(tree, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape")), "left")
    verdict = F.coalesce("verdict", F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
