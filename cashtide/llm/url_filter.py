"""URL rules that also reach aliases: redirect and canonical-link equivalence.

A page's own rule is the longest that fits its url. Pages that are one page under several names are found
as connected components over redirect edges, canonical links and the usual redirect conventions. A page
without a rule of its own is blocked if one of its names is blocked, unless one of its names is allowed:
an explicit allow comes first, on the page and in its class. Names are held against the rules whether or not a
page of that name was crawled.

Rules are an argument of bounded number and become part of the expression, so urls are not moved to judge
them; only pages that have an alias take part in the components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: More rules than this belong into a table that is joined, not into an expression.
MAX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and, from its first slash on, the beginning of a path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (size, allow, rule) of the longest rule that fits, or null; of equally long ones an allow wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fitting = [
        F.when(
            ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path),
            F.struct(
                F.lit(len(rule.text)).alias("size"),
                F.lit(rule.verdict == "allow").alias("allow"),
                F.lit(rule.text).alias("rule"),
            ),
        )
        for rule in rules
    ]
    return F.array_max(F.array(*fitting))


def name_of(url: Column) -> Column:
    """The url without scheme, fragment and tracking parameters: urls that differ in these are one page."""
    rest = F.regexp_replace(F.coalesce(after_scheme(url), F.lit("")), r"#[\s\S]*\z", "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"\A[^/?#]*([\s\S]*)\z", 1), r"(?<=[?&])(?:utm_\w+|ref)=[^&]*(?:&|\z)", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(tail, r"[?&]\z", "")))


def convention_of(name: Column) -> Column:
    """The name the usual redirects lead to: without ``www.`` or ``m.``, a trailing slash or ``.html``."""
    bare = F.regexp_replace(name, r"\A(?:www|m)\.(?=[^/?]*\.)", "")
    return F.regexp_replace(bare, r"\A([^?]*?)(?:/|/index\.html|\.html)(?=\?|\z)", "$1")


def linked_url(html: Column, url: Column) -> Column:
    """Array of the urls that a page's canonical link and its refresh redirect name, made absolute."""

    def absolute(link: Column) -> Column:
        scheme = F.coalesce(F.nullif(F.regexp_extract(url, r"\A([^:/?#]+)://", 1), F.lit("")), F.lit("http"))
        host, path = host_of(url), path_of(url)
        return (
            F.when(link == "", F.lit(None).cast("string"))
            .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
            .otherwise(
                F.concat(scheme, F.lit("://"), host, F.coalesce(F.nullif(F.regexp_extract(path, r"\A(.*/)", 1), F.lit("")), F.lit("/")), link)
            )
        )

    canonical = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    links = F.array(
        F.regexp_extract(canonical, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(refresh, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1),
    )
    return F.filter(F.transform(links, absolute), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, name, component.

    ``redirects`` may add edges (source, target), both urls. A null url, or one without ``://``, has an empty host
    and path, no rule, no alias and the verdict ``default``. ``name`` is null then; ``component`` is the
    smallest name of the page's class, null for pages without an alias. Repeated rows are judged alike;
    null html has no links. Other columns are ignored.
    """
    url = F.col("url")
    named = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), name_of(url).alias("name")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    links = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(
        name_of(url).alias("a"), F.explode(linked_url(F.col("html"), url)).alias("link")
    )
    edges = links.select("a", name_of(F.col("link")).alias("b"))
    names = named.select("name")
    if redirects is not None:
        moved = redirects.select(name_of(F.col("source")).alias("a"), name_of(F.col("target")).alias("b"))
        edges = edges.union(moved)
    names = names.union(edges.select("a")).union(edges.select("b")).where("name IS NOT NULL").distinct()
    usual = names.select(F.col("name").alias("a"), convention_of(F.col("name")).alias("b")).where("a <> b")
    classes = components(edges.union(usual))
    # Names that only links, redirects or conventions lead to are judged as well.
    node = F.concat(F.lit("any://"), F.col("node"))
    of_nodes = classes.select(F.col("node").alias("name"), best_rule(host_of(node), path_of(node), rules).alias("best"))
    judged = named.select("name", "best").union(of_nodes).where("best IS NOT NULL")
    own = judged.groupBy("name").agg(F.max("best.allow").alias("allow"), F.min("best.allow").alias("not_block"))
    held = (
        classes.join(own, F.col("node") == F.col("name"))
        .groupBy("component")
        .agg(F.max("allow").alias("any_allow"), (~F.min("not_block")).alias("any_block"))
    )
    of_name = classes.join(held, "component", "left").withColumnRenamed("node", "name")
    inherited = F.when(F.col("any_block") & ~F.col("any_allow"), F.lit("block")).otherwise(F.lit(default))
    return named.join(of_name, "name", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.when(F.col("best.allow"), "allow").when(~F.col("best.allow"), "block").otherwise(inherited).alias("verdict"),
        "name",
        "component",
    )
