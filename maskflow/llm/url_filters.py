"""URL filters: host and path rules, and block decisions that reach a page's aliases.

A rule names a host and a beginning of paths; it fits its host and all subdomains, and
the longest that fits decides.  URLs that redirect to each other or name each other as
canonical are one page under several addresses: connected components over such links
carry decisions on.  A URL that no rule fits is allowed if a rule allows one of its
aliases, else blocked if a rule blocks one, else allowed.  Addresses that are only
linked to, and aren't among the pages, count as aliases too.

Links come from the pages themselves (``<link rel=canonical>``, ``<meta
http-equiv=refresh>``) and from a table of redirects, if there is one.  An alias is an
address without its fragment, scheme and host in lower case, without the usual port.

Rules are a table of any size.  A page's host has one suffix for each number of labels
that rules have; a suffix meets its rules in one equi-join, which gives the lengths of
their paths, and the path's beginnings of those lengths meet them in another.
Distinct (host, path) pairs are judged once.  Everything is DataFrame functions.

Defined results: a URL that is null or without ``://`` has an empty host and path, fits
no rule and is allowed; of two verdicts for one rule allow counts; of rules of one
length that with the longer host; null ids and repeated rows are judged alike, each for
itself; a null html has no links; an empty table gives an empty table; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from maskflow.functions.spans import let
from maskflow.llm.components import components
from maskflow.llm.shared import Shelf, sized_join

RULES = "verdict string, host string, path string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag of the kinds that can carry a link, and what is asked of it.
TAG = r"(?i)<(?:link|meta)\s[^<>]*>"
CANONICAL = r"""(?i)\srel\s*=\s*["']?canonical["'\s/>]"""
REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CONTENT = r"""(?i)\scontent\s*=\s*("[^"]*"|'[^']*')"""
TARGET = r"""(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)"""


def lowered(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z) and the path of a URL; empty where it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _rules(rules: DataFrame) -> DataFrame:
    """One row for each (host, path)."""
    return rules.groupBy(lowered(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))


def stored_rules(rules: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame, Row]:
    """(rules, their hosts with the lengths of paths, the most labels and characters of a host)."""
    known = shelf.put("url-rules", _rules(rules))
    # for each host the lengths of its rules' paths: a few numbers, however many rules
    hosts = shelf.put("url-rule-hosts", known.groupBy("r_host").agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("sizes")))
    shape = known.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.length("r_host")).alias("chars")).first()
    return known, hosts, shape


def fitted(urls: DataFrame, rules: tuple[DataFrame, DataFrame, Row]) -> DataFrame:
    """(host, path, rule, verdict) of the distinct pairs of ``urls`` that a rule fits; the longest one."""
    known, hosts, shape = rules
    pairs = urls.filter("host <> ''").select("host", "path").distinct()
    suffix = F.expr("substring_index(host, '.', -n)")
    asked = pairs.select("host", "path", F.explode(F.sequence(F.lit(1), F.lit(shape["labels"] or 1))).alias("n"))
    asked = asked.withColumn("r_host", suffix).filter(F.length("r_host") <= (shape["chars"] or 0))
    # a host of fewer labels has itself as every further suffix
    asked = asked.filter(F.col("n") == F.size(F.split("r_host", r"\."))).drop("n")
    met = sized_join(asked, hosts, "r_host", "inner")
    begun = met.select("host", "path", "r_host", F.explode("sizes").alias("size")).filter(F.length("path") >= F.col("size"))
    begun = begun.withColumn("r_path", F.expr("substring(path, 1, size)"))
    found = sized_join(begun, known, ["r_host", "r_path"], "inner")
    rule = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(rule).alias("size"), F.length("r_host").alias("chars"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def address(url: Column) -> Column:
    """An address as a node: no fragment, scheme and host in lower case, no usual port, a path; null without ``://``."""

    def cut(plain: Column) -> Column:
        rest = F.substring(plain, F.instr(plain, "://") + 3, F.length(plain))
        return F.struct(
            lowered(F.substring_index(plain, "://", 1)).alias("scheme"),
            lowered(F.regexp_extract(rest, r"^[^/?]*", 0)).alias("host"),
            F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1).alias("after"),
        )

    def joined(x: Column) -> Column:
        usual = F.when(x["scheme"] == "http", ":80").when(x["scheme"] == "https", F.lit(":443")).otherwise("")
        host = F.when(x["host"].endswith(usual), F.left(x["host"], F.length(x["host"]) - F.length(usual))).otherwise(x["host"])
        return F.concat(x["scheme"], F.lit("://"), host, F.when(x["after"].startswith("/"), "").otherwise("/"), x["after"])

    plain = F.substring_index(url, "#", 1)
    return F.when(F.contains(plain, F.lit("://")), let(plain, lambda p: let(cut(p), joined)))


def resolved(link: Column, base: Column) -> Column:
    """A link as a URL: absolute, without a scheme, from the root, a query, or from the page's folder (no ``..``)."""
    scheme = F.substring_index(base, "://", 1)
    root = F.regexp_extract(base, r"^[^:]*://[^/?]*", 0)
    page = F.regexp_extract(base, r"(?s)^[^?]*", 0)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when((link != "") & ~link.startswith("#") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.regexp_extract(page, r"(?s)^.*/", 0), F.regexp_replace(link, r"^(?:\./)+", "")))
    )


def _unquoted(x: Column) -> Column:
    text = F.regexp_replace(x, r"""^["']|["']$""", "")
    return F.btrim(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit(" \t\n\x0b\f\r"))


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that stays one: a generator's output isn't written out again wherever it is named."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses of pages and those that they name as canonical or refresh to."""
    some = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("url"), F.regexp_extract_all(html, F.lit(TAG), F.lit(0)).alias("tags"))
    tags = _computed(some, "a", address(F.col("url"))).filter("a IS NOT NULL").select("a", F.explode("tags").alias("tag"))
    named = F.when(
        F.lower(F.substring("tag", 2, 4)) == "link", F.when(F.col("tag").rlike(CANONICAL), _unquoted(F.regexp_extract("tag", HREF, 1)))
    ).when(F.col("tag").rlike(REFRESH), _unquoted(F.regexp_extract(_unquoted(F.regexp_extract("tag", CONTENT, 1)), TARGET, 1)))
    linked = _computed(tags, "link", named).filter("link IS NOT NULL").select("a", "link")
    whole = _computed(linked, "whole", resolved(F.col("link"), F.col("a")))
    return whole.select("a", address(F.col("whole")).alias("b")).filter("b IS NOT NULL")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all, if not given) with ``_url``: host, path, rule, verdict, and what decided: rule, alias or default.

    ``rules`` has (verdict, host, path), ``redirects`` (source, target).
    """
    shelf = Shelf(pages.sparkSession)
    keep = [c for c in pages.columns if c != "_url"] if keep is None else keep
    host, path = host_and_path(F.col(url))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"), address(F.col(url)).alias("node"))
    rows = shelf.put("url-rows", rows)
    links = page_links(pages, url, html) if html else None
    if redirects is not None:
        given = redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
        links = given if links is None else links.unionByName(given)
    listed = stored_rules(rules, shelf)
    own = shelf.put("url-verdicts", fitted(rows, listed))
    asked = sized_join(rows, own.select(F.col("host").alias("f_host"), F.col("path").alias("f_path"), "rule", "verdict"), F.expr("host = f_host AND path = f_path")).drop("f_host", "f_path")
    if links is None:
        asked = asked.withColumn("passed", F.lit(None).cast("string"))
    else:
        nodes = components(links, shelf)
        node_host, node_path = host_and_path(F.col("node"))
        placed = shelf.put("url-nodes", nodes.select("node", "root", node_host.alias("host"), node_path.alias("path")))
        decided = shelf.put("url-node-verdicts", fitted(placed, listed))
        known = sized_join(placed, decided.select("host", "path", "verdict"), ["host", "path"], "inner")
        roots = shelf.put("url-roots", known.groupBy("root").agg(F.min("verdict").alias("passed")))  # allow before block
        aliases = shelf.put("url-aliases", sized_join(placed.select("node", "root"), roots, "root", "inner").select(F.col("node").alias("alias"), "passed"))
        asked = sized_join(asked, aliases, F.expr("node = alias")).drop("alias")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise(F.lit("default"))
    found = F.struct("host", "path", "rule", F.coalesce("verdict", "passed", F.lit("allow")).alias("verdict"), by.alias("decided_by"))
    return asked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], found.alias("_url"))


def allowed(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """The pages that may stay, with their columns as they came."""
    names = pages.columns
    inner = [f"p{i}" for i in range(len(names))]
    asked = pages.toDF(*inner)
    kept = judged(asked, rules, redirects, inner[names.index("url")], inner[names.index("html")] if "html" in names else None)
    return kept.filter("_url.verdict = 'allow'").select(*[F.col(i).alias(c) for i, c in zip(inner, names)])
