"""Text nodes of HTML pages, in column expressions.

A page is split at its markup: scripts and styles as wholes, the two ends of
comments, and single tags, whose quoted attributes may hold ``<`` and ``>``.  What lies
between is text.  Markup is kept, so a page can be put together again with its text
nodes rewritten.

A node whose direct parent is ``code`` or ``pre`` is left alone, one deeper inside
is not.  The parent comes from a fold over the tags that keeps the open elements;
only pages with such an element need it.  What stands in a comment is searched and
stays a comment.  Character references are read before a text is searched: numbers
and the names in ``NAMED``.  A rewritten node has ``&``, ``<`` and ``>`` written as
references, a node that stays keeps its own spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.spans import is_blank, let, scanned

#: A script or style without an end goes on to the end of the page; a tag ends where the next begins.
MARKUP = r"""(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--|-->|<[a-z/!?](?:"[^"]*"|'[^']*'|[^'"<>])*>"""
#: The same for an engine that would recurse for each turn of the last group and go back into it.
_RUNS = MARKUP.replace("""(?:"[^"]*"|'[^']*'|[^'"<>])*>""", """(?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+>""")
# Elements whose own text stays, elements without content, names of characters.
SKIPPED = ("code", "pre")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "reg": "®", "euro": "€", "pound": "£", "yen": "¥", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”"}
REFERENCE = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(NAMED)});"


def _character(reference: Column) -> Column:
    """The character of a reference."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    digits = F.when(body.rlike("^#[xX]"), F.upper(F.substring(body, F.lit(3), F.length(body)))).otherwise(F.conv(F.substring(body, F.lit(2), F.length(body)), 10, 16))
    code = F.conv(digits, 16, 10).cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    numeric = F.decode(F.unhex(F.lpad(F.when(valid, digits).otherwise(F.lit("FFFD")), 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.when(body.startswith("#"), numeric).otherwise(F.element_at(names, body))


def decoded(text: Column) -> Column:
    """``text`` with its character references read."""
    pairs = F.arrays_zip(F.split(text, REFERENCE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("hit"))
    read = F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.when(p["hit"].isNull(), F.lit("")).otherwise(_character(p["hit"])))), "")
    return F.when(text.rlike(REFERENCE), read).otherwise(text)


def escaped(text: Column) -> Column:
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(reference))
    return text


def _open_elements(markup: Column) -> Column:
    """For each gap between markup whether its direct parent is one of SKIPPED."""

    def step(open_now: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))
        ends = tag.startswith("</")
        begins = ~ends & (name != "") & ~tag.endswith("/>") & ~name.isin("script", "style", *EMPTY)
        at = F.array_position(open_now, name)  # the innermost stands first
        stack = (
            F.when(begins, F.array_prepend(open_now, name))
            .when(ends & (name != "") & (at > 0), F.slice(open_now, at.cast("int") + 1, F.size(open_now)))
            .otherwise(open_now)
        )
        return let(stack, lambda s: F.struct(s.alias("carried"), F.coalesce(F.get(s, F.lit(0)).isin(*SKIPPED), F.lit(False)).alias("out")))

    after = scanned(markup, F.array().cast("array<string>"), step, "boolean")
    return F.array_prepend(after, F.lit(False))


def text_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, frag_ord, text): the nodes to search, numbered by their place among all stretches between markup."""
    gaps = F.split(html, _RUNS, -1)
    skipped = F.when(F.col(html).rlike(rf"(?i)<(?:{'|'.join(SKIPPED)})\b"), _open_elements(F.regexp_extract_all(html, F.lit(_RUNS), F.lit(0))))
    nodes = pages.select(key, F.posexplode(F.arrays_zip(gaps.alias("text"), F.coalesce(skipped, F.array().cast("array<boolean>")).alias("skipped"))).alias("frag_ord", "node"))
    open_nodes = nodes.filter(~F.coalesce("node.skipped", F.lit(False)))
    read = open_nodes.select(key, F.col("frag_ord").cast("bigint").alias("frag_ord"), decoded(F.col("node.text")).alias("text"))
    return read.filter(~is_blank(F.col("text")))


def with_nodes(pages: DataFrame, nodes: DataFrame, key: str = "page_id", html: str = "html", text: str = "sanitized", into: str = "sanitized", before: str = "text") -> DataFrame:
    """``pages`` with the text nodes put back whose text isn't what it was."""
    changed = nodes.filter(~F.col(text).eqNullSafe(F.col(before)))
    per_page = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("frag_ord").cast("int"), escaped(F.col(text))))).alias("_nodes"))
    pairs = F.arrays_zip(F.split(html, _RUNS, -1).alias("text"), F.regexp_extract_all(html, F.lit(_RUNS), F.lit(0)).alias("markup"))
    parts = F.transform(pairs, lambda p, i: F.concat(F.coalesce(F.try_element_at(F.col("_nodes"), i), p["text"]), F.coalesce(p["markup"], F.lit(""))))
    rebuilt = F.when(F.col("_nodes").isNull(), F.col(html)).otherwise(F.array_join(parts, ""))
    return pages.join(per_page, key, "left").withColumn(into, rebuilt).drop("_nodes")
