"""Spans of text as arrays of structs, in column expressions.

A span is ``struct<s:int, e:int, layer:int, rule_id:int, entity_type:string,
original:string>``, half-open, counted in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,layer:int,rule_id:int,entity_type:string,original:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Elements that a fold appends one by one; longer arrays are made of such parts.
PART = 256


def scanned(values: Column, carried: Column, step, kind: str) -> Column:
    """What ``step`` gives for each element of an array in order, as an array of ``kind``.

    ``step(carried, element)`` is a struct of ``carried``, handed on, and ``out``.
    Appending copies an array, so results are gathered in parts: the time follows the
    length, as long as it is below some millions.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, value: Column) -> Column:
        return let(step(acc["carried"], value), lambda r: F.struct(r["carried"].alias("carried"), F.array_append(acc["out"], r["out"]).alias("out")))

    def part(acc: Column, first: Column) -> Column:
        done = F.aggregate(F.slice(values, first + 1, F.lit(PART)), F.struct(acc["carried"].alias("carried"), none.alias("out")), one)
        return let(done, lambda r: F.struct(r["carried"].alias("carried"), F.array_append(acc["parts"], r["out"]).alias("parts")))

    start = F.struct(carried.alias("carried"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    parts = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1, F.lit(PART)), start, part, lambda acc: F.flatten(acc["parts"]))
    return F.when(F.size(values) > 0, parts).otherwise(none)


#: A character that no text should hold, put around matches.
MARK = "\uffff"


def search(text: Column, pattern: str, rule_id: int, entity_type: str, guard: Column | None = None) -> Column:
    """Matches of a pattern and the stretches between them by turns, a stretch first; none where ``guard`` is false.

    One pass marks the matches, and the text is cut at the marks.  A text that holds the mark itself
    is gone through twice.
    """

    def by_turns(hits: Column) -> Column:
        return F.flatten(F.transform(F.split(text, pattern, -1), lambda gap, i: F.when(i < F.size(hits), F.array(gap, F.get(hits, i))).otherwise(F.array(gap))))

    twice = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), by_turns)
    once = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(entity_type).alias("entity_type"),
        F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once).alias("parts"),
    )
    return found if guard is None else F.when(guard, found)


def found_by(searches: list[Column], layer: int) -> Column:
    """Spans of what each search found: summing the lengths of matches and stretches gives the offsets."""

    def spans(x: Column) -> Column:
        def add(at: Column, pair: Column) -> Column:
            s = at + F.length(pair["gap"])
            e = s + F.length(pair["hit"])
            span = F.struct(
                s.alias("s"), e.alias("e"), F.lit(layer).alias("layer"), x["rule_id"].alias("rule_id"), x["entity_type"].alias("entity_type"), pair["hit"].alias("original")
            )
            return F.struct(e.alias("carried"), span.alias("out"))

        hits = F.sequence(F.lit(1), F.size(x["parts"]) - 2, F.lit(2))
        pairs = F.transform(hits, lambda i: F.struct(F.get(x["parts"], i - 1).alias("gap"), F.get(x["parts"], i).alias("hit")))
        return let(pairs, lambda p: scanned(p, F.lit(0), add, SPAN))

    some = F.filter(F.array(*searches), lambda x: F.coalesce(F.size(x["parts"]) > 1, F.lit(False)))
    return F.flatten(F.transform(some, spans))


def finditer(text: Column, pattern: str, layer: int, rule_id: int, entity_type: str) -> Column:
    """Every match of a pattern that never matches the empty string."""
    return found_by([search(text, pattern, rule_id, entity_type)], layer)


def quoted(literal: Column) -> Column:
    """The pattern of a literal that is only known to the data."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def literal(text: str, ignore_case: bool) -> str:
    """The pattern of a literal."""
    return ("(?iu)" if ignore_case else "") + "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _greedy(spans: Column) -> Column:
    """Of spans in order of priority each that overlaps none accepted before it."""
    return F.aggregate(
        spans,
        no_spans(),
        lambda acc, m: F.when(F.exists(acc, lambda z: (m["s"] < z["e"]) & (m["e"] > z["s"])), acc).otherwise(F.array_append(acc, m)),
    )


def first_wins(spans: Column) -> Column:
    """Of spans in order of priority (rule_id, then start) each that overlaps none accepted before it; sorted by start.

    Spans that hang together by overlaps are resolved by themselves, so the time
    follows their number and the size of such groups.
    """

    def resolved(ordered: Column) -> Column:
        ends = scanned(ordered, F.lit(0), lambda end, m: F.struct(F.greatest(end, m["e"]).alias("carried"), F.greatest(end, m["e"]).alias("out")), "int")

        def groups(end: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["s"] >= F.get(end, i - 1)))
            return let(first, lambda f: F.flatten(F.transform(f, lambda i, k: group(F.slice(ordered, i + 1, F.coalesce(F.get(f, k + 1), F.size(ordered)) - i)))))

        return let(ends, groups)

    def group(own: Column) -> Column:
        by_priority = F.array_sort(own, lambda x, y: F.when(x["rule_id"] != y["rule_id"], x["rule_id"] - y["rule_id"]).otherwise(x["s"] - y["s"]))
        return F.when(F.size(own) == 1, own).otherwise(F.array_sort(_greedy(by_priority)))

    return let(F.array_sort(spans), lambda ordered: F.when(F.size(ordered) < 2, ordered).otherwise(resolved(ordered)))


def earliest_wins(spans: Column) -> Column:
    """Over all layers: by start, then layer, each span that begins at or after the end of the last kept one."""
    ordered = F.array_sort(
        spans,
        lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).when(x["layer"] != y["layer"], x["layer"] - y["layer"]).otherwise(x["rule_id"] - y["rule_id"]),
    )

    def step(end: Column, m: Column) -> Column:
        return F.struct(F.when(m["s"] >= end, m["e"]).otherwise(end).alias("carried"), (m["s"] >= end).alias("out"))

    def kept(o: Column) -> Column:
        return let(scanned(o, F.lit(0), step, "boolean"), lambda stays: F.filter(o, lambda m, i: F.get(stays, i)))

    return let(ordered, lambda o: F.when(F.size(o) < 2, o).otherwise(kept(o)))


def splice(text: Column, replacements: Column) -> Column:
    """``text`` with disjoint ``struct<s, e, replacement>`` put in, given in order of start.

    A text is cut into stretches of ``PART`` replacements first: finding a place
    in a text takes time that follows the place.
    """

    def end(r: Column, k: Column) -> Column:
        """Where the replacement before the one numbered k ends."""
        return F.coalesce(F.get(r, k - 1)["e"].cast("int"), F.lit(0))

    def stretch(r: Column, first: Column) -> Column:
        own = F.slice(r, first + 1, F.lit(PART))
        begin = end(r, first)

        def filled(x: Column) -> Column:
            def piece(m: Column, k: Column) -> Column:
                before = F.when(k == 0, x["begin"]).otherwise(end(x["own"], k))
                return F.concat(F.substring(x["part"], before - x["begin"] + 1, m["s"].cast("int") - before), m["replacement"])

            return F.array_join(F.transform(x["own"], piece), "")

        part = F.substring(text, begin + 1, F.element_at(own, -1)["e"].cast("int") - begin)
        return let(F.struct(own.alias("own"), begin.alias("begin"), part.alias("part")), filled)

    def done(r: Column) -> Column:
        whole = F.array_join(F.transform(F.sequence(F.lit(0), F.size(r) - 1, F.lit(PART)), lambda first: stretch(r, first)), "")
        return F.concat(whole, F.substring(text, F.element_at(r, -1)["e"].cast("int") + 1, F.length(text)))

    return F.when(F.size(replacements) > 0, let(replacements, done)).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")
