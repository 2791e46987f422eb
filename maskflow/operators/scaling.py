"""Reproducible scaling of numbers: in typed cells, in CSV cells and in prose.

A seed's factor is kept once drawn; a new one comes from SHA-256 of seed and salt,
between two limits.  One seed for everything keeps sums across tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.spans import let, scanned


# The seed of all numbers, the range that holds unless another is given, and those that a user can pick.
GLOBAL_SEED = "__global__"
DEFAULT_RANGE = (0.01, 100.0)
PRESETS = {"thirty_percent": (0.7, 1.3), "fifty_percent": (0.5, 1.5), "tenfold": (0.1, 10.0), "hundredfold": (0.01, 100.0)}


def checked_range(low: float, high: float) -> tuple[float, float]:
    """The limits if they are positive and in order, else the default."""
    return (low, high) if 0 < low < high else DEFAULT_RANGE


def drawn_factor(seed: Column, salt: str, low: float = 0.01, high: float = 100.0) -> Column:
    """The factor of a seed: uniform between the limits, six decimals."""
    low, high = min(low, high), max(low, high)
    share = F.conv(F.substring(F.sha2(F.concat(seed, F.lit(f"::{salt}")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.round(F.lit(low) + share * (high - low), 6)


def with_factors(df: DataFrame, seed: str, factors: DataFrame, salt: str, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """``df`` with ``factor``: the kept one for its seed, else the drawn one."""
    kept = factors.select(F.col("seed").alias("_seed"), F.col("factor").alias("_kept"))
    return df.join(kept, F.col(seed) == F.col("_seed"), "left").withColumn("factor", F.coalesce("_kept", drawn_factor(F.col(seed), salt, low, high))).drop("_seed", "_kept")


def is_year(v: Column) -> Column:
    return v.between(2000, 2099)


def decimals_of(v: Column) -> Column:
    """Places that a scaled fraction keeps: three significant digits, four places at most."""
    return F.least(F.greatest(2 - F.floor(F.log10(F.abs(v))), F.lit(0)), F.lit(4)).cast("int")


def scale_number(v: Column, factor: Column) -> Column:
    """Zero stays; whole numbers stay whole (half to even); others keep ``decimals_of`` places."""

    def rounded(scaled: Column) -> Column:
        places = decimals_of(v)
        out = F.bround(scaled, 4)
        for k in range(3, -1, -1):
            out = F.when(places == k, F.bround(scaled, k)).otherwise(out)
        return F.when(v == F.floor(v), F.rint(scaled)).otherwise(out)

    return F.when(v == 0, F.lit(0.0)).otherwise(let(v * factor, rounded))


#: What Python's float() reads, but for infinities and NaN, which aren't scaled.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER = rf"^\s*+[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*+$"


def csv_number(cell: Column) -> Column:
    """The number in a CSV cell, or null if it is text: long digit strings are account numbers."""
    plain = F.replace(cell, F.lit(","), F.lit(""))
    number = F.when(plain.rlike(NUMBER), F.replace(F.regexp_replace(plain, r"\s", ""), F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.contains(cell, F.lit(".")) | (F.length(F.trim(plain)) <= 8), number)


def scale_csv_cell(cell: Column, factor: Column) -> Column:
    """A numeric cell scaled in its own style; null for text cells. Years stay."""
    places = F.length(F.trim(F.substring_index(cell, ".", -1)))

    def styled(scaled: Column) -> Column:
        whole = F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("bigint")
        return (
            F.when(F.contains(cell, F.lit(".")), fixed_places(scaled, places, False))
            .when(F.contains(cell, F.lit(",")), F.format_number(whole, 0))
            .otherwise(whole.cast("string"))
        )

    def of(v: Column) -> Column:
        return F.when(v.isNull(), F.lit(None).cast("string")).when(is_year(v), cell).otherwise(let(scale_number(v, factor), styled))

    return let(csv_number(cell), of)


def fixed_places(v: Column, places: Column, grouped: bool, most: int = 10) -> Column:
    """``v`` with a number of decimals, with or without thousands separators."""
    out = F.format_number(v, most)
    for k in range(most - 1, -1, -1):
        out = F.when(places == k, F.format_number(v, k)).otherwise(out)
    return out if grouped else F.replace(out, F.lit(","), F.lit(""))


# Fixed value: number formats of dates, as substrings of the lower-cased format.
DATE_FORMATS = ("yy", "yyyy", "mm", "dd", "h:mm", "hh:mm", "ss", "am/pm", "m/d", "d/m", "y/m", "mmm", "mmmm", "ddd", "dddd")


def is_date_format(number_format: Column) -> Column:
    lowered = F.lower(number_format)
    held = F.lit(False)
    for part in DATE_FORMATS:
        held = held | F.contains(lowered, F.lit(part))
    return F.coalesce((number_format != "") & (lowered != "general") & held, F.lit(False))


def cell_action(text: str = "s") -> Column:
    """What is done with a typed cell (cell_type, ``text``, d, number_format): keep, sanitize (text) or scale."""
    kind, d = F.col("cell_type"), F.col("d")
    number = F.when(is_date_format(F.col("number_format")) | is_year(d) | F.isnan(d) | (F.abs(d) == float("inf")) | d.isNull(), "keep").otherwise("scale")
    s = F.col(text)
    of_text = F.when(s.isNull() | s.startswith("=") | (F.trim(s) == ""), "keep").otherwise("sanitize")
    return F.when(kind == "number", number).when(kind == "string", of_text).otherwise("keep")


#: From here on not every digit of a double means something, and libraries differ in those they print.
LONG = 1e15
LIMB = 1_000_000_000


def _times(limbs: Column, by: Column) -> Column:
    """A number in limbs of nine digits, the lowest first, times another of up to 2**29."""

    def step(carry: Column, limb: Column) -> Column:
        return let(limb * by + carry, lambda p: F.struct(F.call_function("div", p, F.lit(LIMB)).alias("carried"), (p % LIMB).alias("out")))

    # a limb more than needed stays zero
    return scanned(F.array_append(limbs, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"), step, "bigint")


def exact_digits(v: Column) -> Column:
    """All digits of a whole double from 2**53 on, however large."""
    e = F.greatest(F.floor(F.log2(v)).cast("int") - 53, F.lit(0))

    def multiplied(x: Column) -> Column:
        first = F.array(x["q"] % LIMB, F.call_function("div", x["q"], F.lit(LIMB)))
        turns = F.call_function("div", x["e"], F.lit(29)).cast("int")
        whole = F.aggregate(F.sequence(F.lit(0), turns), first, lambda acc, k: F.when(k == 0, acc).otherwise(_times(acc, F.lit(1 << 29).cast("bigint"))))
        limbs = _times(whole, F.call_function("shiftleft", F.lit(1).cast("bigint"), x["e"] % 29))
        return F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda l: F.lpad(l.cast("string"), 9, "0")), ""), F.lit("0"))

    # half the exponent at a time, as 2**e may be too large for a double
    q = (v / F.pow(F.lit(2.0), F.floor(e / 2)) / F.pow(F.lit(2.0), e - F.floor(e / 2))).cast("bigint")
    return let(F.struct(q.alias("q"), e.alias("e")), multiplied)


def long_digits(v: Column, meant: int = 17) -> Column:
    """A whole double from LONG on with the digits that tell it from others, rounded half to even, then zeros."""

    def rounded(d: Column) -> Column:
        head, rest = F.substring(d, 1, meant).cast("bigint"), F.substring(d, F.lit(meant + 1), F.length(d))
        half = F.rpad(F.lit("5"), F.length(rest), "0")
        up = (rest > half) | ((rest == half) & (head % 2 == 1))
        # 99...9 and one more has a digit more, which takes the place of a zero
        return F.when(F.length(d) <= meant, d).otherwise(let(head + up.cast("bigint"), lambda h: F.concat(h.cast("string"), F.repeat(F.lit("0"), F.length(d) - meant))))

    return let(exact_digits(v), rounded)


# Fixed value: numbers in prose, with an optional currency before them.
PROSE_NUMBER = r"(?U)(?<![.\d])((?:HK\$|USD|CNY|EUR|GBP|SGD|JPY|[¥$€£₩₿])\s*)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?|\d+\.\d{2,})(?![.\d])"
LEAST_IN_PROSE = 1000


def prose_replacement(hit: Column, factor: Column) -> Column:
    """The scaled form of one match of PROSE_NUMBER, or the match itself (so of more digits than a double holds)."""
    currency = F.regexp_extract(hit, PROSE_NUMBER, 1)
    number = F.regexp_extract(hit, PROSE_NUMBER, 2)
    v = F.replace(number, F.lit(","), F.lit("")).cast("double")
    places = F.when(F.contains(number, F.lit(".")), F.length(F.substring_index(number, ".", -1))).otherwise(F.lit(0))

    def styled(scaled: Column) -> Column:
        value = F.when(places > 0, scaled).otherwise(F.rint(scaled))
        zeros = F.when(places > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), F.least(places, F.lit(10))))).otherwise(F.lit(""))

        def long(digits: Column) -> Column:
            return F.concat(F.when(F.contains(number, F.lit(",")), F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", ",")).otherwise(digits), zeros)

        return F.when(value >= LONG, let(long_digits(value), long)).when(F.contains(number, F.lit(",")), fixed_places(value, places, True)).otherwise(fixed_places(value, places, False))

    return F.when(is_year(v) | (v < LEAST_IN_PROSE) | (v == float("inf")), hit).otherwise(F.concat(currency, let(scale_number(v, factor), styled)))


def scale_in_text(text: Column, factor: Column) -> Column:
    """Every number of a text that is large enough and no year, scaled in its own style."""
    pairs = F.arrays_zip(F.split(text, PROSE_NUMBER, -1).alias("gap"), F.regexp_extract_all(text, F.lit(PROSE_NUMBER), F.lit(0)).alias("hit"))
    parts = F.transform(pairs, lambda p: F.concat(p["gap"], F.when(p["hit"].isNull(), F.lit("")).otherwise(prose_replacement(p["hit"], factor))))
    return F.array_join(parts, "")


