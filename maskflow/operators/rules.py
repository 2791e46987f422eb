"""The prioritised rules for identifiers in financial text.

A rule is a pattern, the type it stands for, and perhaps a check.  Earlier rules
win over later ones where they overlap; a match that fails its check blocks
nothing.  Patterns use Unicode classes, so a number next to a Han character isn't
at a word boundary.

The engine that runs patterns recurses for each turn of a repeated group and starts
again at each place of a run that led nowhere.  Rules for which that matters have a
second pattern, ``runs_as``, with the same matches: its loops are possessive and go
straight on, so that a text of any length and shape takes little stack and time that
follows its length.  Where a run can't begin a match anywhere, it is taken as a whole
and sorted out by ``real``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.spans import first_wins, found_by, is_blank, no_spans, search


def passes_luhn(number: Column) -> Column:
    digits = F.regexp_replace(number, r"(?U)[\s-]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


# Weights and check characters of the mainland identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def passes_china_id(number: Column) -> Column:
    total = sum((F.try_to_number(F.substring(number, i + 1, 1), F.lit("9")).cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    expected = F.substring(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))
    return (F.length(number) == 18) & F.coalesce(F.upper(F.substring(number, 18, 1)) == expected, F.lit(False))


def iban_length(number: Column) -> Column:
    return F.length(F.regexp_replace(number, r"(?U)\s", "")).between(15, 34)


@dataclass(frozen=True)
class Rule:
    name: str
    entity_type: str
    pattern: str
    check: Callable[[Column], Column] | None = None
    #: what every match of the pattern contains, cheap to look for; texts without it aren't searched
    holds: str | None = None
    #: a pattern with the same matches that is safe on any text, and those that hold no ``real``
    runs_as: str | None = None
    real: str | None = None


_LOCAL = r"[a-zA-Z0-9._%+-]"
#: A run of characters of an address that doesn't end at an ``@`` with a domain holds no address, wherever one would begin.
EMAIL_RUNS = rf"(?U)\b{_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b|\b{_LOCAL}{{64,}}+"

_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?"
#: Everything that a host may hold may also follow it, so a match ends where the run of such characters does, if any
#: label but the first begins with two letters.
URL_RUNS = rf"(?iU)(?:https?://|www\.){_LABEL}(?:\.(?![a-zA-Z]{{2}}){_LABEL})*+\.[a-zA-Z]{{2}}[/\w\-.~:/?#\[\]@!$&'()*+,;=%]*+"

_GAP = r"\)?[\s.-]?"
#: A number ends with the last run of four digits or more (five after a parenthesis); shorter runs may stand between,
#: and the first may end it with five.
_LONGER = rf"(?:(?:{_GAP}(?:\(\d{{1,4}}|\d{{1,3}})(?!\d))*+{_GAP}(?:\(\d{{5,}}+|\d{{4,}}+))"
PHONE_RUNS = rf"(?U)\+(?:\d{{5,}}+{_LONGER}*+|(?:\d{{2,4}}(?!\d)|\d(?![\d)])){_LONGER}++)"

# Patterns and types, in order of priority.
RULES: tuple[Rule, ...] = (
    Rule("china_id", "china_id", r"(?U)\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", passes_china_id, holds=r"[1-9]\p{Nd}{16}"),
    Rule("hk_id", "hk_id", r"(?U)\b[A-Z]{1,2}\d{6}\(\d\)", holds=r"[A-Z]\p{Nd}{6}\("),
    Rule("credit_card", "credit_card", r"(?U)\b(?:\d{4}[\s-]?){3,4}\d{1,4}\b", passes_luhn, holds=r"\p{Nd}{4}"),
    Rule("bitcoin", "crypto_address", r"(?U)\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-zA-HJ-NP-Z0-9]{25,62})\b", holds=r"[13][a-km-zA-HJ-NP-Z1-9]{25}|bc1[a-zA-HJ-NP-Z0-9]{25}"),
    Rule("evm", "crypto_address", r"(?U)\b0x[0-9a-fA-F]{40}\b", holds=r"0x[0-9a-fA-F]{40}"),
    Rule("tron", "crypto_address", r"(?U)\bT[a-km-zA-HJ-NP-Z1-9]{33}\b", holds=r"T[a-km-zA-HJ-NP-Z1-9]{33}"),
    Rule("tx_hash", "tx_hash", r"(?U)\b(?:0x)?[0-9a-fA-F]{64}\b", holds=r"(?<![0-9a-fA-F])[0-9a-fA-F]{64}"),
    Rule("iban", "iban", r"(?U)\b[A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?(?:[A-Z0-9]{4}[\s]?){1,7}[A-Z0-9]{1,4}\b", iban_length, holds=r"[A-Z]{2}\p{Nd}{2}"),
    Rule("swift_code", "swift_code", r"(?U)\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", holds=r"[A-Z]{6}"),
    Rule("invoice_no", "invoice_no", r"(?iU)(?:发票号[码]?|票号|Invoice[\s]?No\.?|Inv[\s]?[#.])[\s:：#]*([A-Za-z0-9\-]{6,20})", holds=r"(?iu)发票号|票号|inv"),
    Rule("contract_no", "contract_no", r"(?iU)(?:合同[编号]*|Contract[\s]?No\.?|协议[编号]*|Agreement[\s]?No\.?)[\s:：#]*([A-Za-z0-9\-]{4,30})", holds=r"(?iu)合同|协议|contract|agreement"),
    Rule("email", "email", r"(?U)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", holds=r"@", runs_as=EMAIL_RUNS, real="@"),
    Rule("url", "url", r"(?iU)(?:https?://|www\.)[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?)*(?:\.[a-zA-Z]{2,})(?:[/\w\-.~:/?#\[\]@!$&'()*+,;=%]*)?", holds=r"(?iu)https?://|www\.", runs_as=URL_RUNS),
    Rule("phone", "phone", r"(?U)(?:\+\d{1,3}[\s.-]?)(?:\(?\d{1,4}\)?[\s.-]?)*\d{4,}", holds=r"\+\p{Nd}", runs_as=PHONE_RUNS),
    Rule("china_mobile", "phone", r"(?U)\b1[3-9]\d{9}\b", holds=r"1[3-9]\p{Nd}{9}"),
    Rule("tax_id", "tax_id", r"(?U)\b[0-9A-HJ-NP-RTUW-Y]{2}\d{6}[0-9A-HJ-NP-RTUW-Y]{10}\b", holds=r"\p{Nd}{6}[0-9A-HJ-NP-RTUW-Y]{10}"),
    Rule("bank_account", "bank_account", r"(?U)\b\d{9,18}\b", holds=r"\p{Nd}{9}"),
)

def raw_matches(text: Column, rule: Rule) -> Column:
    """All matches of one rule, checked, whatever other rules find."""
    return _checked(text, [(RULES.index(rule) if rule in RULES else 0, rule)])


def find_all(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules, earlier rules first where they overlap, sorted by start."""
    return F.when(is_blank(text), no_spans()).otherwise(first_wins(_checked(text, list(enumerate(rules)))))


def _checked(text: Column, numbered: list[tuple[int, Rule]]) -> Column:
    """Matches of numbered rules that pass their rule's check."""
    found = found_by([search(text, rule.runs_as or rule.pattern, k, rule.entity_type, text.rlike(rule.holds) if rule.holds else None) for k, rule in numbered], 1)
    checks = [(k, rule) for k, rule in numbered if rule.check or rule.real]

    def passes(m: Column) -> Column:
        out = F.lit(True)
        for k, rule in checks:
            own = rule.check(m["original"]) if rule.check else F.contains(m["original"], F.lit(rule.real))
            out = F.when(m["rule_id"] == k, own).otherwise(out)
        return out

    return F.filter(found, passes) if checks else found
