"""Replacements for entities: numbered labels, or strings of the same form.

Numbered types take their place in the order of first sight.  The others keep
length and form and take their characters from SHA-256 of the original, so they
need neither a number nor a look-up and are equal wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.spans import let

# Labels of numbered types.
LABELS = {
    "person": "Person_%02d",
    "bank_name": "Bank_%02d",
    "address": "Address_%02d",
    "email": "user_%02d@example.com",
    "url": "https://www.example-%02d.com",
    "contract_no": "CONTRACT-%03d",
    "invoice_no": "INV-%03d",
}
# Types whose replacement keeps its form, and the alphabets of replacements.
FORMED = ("bank_account", "iban", "phone", "china_id", "hk_id", "credit_card", "swift_code", "tax_id", "crypto_address", "tx_hash")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
HEXADECIMAL = "0123456789abcdef"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "023456789acdefghjklmnpqrstuvwxyz"


def letters(n: Column) -> Column:
    """1, 2, ... as A, ..., Z, AA, ...: base 26 without a zero."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(8)),
        F.struct(n.cast("bigint").alias("left"), F.lit("").alias("out")),
        lambda acc, _: F.when(acc["left"] <= 0, acc).otherwise(
            F.struct(
                F.floor((acc["left"] - 1) / 26).cast("bigint").alias("left"),
                F.concat(F.substring(F.lit(UPPER), ((acc["left"] - 1) % 26).cast("int") + 1, F.lit(1)), acc["out"]).alias("out"),
            )
        ),
    )
    return steps["out"]


def draws(original: Column, salt: str = "") -> Column:
    """A hexadecimal stream of 256 characters for an original."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{salt}{k}:"), original), 256) for k in range(4)])


def draw(stream: Column, place: Column, alphabet: str) -> Column:
    """One character for a place: two hexadecimal digits of the stream, modulo the alphabet."""
    value = F.conv(F.substring(stream, (place * 2 % 254).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
    return F.substring(F.lit(alphabet), value % len(alphabet) + 1, F.lit(1))


def fill(stream: Column, length: Column, alphabet: str, offset: int = 0) -> Column:
    """``length`` drawn characters."""
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: draw(stream, i + offset, alphabet)), "")
    return F.when(length > 0, made).otherwise(F.lit(""))


def same_digits(original: Column, stream: Column) -> Column:
    """Digits drawn anew, all other characters kept."""
    return F.array_join(
        F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike(r"^\d$"), draw(stream, i, DIGITS)).otherwise(c)), ""
    )


def formed(entity_type: Column, original: Column, salt: str = "") -> Column:
    """The replacement for a type in FORMED; null for others."""
    # a stream is made once for an original, not for each of its characters
    return let(F.struct(original.alias("x"), draws(original, salt).alias("s")), lambda o: _formed(entity_type, o["x"], o["s"], salt))


def _formed(entity_type: Column, x: Column, s: Column, salt: str) -> Column:
    n = F.length(x)
    compact = F.regexp_replace(x, r"(?U)\s", "")
    crypto = (
        F.when(x.startswith("0x"), F.concat(F.lit("0x"), fill(s, n - 2, HEXADECIMAL)))
        .when(x.startswith("bc1"), F.concat(F.lit("bc1"), fill(s, n - 3, BECH32)))
        .otherwise(F.concat(F.substring(x, 1, 1), fill(s, n - 1, BASE58)))
    )
    return (
        F.when(entity_type == "bank_account", F.concat(draw(s, F.lit(0), DIGITS[1:]), fill(s, n - 1, DIGITS, 1)))
        .when(entity_type == "iban", F.concat(F.substring(x, 1, 2), fill(s, F.length(compact) - 2, DIGITS)))
        .when(entity_type.isin("phone", "credit_card"), same_digits(x, s))
        .when(entity_type == "china_id", fill(s, F.lit(18), DIGITS))
        .when(entity_type == "hk_id", F.concat(F.substring(x, 1, 1), fill(s, F.lit(6), DIGITS), F.lit("("), draw(s, F.lit(6), DIGITS), F.lit(")")))
        .when(
            entity_type == "swift_code",
            F.concat(fill(s, F.lit(6), UPPER), fill(s, F.lit(2), UPPER + DIGITS, 6), F.when(n == 11, fill(s, F.lit(3), UPPER + DIGITS, 8)).otherwise(F.lit(""))),
        )
        .when(entity_type == "tax_id", fill(s, n, DIGITS + UPPER))
        .when(entity_type == "crypto_address", crypto)
        .when(entity_type == "tx_hash", F.concat(F.when(x.startswith("0x"), F.lit("0x")).otherwise(F.lit("")), F.sha2(F.concat(F.lit(f"{salt}tx"), x), 256)))
    )


def labelled(entity_type: Column, number: Column) -> Column:
    """The label of the ``number``-th entity of a numbered type."""
    out = F.format_string("[REDACTED_%s_%03d]", entity_type, number)
    for kind, label in LABELS.items():
        out = F.when(entity_type == kind, F.format_string(label, number)).otherwise(out)
    return F.when(entity_type == "company", F.concat(F.lit("Company_"), letters(number))).otherwise(out)


def replacement(entity_type: Column, original: Column, number: Column, salt: str = "") -> Column:
    return F.coalesce(formed(entity_type, original, salt), labelled(entity_type, number))
