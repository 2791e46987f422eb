import re

from pyspark.sql import functions as F

from maskflow.operators import mapping as M
from maskflow.operators.pseudonyms import BECH32
from maskflow.operators.resolve import detect_each


def test_a_key_that_begins_as_a_bitcoin_address_keeps_that_form(spark):
    """As the reference does; the SQL of ``sanitized_documents`` makes every address ``0x`` and hexadecimal digits."""
    address, iban = "bc1" + "2ce3dc53e28434ec238b393cc046b2ca74df8", "BE65F3BBF8A1\nB9EFFB5EDB14"
    texts = spark.createDataFrame([(1, f"key {address} end"), (2, iban), (3, f"key 0x{'a1' * 20} end")], "doc_id bigint, text string")
    detected = detect_each(texts)
    spans = M.held_spans(detected, "doc_id")
    mapping = M.upsert(M.first_seen(spans, ["doc_id"]), M.empty_mapping(spark), created_at="2000-01-01 00:00:00")
    out = {r["doc_id"]: r["sanitized"] for r in M.rewrite(detected.drop("spans"), spans, mapping, ["doc_id"]).select("doc_id", "sanitized").collect()}
    assert re.fullmatch(rf"key bc1[{BECH32}]{{37}} end", out[1]) and address not in out[1]
    # white space of every kind leaves an IBAN
    assert re.fullmatch(r"BE\d{22}", out[2])
    assert re.fullmatch(r"key 0x[0-9a-f]{40} end", out[3]) and out[3] != f"key 0x{'a1' * 20} end"
    assert spans.filter(F.col("entity_type") == "crypto_address").count() == 2
