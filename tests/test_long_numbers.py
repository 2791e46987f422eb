import random

from pyspark.sql import functions as F

from maskflow.operators import scaling


def seventeen(v):
    """The first 17 digits of a whole double, as C prints them, and zeros."""
    if v < 1e17:
        return str(int(v))
    head, power = f"{v:.16e}".split("e+")
    return head.replace(".", "").ljust(int(power) + 1, "0")


def test_digits_of_long_numbers(spark):
    rng = random.Random(1)
    values = [1e15, 1e17, 1e22, 2.0**53, 2.0**63, 2.0**64, 1.7e308, 136229841068003264.0] + [float(int(rng.random() * 10 ** rng.randrange(15, 60) + 1e15)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scaling.long_digits(F.col("v")).alias("d"))
    assert [r["d"] for r in df.collect()] == [seventeen(v) for v in values]


def test_long_numbers_in_prose(spark):
    texts = {"a 90819894045335509 b": f"a {seventeen(90819894045335509 * 1.5)} b", "12,345,678,901,234,567.25 c": "18,518,518,351,851,852.00 c"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scaling.scale_in_text(F.col("t"), F.lit(1.5)).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == texts
