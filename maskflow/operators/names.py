"""Names from a language model: a hook that asks it, and a reader of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = "array<struct<text:string,type:string>>"
#: The model sees this many characters of a text; what it finds is located in all of it.
MOST_CHARACTERS = 4000


def parse_response(response: Column) -> Column:
    """The entities in an answer: JSON alone, in a fenced block, or between the outer brackets; else none."""
    text = F.trim(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(text, r"(?s)```\w*(.*?)```", 1)
    bracketed = F.regexp_extract(text, r"(?s)\[.*\]", 0)

    def read(x: Column) -> Column:
        return F.when(F.trim(x).startswith("["), F.from_json(F.trim(x), ENTITIES))

    return F.coalesce(read(text), read(fenced), read(bracketed), F.array().cast(ENTITIES))


ANSWERS = "hash bigint, length int, response string"


def _asked(recogniser: Callable[[list[str]], list[str]], texts: list[str], tries: int) -> tuple[list[str | None], list[str | None]]:
    """(answers, errors): a batch at once; if that fails, its texts one by one, each ``tries`` times at most."""

    def once(some: list[str]) -> list[str]:
        answers = recogniser(some)
        if len(answers) != len(some):
            raise ValueError(f"{len(answers)} answers to {len(some)} texts")
        return answers

    try:
        return once(texts), [None] * len(texts)
    except Exception:
        answers, errors = [], []
        for text in texts:
            answer, error = None, None
            for _ in range(tries):
                try:
                    answer, error = once([text])[0], None
                    break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            answers.append(answer)
            errors.append(error)
        return answers, errors


def ask(fragments: DataFrame, recogniser: Callable[[list[str]], list[str]], text: str = "text", answers: DataFrame | None = None, tries: int = 2) -> DataFrame:
    """``fragments`` with ``response``, the recogniser's answer to the first characters of each text, and ``error``.

    Blank texts, and those that ``answers`` (ANSWERS, from earlier runs) knows by hash and
    length, aren't asked about.  A text at which the recogniser fails has an empty answer and its error; the
    others of its batch are answered all the same.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType([*fragments.schema, StructField("response", StringType()), StructField("error", StringType())])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "")[:MOST_CHARACTERS] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            some = [k for k, t in enumerate(texts) if t.strip()]
            found, errors = ["[]"] * len(texts), [None] * len(texts)
            for k, answer, error in zip(some, *(_asked(recogniser, [texts[k] for k in some], tries) if some else ((), ()))):
                found[k], errors[k] = "[]" if answer is None else answer, error
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "response", "error"])

    if answers is None:
        return fragments.mapInArrow(run, out)
    known = answers.select(F.col("hash").alias("_hash"), F.col("length").alias("_length"), "response").dropDuplicates(["_hash", "_length"])
    keyed = fragments.withColumn("_h", _hash(text)).withColumn("_n", F.length(text))
    met = keyed.join(known, F.expr("_h = _hash AND _n = _length"), "left").drop("_h", "_n", "_hash", "_length")
    old = met.filter("response IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
    return old.unionByName(met.filter("response IS NULL").drop("response").mapInArrow(run, out))


def _hash(text: str) -> Column:
    return F.xxhash64(F.left(F.col(text), F.lit(MOST_CHARACTERS)))


def answered(asked: DataFrame, text: str = "text") -> DataFrame:
    """ANSWERS of what :func:`ask` gave, for later runs; failures are asked about again."""
    good = asked.filter(F.col("error").isNull() & F.col(text).isNotNull())
    return good.select(_hash(text).alias("hash"), F.length(text).alias("length"), "response").dropDuplicates(["hash", "length"])
