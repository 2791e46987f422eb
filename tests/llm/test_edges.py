"""Every operator and the pipeline on odd tables: null ids, repeated rows, very long texts, clashing columns, no rows."""

import importlib.util
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose

#: Names that operators use inside, and results of theirs.
CLASHES = (
    "_quality _pieces _q_text _q_words c0 c1 c5 q_lang q_source s_lang s_source s_own s_all words blocks row own spans kind shard doc mark starts ends ids n_pieces round_trip n held_out "
    "component_id class_id _dropped _c0 _c1 k0 items found base places tokens size number part word edges piece start len key label matched score kept redacted payload sha first_id copies frame offset"
).split()
N_LONG = 1_000_000


def long_text():
    rng = random.Random(17)
    words = prose(2000, rng)
    return (words + "\n") * (N_LONG // len(words)) + "x" * 40_000


def rows():
    rng = random.Random(11)
    a, b, c = (prose(60, rng) for _ in range(3))
    return [(1, a), (1, a), (None, a), (None, a), (None, None), (5, None), (6, ""), (7, long_text()), (8, b), (8, c), (None, b + " " + c), (9, " \n\t ")]


def odd(spark):
    """The rows with a text column for n_chars and all clashing names."""
    df = spark.createDataFrame(rows(), "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    df = df.withColumn("n_chars", F.lit("many"))
    return df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)])


def pages(df):
    return df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))


def bench(spark):
    return spark.createDataFrame([(1, prose(20, random.Random(1))), (None, None)], "item_id bigint, text string").withColumn("spans", F.lit(1))


def run(spark, name, df):
    if name == "1":
        from maskflow.llm.token_counts import token_counts

        return token_counts(df)
    if name == "2":
        from maskflow.llm.warc import read_records, write_bundles

        return read_records(spark, write_bundles(pages(df)))
    if name == "3":
        from maskflow.llm.similarity import similar

        return similar(df)
    if name == "4":
        from maskflow.llm.licenses import scan

        return scan(df)
    if name == "5":
        from maskflow.llm.repeats import repeats

        return repeats(df)
    if name == "6":
        from maskflow.llm.encoding import encode

        return encode(df)
    if name == "7":
        from maskflow.llm.secrets import scan

        return scan(df)
    if name == "8":
        from maskflow.llm.decontaminate import contamination

        return contamination(df, bench(spark))
    if name == "9":
        from maskflow.llm.quality import judged

        return judged(df)
    from maskflow.llm.kneser_ney import score

    return score(df)


@pytest.mark.parametrize("name", [str(k) for k in range(1, 11)])
def test_odd_rows(spark, name):
    """A result for each row, equal ones for equal rows; no rows, no results."""
    out = run(spark, name, odd(spark))
    key = "page_id" if name == "2" else "doc_id"
    got = [r.asDict(True) for r in out.collect()]
    ids = lambda found: sorted(str(x) for x in found)
    assert ids(r[key] for r in got) == ids(i for i, _ in rows())
    ones = [r for r in got if r[key] == 1]
    for r in ones:
        for place in ("bundle", "record_id", "frame", "offset"):
            r.pop(place, None)
    assert ones[0] == ones[1]
    assert run(spark, name, odd(spark).limit(0)).count() == 0


def test_filters_keep_columns(spark):
    from maskflow.llm.decontaminate import remove_contaminated
    from maskflow.llm.quality import keep_good
    from maskflow.llm.secrets import redact
    from maskflow.llm.similarity import keep_one

    df = odd(spark)
    for kept in (keep_good(df), keep_one(df), remove_contaminated(df, bench(spark)), redact(df)):
        assert kept.columns == df.columns and kept.dtypes == df.dtypes
        found = kept.collect()
        assert found and all(tuple(r[c] for c in CLASHES) == tuple(range(len(CLASHES))) and r["n_chars"] == "many" for r in found)
    assert sum(r["doc_id"] is None for r in keep_one(df).collect()) == 4  # rows without an id stay


def test_repeats_of_rows_with_equal_or_no_ids(spark):
    """Equal ids with different texts, and null ids, are texts of their own; a null id comes last."""
    from maskflow.llm.repeats import repeats

    passage = prose(50, random.Random(3))
    texts = [(4, "first " + passage), (4, "second one " + passage), (None, "third " + passage), (None, passage + " end")]
    got = repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    whole = [r for r in got if r["n_removed"] == 0]
    assert len(got) == 4 and len(whole) == 1 and whole[0]["doc_id"] == 4
    assert all(r["n_spans"] == 1 and r["n_removed"] >= len(passage.encode()) for r in got if r is not whole[0])


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path))
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0
    odd(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def twins(n):
    """Two words of n bytes that a polynomial hash modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 8192])
def test_long_words_of_like_hashes(spark, n):
    from maskflow.llm.encoding import decode_ids, encode
    from maskflow.llm.kneser_ney import score
    from maskflow.llm.similarity import JaccardRule, similar

    a, b = twins(n)
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 7 != 2][:1] + [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    df = spark.createDataFrame([(ids[0], a), (ids[1], b)], "doc_id bigint, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in similar(df, JaccardRule(4, 85)).collect()} == {i: i for i in ids}
    assert {r["doc_id"]: r["n_known"] for r in score(df).collect()} == {ids[0]: 2, ids[1]: 1}
    assert {r["decoded"] for r in decode_ids(encode(df).select("doc_id", "_pieces.ids")).collect()} == {a, b}


def test_hot_rows(spark):
    """A third of all rows under one key: results as for any other key."""
    from maskflow.llm.quality import judged
    from maskflow.llm.similarity import JaccardRule, similar

    rng = random.Random(21)
    base = prose(80, rng).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(10, 70)]
    texts = [prose(60, rng) for _ in range(120)] + near
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") < 120, "a").otherwise("b"))
    got = {r["doc_id"]: r["component_id"] for r in similar(df, JaccardRule(4, 80)).collect()}
    assert {got[i] for i in range(120, 180)} == {120} and all(got[i] == i for i in range(120))
    assert judged(df).filter("_quality.kept").count() == 180


def test_scratch_is_deleted(spark):
    from maskflow.llm.shared import clean_up, shared_dir
    from maskflow.llm.similarity import similar

    clean_up(spark)
    folders = lambda: [f.getPath().getName() for f in _listed(spark, shared_dir(spark))]
    before = set(folders())
    out = similar(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string"))
    assert out.count() == 2
    # what the result still reads stays until it is written
    assert {name.split("-")[0] for name in set(folders()) - before} == {"signatures", "placed"}
    clean_up(spark)
    assert set(folders()) == before


def _listed(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)


def test_novelty_tells_keys_from_identifiers(spark):
    """Held-out accuracy: random keys and names made of words, both near sensitive words and outside the base patterns."""
    import string

    from maskflow.llm.secrets import scan

    rng = random.Random(31)
    parts = "customer invoice payment ledger session request handler account balance report factory service gateway buffer channel monitor".split()
    lead = ("the private part is ", "her signature reads ", "a bearer of ", "this credential, ")
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(22, 40))) for _ in range(150)]
    names = ["_".join(rng.choice(parts) for _ in range(4)) + f"_{rng.randrange(10)}" for _ in range(150)]
    own = [f"{prose(20, rng)} {' '.join(rng.sample(parts, 6))} {rng.choice(lead)}{x} {' '.join(rng.sample(parts, 6))}" for x in keys + names]
    rows = {r["doc_id"]: r["found"] for r in scan(spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")).collect()}
    caught = sum(any(own[i][m["start"] : m["end"]] == keys[i] for m in rows[i]) for i in range(150))
    wrong = sum(bool(rows[i]) for i in range(150, 300))
    assert caught >= 145 and wrong <= 8, (caught, wrong)


def test_novelty_with_and_without_digits(spark):
    """Keys of every alphabet are found near a sensitive word and 150 characters from it; names put together from words mostly aren't."""
    import string

    from maskflow.llm.secrets import scan

    rng = random.Random(31)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_uppercase]
    filler = " it is kept here and used by all of the other parts of it" * 3
    words = "user account session manager factory handler default config service request builder context provider stream reader writer customer address payment gateway".split()

    def text(own, k):
        return f"The service reads its settings. The private key{filler[: (0, 60, 150)[k % 3]]} {own} and then it starts."

    keys = ["".join(rng.choice(alphabets[k % 5]) for _ in range((16, 20, 28, 40)[k % 4])) for k in range(300)]
    names = [(("".join, str.title), ("_".join, str))[k % 2] for k in range(200)]
    names = [join(change(rng.choice(words)) for _ in range(4)) for join, change in names]
    rows = {r["doc_id"]: [(m["start"], m["end"]) for m in r["found"]] for r in scan(spark.createDataFrame([(k, text(x, k)) for k, x in enumerate(keys + names)], "doc_id bigint, text string")).collect()}
    caught = [(text(x, k).index(x), text(x, k).index(x) + len(x)) in rows[k] for k, x in enumerate(keys)]
    assert all(sum(caught[a::5]) >= 0.9 * len(caught[a::5]) for a in range(5))
    assert sum(bool(rows[300 + k]) for k in range(200)) <= 60
