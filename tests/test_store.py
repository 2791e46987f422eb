from maskflow.operators import mapping as M
from maskflow.operators.store import Store, counts_differ, summary


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    assert store.read("mapping").count() == 0
    store.write("mapping", spark.createDataFrame([("A", "company", "Company_A", None, None)], M.MAPPING))
    salt = store.salt()
    again = Store(spark, path)
    assert again.salt() == salt and again.read("mapping").first()["replacement"] == "Company_A"
    seeds = spark.createDataFrame([("a",), ("b",), ("a",)], "seed string")
    first = {r["seed"]: r["factor"] for r in store.factors(seeds, 0.7, 1.3).collect()}
    assert len(first) == 2 and all(0.7 <= f <= 1.3 for f in first.values())
    assert first == {r["seed"]: r["factor"] for r in again.factors(seeds, 5, 6).collect()}
    store.save_keywords(["b", "a", "b"])
    assert sorted(r["keyword"] for r in again.read("keywords").collect()) == ["a", "b"]
    store.save_keywords([])
    assert again.read("keywords").count() == 0


def test_counts_and_summary(spark):
    sheets = lambda rows: spark.createDataFrame(rows, "sheet string, row int")
    before = sheets([("a", k) for k in range(100)] + [("b", 1), ("c", 1)])
    after = sheets([("a", k) for k in range(97)] + [("c", 1)])
    assert [r["sheet"] for r in counts_differ(before, after).collect()] == ["b"]
    counts = spark.createDataFrame([("f", "email", 2), ("g", "email", 1)], "file string, entity_type string, n bigint")
    errors = spark.createDataFrame([(f"{k:02d}", "x") for k in range(20)], "path string, error string")
    totals, first = summary(counts, errors)
    assert {r["entity_type"]: r["n"] for r in totals.collect()} == {"email": 3, "total": 3} and first.count() == 10


def test_what_is_written_follows_what_is_new(spark, tmp_path):
    """Appending leaves earlier files alone; a version that failed doesn't count; compaction keeps the rows."""
    store, path = Store(spark, str(tmp_path / "store")), tmp_path / "store" / "mapping"
    row = lambda k: (f"o{k}", "company", f"Company_{k}", None, None)
    store.append("mapping", spark.createDataFrame([row(k) for k in range(5000)], M.MAPPING))
    first = {f: f.stat().st_mtime_ns for f in path.glob("v1/*.parquet")}
    store.append("mapping", spark.createDataFrame([row(9000)], M.MAPPING))
    assert {f: f.stat().st_mtime_ns for f in path.glob("v1/*.parquet")} == first
    assert sum(f.stat().st_size for f in path.glob("v2/*.parquet")) < sum(f.stat().st_size for f in first) / 5
    spark.createDataFrame([row(1)], M.MAPPING).write.parquet(str(path / "v3"))  # a run that ended before it named its version
    assert Store(spark, str(tmp_path / "store")).read("mapping").count() == 5001
    store.append("mapping", spark.createDataFrame([row(9001)], M.MAPPING))
    store.compact("mapping")
    assert store.read("mapping").distinct().count() == store.read("mapping").count() == 5002
    store.append("mapping", spark.createDataFrame([row(9002)], M.MAPPING))
    assert store.read("mapping").count() == 5003


def test_recogniser_runs(spark):
    """One text that fails leaves the others answered; what was answered isn't asked about again."""
    from maskflow.operators.names import ANSWERS, answered, ask

    def first(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [f'[{{"text": "{t[:3]}", "type": "company"}}]' for t in texts]

    def second(texts):
        raise OSError("asked again")

    df = spark.createDataFrame([(k, f"t{k} " + ("bad" if k == 7 else "x" * 5000 if k == 8 else "text")) for k in range(20)] + [(99, None)], "id int, text string").coalesce(1)
    asked = ask(df, first, answers=spark.createDataFrame([], ANSWERS))
    rows = {r["id"]: r for r in asked.collect()}
    assert [k for k, r in rows.items() if r["error"]] == [7] and rows[7]["response"] == "[]" and rows[8]["response"].startswith('[{"text": "t8 "')
    again = {r["id"]: r for r in ask(df, second, answers=answered(asked)).collect()}
    assert {k for k, r in again.items() if r["error"]} == {7}
    assert all(again[k]["response"] == rows[k]["response"] for k in rows)
