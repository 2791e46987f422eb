"""The keyword index: no file that holds a keyword is missed, and files that can't aren't read."""

import os
import random

from pyspark.sql import functions as F

from maskflow.operators import folder, keyword_index
from maskflow.operators.store import Store


def test_recall_and_share(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnoßÉ字 -") for _ in range(rng.randint(3, 9)))
    texts = [(f"f{k % 150}", " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(400)] + [("f1", None), ("none", None), ("long", "xyz " * 100_000 + "needle")]
    sizes = {}
    for name, t in texts:
        sizes[name] = sizes.get(name, 0) + len((t or "").encode())
    listed = spark.createDataFrame(list(sizes.items()), "relative string, size bigint").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    fragments = spark.createDataFrame(texts, "relative string, text string").repartition(4)
    index = keyword_index.build(fragments, listed)
    index.cache()
    assert {r["relative"] for r in index.select("relative").collect()} == set(sizes)
    asked = held = 0
    for k in range(12):
        words = [t[s : s + rng.randint(3, 12)].upper().replace("SS", "ß") for _, t in rng.sample([x for x in texts[:400] if len(x[1]) > 20], 2) for s in [rng.randrange(len(t) - 15 if len(t) > 16 else 1)]]
        words = [w for w in words if len(w) >= 3] + ["NEEDLE"][: k % 2]
        low = [keyword_index.folded(w) for w in words]
        want = {name for name, t in texts if t and any(w in keyword_index.folded(t) for w in low)}
        got = {r["relative"] for r in keyword_index.candidates(index, listed, words).collect()}
        assert want <= got, words
        asked, held = asked + len(got - want), held + len(sizes) - len(want)
    assert asked < 0.1 * held
    changed = listed.withColumn("size", F.col("size") + F.when(F.col("relative") == "f7", 1).otherwise(0))
    assert {r["relative"] for r in keyword_index.candidates(index, changed, ["qwzxkvjpyw"]).collect()} == {"f7"}
    assert keyword_index.candidates(index, listed, ["qq"]).count() == len(sizes)


def test_untouched_files_are_not_read(spark, tmp_path):
    """What an untouched file now holds, under its old size and time, isn't seen; a changed file is."""
    root, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    root.mkdir()
    (root / "a [1].txt").write_text("Umbrella wrote x@y.com", encoding="utf-8")
    (root / "b.txt").write_text("nothing to find here", encoding="utf-8")
    (root / "c.csv").write_text("Umbrella,1\r\n", encoding="utf-8")
    (root / "d.html").write_text("<p>plain</p>", encoding="utf-8")
    full = folder.FolderJob(spark, store, [("company", "Acme")]).run(str(root))
    assert full.done == "full"
    before = os.stat(root / "b.txt")
    (root / "b.txt").write_text("umbrella is in here!", encoding="utf-8")
    os.utime(root / "b.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    (root / "d.html").write_text("<p>now Umbrella</p>", encoding="utf-8")
    again = folder.FolderJob(spark, store, [("company", "Acme"), ("company", "umbrella")]).run(str(root), incremental=True)
    assert again.done == "incremental"
    assert {os.path.basename(r["output"]) for r in again.written.collect()} == {"a [1].txt", "c.csv", "d.html"}
    out = tmp_path / ("in" + folder.OUTPUT_SUFFIX)
    assert "Company_A wrote" in (out / "a [1].txt").read_text(encoding="utf-8") and "nothing" in (out / "b.txt").read_text(encoding="utf-8")
    assert (out / "d.html").read_text(encoding="utf-8") == "<p>now Company_A</p>"
    third = folder.FolderJob(spark, store, [("company", "Acme"), ("company", "umbrella"), ("company", "zebra")]).run(str(root), incremental=True)
    assert third.done == "nothing affected"
