"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tests.llm.test_operators import TEXTS, prose

SCHEMA = "doc_id bigint, text string, key string, rank int, _id int, c0 int, score string, n_words string, found int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "s", "w", 4) for i, t in rows], SCHEMA)


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    s, t = [0] * 10000, [0] * 10000
    for held, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                held[b] += 1
    all_s, all_t = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)]
    scored = []
    for i, x in rows:
        n, found = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 5 * len(order) // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in scored if not r[4]]
    return sorted(ranked, key=str)


def rows():
    rng = random.Random(8)
    made = [(k, t) for k, t in enumerate(TEXTS)]
    made += [(100 + k, prose(rng.randint(1, 60), rng)) for k in range(150)]
    made += [(300 + k, made[0][1]) for k in range(120)]  # a third are copies
    return made + [(None, made[1][1]), (None, None), (7, made[7][1]), (7, made[7][1]), (500, "A b " * 30_000), (501, None), (502, "")]


TARGET = [prose(25, random.Random(k)) for k in range(12)] + [None, "", "one"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(TARGET)], "item_id bigint, text string, key string")


def columns(df):
    return sorted((tuple(r) for r in df.select("doc_id", "_importance.n_features", "_importance.weight", "_importance.score", "_importance.rank").collect()), key=str)


def test_equals_plain(spark, target):
    from maskflow.llm.importance import importance

    want = plain(rows(), TARGET)
    assert columns(importance(table(spark, rows()), target)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_drawn_documents_keep_their_columns(spark, target):
    from maskflow.llm.importance import drawn

    got = drawn(table(spark, rows()), target)
    assert got.columns == table(spark, []).columns
    texts = dict(rows())
    found = got.collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in plain(rows(), TARGET) if r[4])
    assert all(r["text"] == texts[r["doc_id"]] and r["key"] == "k" for r in found if r["doc_id"] not in (None, 7))


def test_equal_scores_go_to_smaller_ids(spark):
    """Without features only noise is left; a document that stands many times keeps a rank for each row."""
    from maskflow.llm.importance import importance

    same = [(k % 7, " ".join(["w"] * 25)) for k in range(200)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert columns(importance(table(spark, same), none)) == plain(same, [])


def test_no_rows(spark, target):
    from maskflow.llm.importance import importance

    assert importance(table(spark, []), target).collect() == []
