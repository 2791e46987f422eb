import random

from maskflow.llm.similarity import JaccardRule, similar


def shingles(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, rule):
    """Links of each document's set with different sets."""
    sets = {i: frozenset(shingles(t or "", rule.words)) for i, t in texts}
    distinct = {s for s in sets.values() if s}
    links = {s: sum(1 for o in distinct if o != s and s & o and rule.den * len(s & o) >= rule.num * len(s | o)) for s in distinct}
    return {i: links.get(s, 0) for i, s in sets.items()}


def near_copies(n, words, seed):
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w[: len(w) - rng.randrange(6)]))
    return out


def test_every_link_is_counted(spark):
    texts = near_copies(60, 80, 1) + near_copies(40, 30, 2) + near_copies(5, 12, 3) + ["", None, "one two", "one two", "alone here in this text"]
    rows = list(enumerate(texts + texts[:7]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # the large components take several blocks, the small one takes one
    rule = JaccardRule(words=4, num=85, den=100, block=7)
    found = {r["doc_id"]: r["n_links"] for r in similar(df, rule).collect()}
    assert found == brute(rows, rule)
    assert max(found.values()) > 20


def test_links_of_all_sizes_of_sets(spark):
    """Sets that just link lie in size classes that follow each other."""
    base = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(base[:n])) for n in range(4, 201)]
    rule = JaccardRule(words=4, num=85, den=100, block=5)
    found = {r["doc_id"]: r["n_links"] for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string"), rule).collect()}
    assert found == brute(rows, rule)
