"""URL rules, links found in pages, and decisions that reach aliases, against brute force and SQL."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, html string, host int, verdict string, c0 int, node string, rule string"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "WWW.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "b.example.org", ""), ("allow", "b.example.org", "/ok"), ("allow", "twice.org", "/"), ("block", "twice.org", "/")]


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2, "y", "z") for i, u, h in rows], SCHEMA)


def rules(spark, listed=RULES):
    return spark.createDataFrame(listed, "verdict string, host string, path string")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return lower(host), rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def fits(url, listed=RULES):
    host, path = parts(url)
    found = [(len(h + p), v == "allow", v, lower(h) + p) for v, h, p in listed if host and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)]
    return (max(found)[3], max(found)[2]) if found else (None, None)


def judge(rows, edges):
    """{row: (host, path, rule, verdict)} by walking all aliases."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for i, url, node in rows:
        rule, verdict = fits(url)
        seen, todo = {node}, [node]
        while todo:
            for n in near.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        told = {fits(n)[1] for n in seen} - {None}
        out.append((i, *parts(url), rule, verdict or ("allow" if "allow" in told or not told else "block")))
    return sorted(out, key=str)


def canonical(x):
    return f"<html><head><link href='{x}' rel=canonical></head>"


ROWS = [
    (1, "http://a.org/1", canonical("http://x.net/es/1")),
    (2, "http://a.org/2", canonical("/1")),
    (3, "HTTP://A.org:80/3#top", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=http://a.org/2">'),
    (4, "http://free.org/4", canonical("http://www.example.com/en/4")),
    (5, "http://free.org/5", canonical("4")),
    (6, "http://shop.example.com/en/6", canonical("http://www.example.com/en/4")),
    (7, "https://lone.org/7", '<link rel="stylesheet" href="http://x.net/es/1"><meta charset=utf-8>'),
    (8, "https://www.Example.com/en/8?x=1#y", None),
    (9, "https://deep.www.example.com/de/9", ""),
    (10, "http://example.com", None),
    (11, "http://notexample.com/en/", None),
    (12, "http://b.example.org/o", None),
    (13, "http://b.example.org/okay", None),
    (14, "ftp://c.net/es", None),
    (15, "c.net/es/1", None),
    (16, None, canonical("http://x.net/es/1")),
    (17, "http://twice.org/", None),
    (None, "http://a.org/2", None),
    (1, "http://a.org/1", canonical("http://x.net/es/1")),
    (18, "http://host.only", canonical("//x.net/fr/2")),
    (19, "http://self.org/19", canonical("#part") + canonical("mailto:a@b.c") + canonical("")),
    (20, "http://query.org/p?a=1", canonical("?a=2")),
    (21, "http://query.org/p?a=2", canonical("http://x.net/es/q")),
    (22, "x" * 200_000 + "://" + "l." * 50_000 + "net/es/" + "y" * 200_000, "<link " * 100_000 + canonical("http://x.net/es/1")),
]
EDGES = [
    ("http://a.org/1", "http://x.net/es/1"),
    ("http://a.org/2", "http://a.org/1"),
    ("http://a.org/3", "http://a.org/2"),
    ("http://free.org/4", "http://www.example.com/en/4"),
    ("http://free.org/5", "http://free.org/4"),
    ("http://shop.example.com/en/6", "http://www.example.com/en/4"),
    ("http://host.only/", "http://x.net/fr/2"),
    ("http://query.org/p?a=1", "http://query.org/p?a=2"),
    ("http://query.org/p?a=2", "http://x.net/es/q"),
]


def node(url):
    return None if url is None else {"HTTP://A.org:80/3#top": "http://a.org/3", "http://host.only": "http://host.only/"}.get(url, url)


def columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict").collect()), key=str)


def test_rules_and_aliases(spark):
    from maskflow.llm.url_filters import allowed, judged

    want = judge([(i, u, node(u)) for i, u, _ in ROWS], [*EDGES, (node(ROWS[-1][1]), "http://x.net/es/1")])
    assert columns(judged(table(spark, ROWS), rules(spark))) == want
    kept = allowed(table(spark, ROWS), rules(spark))
    assert kept.columns == table(spark, ROWS).columns
    assert sorted(str(r["page_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[4] == "allow")


def test_redirects_from_a_table(spark):
    """Long chains and a star, with decisions at their ends; without html."""
    from maskflow.llm.url_filters import judged

    rng = random.Random(4)
    urls = [f"http://h{k}.org/p" for k in range(300)] + ["http://bad.net/es/x", "http://good.com/", "http://worse.net/fr/y"]
    edges = [(urls[k], urls[k + 1]) for k in range(60)] + [(urls[60], "http://bad.net/es/x")]
    edges += [(urls[k], urls[100]) for k in range(101, 200)] + [(urls[100], "http://good.com/"), (urls[150], "http://worse.net/fr/y")]
    edges += [(rng.choice(urls[200:300]), rng.choice(urls[200:300])) for _ in range(60)] + [(urls[250], "http://worse.net/fr/y")] * 2
    rows = [(k, u, None) for k, u in enumerate(urls)]
    redirects = spark.createDataFrame([*edges, (None, "http://a.org/"), ("nothing", "http://a.org/")], "source string, target string")
    got = columns(judged(table(spark, rows), rules(spark), redirects, html=None))
    assert got == judge([(i, u, u) for i, u, _ in rows], edges)


def test_many_rules(spark):
    """Thousands of rules, many for one host, joined and not broadcast."""
    from maskflow.llm import shared, url_filters

    rng = random.Random(5)
    hosts = ["big.com", "x.big.com", "a.b.c.org", "org", "net"]
    listed = [(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 7)))) for _ in range(3000)]
    listed = sorted({(h, p): (v, h, p) for v, h, p in sorted(listed, reverse=True)}.values())
    rows = [(k, f"http://{rng.choice(['', 'y.', 'y.x.'])}{rng.choice(hosts)}/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))), None) for k in range(400)]
    rows += [(1000 + k, "http://y.x.big.com/aa", None) for k in range(300)]
    got = columns(url_filters.judged(table(spark, rows), rules(spark, listed), html=None))
    want = sorted(((i, *parts(u), fits(u, listed)[0], fits(u, listed)[1] or "allow") for i, u, _ in rows), key=str)
    assert got == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shared, "stored_bytes", lambda df: 1 << 40)
        assert columns(url_filters.judged(table(spark, rows), rules(spark, listed), html=None)) == want


def test_no_rows(spark):
    from maskflow.llm.url_filters import judged

    assert judged(table(spark, []), rules(spark)).collect() == []
    got = judged(table(spark, ROWS), rules(spark, [])).select("_url.verdict", "_url.rule").distinct().collect()
    assert [tuple(r) for r in got] == [("allow", None)]


def test_sql_agrees(spark, tmp_path):
    from maskflow.llm.queries import op12_url_filters
    from maskflow.llm.sql import SQL

    pages = table(spark, [r for r in ROWS if r[0] not in (None, 1, 22)] + [ROWS[0]]).select("page_id", "url", "html")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(SQL["op12_url_filters"])
    names = [d[0] for d in cursor.description]
    want = sorted((dict(zip(names, r)) for r in cursor.fetchall()), key=str)
    got = sorted((dict(zip(names, (r[n] for n in names))) for r in op12_url_filters(spark, str(tmp_path)).collect()), key=str)
    assert got == want
    assert {r["decided_by"] for r in got} == {"rule", "alias", "default"}
