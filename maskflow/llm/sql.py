"""SQL for the corpus queries that it can express."""

from __future__ import annotations

from maskflow.llm.centroids import CentroidRule
from maskflow.llm.license_texts import PHRASES
from maskflow.llm.licenses import WINDOWS, templates
from maskflow.llm.quality import RATES, QualityParams
from maskflow.llm.queries import URL_RULES
from maskflow.llm.url_filters import CANONICAL, CONTENT, HREF, REFRESH, TAG, TARGET

HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
PLAIN = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _base32(sha: str) -> str:
    """Five hexadecimal digits make four characters."""
    groups = []
    for g in range(8):
        value = " + ".join(f"(strpos('{HEX}', substr({sha}, {5 * g + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
        groups += [f"substr('{BASE32}', CAST((({value}) // {32 ** (3 - j)}) % 32 + 1 AS BIGINT), 1)" for j in range(4)]
    return " || ".join(groups)


WARC = f"""SELECT page_id, octet_length(encode(body)) AS payload_bytes, {_base32('sha')} AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
 FROM (SELECT page_id, body, sha1(body) AS sha, min(page_id) OVER (PARTITION BY body) AS first_id FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""


def _licenses(threshold: float = 0.8) -> str:
    words = f"(SELECT doc_id, text, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents)"
    places = " UNION ALL ".join(
        f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS start, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {words}) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES
    )
    rows = []
    for _, size, label, tokens, needed in templates(threshold):
        listed = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
        rows.append(f"({size}, {_q(label)}, {listed}, {needed})")
    return f"""WITH places AS ({places}),
 base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS own FROM places GROUP BY doc_id),
 templates AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(size, label, tokens, needed)),
 blocks AS (SELECT doc_id, size, list_distinct(w[beginning + 1:beginning + 2 * size]) AS b FROM (SELECT doc_id, w, size, unnest(range(0, greatest(len(w) - size, 1), size)) AS beginning FROM {words}, (SELECT unnest({list(WINDOWS)}) AS size))),
 met AS (SELECT doc_id, label, len(list_filter(tokens, lambda t: list_contains(b, t))) AS shared, len(tokens) AS n, needed FROM blocks JOIN templates USING (size) WHERE len(b) >= needed),
 found AS (SELECT doc_id, list(DISTINCT label) AS more, max(CAST(shared AS DOUBLE) / n) AS best FROM met WHERE shared >= needed GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
 FROM {words} LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


DECONTAMINATION = f"""WITH items AS (SELECT item_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
 docs AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
 grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
 met AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
 hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _quality(p: QualityParams = QualityParams()) -> str:
    e = "greatest(len(bin(v)) - 6, 0)"
    bucket = f"CAST({e} * 32 + (v >> CAST({e} AS INTEGER)) AS INTEGER)"
    step = "CAST(CASE WHEN b < 64 THEN 0 ELSE b // 32 - 1 END AS INTEGER)"
    top = f"(CAST(b - {step} * 32 + 1 AS BIGINT) << {step}) - 1"
    rates = " UNION ALL ".join(f"SELECT lang, source, {k} AS rate, {name} AS v FROM counted WHERE NOT base_failed" for k, name in enumerate(RATES))
    floors = "CASE rate " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(p.floor)) + " END"
    wide = ", ".join(f"max(CASE WHEN rate = {k} THEN most END) AS most_{k}" for k in range(len(RATES)))
    within = " AND ".join(f"coalesce({name} <= CASE WHEN o.total IS NULL THEN w.most_{k} ELSE least(o.most_{k}, {p.cap} * w.most_{k}) END, true)" for k, name in enumerate(RATES))
    return f"""WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {PLAIN}) AS w FROM documents),
 grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + {p.window - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {p.window - 2})) AS i FROM texts WHERE len(w) >= {p.window}))),
 repeated AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + {p.window})) AS q FROM grams WHERE c > 1) GROUP BY doc_id),
 lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, {PLAIN}) GROUP BY doc_id),
 plain AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(k.n, 0) AS n_lines
  FROM texts LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines k USING (doc_id)),
 counted AS (SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, word_chars * 1000 // greatest(n_words, 1) AS word_length,
  n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM plain),
 sketch AS (SELECT lang, source, rate, {bucket} AS b, count(*) AS n FROM ({rates}) GROUP BY ALL),
 merged AS (SELECT false AS whole, lang, source, rate, b, n FROM sketch UNION ALL SELECT true, NULL, NULL, rate, b, sum(n) FROM sketch GROUP BY rate, b),
 summed AS (SELECT *, sum(n) OVER (PARTITION BY whole, lang, source, rate ORDER BY b) AS seen, sum(n) OVER (PARTITION BY whole, lang, source, rate) AS total FROM merged),
 read AS (SELECT whole, lang, source, rate, max(total) AS total, min(CASE WHEN seen * 100 >= total * 50 THEN {top} END) AS middle, min(CASE WHEN seen * 100 >= total * {round(p.upper * 100)} THEN {top} END) AS upper FROM summed GROUP BY whole, lang, source, rate),
 limits AS (SELECT whole, lang, source, max(total) AS total, {wide} FROM (SELECT *, upper + {p.spread} * greatest(upper - middle, {floors}) AS most FROM read) GROUP BY whole, lang, source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
 FROM counted c LEFT JOIN (SELECT * FROM limits WHERE NOT whole AND total >= {p.min_group}) o ON c.lang IS NOT DISTINCT FROM o.lang AND c.source IS NOT DISTINCT FROM o.source LEFT JOIN (SELECT * FROM limits WHERE whole) w ON true"""


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_parts(url: str) -> str:
    rest = f"coalesce(CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) END, '')"
    host = f"regexp_extract({rest}, '^[^/?#]*')"
    return f"{_lower(host)} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def _address(url: str) -> str:
    """An address without fragment, scheme and host in lower case, without the usual port."""
    plain = f"split_part({url}, '#', 1)"
    host = f"regexp_extract(substr({plain}, strpos({plain}, '://') + 3), '^[^/?]*')"
    after = f"substr({plain}, strpos({plain}, '://') + 3 + len({host}))"
    whole = _lower(f"split_part({plain}, '://', 1) || '://' || {host}")
    named = rf"regexp_replace(regexp_replace({whole}, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1')"
    return f"CASE WHEN contains({plain}, '://') THEN {named} || CASE WHEN starts_with({after}, '/') THEN '' ELSE '/' END || {after} END"


def _unquoted(x: str) -> str:
    quotes = _q("""^["']|["']$""")
    return f"trim(replace(regexp_replace({x}, {quotes}, '', 'g'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

    def fit(source: str) -> str:
        return f"""(SELECT u.host, u.path, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(r.verdict, len(r.host || r.path)) AS verdict
 FROM (SELECT DISTINCT host, path FROM {source}) u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path)"""

    href, content = (f"regexp_extract(tag, {_q(x)}, 1)" for x in (HREF, CONTENT))
    link = f"""CASE WHEN regexp_matches(tag, '(?i)^<link') THEN CASE WHEN regexp_matches(tag, {_q(CANONICAL)}) THEN {_unquoted(href)} END
 WHEN regexp_matches(tag, {_q(REFRESH)}) THEN {_unquoted(f'regexp_extract({_unquoted(content)}, {_q(TARGET)}, 1)')} END"""
    whole = r"""CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN split_part(a, '://', 1) || ':' || link
 WHEN starts_with(link, '/') THEN regexp_extract(a, '^[^:]*://[^/?]*') || link WHEN starts_with(link, '?') THEN split_part(a, '?', 1) || link
 WHEN link <> '' AND NOT starts_with(link, '#') AND NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN regexp_extract(split_part(a, '?', 1), '^.*/') || regexp_replace(link, '^(\./)+', '') END"""
    return f"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rules}) AS t(verdict, host, path)),
 found AS MATERIALIZED (SELECT page_id, {_url_parts('url')}, {_address('url')} AS node, html FROM pages),
 tags AS (SELECT node AS a, unnest(regexp_extract_all(html, {_q(TAG)})) AS tag FROM found WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
 named AS (SELECT a, {link} AS link FROM tags), pointed AS (SELECT a, {whole} AS target FROM named),
 links AS MATERIALIZED (SELECT a, b FROM (SELECT a, {_address('target')} AS b FROM pointed) WHERE b IS NOT NULL),
 both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
 parts AS (SELECT node, other, {_url_parts('other')} FROM reach),
 passed AS (SELECT node, min(f.verdict) AS passed FROM parts JOIN {fit('parts')} f USING (host, path) GROUP BY node)
 SELECT page_id, host, path, rule, coalesce(f.verdict, passed, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN passed IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
 FROM found LEFT JOIN {fit('found')} f USING (host, path) LEFT JOIN passed USING (node)"""


def _clusters(rule: CentroidRule = CentroidRule()) -> str:
    far = f"list_sum(list_transform(range(1, {rule.dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for r in range(rule.rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': CAST({far} AS BIGINT), 'n': n}}) AS best FROM kept, centroids{r} GROUP BY vec_id)")
        if r < rule.rounds:
            steps.append(
                f"""moved{r} AS (SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS c FROM (SELECT best.n AS n, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS m
 FROM near{r}, (SELECT unnest(range(1, {rule.dims + 1})) AS i) GROUP BY best.n, i) GROUP BY n),
 centroids{r + 1} AS MATERIALIZED (SELECT o.n, coalesce(m.c, o.c) AS c FROM centroids{r} o LEFT JOIN moved{r} m ON o.n = m.n)"""
            )
    last = rule.rounds
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({rule.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {rule.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {rule.dims}),
 centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v AS c FROM (SELECT v, sha256('{rule.seed}' || vec_id) AS h FROM kept ORDER BY h LIMIT {rule.k})),
 {', '.join(steps)},
 placed AS (SELECT vec_id, best.n AS n, best.d AS d FROM near{last})
 SELECT vec_id, CAST(p.n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY p.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
 FROM placed p JOIN centroids{last} f ON p.n = f.n"""


SQL = {
    "op2_warc_bundles": WARC,
    "op4_license_scans": _licenses(),
    "op8_decontamination": DECONTAMINATION,
    "op9_quality_rules": _quality(),
    "op12_url_filters": _urls(),
    "op13_centroid_clustering": _clusters(),
}
