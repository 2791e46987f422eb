"""The inputs that queries build, in both dialects, and SQL for the queries' results.

The SQL engine's regular expressions know only ASCII word boundaries, so texts are
first brought to ASCII without changing their length: letters and digits beyond it
become ``_``, everything else a space.
"""

from __future__ import annotations

from maskflow.operators.dictionary import by_priority
from maskflow.operators.pseudonyms import DIGITS, FORMED, HEXADECIMAL, LABELS, UPPER
from maskflow.operators.rules import ID_CHECKS, ID_WEIGHTS, RULES
from maskflow.operators.scaling import LEAST_IN_PROSE
from maskflow.sources.html import MARKUP, NAMED

#: Rules that the documents themselves have matches for.
NATURAL = ("credit_card", "swift_code", "email", "phone", "bank_account")
KEYWORDS = [("company", "Apache License"), ("company", "MIT License"), ("company", "License"), ("person", "anthe"), ("address", "token")]


def _sha(x: str, spark: bool) -> str:
    return f"sha2({x}, 256)" if spark else f"sha256({x})"


def _text(x: str, spark: bool) -> str:
    return f"CAST({x} AS {'STRING' if spark else 'VARCHAR'})"


def _pad(x: str, n: int, spark: bool) -> str:
    return f"lpad({_text(x, spark)}, {n}, '0')"


def originals(kind: str, spark: bool, k: str = "c_custkey") -> str:
    """An original of a type, built from a key."""
    sha = _sha(_text(k, spark), spark)
    return {
        "china_id": f"'110105' || '19' || {_pad(f'{k} % 100', 2, spark)} || {_pad(f'{k} % 12 + 1', 2, spark)} || {_pad(f'{k} % 28 + 1', 2, spark)} || {_pad(f'{k} % 1000', 3, spark)} || {_text(f'{k} % 10', spark)}",
        "hk_id": f"'A' || {_pad(k, 6, spark)} || '(' || {_text(f'{k} % 10', spark)} || ')'",
        "credit_card": f"'4000-0012-' || substr({_pad(k, 8, spark)}, 1, 4) || '-' || substr({_pad(k, 8, spark)}, 5, 4)",
        "crypto_address": f"'0x' || substr({sha}, 1, 40)",
        "tx_hash": f"CASE WHEN {k} % 2 = 0 THEN '0x' || {sha} ELSE {sha} END",
        "iban": f"'GB82 WEST ' || substr({_pad(k, 8, spark)}, 1, 4) || ' ' || substr({_pad(k, 8, spark)}, 5, 4) || ' 12'",
        "swift_code": f"CASE WHEN {k} % 2 = 0 THEN 'BKCHCNBJ' ELSE 'BKCHCNBJ' || {_pad(f'{k} % 1000', 3, spark)} END",
        "phone": f"'+852 9' || {_pad(f'{k} % 1000', 3, spark)} || ' ' || {_pad(f'{k} % 10000', 4, spark)}",
        "tax_id": f"'91' || {_pad(k, 6, spark)} || 'MA' || {_pad(f'{k} % 100000000', 8, spark)}",
        "bank_account": f"'62' || {_pad(k, 11, spark)}",
    }[kind]


def built(spark: bool, k: str = "c_custkey") -> str:
    o = lambda kind: originals(kind, spark, k)
    sha = _sha(_text(k, spark), spark)
    return " || ' ; ' || ".join(
        (
            f"'id ' || {o('china_id')}",
            o("hk_id"),
            o("credit_card"),
            f"'1' || translate(substr({sha}, 1, 30), '0', '1')",
            o("crypto_address"),
            f"'T' || translate(substr({sha}, 1, 33), '0', '1')",
            o("tx_hash"),
            o("iban"),
            o("swift_code"),
            f"'Invoice No: INV' || {_pad(k, 6, spark)}",
            f"'contract no. C-' || {_pad(k, 6, spark)}",
            f"'u' || {_text(k, spark)} || '@ex-' || {_text(f'{k} % 7', spark)} || '.example.com'",
            f"'https://www.shop' || {_text(k, spark)} || '.example.com/a?b=' || {_text(k, spark)}",
            o("phone"),
            f"'138' || {_pad(f'{k} % 100000000', 8, spark)}",
            o("tax_id"),
            o("bank_account"),
            f"'year 2024, total 1,234.50'",
        )
    )


BUILT_SPARK = built(True)
ORIGINALS_SPARK = {k: originals(k, True) for k in FORMED}
_ORDER_TEXT = """'Order ' || o_orderkey || ' of customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' / CUSTOMER#' || lpad(CAST(o_custkey * 7 AS STRING), 9, '0')
 || CASE WHEN o_orderkey % 5 = 0 THEN ' Customer#1234' ELSE 'Customer#00000000' || o_orderkey % 10 END"""
ORDER_TEXT_SPARK = _ORDER_TEXT
#: A line of a keyword file for each customer.
_KEYWORD_LINE = """CASE c_custkey % 9 WHEN 0 THEN '# ' || c_name WHEN 1 THEN '   ' WHEN 2 THEN '  ' || c_name || ' ' WHEN 3 THEN '[人名] ' || c_name WHEN 4 THEN '[银行]' || c_mktsegment
 WHEN 5 THEN '[地址] ' || c_name || '号' WHEN 6 THEN '[签字] 】' || c_name WHEN 7 THEN '[人名]' ELSE '【人名】' || c_name END"""
KEYWORD_LINE_SPARK = _KEYWORD_LINE
#: An answer about each customer; its array alone is _ANSWER.
_ANSWER = """'[{"text":"' || c_name || '","type":"' || CASE WHEN c_custkey % 2 = 0 THEN 'company' ELSE 'person' END || '"}]'"""
RESPONSE_SPARK = f"""CASE c_custkey % 6 WHEN 0 THEN {_ANSWER} WHEN 1 THEN '```json\\n' || {_ANSWER} || '\\n```' WHEN 2 THEN '[]' WHEN 3 THEN 'no json about ' || c_name
 WHEN 4 THEN 'Found:\\n' || {_ANSWER} || '\\nEnd.' ELSE '<think>hm [' || c_custkey || ']</think>\\n' || {_ANSWER} END"""
CSV_CELL = """CASE p_partkey % 8 WHEN 0 THEN '1,234' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN '3.50' WHEN 3 THEN '2024'
 WHEN 4 THEN '123456789' WHEN 5 THEN 'nan' WHEN 6 THEN p_name ELSE '12345.25' END"""
_EXTENSION = """CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.xls' WHEN 3 THEN '.html' WHEN 4 THEN '.pdf' WHEN 5 THEN '.exe' ELSE '.docx' END"""
PATH_SPARK = f"""'/root/' || CASE WHEN doc_id % 50 = 0 THEN '.hidden/' ELSE '' END || source || '/' || CASE WHEN doc_id % 31 = 0 THEN '~$' ELSE '' END
 || 'f' || lpad(CAST(doc_id AS STRING), 12, '0') || {_EXTENSION}"""
_PATH = PATH_SPARK.replace("STRING", "VARCHAR")
NUMBERED = [
    ("map_company", "customer", "c_name", "c_custkey", "company"),
    ("map_person", "supplier", "s_name", "s_suppkey", "person"),
    ("map_bank", "nation", "n_name", "n_nationkey", "bank_name"),
    ("map_address", "region", "r_name", "r_regionkey", "address"),
    ("map_url", "pages", "url", "page_id", "url"),
    ("map_contract_no", "part", "p_brand", "p_partkey", "contract_no"),
    ("map_invoice_no", "part", "p_type", "p_partkey", "invoice_no"),
    ("map_other", "customer", "c_mktsegment", "c_custkey", "account_name"),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    return _quoted(p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?iu)", "(?i)"))


ASCII = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
#: Patterns without word boundaries, or for which ``_`` would be a character of a match, see the text as it is.
AS_IT_IS = ("invoice_no", "contract_no", "email", "url")


def _matches(source: str, pattern: str, text: str) -> str:
    """(doc_id, s, e, original) of every match in ``source`` (doc_id, text)."""
    return rf"""SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(s + len(h[i]) AS INTEGER) AS e, substr(text, CAST(s + 1 AS BIGINT), CAST(len(h[i]) AS BIGINT)) AS original
 FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i
   FROM (SELECT doc_id, text, regexp_extract_all(t, {pattern}) AS h, string_split_regex(t, {pattern}) AS g FROM (SELECT doc_id, text, {text} AS t FROM {source}))
   WHERE len(h) > 0))"""


DOCUMENTS = "(SELECT doc_id, source, text FROM documents)"
BUILT = f"(SELECT c_custkey AS doc_id, {built(False)} AS text FROM customer)"


def _luhn(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"""(len({digits}) >= 13 AND list_sum(list_transform(range(1, len({digits}) + 1), lambda j: CASE WHEN (len({digits}) - j) % 2 = 0 THEN CAST(substr({digits}, j, 1) AS BIGINT)
 WHEN CAST(substr({digits}, j, 1) AS BIGINT) > 4 THEN CAST(substr({digits}, j, 1) AS BIGINT) * 2 - 9 ELSE CAST(substr({digits}, j, 1) AS BIGINT) * 2 END)) % 10 = 0)"""


def _china_id(x: str) -> str:
    total = " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS BIGINT) * {w}" for i, w in enumerate(ID_WEIGHTS))
    return f"(len({x}) = 18 AND substr('{ID_CHECKS}', CAST(({total}) % 11 + 1 AS BIGINT), 1) = upper(substr({x}, 18, 1)))"


CHECKS = {"credit_card": _luhn("original"), "china_id": _china_id("original"), "iban": r"len(regexp_replace(original, '\s', '', 'g')) BETWEEN 15 AND 34"}


def _rule(k: int, source: str) -> str:
    rule = RULES[k]
    found = _matches(source, _pattern(rule.pattern), "text" if rule.name in AS_IT_IS else ASCII)
    return f"SELECT * FROM ({found}) WHERE {CHECKS[rule.name]}" if rule.name in CHECKS else found


def _fold(spans: str, first: str = "doc_id") -> str:
    """Accepted spans of (doc_id, rule_id, s, ...): by rule, then start, none overlapping one accepted before."""
    return f"""SELECT doc_id, unnest(list_filter(list_reduce(l, lambda acc, m: CASE WHEN len(list_filter(acc, lambda z: z.s < m.e AND m.s < z.e)) > 0 THEN acc ELSE list_append(acc, m) END,
 [CAST({{'rule_id': -1, 's': -1, 'e': -1, 'entity_type': '', 'original': ''}} AS STRUCT(rule_id INTEGER, s INTEGER, e INTEGER, entity_type VARCHAR, original VARCHAR))]), lambda z: z.s >= 0)) AS m
 FROM (SELECT doc_id, list({{'rule_id': CAST(rule_id AS INTEGER), 's': s, 'e': e, 'entity_type': entity_type, 'original': original}} ORDER BY rule_id, s) AS l FROM ({spans}) GROUP BY doc_id)"""


def _all_rules(source: str) -> str:
    every = " UNION ALL ".join(f"SELECT {k} AS rule_id, '{r.entity_type}' AS entity_type, doc_id, s, e, original FROM ({_rule(k, source)})" for k, r in enumerate(RULES))
    return f"SELECT doc_id, m.s AS s, m.e AS e, m.entity_type AS entity_type, m.original AS original FROM ({_fold(every)})"


def _keywords(source: str) -> str:
    every = " UNION ALL ".join(
        f"SELECT {k} AS rule_id, '{kind}' AS entity_type, doc_id, s, e, original FROM ({_matches(source, _quoted('(?i)' + word), 'text')})" for k, (kind, word) in enumerate(by_priority(KEYWORDS))
    )
    return f"SELECT doc_id, m.s AS s, m.e AS e, m.entity_type AS entity_type, m.original AS original FROM ({_fold(every)})"


def _letters(n: str) -> str:
    a = f"'{UPPER}'"
    one = f"substr({a}, CAST(({n} - 1) % 26 + 1 AS BIGINT), 1)"
    two = f"substr({a}, CAST((({n} - 27) // 26) % 26 + 1 AS BIGINT), 1)"
    three = f"substr({a}, CAST((({n} - 703) // 676) % 26 + 1 AS BIGINT), 1)"
    return f"CASE WHEN {n} <= 26 THEN {one} WHEN {n} <= 702 THEN {two} || {one} ELSE {three} || {two} || {one} END"


def _label(kind: str, n: str) -> str:
    if kind == "company":
        return f"'Company_' || {_letters(n)}"
    before, width = LABELS.get(kind, f"[REDACTED_{kind}_%03d]").split("%0")
    return f"'{before}' || CASE WHEN len(CAST({n} AS VARCHAR)) >= {width[0]} THEN CAST({n} AS VARCHAR) ELSE lpad(CAST({n} AS VARCHAR), {width[0]}, '0') END || '{width[2:]}'"


def _numbered(table: str, column: str, key: str, kind: str) -> str:
    return f"SELECT original, {_label(kind, 'n')} AS replacement FROM (SELECT {column} AS original, row_number() OVER (ORDER BY min({key})) AS n FROM {table} GROUP BY {column})"


def _stream(x: str) -> str:
    return " || ".join(f"sha256('{k}:' || {x})" for k in range(4))


def _draw(place: str, alphabet: str) -> str:
    at = f"CAST(({place}) * 2 % 254 + 1 AS BIGINT)"
    value = f"((strpos('{HEXADECIMAL}', substr(st, {at}, 1)) - 1) * 16 + strpos('{HEXADECIMAL}', substr(st, {at} + 1, 1)) - 1)"
    return f"substr('{alphabet}', CAST({value} % {len(alphabet)} + 1 AS BIGINT), 1)"


def _fill(length: str, alphabet: str, offset: int = 0) -> str:
    return f"array_to_string(list_transform(range(0, {length}), lambda i: {_draw(f'i + {offset}', alphabet)}), '')"


def _made(kind: str) -> str:
    """The replacement of ``x``, whose stream is ``st``."""
    digits = f"array_to_string(list_transform(range(0, len(x)), lambda i: CASE WHEN strpos('{DIGITS}', substr(x, i + 1, 1)) > 0 THEN {_draw('i', DIGITS)} ELSE substr(x, i + 1, 1) END), '')"
    return {
        "bank_account": f"{_draw('0', DIGITS[1:])} || {_fill('len(x) - 1', DIGITS, 1)}",
        "iban": "substr(x, 1, 2) || " + _fill("len(replace(x, ' ', '')) - 2", DIGITS),
        "phone": digits,
        "credit_card": digits,
        "china_id": _fill("18", DIGITS),
        "hk_id": f"substr(x, 1, 1) || {_fill('6', DIGITS)} || '(' || {_draw('6', DIGITS)} || ')'",
        "swift_code": f"{_fill('6', UPPER)} || {_fill('2', UPPER + DIGITS, 6)} || CASE WHEN len(x) = 11 THEN {_fill('3', UPPER + DIGITS, 8)} ELSE '' END",
        "tax_id": _fill("len(x)", DIGITS + UPPER),
        "crypto_address": f"'0x' || {_fill('len(x) - 2', HEXADECIMAL)}",
        "tx_hash": "CASE WHEN x[1:2] = '0x' THEN '0x' ELSE '' END || sha256('tx' || x)",
    }[kind]


def _formed(kind: str) -> str:
    return f"SELECT c_custkey, x AS original, {_made(kind)} AS replacement FROM (SELECT c_custkey, x, {_stream('x')} AS st FROM (SELECT c_custkey, {originals(kind, False)} AS x FROM customer))"


_EMAILS = _rule([r.name for r in RULES].index("email"), DOCUMENTS)
_EMAIL_MAP = f"""SELECT original, {_label('email', 'n')} AS replacement FROM (SELECT original, row_number() OVER (ORDER BY doc_id, s DESC) AS n
 FROM (SELECT original, doc_id, s, row_number() OVER (PARTITION BY original ORDER BY doc_id, s DESC) AS k FROM ({_EMAILS})) WHERE k = 1)"""


def _across_layers(source: str) -> str:
    """Keywords and rules: by start, then layer, each span that begins where the last kept one has ended."""
    kind = "STRUCT(layer INTEGER, s INTEGER, e INTEGER, entity_type VARCHAR, original VARCHAR)"
    return f"""SELECT doc_id, m.s AS s, m.e AS e, m.layer AS layer, m.entity_type AS entity_type, m.original AS original FROM (SELECT doc_id,
 unnest(list_filter(list_reduce(l, lambda acc, m: CASE WHEN m.s >= acc[len(acc)].e THEN list_append(acc, m) ELSE acc END,
 [CAST({{'layer': -1, 's': -1, 'e': 0, 'entity_type': '', 'original': ''}} AS {kind})]), lambda z: z.s >= 0)) AS m
 FROM (SELECT doc_id, list(CAST({{'layer': layer, 's': s, 'e': e, 'entity_type': entity_type, 'original': original}} AS {kind}) ORDER BY s, layer) AS l
 FROM (SELECT 0 AS layer, doc_id, s, e, entity_type, original FROM ({_keywords(source)}) UNION ALL SELECT 1, doc_id, s, e, entity_type, original FROM ({_all_rules(source)})) GROUP BY doc_id))"""


def _sanitized(source: str) -> str:
    label = " ".join(f"WHEN '{k}' THEN {_label(k, 'n')}" for k in ("company", *LABELS))
    form = " ".join(f"WHEN '{k}' THEN {_made(k)}" for k in FORMED)
    return f"""WITH spans AS ({_across_layers(source)}),
 firsts AS (SELECT entity_type, original, row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, s DESC) AS n
  FROM (SELECT entity_type, original, doc_id, s, row_number() OVER (PARTITION BY entity_type, original ORDER BY doc_id, s DESC) AS k FROM spans) WHERE k = 1),
 map AS (SELECT entity_type, x, CASE entity_type {form} {label} END AS replacement FROM (SELECT entity_type, original AS x, n, {_stream('original')} AS st FROM firsts)),
 cut AS (SELECT doc_id, s, e, replacement, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans JOIN map ON spans.entity_type = map.entity_type AND spans.original = map.x),
 done AS (SELECT doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(s - before AS BIGINT)) || replacement, '' ORDER BY s) AS head, max(e) AS last FROM cut JOIN {source} USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS sanitized FROM {source} LEFT JOIN done USING (doc_id)"""


def _factor(seed: str) -> str:
    sha = f"sha256({seed} || '::salt')"
    value = " + ".join(f"CAST(strpos('{HEXADECIMAL}', substr({sha}, {i + 1}, 1)) - 1 AS BIGINT) * {16 ** (7 - i)}" for i in range(8))
    return f"round(0.7::DOUBLE + (({value}) / 4294967296.0::DOUBLE) * 0.6::DOUBLE, 6)"


def _scaled(v: str, factor: str) -> str:
    product = f"({v} * {factor})"
    even = f"CASE WHEN {product} - floor({product}) = 0.5 THEN 2 * round({product} / 2) ELSE round({product}) END"
    return f"round(CAST(CASE WHEN {v} BETWEEN 2000 AND 2099 THEN {v} WHEN {v} = 0 THEN 0 ELSE {even} END AS DOUBLE), 1)"


# This engine's expressions don't look around: a mark stands on both sides of every
# character that may stand beside a number, so that numbers don't share it.  What
# comes before a number, as a currency, stays either way.
_PROSE = r"\x01(\d{1,3}(?:\x01,\x01\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?|\d+\.\d{2,})\x01"
_PRODUCT = "(CAST(replace(x, ',', '') AS DOUBLE) * 1.5::DOUBLE)"
_EVEN = f"(CASE WHEN {_PRODUCT} - floor({_PRODUCT}) = 0.5 THEN 2 * round({_PRODUCT} / 2) ELSE round({_PRODUCT}) END)"
_DIGITS = f"""CASE WHEN {_EVEN} < 1e15 THEN CAST(CAST({_EVEN} AS BIGINT) AS VARCHAR)
 ELSE rpad(replace(split_part(printf('%.16e', {_EVEN}), 'e', 1), '.', ''), CAST(split_part(printf('%.16e', {_EVEN}), 'e+', 2) AS INTEGER) + 1, '0') END"""
_STYLED = f"""CASE WHEN CAST(replace(x, ',', '') AS DOUBLE) < {LEAST_IN_PROSE} OR CAST(replace(x, ',', '') AS DOUBLE) BETWEEN 2000 AND 2099 THEN x
 ELSE (CASE WHEN contains(x, ',') THEN format('{{:,}}', CAST({_DIGITS} AS HUGEINT)) ELSE {_DIGITS} END)
 || CASE WHEN contains(x, '.') THEN '.' || repeat('0', least(len(split_part(x, '.', 2)), 10)) ELSE '' END END"""
_SCALED_TEXT = f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: replace(g[i], chr(1), '') || coalesce(out[i], '')), '') END AS scaled
 FROM (SELECT doc_id, text, g, list_transform(h, lambda x: {_STYLED}) AS out FROM (SELECT doc_id, text, string_split_regex(t, '{_PROSE}') AS g,
 list_transform(regexp_extract_all(t, '{_PROSE}', 1), lambda y: replace(y, chr(1), '')) AS h
 FROM (SELECT doc_id, text, chr(1) || regexp_replace(text, '([^.0-9])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS t FROM documents)))"""
_CELL = CSV_CELL.replace("STRING", "VARCHAR")
_MANIFEST = f"""SELECT path, substr(path, 7) AS relative, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, size FROM (SELECT {_PATH} AS path, n_chars AS size FROM documents)
 WHERE path NOT LIKE '%/.hidden/%' AND path NOT LIKE '%/~$%' AND lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.xlsx', '.xls', '.csv', '.tsv', '.txt', '.docx', '.pdf', '.html', '.htm')"""
_MARKUP = _quoted(MARKUP)
_READ = "t"
for _name, _mark in (*((n, m) for n, m in NAMED.items() if n != "amp"), ("amp", "&")):
    _READ = f"replace({_READ}, '&{_name};', {_quoted(_mark)})"
_NODES = f"""SELECT page_id, i - 1 AS frag, page_id * 1000000 + i - 1 AS doc_id, text FROM (SELECT page_id, i, {_READ} AS text FROM (SELECT page_id, g[i] AS t, i
 FROM (SELECT page_id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT page_id, string_split_regex(html, {_MARKUP}) AS g FROM pages)))) WHERE regexp_matches(text, '[^\\s]')"""
_PAGES = f"""WITH nodes AS MATERIALIZED ({_NODES}), rewritten AS ({_sanitized('nodes')}),
 parts AS (SELECT page_id, i, g[i] AS gap, coalesce(h[i], '') AS markup FROM (SELECT page_id, g, h, unnest(range(1, len(g) + 1)) AS i
  FROM (SELECT page_id, string_split_regex(html, {_MARKUP}) AS g, regexp_extract_all(html, {_MARKUP}) AS h FROM pages))),
 put AS (SELECT n.page_id, frag, replace(replace(replace(sanitized, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS own FROM nodes n JOIN rewritten USING (doc_id) WHERE sanitized <> text)
 SELECT p.page_id, string_agg(coalesce(own, gap) || markup, '' ORDER BY i) AS sanitized FROM parts p LEFT JOIN put ON put.page_id = p.page_id AND frag = i - 1 GROUP BY p.page_id"""
_CUSTOMER_MAP = f"""SELECT 'company' AS entity_type, original, replacement FROM ({_numbered('customer', 'c_name', 'c_custkey', 'company')})
 UNION ALL SELECT 'bank_name', original, replacement FROM ({_numbered('customer', 'c_mktsegment', 'c_custkey', 'bank_name')})"""
_HOLDS = " OR ".join(f"contains(lower(text), lower({_quoted(k)}))" for _, k in KEYWORDS)
_UPSERT = """WITH a AS (SELECT c_name AS original, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_name),
 b AS (SELECT c_name AS original, row_number() OVER (ORDER BY min(c_custkey)) + (SELECT count(*) FROM a) AS n FROM customer WHERE c_name NOT IN (SELECT original FROM a) GROUP BY c_name)"""

SQL: dict[str, str] = {
    **{f"spans_{r.name}": _rule(k, DOCUMENTS if r.name in NATURAL else BUILT) for k, r in enumerate(RULES)},
    "spans_resolved": _all_rules(DOCUMENTS),
    "spans_resolved_built": _all_rules(BUILT),
    "luhn_check": f"SELECT o_orderkey, number, {_luhn('number')} AS ok FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS number FROM orders)",
    "china_id_check": f"""SELECT o_orderkey, number, {_china_id('number')} AS ok FROM (SELECT o_orderkey, '11010519900101' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
 || CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE CAST(o_orderkey % 11 AS VARCHAR) END AS number FROM orders)""",
    "entity_counts_by_type": f"SELECT entity_type, count(*) AS n FROM ({_all_rules(DOCUMENTS)}) GROUP BY entity_type",
    "entity_counts_by_source": f"SELECT source, entity_type, count(*) AS n FROM ({_all_rules(DOCUMENTS)}) JOIN documents USING (doc_id) GROUP BY source, entity_type",
    "dictionary_matches": _keywords(DOCUMENTS),
    "cross_layer_resolution": _across_layers(DOCUMENTS),
    "sanitized_documents": _sanitized(DOCUMENTS),
    # what a full name leaves is searched for the short one: names overlap nowhere here
    "dictionary_table_matches": f"""WITH texts AS (SELECT o_orderkey AS doc_id, {_ORDER_TEXT.replace('STRING', 'VARCHAR')} AS text FROM orders),
 found AS (SELECT doc_id, s, substr(text, CAST(s + 1 AS BIGINT), 18) AS long, substr(text, CAST(s + 1 AS BIGINT), 15) AS short FROM (SELECT doc_id, text, unnest(range(0, len(text))) AS s FROM texts) WHERE lower(substr(text, CAST(s + 1 AS BIGINT), 9)) = 'customer#')
 SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(s + CASE WHEN w.k IS NULL THEN 15 ELSE 18 END AS INTEGER) AS e, CASE WHEN w.k IS NULL THEN 'person' ELSE 'company' END AS entity_type, CASE WHEN w.k IS NULL THEN short ELSE long END AS original
 FROM found LEFT JOIN (SELECT lower(c_name) AS k FROM customer) w ON lower(long) = w.k LEFT JOIN (SELECT DISTINCT lower(substr(c_name, 1, 15)) AS k FROM customer) p ON lower(short) = p.k WHERE w.k IS NOT NULL OR p.k IS NOT NULL""",
    "keyword_file_parse": """SELECT CASE c_custkey % 9 WHEN 3 THEN 'person' WHEN 4 THEN 'bank_name' WHEN 5 THEN 'address' WHEN 6 THEN 'person' ELSE 'company' END AS entity_type,
 CASE c_custkey % 9 WHEN 4 THEN c_mktsegment WHEN 5 THEN c_name || '号' WHEN 7 THEN '[人名]' WHEN 8 THEN '【人名】' || c_name ELSE c_name END AS keyword, CAST(c_custkey AS INTEGER) AS ord FROM customer WHERE c_custkey % 9 > 1""",
    **{name: _numbered(*rest) for name, *rest in NUMBERED},
    "map_email": _EMAIL_MAP,
    "sanitized_emails": f"""WITH spans AS ({_EMAILS}), map AS ({_EMAIL_MAP}),
 cut AS (SELECT doc_id, s, e, replacement, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans JOIN map USING (original)),
 done AS (SELECT doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(s - before AS BIGINT)) || replacement, '' ORDER BY s) AS head, max(e) AS last FROM cut JOIN documents USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS sanitized FROM documents LEFT JOIN done USING (doc_id)""",
    **{f"mask_{k}": _formed(k) for k in FORMED},
    "mapping_upsert": f"{_UPSERT} SELECT original, 'company' AS entity_type, {_label('company', 'n')} AS replacement FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "mapping_statistics": f"SELECT entity_type, count(*) AS n FROM ({_CUSTOMER_MAP}) GROUP BY entity_type UNION ALL SELECT 'total', count(*) FROM ({_CUSTOMER_MAP})",
    "mapping_report": f"SELECT CAST(1 AS INTEGER) AS section, entity_type, original, replacement, '' AS note FROM ({_CUSTOMER_MAP})",
    "scale_factors": f"SELECT seed, {_factor('seed')} AS factor FROM (SELECT DISTINCT o_orderpriority AS seed FROM orders)",
    "scale_unified": f"SELECT l_orderkey, l_linenumber, {_scaled('v', 'f')} AS scaled FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS DOUBLE) AS v, f FROM lineitem, (SELECT {_factor(chr(39) + '__global__' + chr(39))} AS f))",
    "scale_per_seed": f"SELECT o_orderkey, {_scaled('v', 'f')} AS scaled FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS v, f FROM orders JOIN (SELECT seed, {_factor('seed')} AS f FROM (SELECT DISTINCT o_orderpriority AS seed FROM orders)) ON seed = o_orderpriority)",
    "scale_text": _SCALED_TEXT,
    "scale_fractions": """SELECT p_partkey, round(CASE WHEN v = 0 THEN 0 WHEN v = floor(v) THEN round(v * 1.37::DOUBLE)
 ELSE round(v * 1.37::DOUBLE, CAST(least(greatest(2 - floor(log10(abs(v))), 0), 4) AS INTEGER)) END, 4) AS scaled
 FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) / (CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 1024 WHEN 3 THEN 16384 ELSE -131072 END) AS v FROM part)""",
    "csv_cells": f"""SELECT p_partkey, cell, CAST(CASE p_partkey % 8 WHEN 0 THEN 1234 WHEN 1 THEN p_size WHEN 2 THEN 3.5 WHEN 3 THEN 2024 WHEN 7 THEN 12345.25 END AS DOUBLE) AS number,
 CASE p_partkey % 8 WHEN 0 THEN '2,468' WHEN 1 THEN CAST(p_size * 2 AS VARCHAR) WHEN 2 THEN '7.00' WHEN 3 THEN '2024' WHEN 7 THEN '24690.00' END AS scaled
 FROM (SELECT p_partkey, p_size, {_CELL} AS cell FROM part)""",
    "excel_cell_dispatch": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'keep' ELSE 'sanitize' END
 WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_totalprice BETWEEN 2000 AND 2099 THEN 'keep' ELSE 'scale' END ELSE 'keep' END AS action FROM orders""",
    "html_text_nodes": f"SELECT page_id, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars FROM ({_NODES}) GROUP BY page_id",
    "sanitized_pages": _PAGES,
    "file_type_histogram": f"""SELECT CASE WHEN extension IN ('.xlsx', '.xls') THEN 'Excel' WHEN extension IN ('.csv', '.tsv') THEN 'CSV' WHEN extension = '.docx' THEN 'Word' WHEN extension = '.pdf' THEN 'PDF'
 WHEN extension = '.txt' THEN 'Text' ELSE 'HTML' END AS file_type, count(*) AS n FROM ({_MANIFEST}) GROUP BY file_type""",
    "folder_manifest": f"SELECT relative, extension, size, CAST(row_number() OVER (ORDER BY relative) AS INTEGER) AS file_ord FROM ({_MANIFEST})",
    "output_paths": f"SELECT relative, regexp_replace(replace(relative, 'src1', 'Company_A'), '\\.xls$', '.xlsx') AS output FROM ({_MANIFEST})",
    "response_parse": f"SELECT c_custkey, CASE WHEN c_custkey % 6 IN (2, 3) THEN '[]' ELSE {_ANSWER} END AS entities FROM customer",
    "new_keywords": "SELECT DISTINCT c_name AS keyword FROM customer WHERE c_custkey % 3 = 0",
    "indexed_documents": f"SELECT doc_id FROM documents WHERE {_HOLDS}",
    "incremental_documents": f"SELECT doc_id FROM documents WHERE text IS NULL OR {_HOLDS}",
}
