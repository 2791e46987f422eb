"""Secret scans: three fixed patterns, and dictionary-primed zstandard novelty.

The patterns give the base spans.  The method then looks at strings of key
characters, 16 or more and a letter among them, that begin within reach of a sensitive
word and aren't in a base span.
Each is compressed after its surroundings, with a dictionary; the bytes it adds, in
proportion to its length, are its novelty.  The dictionary holds code idioms and
the words of identifiers that stand most often near sensitive words in the whole table:
tasks count them, Spark adds the counts up and the first ``identifiers`` of them,
a bounded list, go to every worker.  Identifiers are runs of letters and underscores
alone and their words are short, so a key that is copied into many documents doesn't
come to be known by it.
Copies of it and other candidates are blanked out of the surroundings.  A string
that is novel at one place is reported wherever the text has it.
Words and identifiers compress well against them, random keys don't, and those
that stay incompressible are reported as ``novel``.

Offsets count code points.  Whole texts are scanned; ``before`` and ``after`` bound
what the compressor sees of a candidate's surroundings.  Defined results: null and
empty texts have no spans; repeated rows each get their own result; an empty
table gives an empty table; other columns pass through :func:`redact` and aren't
read by :func:`scan`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.llm.shared import whole_number

# The three base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as runs of any length, of which the short ones are dropped

SENSITIVE = re.compile(r"(?:secret|passwd|password|passphrase|credential|private|bearer|authori[sz]ation|api.?key|access.?key|token|signature)", re.IGNORECASE | re.ASCII)
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CANDIDATE)

#: Raw content that primes the compressor: code idioms and common identifiers.
PRIMER = "\n".join(
    (
        "import os sys json re time logging argparse subprocess collections itertools functools typing dataclasses pathlib",
        "def __init__(self, config, client, session, request, response, options=None, timeout=30, **kwargs): return None",
        "public static final private protected void String boolean int long double class interface extends implements",
        "const let var function async await export default module require process env window document prototype",
        "select from where group by order by insert into values update set delete create table primary key not null",
        "https://www.example.com/api/v1/users/items?page=1&limit=100 application/json content-type accept user-agent",
        "authorization bearer access_token refresh_token client_id client_secret api_key private_key public_key password username",
        "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_URL REDIS_URL SECRET_KEY CONNECTION_STRING ENVIRONMENT",
        "configuration authentication authorization initialization implementation documentation specification representation",
        "the and for that with this from have are was were been their there which would could should about after before",
        "begin certificate end certificate begin rsa private key end rsa private key ssh-rsa ssh-ed25519 localhost 127.0.0.1",
    )
).encode()


@dataclass(frozen=True)
class NoveltyRule:
    """``reach`` characters lie between a sensitive word and a candidate at most; ``identifiers`` of the table prime the compressor.

    A candidate is novel from a share of ``least`` on, without digits from ``least_letters`` on: words
    that the dictionary doesn't know are put together into names.  Digits alone are numbers.
    """

    reach: int = 200
    before: int = 400
    after: int = 200
    least: float = 0.68
    least_letters: float = 0.85
    #: of compression: lower ones change their way of coding with a few bytes more or less, which hides a key's own
    level: int = 15
    identifiers: int = 2000


#: Whole runs only: a key's letters between its digits aren't one.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{4,80}(?![A-Za-z0-9+/_=-])")
#: The words of an identifier, shorter than a candidate: a key of letters alone has none, or short ones.
PARTS = re.compile(r"(?<![a-z])[A-Z]?[a-z]{3,14}(?![a-z])|(?<![A-Za-z])[A-Z]{4,15}(?![A-Za-z])")
#: Distinct identifiers that a task counts before it passes them on.
COUNTED = 100_000


def identifiers(docs: DataFrame, rule: NoveltyRule) -> list[str]:
    """The most frequent words of identifiers near sensitive words, over all texts; ties by name."""

    def count(batches):
        import pyarrow as pa

        def counted(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = 0
                for m in SENSITIVE.finditer(text or ""):
                    # each stretch once
                    b, e = max(at, m.start() - rule.before), m.end() + rule.reach + rule.after
                    if b < e:
                        found.update(x for run in IDENTIFIER.findall(text, b, e) for x in PARTS.findall(run))
                        at = e
                if len(found) >= COUNTED:
                    yield counted(found)
                    found = Counter()
        yield counted(found)

    counts = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # a dictionary of a fixed size
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(rule.identifiers).collect()]


class Places:
    """Disjoint spans, in order, to look up others in."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k < len(self.starts) and self.starts[k] < e

    def holds(self, s: int, e: int) -> bool:
        k = bisect_right(self.starts, s) - 1
        return k >= 0 and e <= self.ends[k]


class Novelty:
    """Marginal compressed bytes of a string, given its surroundings and the primer."""

    def __init__(self, rule: NoveltyRule, known: list[str] = ()):
        import zstandard

        self.rule = rule
        # what stands last is the nearest
        content = "\n".join([*reversed(known), ""]).encode() + PRIMER
        primer = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=rule.level)
        self.compressor = zstandard.ZstdCompressor(level=rule.level, dict_data=primer, write_content_size=False, write_dict_id=False)

    def share(self, text: str, start: int, end: int, others: list[tuple[int, int]] = ()) -> float:
        """Novelty of a candidate; its copies and ``others`` in its surroundings are blanked out."""
        rule, own = self.rule, text[start:end]
        low, high = max(0, start - rule.before - len(own)), end + rule.after + len(own)  # copies that reach over the edge are whole
        near = text[low:high]
        for s, e in others:
            s, e = max(s, low) - low, min(e, high) - low
            if s < e and s != start - low:
                near = near[:s] + " " * (e - s) + near[e:]
        before, after = near[: start - low], near[end - low :]
        blank = " " * len(own)
        before, after = before.replace(own, blank), after.replace(own, blank)
        around = (before[max(0, len(before) - rule.before) :] + after[: rule.after]).encode()
        return (len(self.compressor.compress(around + own.encode())) - len(self.compressor.compress(around))) / len(own.encode())

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Strings of key characters that begin within reach of a sensitive word, in order."""
        found, end_before = [], 0
        for word in SENSITIVE.finditer(text):
            # each looked at once
            for m in CANDIDATE.finditer(text, max(word.end(), end_before), word.end() + self.rule.reach + 4096):
                if m.start() > word.end() + self.rule.reach:
                    break
                s, e = m.span()
                while e < len(text) and CANDIDATE_CHARACTER(text[e]):
                    e += 1
                end_before = e
                found.append((s, e))
        return found

    def spans(self, text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places of the candidates that are novel anywhere; one decision for each distinct string."""
        taken = Places(base)
        found = [c for c in self.candidates(text) if LETTER(text, *c)]
        starts = [s for s, _ in found]
        reach = max((e - s for s, e in found), default=0)
        novel: set[str] = set()
        for s, e in found:
            own = text[s:e]
            if own in novel or taken.meets(s, e):
                continue
            low, high = s - self.rule.before - len(own), e + self.rule.after + len(own)
            others = found[bisect_left(starts, low - reach) : bisect_left(starts, high)]
            if self.share(text, s, e, others) >= (self.rule.least if DIGIT(text, s, e) else self.rule.least_letters):
                novel.add(own)
        return self._places(text, novel, taken) if novel else []

    @staticmethod
    def _places(text: str, novel: set[str], taken: Places) -> list[tuple[int, int]]:
        """Where novel strings stand in runs of key characters, without places inside another or inside a base span."""
        by_head: dict[str, list[str]] = {}
        for own in sorted(novel, key=len, reverse=True):
            by_head.setdefault(own[:LEAST_CANDIDATE], []).append(own)
        places, end_before = [], 0
        for run in CANDIDATE.finditer(text):
            for s in range(run.start(), run.end() - LEAST_CANDIDATE + 1):
                own = next((x for x in by_head.get(text[s : s + LEAST_CANDIDATE], ()) if text.startswith(x, s)), None)
                if own is not None and s + len(own) > end_before:
                    end_before = s + len(own)
                    if not taken.holds(s, end_before):
                        places.append((s, end_before))
        return places


LETTER = re.compile(r"[A-Za-z]").search
DIGIT = re.compile(r"[0-9]").search
CANDIDATE_CHARACTER = re.compile(r"[A-Za-z0-9+/_=-]").match


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            found.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _finder(rule: NoveltyRule, known: list[str]):
    novelty = None

    def all_spans(text: str | None) -> tuple[list, list]:
        nonlocal novelty
        if novelty is None:
            novelty = Novelty(rule, known)
        if not text:
            return [], []
        base = base_spans(text)
        more = novelty.spans(text, [(s, e) for s, _, e in base])
        return base, sorted(base + [(s, 3, e) for s, e in more])

    return all_spans


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, rule: NoveltyRule = NoveltyRule()) -> DataFrame:
    """doc_id, base (joined base spans), spans (joined, all), found (array of kind, start, end)."""
    out = T.StructType(
        [docs.schema["doc_id"], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", SPAN)]
    )

    known = docs.sparkSession.sparkContext.broadcast(identifiers(docs, rule))

    def run(batches):
        import pyarrow as pa

        find = _finder(rule, known.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            results = [find(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([joined(b) for b, _ in results], pa.string()),
                    pa.array([joined(a) for _, a in results], pa.string()),
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in a] for _, a in results], kind),
                ],
                names=["doc_id", "base", "spans", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each maximal stretch of spans replaced by a mark."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rule: NoveltyRule = NoveltyRule()) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by marks; ``n_chars``, if there as a whole number, follows."""
    names = docs.columns
    at = names.index("text")
    k = whole_number(docs, "n_chars")
    known = docs.sparkSession.sparkContext.broadcast(identifiers(docs, rule))

    def run(batches):
        import pyarrow as pa

        find = _finder(rule, known.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [t if not t or not (a := find(t)[1]) else blanked(t, a) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if k is not None:
                kept = columns[k].to_pylist()
                columns[k] = pa.array([n if t == c else len(c) for t, c, n in zip(texts, clean, kept)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digested(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    parts = F.split("base", ",")

    def count(kind: str):
        return F.size(F.filter(parts, lambda x: x.startswith(f"{kind}:"))).cast("bigint").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2("base", 256).alias("base_sha256"), "spans")
