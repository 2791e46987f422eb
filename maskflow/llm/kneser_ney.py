"""Interpolated modified Kneser-Ney scoring with a bigram model counted in Spark.

Counting: tasks hash words by array arithmetic, add up each piece's bigrams and
deal them to shards by (context, word) as packed arrays, so a bigram that is in
every text still comes from each task once.  A shard's task adds up the counts and
writes its sorted hash array; it passes on, packed in the same way, how often each
context has one, two or more different followers and each word different
predecessors.  These make the unigram shards.  Workers map the shards and score
batches of texts by sorted look-ups; nothing of the model goes through the driver
but eight totals.

Model (order 2, each text ends with an end mark and begins after a start mark):

    p(w | v) = max(c(v w) - D(c(v w)), 0) / c(v .) + g(v) p(w)
    p(w)     = max(N(. w) - d(N(. w)), 0) / N(. .) + g / (V + 1)

with the three discounts of modified Kneser-Ney at either level, from the counts
of counts; unseen contexts use p(w), and one share of the uniform part is for
unseen words.

Base: add-one unigram scores.  Defined results: null and empty texts are one end
mark; rows that repeat are scored, and learned from, each for itself; a null
doc_id is hashed as an empty text; without training rows all words are unknown;
empty tables give empty tables; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.arraystore import Shards, shard_bits
from maskflow.llm.shared import scratch, stored
from maskflow.llm.textbytes import PLAIN, Words, as_bytes, combine, groups

START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)
#: Tokens that a task adds up before it deals them out.
PIECE = 3_000_000

BIGRAMS = ("count",)
WORDS = ("count", "n1", "n2", "n3", "before")


@dataclass(frozen=True)
class HoldOut:
    """Rows whose crc32(doc_id as text) mod ``mod`` is ``rest`` are held out of training."""

    mod: int = 7
    rest: int = 2


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    bigrams: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_mass: float


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end mark after each text, offsets of the texts)."""
    words = Words(texts, PLAIN)
    sizes = np.diff(words.first) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), np.uint64)
    ends = offsets[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words.hashes
    out[ends] = END
    return out, offsets


def contexts(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each, or the start mark."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = START
    return before


def _added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with counts added up."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *[np.add.reduceat(c[order], at) for c in counts])


def _small(a: np.ndarray) -> bytes:
    """Counts as bytes, wider ones apart: most are one byte."""
    wide = np.flatnonzero(a >= 255)
    return np.int64(len(wide)).tobytes() + wide.astype(np.int64).tobytes() + a[wide].astype(np.int64).tobytes() + np.minimum(a, 255).astype(np.uint8).tobytes()


def _large(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    wide = np.frombuffer(b, np.int64, n, 8)
    values = np.frombuffer(b, np.int64, n, 8 + 8 * n)
    out = np.frombuffer(b, np.uint8, -1, 8 + 16 * n).astype(np.int64)
    out[wide] = values
    return out


class Layout:
    """Shard of a bigram: half of the bits from the context's hash, half from the word's, so no context fills a shard."""

    def __init__(self, bits: int):
        self.high, self.low = bits - bits // 2, bits // 2

    def key(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bigram's hash, whose top bits are its shard."""
        h, n = np.uint64(64 - self.high), np.uint64(64 - self.low)
        top = (before >> h) << h
        if self.low:
            top = top | ((word >> n) << np.uint64(64 - self.high - self.low))
        return top | (combine(before, word) >> np.uint64(self.high + self.low))


def _training(docs: DataFrame, rule: HoldOut) -> DataFrame:
    """(doc_id, held_out, text)."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % rule.mod
    return docs.select("doc_id", (rest == rule.rest).alias("held_out"), "text")


def count_bigrams(split: DataFrame, uri: str, bits: int) -> DataFrame:
    """Write the bigram shards; returns the packed word statistics (shard, kind, keys, four counts), stored."""
    layout, shards, by_word = Layout(bits), Shards(uri, bits, BIGRAMS, "b"), Shards(uri, bits, WORDS)

    def emit(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            tokens = np.concatenate([t for t, _ in held])
            before = np.concatenate([b for _, b in held])
            key = layout.key(before, tokens)
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.append(at, len(key)))
            key, first = key[at], order[at]
            for s, b, e in shards.runs(key):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), *[pa.array([x], pa.binary()) for x in (before[first[b:e]].tobytes(), tokens[first[b:e]].tobytes(), _small(counts[b:e]))]],
                    names=["shard", "before", "word", "counts"],
                )

        for batch in batches:
            texts = as_bytes(batch.column(0))
            for b, e in groups([len(t) for t in texts]):
                tokens, offsets = token_stream(texts[b:e])
                held.append((tokens, contexts(tokens, offsets)))
                n += len(tokens)
                if n >= PIECE:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def gather(key, table):
        import pyarrow as pa

        join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64)
        before, word = join("before"), join("word")
        counts = np.concatenate([_large(x) for x in table.column("counts").to_pylist()])
        keys = layout.key(before, word)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first, counts = order[at], np.add.reduceat(counts[order], at)
        shards.write(int(key[0].as_py()), keys[at], counts.astype(np.uint16) if counts.max() < 65536 else counts)
        own = [(counts == k).astype(np.int64) for k in (1, 2)] + [(counts > 2).astype(np.int64)]
        rows = []
        # 0: contexts with their followers; 1: words with their counts and predecessors; 2: counts of counts
        for kind, (k, *values) in enumerate(
            (_added(before[first], *own, counts), _added(word[first], np.ones(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), counts))
        ):
            for s, b, e in by_word.runs(k):
                rows.append((s, kind, k[b:e].tobytes(), *[_small(v[b:e]) for v in values]))
        tally = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)
        rows.append((-1, 2, b"", *[_small(x) for x in (tally, np.array([len(counts)]), np.zeros(1, np.int64), np.zeros(1, np.int64))]))
        return pa.table(dict(zip(("shard", "kind", "keys", "v1", "v2", "v3", "v4"), map(list, zip(*rows)))), schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("keys", "v1", "v2", "v3", "v4")]]))

    packed = split.filter("NOT held_out").select("text").mapInArrow(emit, "shard int, before binary, word binary, counts binary")
    rows = packed.groupBy("shard").applyInArrow(gather, "shard int, kind int, keys binary, v1 binary, v2 binary, v3 binary, v4 binary")
    return stored(rows, "word-statistics")


def count_words(statistics: DataFrame, uri: str, bits: int) -> Totals:
    """Write the word shards from the statistics; returns the model's totals."""
    by_word = Shards(uri, bits, WORDS)

    def gather(key, table):
        import pyarrow as pa

        kinds = table.column("kind").to_numpy()
        parts = []
        for kind in (0, 1):
            chosen = table.filter(pa.array(kinds == kind))
            keys = np.frombuffer(b"".join(chosen.column("keys").to_pylist()), np.uint64)
            values = [np.concatenate([_large(x) for x in chosen.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("v1", "v2", "v3", "v4")]
            parts.append(_added(keys, *values))
        (left, n1, n2, n3, _), (words, preceded, _, _, counts) = parts
        keys = np.union1d(left, words)
        columns = [np.zeros(len(keys), np.int64) for _ in WORDS]
        at = np.searchsorted(keys, left)
        for c, v in zip(columns[1:4], (n1, n2, n3)):
            c[at] = v
        at = np.searchsorted(keys, words)
        columns[0][at], columns[4][at] = counts, preceded
        by_word.write(int(key[0].as_py()), keys, *columns)
        tally = [int((preceded == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"tokens": [int(counts.sum())], "distinct": [len(words)], **{f"m{k + 1}": [x] for k, x in enumerate(tally)}, "mass": [int(preceded.sum())]})

    names = ["tokens", "distinct", "m1", "m2", "m3", "m4", "mass"]
    totals = (
        statistics.filter("kind < 2")
        .groupBy("shard")
        .applyInArrow(gather, ", ".join(f"{n} bigint" for n in names))
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        .first()
    )

    def tally(batches):
        import pyarrow as pa

        out = np.zeros(5, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += np.append(_large(x), _large(y)[:1])
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in out], names=["n1", "n2", "n3", "n4", "n"])

    row = statistics.filter("kind = 2").select("v1", "v2").mapInArrow(tally, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, n bigint").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n")]
    ).first()
    lower = discounts(totals["m1"], totals["m2"], totals["m3"], totals["m4"])
    share = lower[0] * totals["m1"] + lower[1] * totals["m2"] + lower[2] * (totals["distinct"] - totals["m1"] - totals["m2"])
    return Totals(
        totals["tokens"],
        totals["distinct"],
        totals["mass"],
        discounts(row["n1"], row["n2"], row["n3"], row["n4"]),
        lower,
        share / totals["mass"] if totals["mass"] else 1.0,
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; where counts of counts are missing, a half of each count or less."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found))


class Scorer:
    def __init__(self, uri: str, bits: int, totals: Totals):
        self.layout, self.totals = Layout(bits), totals
        self.bigrams, self.words = Shards(uri, bits, BIGRAMS, "b"), Shards(uri, bits, WORDS)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score."""
        t = self.totals
        tokens, offsets = token_stream(texts)
        before = contexts(tokens, offsets)
        distinct, which = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        _, count, n1, n2, n3, preceded = (x.astype(np.float64) for x in self.words.look_up(distinct))
        d1, d2, d3 = t.lower
        lower = np.where(preceded > 0, preceded - np.where(preceded == 1, d1, np.where(preceded == 2, d2, d3)), 0.0) / max(t.bigrams, 1)
        lower += t.lower_mass / (t.distinct + 1)
        base = np.log10((count + 1) / (t.tokens + 1.0 * (t.distinct + 1)))
        w, v = which[: len(tokens)], which[len(tokens) :]
        # a context's tokens: its followers' counts; all but the end mark are followed each time
        followed = np.where(distinct == START, self._starts(), np.where(distinct == END, 0.0, count))
        e1, e2, e3 = t.discounts
        spare = np.divide(e1 * n1 + e2 * n2 + e3 * n3, followed, out=np.ones_like(followed), where=followed > 0)
        key = self.layout.key(before, tokens)
        keys, at = np.unique(key, return_inverse=True)
        _, pair = self.bigrams.look_up(keys)
        pair = pair.astype(np.float64)[at]
        higher = np.divide(np.where(pair > 0, pair - np.where(pair == 1, e1, np.where(pair == 2, e2, e3)), 0.0), followed[v], out=np.zeros(len(tokens)), where=followed[v] > 0)
        score = np.log10(higher + spare[v] * lower[w])
        starts = offsets[:-1]
        return (
            np.diff(offsets),
            np.add.reduceat((count[w] > 0).astype(np.int64), starts),
            np.add.reduceat(base[w], starts),
            np.add.reduceat(score, starts),
        )

    def _starts(self) -> float:
        """Training texts: each has one end mark."""
        _, count, *_ = self.words.look_up(np.array([END], np.uint64))
        return float(count[0])


def score(docs: DataFrame, rule: HoldOut = HoldOut()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity."""
    spark = docs.sparkSession
    split = _training(docs, rule)
    bits = shard_bits(docs.rdd.getNumPartitions())
    uri = scratch(spark, "language-model")
    totals = count_words(count_bigrams(split, uri, bits), uri, bits)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(uri, bits, totals)
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for b, e in groups([len(t) for t in texts]):
                n, known, base, model = scorer(texts[b:e])
                part = batch.slice(b, e - b)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), totals.tokens)), pa.array(base), pa.array(model), pa.array(10.0 ** np.minimum(-model / n, 300))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return split.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
