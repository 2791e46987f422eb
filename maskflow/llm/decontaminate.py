"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words are numbered and put into one automaton over all items.  Each
text's words are streamed through it; at every word the automaton knows the
longest stretch of words, ending there, that occurs in an item.  A stretch of
``window`` words marks those words as hit; items of fewer words count as one
window each.  Words that no item holds send the automaton back to its start, so
only runs of item words that are long enough are streamed.

The items' bytes are added up in Spark before anything is fetched.  Up to
``bound`` of them are broadcast.  Beyond it tasks write the items to the shared
folder in blocks of about ``block_bytes``; a task then gathers texts up to
``HELD_BYTES``, and streams them through one block's automaton after the other, so
an automaton is built once for each such load and only one is held at a time.

Defined results: null texts have no words; items without words are never found;
repeated items count once by their item_id; a null item_id marks words like any
other, but is left out of the list of items; empty tables give no hits or no rows;
further columns aren't read by :func:`contamination` and pass through
:func:`remove_contaminated` unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.arraystore import ArrayStore
from maskflow.llm.shared import scratch, whole_number
from maskflow.llm.textbytes import ALNUM, as_bytes, word_spans

#: Bytes of item text in one automaton, which takes some 300 times as many.
BLOCK_BYTES = 512 << 10
#: Bytes of item text that are broadcast at most.
BOUND = 512 << 10
#: Bytes of texts that a task gathers where there are several blocks.
HELD_BYTES = 32 << 20


@dataclass(frozen=True)
class ContaminationRule:
    """A text is contaminated if hit words are at least 1 / ``share`` of its words, and any are hit."""

    window: int = 13
    share: int = 20


class Automaton:
    """Suffix automaton over word numbers, one path from the start for each item."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.whole: dict[int, list[tuple[int, object]]] = {}
        ended: dict[int, list] = {}  # the items with a word sequence from their start that leads here
        self.least = window
        for key, words in items:
            if not words:
                continue
            self.least = min(self.least, len(words))
            at = 0
            for w in words:
                at = self._extend(at, self.numbers.setdefault(w, len(self.numbers) + 1))
                own = ended.setdefault(at, [])
                if not own or own[-1] != key:
                    own.append(key)
            if len(words) < window:
                self.whole.setdefault(at, []).append((len(words), key))
        # a state's shorter suffixes occur wherever it does: in the tree of links an
        # item ends in a state's part of the walk if the state occurs in it
        below: dict[int, list[int]] = {}
        for s in range(1, len(self.step)):
            below.setdefault(self.link[s], []).append(s)
        self.walk: list = []
        self.first = [0] * len(self.step)
        self.last = [0] * len(self.step)
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                self.last[s] = len(self.walk)
                continue
            self.first[s] = len(self.walk)
            self.walk += ended.get(s, ())
            if s and (above := self.whole.get(self.link[s])):
                self.whole[s] = self.whole.get(s, []) + above
            stack.append((s, True))
            stack += [(x, False) for x in below.get(s, ())]
        self.known: dict[int, frozenset] = {}

    def owners(self, s: int) -> frozenset:
        """The items that hold a state's words."""
        if s not in self.known:
            self.known[s] = frozenset(self.walk[self.first[s] : self.last[s]])
        return self.known[s]

    def _copy(self, p: int, c: int, q: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        known = self.step[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(last, c, known)
        new = len(self.step)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [start, end) of words, in order of their ends, and the items found."""
        get = self.numbers.get
        numbers = [get(w, 0) for w in words]
        known = np.fromiter(map(bool, numbers), np.int8, len(numbers))
        turn = np.diff(known, prepend=0, append=0)
        begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = ends - begins >= self.least
        spans: list[tuple[int, int]] = []
        found: set = set()
        for b, e in zip(begins[long].tolist(), ends[long].tolist()):
            self._run(numbers, b, e, spans, found)
        return spans, found

    def _run(self, numbers: list[int], b: int, e: int, spans: list, found: set) -> None:
        step, link, length, whole, window = self.step, self.link, self.length, self.whole, self.window
        state = matched = 0
        for i in range(b, e):
            c = numbers[i]
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(c, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                spans.append((i + 1 - matched, i + 1))
                s = state
                while length[link[s]] >= window:  # the state of the last ``window`` words
                    s = link[s]
                found |= self.owners(s)
            for n, key in whole.get(state, ()):
                if n <= matched:
                    spans.append((i + 1 - n, i + 1))
                    found.add(key)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as disjoint ones, in order."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


class Items:
    """The items as blocks: a single broadcast one, or arrays in the shared folder."""

    def __init__(self, benchmark: DataFrame, rule: ContaminationRule, block_bytes: int, bound: int):
        spark = benchmark.sparkSession
        texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("text")).filter("text IS NOT NULL")
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.rule, self.key, self.shared, self.uri, self.blocks = rule, uuid.uuid4().hex, None, None, 1
        if size <= bound:
            self.shared = spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in texts.collect()])
        else:
            self.uri, self.blocks = scratch(spark, "benchmark-items"), -(-size // block_bytes)
            self._write(texts)

    def _write(self, texts: DataFrame) -> None:
        uri, blocks = self.uri, self.blocks

        def write(key, table):
            import pyarrow as pa

            store, block = ArrayStore(uri), int(key[0].as_py())
            items, bodies = table.column("item").to_pylist(), [bytes(t) for t in table.column("text").to_pylist()]
            names = [b"" if x is None else b"=" + x.encode() for x in items]
            for name, parts in (("text", bodies), ("item", names)):
                store.write(f"{block}-{name}", np.frombuffer(b"".join(parts), np.uint8))
                store.write(f"{block}-{name}-ends", np.cumsum([len(p) for p in parts], dtype=np.int64))
            return pa.table({"n": pa.array([len(items)], pa.int64())})

        dealt = texts.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int").alias("block"), "item", "text")
        dealt.groupBy("block").applyInArrow(write, "n bigint").agg(F.sum("n")).collect()

    def automata(self) -> Iterator[Automaton]:
        """One block's after the other; a single one is kept by the worker."""
        if self.shared is not None:
            if self.key not in _automata:
                _automata.clear()
                _automata[self.key] = Automaton([(k, t.translate(ALNUM).split()) for k, t in self.shared.value], self.rule.window)
            yield _automata[self.key]
            return
        store = ArrayStore(self.uri)

        def parts(name):
            blob, ends = store.read(name), store.read(f"{name}-ends")
            if ends is not None:
                begin = 0
                for end in ends.tolist():
                    yield blob[begin:end].tobytes()
                    begin = end

        for block in range(self.blocks):
            items = [(k[1:].decode() if k else None, t.translate(ALNUM).split()) for k, t in zip(parts(f"{block}-item"), parts(f"{block}-text"))]
            if items:
                BUILT[self.key] = BUILT.get(self.key, 0) + 1
                yield Automaton(items, self.rule.window)

    def loads(self, batches, column: int):
        """(batch, its texts' words, merged hit spans, found items), as many batches at a time as may be held."""
        held, size = [], 0
        for batch in batches:
            texts = as_bytes(batch.column(column))
            held.append((batch, texts))
            size += sum(map(len, texts))
            if self.shared is not None or size >= HELD_BYTES:
                yield from self._matched(held)
                held, size = [], 0
        yield from self._matched(held)

    def _matched(self, held):
        if held:
            spans, found = self.hits([t for _, texts in held for t in texts])
            at = 0
            for batch, texts in held:
                yield batch, texts, spans[at : at + len(texts)], found[at : at + len(texts)]
                at += len(texts)

    def hits(self, texts: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """Merged hit spans and found items of each text."""
        spans, found = [[] for _ in texts], [set() for _ in texts]
        for automaton in self.automata():
            for k, text in enumerate(texts):
                s, f = automaton.stream(text.translate(ALNUM).split())
                spans[k] += s
                found[k] |= f
        return [merged(s) for s in spans], found


_automata: dict[str, Automaton] = {}
#: How many automata of blocks this worker has built.
BUILT: dict[str, int] = {}


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: ContaminationRule = ContaminationRule(),
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    bound: int = BOUND,
) -> DataFrame:
    """One row per document: the columns in ``keep``, n_words, n_hit, items (found item_ids as strings, sorted), spans, contaminated."""
    from pyspark.sql import types as T

    keep = ["doc_id"] if keep is None else keep
    items = Items(benchmark, rule, block_bytes, bound)
    source = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    out = T.StructType(
        [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )

    def run(batches):
        import pyarrow as pa

        for batch, texts, spans, found in items.loads(batches, 0):
            n_words = [len(t.translate(ALNUM).split()) for t in texts]
            n_hit = [sum(e - b for b, e in s) for s in spans]
            columns = batch.columns[1:] + [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([sorted(f - {None}) for f in found], pa.list_(pa.string())),
                pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int64()))),
                pa.array([h > 0 and rule.share * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items", "spans", "contaminated")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without disjoint spans of words, in order; what separates words around them stays."""
    starts, ends = word_spans(np.frombuffer(text.translate(ALNUM), np.uint8))
    out, at = [], 0
    for b, e in spans:
        out.append(text[at : int(starts[b])])
        at = int(ends[e - 1])
    return b"".join(out) + text[at:]


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, rule: ContaminationRule = ContaminationRule(), block_bytes: int = BLOCK_BYTES, bound: int = BOUND
) -> DataFrame:
    """``docs`` without its contaminated rows; from the texts of the others the hit spans are cut.

    Spans that only come about where a cut joins two parts are cut as well.
    ``n_chars``, if there as a whole number, follows a text that changes; other
    columns stay as they came.
    """
    items = Items(benchmark, rule, block_bytes, bound)
    names = docs.columns
    at = names.index("text")
    counted = whole_number(docs, "n_chars")

    def run(batches):
        import pyarrow as pa

        for batch, texts, spans, _ in items.loads(batches, at):
            n_words = [len(t.translate(ALNUM).split()) for t in texts]
            n_hit = [sum(e - b for b, e in s) for s in spans]
            keep = [not (h > 0 and rule.share * h >= n) for h, n in zip(n_hit, n_words)]
            cut: dict[int, bytes] = {}
            left = {k: spans[k] for k in range(len(texts)) if keep[k] and spans[k]}
            while left:
                cut |= {k: without_spans(cut.get(k, texts[k]), s) for k, s in left.items()}
                left = {k: s for k, s in zip(left, items.hits([cut[k] for k in left])[0]) if s}
            columns = list(batch.columns)
            if cut:
                clean = columns[at].to_pylist()
                for k, t in cut.items():
                    clean[k] = t.decode()
                columns[at] = pa.array(clean, columns[at].type)
                if counted is not None:
                    kept = columns[counted].to_pylist()
                    for k in cut:
                        kept[k] = len(clean[k])
                    columns[counted] = pa.array(kept, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
