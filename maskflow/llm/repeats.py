"""Exact removal of repeated byte strings by anchored suffix sorting.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(in a text with a smaller doc_id, or earlier in its own).  Whole texts count, and
strings are judged on the input.

1. Every window of ``length`` bytes has an anchor: its smallest hashed gram, the
   rightmost of equal ones.  Equal windows have equal anchors at equal places, so
   comparing windows by anchor loses none.  Successive windows with one anchor
   form a run; about one byte in 35 begins one.
2. Runs are dealt by anchor as packed arrays.  Equal runs (by hash of all their
   bytes) are repeats but for the first; a task drops its own repeats before
   they are shuffled, so a passage of a third of all texts sends one run a task.
   Where a task has very many different runs of one anchor, it deals all but two
   of them by run: those two tell the anchor's shard that there are several, and
   equal runs that so come to different shards meet in step 3.
3. Where an anchor has several different runs, the first of each are sorted: the
   suffixes that begin at the anchor, and the reversed bytes before it, by
   multikey quicksort to a shallow depth and blind tries below it.  Two runs share
   the window that begins ``d`` bytes before the anchor if their suffixes agree
   for ``length - d`` bytes and their reversed parts for ``d``; neighbours' common
   prefixes give these classes for all ``d``, and all but the first of a class
   are repeats.  An anchor's windows are dealt in a few parts by ``d``, and each
   part by the bytes that all its windows share, so an anchor with very many
   surroundings is many groups; a task sends a part with equal bytes once.
4. Repeated spans come back to their texts, merged.

So equal whole runs are told by a 64-bit hash of their bytes, and the sorting
decides where runs differ.  A text is known by its doc_id and a 64-bit hash of it.
Tasks hold ``PIECE`` runs, then deal them out; a shard's runs are compared in
groups of about ``COMPARED``.

Texts travel neither whole nor in part but for the runs of step 3.  Defined
results: null texts are empty; rows that repeat doc_id and text are one text and
get equal results; rows with equal doc_id and different texts are ordered by a
hash of the text, and so are those with a null doc_id, which come last; an empty
table gives an empty table; other columns aren't read by :func:`repeats`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.arraystore import shard_bits
from maskflow.llm.shared import Shelf, release
from maskflow.llm.suffixes import sort_strings
from maskflow.llm.textbytes import as_bytes, mix, powers, prefix_hash, span_hash

LAST = (1 << 63) - 1  # stands for a null doc_id
SLICE = 512 << 10
#: Runs that a task gathers before it deals them out.
PIECE = 250_000
#: Runs of one anchor that a task deals by anchor, if it has no more.
MANY = 16
#: Parts of runs, bytes and all, that a task gathers before it deals them out.
PARTS = 50_000
#: Runs whose bytes are sorted at once; more only where one group has more.
COMPARED = 16_384
COLUMNS = (("anchor", np.uint64), ("run", np.uint64), ("doc", np.int64), ("text", np.int64), ("start", np.int64), ("windows", np.uint8))


@dataclass(frozen=True)
class RepeatRule:
    """``gram`` bytes make an anchor; a window has ``length - gram + 1`` of them.  An anchor's runs are compared in ``parts``."""

    length: int = 100
    gram: int = 32
    parts: int = 4


def runs_of(text: np.ndarray, rule: RepeatRule) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, start, windows, anchor place) of the runs of a text, slice by slice."""
    parts = [_runs(text[b : b + SLICE + rule.length - 1], b, rule) for b in range(0, max(len(text) - rule.length + 1, 0), SLICE)]
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _runs(text: np.ndarray, base: int, rule: RepeatRule) -> tuple[np.ndarray, ...]:
    k, wide = rule.gram, rule.length - rule.gram + 1
    prefix = prefix_hash(text)
    n = len(text) - k + 1
    grams = mix((prefix[k:] - prefix[:-k]) * powers(len(prefix))[1][:n])
    # the smallest hash, then the rightmost place
    low = np.uint64(0xFFFFFF)
    best = (grams & ~low) | (low - np.arange(n, dtype=np.uint64))
    size = 1
    while size * 2 <= wide:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if wide > size:
        best = np.minimum(best[: len(best) - (wide - size)], best[wide - size :])
    place = (low - (best & low)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    windows = np.diff(np.append(begin, len(place)))
    at = place[begin]
    return grams[at], span_hash(prefix, begin, begin + windows + rule.length - 1), begin + base, windows, at + base


FIELDS = 7


def _packed(shard: int, kind: int, *arrays: np.ndarray):
    return [shard, kind, *[a.tobytes() for a in arrays], *[b""] * (FIELDS - len(arrays))]


PACKED = "shard int, kind int, " + ", ".join(f"c{i} binary" for i in range(FIELDS))


def _batch(rows):
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *[(f"c{i}", pa.binary()) for i in range(FIELDS)]])
    columns = list(zip(*rows)) or [[]] * (FIELDS + 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _table(rows):
    import pyarrow as pa

    return pa.Table.from_batches([_batch(rows)])


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _by_text(kind: int, bits: int, doc, text, start, windows):
    """Rows of spans dealt by text: shards beyond the anchors' own."""
    if not len(doc):
        return
    shard = _top(mix(doc.view(np.uint64) ^ mix(text.view(np.uint64))), bits) + (1 << bits)
    order = np.argsort(shard, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        o = order[b:e]
        yield _packed(int(shard[o[0]]), kind, doc[o], text[o], start[o], windows[o])


def _firsts(anchor, run, doc, text, start, windows):
    """Sorted columns and the flag of the first of equal runs."""
    order = np.lexsort((start, text, doc, run, anchor))
    columns = [c[order] for c in (anchor, run, doc, text, start, windows)]
    a, r = columns[:2]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    d, t, s = columns[2:5]
    same = np.zeros(len(order), bool)  # the same place of the same text, from a repeated row
    same[1:] = ~first[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (s[1:] == s[:-1])
    columns = [c[~same] for c in columns]
    first = first[~same]
    return columns, first


def _repeated(columns, first):
    """Places of repeats: those that aren't the first of their run. (A place counts once.)"""
    return [c[~first] for c in columns[2:]]


def deal_runs(docs: DataFrame, rule: RepeatRule, bits: int) -> DataFrame:
    """Packed runs by anchor (kind 0) or, of an anchor with many, by run (kind 3), and spans found to be repeats within a task by text (kind 1)."""

    def emit(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def flush():
            columns, first = _firsts(*[np.concatenate(c) for c in zip(*held)])
            rows = list(_by_text(1, bits, *_repeated(columns, first)))
            kept = [c[first] for c in columns]
            begin = np.flatnonzero(np.concatenate([[True], kept[0][1:] != kept[0][:-1]]))
            size = np.diff(np.append(begin, len(kept[0])))
            by_run = (np.repeat(size, size) > MANY) & (np.arange(len(kept[0])) - np.repeat(begin, size) > 1)
            for kind, chosen in ((0, ~by_run), (3, by_run)):
                own = [c[chosen] for c in kept]
                shard = _top(mix(own[1] if kind else own[0]), bits)  # anchors are the smallest of many hashes: as they are, most have small ones
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
                for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if b < e:
                        rows.append(_packed(int(shard[b]), kind, *[c[order[b:e]] for c in own]))
            for b in range(0, len(rows), 256):
                yield _batch(rows[b : b + 256])

        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if len(text) < rule.length:
                    continue
                anchor, run, start, windows, _ = runs_of(np.frombuffer(text, np.uint8), rule)
                m = len(anchor)
                held.append([anchor, run, np.full(m, doc), np.full(m, mark), start, windows.astype(np.uint8)])
                n += m
                if n >= PIECE:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()
        held = []
        release()

    return docs.mapInArrow(emit, PACKED)


def _joined(table, kind: int, kinds) -> list[np.ndarray]:
    import pyarrow as pa

    chosen = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    return [np.frombuffer(b"".join(chosen.column(f"c{i}").to_pylist()), t) for i, t in enumerate(kinds)]


SPAN_KINDS = (np.int64, np.int64, np.int64, np.uint8)


def resolve(dealt: DataFrame, bits: int) -> DataFrame:
    """Spans by text: repeats (kind 1), and first runs whose anchor has others (kind 2)."""

    def gather(key, table):
        if key[0].as_py() >= 1 << bits:
            return table
        rows = []
        for kind in (0, 3):
            columns, first = _firsts(*_joined(table, kind, [t for _, t in COLUMNS]))
            rows += _by_text(1, bits, *_repeated(columns, first))
            firsts = [c[first] for c in columns]
            anchor = firsts[0]
            several = np.ones(len(anchor), bool)
            if kind == 0 and len(anchor):
                group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
                several = np.bincount(group)[group] > 1
            rows += _by_text(2, bits, *[c[several] for c in firsts[2:]])
        return _table(rows)

    return dealt.groupBy("shard").applyInArrow(gather, PACKED)


SPANS = "doc bigint, mark bigint, starts binary, ends binary"


def per_text(spans: DataFrame, kind: int, rule: RepeatRule) -> DataFrame:
    """(doc, mark, starts, ends) of each text with any: merged byte spans for kind 1, runs as they are for kind 2."""

    def gather(key, table):
        import pyarrow as pa

        doc, text, start, windows = _joined(table, kind, SPAN_KINDS)
        order = np.lexsort((start, text, doc))
        doc, text, start = doc[order], text[order], start[order]
        end = start + windows[order].astype(np.int64) + (rule.length - 1)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]) if len(doc) else np.zeros(0, bool)
        if kind == 1 and len(doc):
            # a running end within each text: spans that touch become one
            group = np.cumsum(new)
            far = np.int64(1) << 40
            reach = np.maximum.accumulate(end + group * far) - group * far
            apart = new.copy()
            apart[1:] |= start[1:] > reach[:-1]
            at = np.flatnonzero(apart)
            last = np.append(at[1:], len(doc)) - 1
            doc, text, start, end, new = doc[at], text[at], start[at], reach[last], new[at]
        cuts = np.append(np.flatnonzero(new), len(doc))
        found = [
            {"doc": int(doc[b]), "mark": int(text[b]), "starts": start[b:e].tobytes(), "ends": end[b:e].tobytes()}
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())
        ]
        return pa.Table.from_pylist(found, schema=pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())]))

    return spans.filter(F.col("kind") == kind).groupBy("shard").applyInArrow(gather, SPANS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): a text is known by its doc_id and a hash of it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _with_spans(keyed: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    # both grow with the texts: they are shuffled at every size, the spans being what a task holds
    return keyed.join(spans.hint("shuffle_hash"), ["doc", "mark"], how)


def compare_runs(keyed: DataFrame, needed: DataFrame, rule: RepeatRule, bits: int) -> DataFrame:
    """Spans by text (kind 1) that the sorted first runs of shared anchors show to be repeats."""

    behind = rule.length - rule.gram
    cuts = [-(-(behind + 1) * k // rule.parts) for k in range(rule.parts + 1)]

    def fetch(batches):
        import xxhash

        # (hash of the bytes that a part's windows share, bytes) -> the places that have them
        held: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        n = 0

        def flush():
            rows: dict[int, list[tuple]] = {}
            again: list[tuple[int, int, int, int]] = []
            for (key, own), places in held.items():
                places = sorted(set(places))
                again += [(*at[:3], len(own) - rule.length + 1) for at in places[1:]]
                rows.setdefault(key >> (64 - bits), []).append((*places[0], key, own))
            out = []
            for shard, found in rows.items():
                doc, mark, start, place, key, own = zip(*found)
                sizes = np.fromiter(map(len, own), np.uint8, len(own))
                numbers = [np.array(c, np.int64) for c in (doc, mark, start)]
                out.append(_packed(shard, 0, *numbers, np.array(place, np.uint8), sizes, np.array(key, np.uint64)))
                out[-1][-1] = b"".join(own)
            if again:
                doc, mark, start, windows = (np.array(c, np.int64) for c in zip(*again))
                out += list(_by_text(1, bits, doc, mark, start, windows.astype(np.uint8)))
            for b in range(0, len(out), 256):
                yield _batch(out[b : b + 256])

        for batch in batches:
            columns = [batch.column(c) for c in ("doc", "mark", "text", "starts", "ends")]
            for doc, mark, text, starts, ends in zip(columns[0].to_pylist(), columns[1].to_pylist(), as_bytes(columns[2]), columns[3].to_pylist(), columns[4].to_pylist()):
                starts, ends = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64)
                place = anchor_places(np.frombuffer(text, np.uint8), starts, ends, rule)
                for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                    # the part's windows begin from ``low`` to before ``high`` bytes ahead of the anchor
                    first = np.maximum(starts, place - high + 1)
                    last = np.minimum(ends - rule.length, place - low)
                    part = np.flatnonzero(first <= last)
                    for f, e, p in zip(first[part].tolist(), last[part].tolist(), place[part].tolist()):
                        key = xxhash.xxh3_64_intdigest(text[p - low : p - high + 1 + rule.length], k)
                        held.setdefault((key, text[f : e + rule.length]), []).append((doc, mark, f, p - f))
                    n += len(part)
                if n >= PARTS:
                    yield from flush()
                    held.clear()
                    n = 0
        if n:
            yield from flush()
        held.clear()
        release()

    def gather(key, table):
        if key[0].as_py() >= 1 << bits:
            return table
        doc, text, start, place, size, group = _joined(table, 0, (np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint64))
        place, size = place.astype(np.int64), size.astype(np.int64)
        blob = np.frombuffer(b"".join(table.column("c6").to_pylist()), np.uint8)
        begin = np.cumsum(size) - size
        # a row that repeats doc_id and text brings its runs again
        order = np.lexsort((start, text, doc, group))
        again = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        again[1:] = (doc[a] == doc[b]) & (text[a] == text[b]) & (start[a] == start[b])
        order = order[~again]
        rows = []
        seams = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
        at = 0
        while at < len(order):
            stop = int(seams[np.searchsorted(seams, min(at + COMPARED, len(order)))])
            own = order[at:stop]
            k, where = repeated_windows(doc[own], text[own], start[own], place[own], size[own], begin[own], blob, rule)
            rows += _by_text(1, bits, doc[own][k], text[own][k], where, np.ones(len(k), np.uint8))
            at = stop
        return _table(rows)

    fetched = _with_spans(keyed, needed, "inner").mapInArrow(fetch, PACKED)
    return fetched.groupBy("shard").applyInArrow(gather, PACKED)


def anchor_places(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: RepeatRule) -> np.ndarray:
    """Where the anchors of known runs are."""
    _, _, begin, _, place = runs_of(text, rule)
    return place[np.searchsorted(begin, starts)]


def repeated_windows(doc, text, start, place, size, begin, blob, rule: RepeatRule) -> tuple[np.ndarray, np.ndarray]:
    """(run number, window start) of every window that an earlier run has too."""
    n, length = len(doc), rule.length
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    behind = length - rule.gram  # most bytes before an anchor

    def matrix(first, step, count, width):
        out = np.zeros((n, width), np.uint8)
        for b in range(0, n, 2048):
            part = slice(b, b + 2048)
            inside = np.arange(width) < count[part, None]
            grid = first[part, None] + step * np.arange(width)
            out[part][inside] = blob[grid[inside]]
        return out

    suffix = matrix(begin + place, 1, np.minimum(size - place, length), length)
    before = matrix(begin + place - 1, -1, np.minimum(place, behind), behind)
    order_s, shared_s = sort_strings(suffix)
    order_b, shared_b = sort_strings(before)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((start, text, doc))] = np.arange(n)
    out_k, out_at = [], []
    class_s, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(behind + 1):
        valid = np.flatnonzero((place >= d) & (place - d + length <= size))
        if len(valid) < 2:
            continue
        class_s[order_s] = np.cumsum(shared_s < length - d)
        class_b[order_b] = np.cumsum(shared_b < d)
        valid = valid[np.argsort(rank[valid])]
        _, first = np.unique(class_s[valid] * (n + 1) + class_b[valid], return_index=True)
        again = np.ones(len(valid), bool)
        again[first] = False
        k = valid[again]
        out_k.append(k)
        out_at.append(start[k] + place[k] - d)
    if not out_k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_k), np.concatenate(out_at)


def repeated_spans(keyed: DataFrame, bits: int, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """(doc, mark, starts, ends): merged spans of repeated bytes for each text that has any."""
    shelf = Shelf(keyed.sparkSession)
    spans = shelf.put("spans", resolve(deal_runs(keyed, rule, bits), bits))
    needed = shelf.put("needed-runs", per_text(spans, 2, rule))
    compared = shelf.put("compared-runs", compare_runs(keyed, needed, rule, bits))
    shelf.drop("needed-runs")
    done = shelf.put("repeated-spans", per_text(spans.filter("kind = 1").unionByName(compared), 1, rule))
    shelf.drop("spans", "compared-runs")
    return done


def cut(text: bytes, starts: bytes | None, ends: bytes | None) -> tuple[bytes, int, int]:
    """(bytes that stay, removed bytes, removed spans)."""
    if starts is None:
        return text, 0, 0
    begins, stops = np.frombuffer(starts, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist()
    kept, at = [], 0
    for s, e in zip(begins, stops):
        kept.append(text[at:s])
        at = e
    return b"".join(kept) + text[at:], sum(stops) - sum(begins), len(begins)


def repeats(docs: DataFrame, rule: RepeatRule = RepeatRule(), with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null without ``with_bytes``)."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, shard_bits(docs.rdd.getNumPartitions()), rule)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column("text"))
            done = [cut(*x) for x in zip(texts, batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([r for _, r, _ in done], pa.int64()),
                    pa.array([n for _, _, n in done], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in done]),
                    pa.array([k if with_bytes else None for k, _, _ in done], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )
        release()

    doc_id = F.nullif("doc", F.lit(LAST)).alias("doc_id")
    return _with_spans(keyed, spans, "left").select(doc_id, "text", "starts", "ends").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
