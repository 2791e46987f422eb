"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, as 64-bit hashes.  Two documents link
when ``den * |A & B| >= num * |A | B|``.  The join is exact:

1. Documents with equal sets form a class; its smallest doc_id stands for it.
2. Shingles are ordered by how many classes hold them, rarest first.  A similar
   pair shares ``l`` of the first ``n - need + l`` shingles of both, where ``need``
   is the overlap that the threshold asks for.  Each document takes the ``l`` with
   the least estimated cost: the rows that its longer prefix meets, plus the
   candidates that share ``l`` of it.  Shingles of one class only can't be shared
   and are left out of the index.
3. Large groups of near copies would pair up quadratically.  So classes are first
   linked to a few centres, each shingle having one (a linear number of pairs, all
   verified), and the components of those links are found; the first round takes
   as centre the document whose shingles are the most common ones, as an original
   among its copies, a further round one drawn at random.  The prefix join then
   looks only at pairs between different components: a shingle that only one
   component has in its prefixes is dropped.
4. Pairs with at least the smaller of their two ``l`` in common are verified on
   whole sets, and the components are found again.
5. Links lie within components, so all of them are counted there: a component's
   classes are dealt into blocks of bounded size, alike in the sizes of their sets,
   and each pair of blocks that may link is one row, whose overlaps are a product of
   two small matrices.  Pairs of documents are never rows.

Shingles come by array arithmetic in tasks; joins, groupings and components are
Spark's.  Defined results: null and empty texts have no shingles and link with
nothing; a text with fewer words than a shingle has one, its whole sequence;
documents with a null doc_id keep their own row with a null component; rows that
repeat a doc_id count as one node with either text; empty tables give empty
tables; other columns aren't read by :func:`similar` and pass through
:func:`keep_one`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.arraystore import Shards, shard_bits
from maskflow.llm.components import components
from maskflow.llm.shared import Shelf, discard, release, scratch, sized_join, stored
from maskflow.llm.textbytes import PLAIN, Words, as_bytes, combine, groups, mix


@dataclass(frozen=True)
class JaccardRule:
    """Shingles of ``words`` words; link from ``num`` in ``den``."""

    words: int = 5
    num: int = 80
    den: int = 100
    centres: int = 3
    rounds: int = 1
    most_matches: int = 8
    candidate_cost: int = 50
    #: classes and shingles of a block, about
    block: int = 512
    block_shingles: int = 131_072


def need(n, rule: JaccardRule):
    """The least overlap with a set of ``n`` or more that the threshold allows."""
    return -(-n * rule.num // rule.den)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, PLAIN)
    h = words.hashes
    if len(h) >= k:
        grams = h[: len(h) - k + 1]
        for j in range(1, k):
            grams = combine(grams, h[j : len(h) - k + 1 + j])
    else:
        grams = h[:0]
    out = []
    for b, e in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if e - b >= k:
            out.append(np.unique(grams[b : e - k + 1]))
        elif e > b:
            one = h[b : b + 1]
            for j in range(b + 1, e):
                one = combine(one, h[j : j + 1])
            out.append(mix(one + np.uint64(e - b)))  # apart from whole shingles
        else:
            out.append(h[:0])
    return out


def _batches(batches, k: int, column: int = 1):
    """(batch slice, sets of its texts), a few megabytes at a time."""
    for batch in batches:
        texts = as_bytes(batch.column(column))
        for b, e in groups([len(t) for t in texts]):
            yield batch.slice(b, e - b), shingle_sets(texts[b:e], k)


def signatures(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """(doc_id, n, fp_a, fp_b): size and fingerprint of each set."""

    def run(batches):
        import pyarrow as pa

        for part, sets in _batches(batches, rule.words):
            filled = [s for s in sets if len(s)]
            flat = np.concatenate(filled) if filled else np.zeros(0, np.uint64)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            at = (np.cumsum(sizes) - sizes)[sizes > 0]
            fp = np.zeros((2, len(sets)), np.uint64)
            if len(at):
                fp[0, sizes > 0] = np.add.reduceat(mix(flat + np.uint64(1)), at)
                fp[1, sizes > 0] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64))],
                names=["doc_id", "n", "fp_a", "fp_b"],
            )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, fp_a bigint, fp_b bigint")


def shingle_counts(node_docs: DataFrame, rule: JaccardRule, bits: int) -> Shards:
    """How many sets hold each shingle, as sorted arrays of those that two or more hold.

    A shingle travels as its shard and the next 32 bits of its hash.  Shards grow
    in number with the input, so about one shingle in ten thousand shares these
    bits with another and seems more frequent than it is, never less.
    """
    shards = Shards(scratch(node_docs.sparkSession, "shingle-counts"), bits, ("count",))
    shift, most = np.uint64(32 - bits), 2_000_000

    def emit(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        n = 0

        def flush():
            keys, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            for s, b, e in shards.runs(keys << shift):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s], pa.int32()),
                        pa.array([keys[b:e].astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([np.minimum(counts[b:e], 65535).astype(np.uint16).tobytes()], pa.binary()),
                    ],
                    names=["shard", "keys", "counts"],
                )

        for _, sets in _batches(batches, rule.words):
            held += sets
            n += sum(map(len, sets))
            if n >= most:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()
        held = []
        release()

    def gather(key, table):
        import pyarrow as pa

        s = int(key[0].as_py())
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[at], np.add.reduceat(counts, at)
        keys, counts = keys[counts > 1], counts[counts > 1]
        top = np.uint64(s) << np.uint64(64 - bits)
        shards.write(s, top | (keys.astype(np.uint64) << shift), counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    packed = node_docs.select("doc_id", "text").mapInArrow(emit, "shard int, keys binary, counts binary")
    packed.groupBy("shard").applyInArrow(gather, "shard int, n bigint").agg(F.sum("n")).collect()
    return shards


class Prefixes:
    """Ordered prefixes of sets and the number of matches each asks for."""

    def __init__(self, uri: str, bits: int, rule: JaccardRule):
        self.counts, self.rule = Shards(uri, bits, ("count",)), rule
        self.mask = ~((np.uint64(1) << np.uint64(32 - bits)) - np.uint64(1))

    def frequencies(self, shingles: np.ndarray) -> np.ndarray:
        """How many sets hold each of ascending shingles."""
        return np.maximum(self.counts.look_up(shingles & self.mask)[1].astype(np.int64), 1)

    def __call__(self, shingles: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(shingles, their places) of the prefix that others may share, and the matches asked for."""
        n, rule = len(shingles), self.rule
        first = n - need(n, rule) + 1
        most = min(rule.most_matches, n - first + 1)
        order = np.lexsort((shingles, frequency))[: first + most - 1]
        met = np.cumsum(frequency[order] - 1)
        # with a set of equal size: rows to look at for a longer prefix, then the candidates that share enough of it
        equal = n + 1 + (-2 * n * rule.num) // (rule.num + rule.den)
        matches = min(range(1, most + 1), key=lambda m: met[equal + m - 2] * (1 + rule.candidate_cost / m))
        order = order[: first + matches - 1]
        shared = np.flatnonzero(frequency[order] > 1)
        return shingles[order[shared]], shared, matches


def prefix_rows(node_docs: DataFrame, counts: Shards, rule: JaccardRule) -> DataFrame:
    """(doc_id, n, matches, shingle, place, weight): prefix entries that another set may have.

    ``weight`` is the mean frequency of the set's shingles, in hundredths: of near
    copies, the one with the fewest changes of its own has the largest.
    """
    uri, bits = counts.store.uri, counts.bits

    def emit(batches):
        import pyarrow as pa

        prefix = Prefixes(uri, bits, rule)
        for part, sets in _batches(batches, rule.words):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            order = np.argsort(flat)
            frequency = np.empty(len(flat), np.int64)
            frequency[order] = prefix.frequencies(flat[order])
            ends = np.cumsum(sizes)
            found = [prefix(s, frequency[e - len(s) : e]) if len(s) else (s, np.zeros(0, np.int64), 0) for s, e in zip(sets, ends.tolist())]
            at = np.repeat(np.arange(len(sets)), [len(p) for p, _, _ in found])
            if not len(at):
                continue
            sums = np.concatenate([[0], np.cumsum(frequency)])
            weight = 100 * (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            column = lambda k: part.column(k).to_numpy(zero_copy_only=False)[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column(0), pa.int64()),
                    pa.array(sizes[at]),
                    pa.array(np.array([m for _, _, m in found], np.int32)[at]),
                    pa.array(np.concatenate([p for p, _, _ in found]).view(np.int64)),
                    pa.array(np.concatenate([i for _, i, _ in found])),
                    pa.array(weight[at]),
                ],
                names=["doc_id", "n", "matches", "shingle", "place", "weight"],
            )
        del prefix
        release()

    return node_docs.select("doc_id", "text").mapInArrow(emit, "doc_id bigint, n bigint, matches int, shingle bigint, place bigint, weight bigint")


def _across(shelf: Shelf, rows: DataFrame) -> DataFrame:
    """The entries whose shingle more than one component has, stored.

    The shingles are counted by task first and stored, so that a shingle which very
    many documents have is one row of its side of the join and split on the other.
    """
    several = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    return shelf.put("shared-prefixes", sized_join(rows, shelf.put("shared-shingles", several), "shingle", "left_semi"))


def _can_link(l: str, r: str, rule: JaccardRule):
    """Conditions on sizes and places under which a shared shingle counts for a pair."""
    asked = F.least(f"{l}matches", f"{r}matches")
    overlap = F.ceil((F.col(f"{l}n") + F.col(f"{r}n")) * rule.num / (rule.num + rule.den) - 1e-6)
    return (
        (F.col(f"{l}root") != F.col(f"{r}root"))
        & (F.least(f"{l}n", f"{r}n") * rule.den >= F.greatest(f"{l}n", f"{r}n") * rule.num)
        & (F.col(f"{l}place") < F.col(f"{l}n") - overlap + asked)
        & (F.col(f"{r}place") < F.col(f"{r}n") - overlap + asked)
    )


def candidates(rows: DataFrame, rule: JaccardRule) -> DataFrame:
    """(a, b): pairs of different components that share enough of their prefixes.

    With sizes known, the overlap that a pair needs is larger than what either set
    asks for, so the places of a shared shingle are held to the pair's own prefix.
    """
    left = rows.select(*[F.col(c).alias(f"l_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    met = left.join(right, (F.col("l_shingle") == F.col("r_shingle")) & (F.col("l_doc_id") < F.col("r_doc_id")) & _can_link("l_", "r_", rule))
    return (
        met.groupBy(F.col("l_doc_id").alias("a"), F.col("r_doc_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("l_matches", "r_matches")).alias("asked"))
        .filter("met >= asked")
        .select("a", "b")
    )


def centre_pairs(shelf: Shelf, rows: DataFrame, rule: JaccardRule, by_draw: int | None) -> DataFrame:
    """(a, b): each document with the centres of its shingles that it meets most; a linear number of pairs.

    A shingle's centre is the document with the largest weight, or by a random draw.
    """
    first = F.col("weight") if by_draw is None else F.xxhash64("doc_id", F.lit(by_draw))
    fields = ["doc_id", "root", "n", "matches", "place"]
    centre = rows.groupBy("shingle").agg(F.max(F.struct(first.alias("first"), *fields)).alias("c")).select("shingle", *[F.col(f"c.{f}").alias(f"c_{f}") for f in fields])
    own = rows.select("shingle", *[F.col(f).alias(f"o_{f}") for f in fields])
    met = sized_join(own, shelf.put("centres", centre), "shingle", "inner").filter(_can_link("o_", "c_", rule))
    counted = (
        met.groupBy("o_doc_id", "c_doc_id")
        .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("o_matches", "c_matches")).alias("asked"))
        .filter("met >= asked")
    )
    # a document has no more centres than prefix entries
    ranked = counted.groupBy("o_doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "c_doc_id")), asc=False), 1, rule.centres).alias("c"))
    return ranked.select("o_doc_id", F.explode("c.c_doc_id").alias("c_doc_id")).select(F.least("o_doc_id", "c_doc_id").alias("a"), F.greatest("o_doc_id", "c_doc_id").alias("b")).distinct()


def verified(shelf: Shelf, docs: DataFrame, pairs: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a, b) of a stored table that link, by their whole sets.

    The sets of the documents in question are stored once; each pair then meets
    them row by row, so a document with very many partners is split like any hot key.
    """

    def sets_of(batches):
        import pyarrow as pa

        for part, sets in _batches(batches, rule.words):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "own"])
        release()

    ends = shelf.put("pair-ends", pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    # rows that repeat a doc_id: either text stands for it
    sets = sized_join(docs, ends, "doc_id", "left_semi").mapInArrow(sets_of, "id bigint, own binary").dropDuplicates(["id"])
    sets = shelf.put("pair-sets", sets)

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            hits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                hits.append(common > 0 and rule.den * common >= rule.num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))
        release()

    left = sets.select(F.col("id").alias("a"), F.col("own").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("set_b"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a bigint, b bigint").distinct()


def packed(nodes: np.ndarray, sets: list[np.ndarray]) -> list[bytes]:
    """A block: its nodes, their sizes, its distinct shingles, and the places of each set's shingles among them."""
    import zlib

    universe, places = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return [nodes.tobytes(), sizes.tobytes(), universe.tobytes(), zlib.compress(places.astype(np.uint32).tobytes(), 1)]


def overlaps(own: list[bytes], other: list[bytes]) -> tuple[np.ndarray, ...]:
    """(nodes, nodes, sizes, sizes, overlap of each with each) of two packed blocks, some thousand shingles at a time."""
    import zlib

    nodes, sizes, universes, places = zip(*[(np.frombuffer(n, np.int64), np.frombuffer(s, np.int64), np.frombuffer(u, np.uint64), np.frombuffer(zlib.decompress(p), np.uint32)) for n, s, u, p in (own, other)])
    _, *shared = np.intersect1d(*universes, assume_unique=True, return_indices=True)
    entries = []
    for k in (0, 1):
        column = np.full(len(universes[k]), -1, np.int64)
        column[shared[k]] = np.arange(len(shared[k]))
        at, row = column[places[k]], np.repeat(np.arange(len(sizes[k])), sizes[k])
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        entries.append((row[order], at[order]))
    both = np.zeros((len(sizes[0]), len(sizes[1])), np.int64)
    for first in range(0, len(shared[0]), 4096):
        wide = min(4096, len(shared[0]) - first)
        part = []
        for (row, at), size in zip(entries, sizes):
            b, e = np.searchsorted(at, [first, first + wide])
            dense = np.zeros((len(size), wide), np.float32)
            dense[row[b:e], at[b:e] - first] = 1
            part.append(dense)
        both += (part[0] @ part[1].T).astype(np.int64)
    return *nodes, *sizes, both


def link_counts(shelf: Shelf, docs: DataFrame, members: DataFrame, rule: JaccardRule) -> DataFrame:
    """(node, n_links): with how many others each of ``members`` (node, root, n) links, every pair within a component being compared."""
    # sets of sizes that may link are in one size class or in two that follow each other
    step = max(math.log(rule.den / rule.num) * 1.000001, 1e-3)
    key = ["root", "size_class", "part"]
    members = members.withColumn("size_class", F.floor(F.log("n") / step))
    parts = members.groupBy("root", "size_class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rule.block), F.ceil(F.sum("n") / rule.block_shingles)).alias("parts"))
    dealt = sized_join(members, shelf.put("link-parts", parts), ["root", "size_class"], "inner")
    dealt = shelf.put("dealt", dealt.select(F.col("node").alias("doc_id"), "root", "size_class", F.pmod(F.xxhash64("node"), "parts").alias("part")))

    def sets_of(batches):
        import pyarrow as pa

        for part, sets in _batches(batches, rule.words):
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", *key, "own"])
        release()

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                # rows that repeat a doc_id: either text stands for it
                held = {m["node"]: m["own"] for m in batch.column(3)[k].as_py()}
                block = packed(np.fromiter(held, np.int64, len(held)), [np.frombuffer(x, np.uint64) for x in held.values()])
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *[pa.array([x], pa.binary()) for x in block]], names=[*key, *fields])
        release()

    def count(two: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(batch.num_rows):
                    block = [c[k].as_py() for c in batch.columns]
                    a, b, n_a, n_b, both = overlaps(block[:4], block[4:] if two else block[:4])
                    linked = (both > 0) & (rule.den * both >= rule.num * (n_a[:, None] + n_b[None, :] - both))
                    if not two:
                        np.fill_diagonal(linked, False)
                    found = [(a, linked.sum(1)), (b, linked.sum(0))] if two else [(a, linked.sum(1))]
                    for nodes, links in found:
                        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64))], names=["node", "links"])
            release()

        return run

    fields = ["nodes", "sizes", "universe", "places"]
    kinds, out = "root bigint, size_class bigint, part bigint", "node bigint, links bigint"
    sets = sized_join(docs, dealt, "doc_id", "inner").select("doc_id", "text", *key).mapInArrow(sets_of, f"node bigint, {kinds}, own binary")
    blocks = sets.groupBy(*key).agg(F.collect_list(F.struct("node", "own")).alias("held")).mapInArrow(pack, f"{kinds}, {', '.join(f'{f} binary' for f in fields)}")
    blocks = shelf.put("blocks", blocks)
    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "lr")
    named = lambda side: [f"{side}_{c}" for c in key]
    follows = (F.col("r_size_class") == F.col("l_size_class") + 1) | ((F.col("r_size_class") == F.col("l_size_class")) & (F.col("r_part") > F.col("l_part")))
    pairs = shelf.put("block-pairs", left.select(*named("l")).join(right.select(*named("r")), (F.col("l_root") == F.col("r_root")) & follows))
    theirs = shelf.put("their-blocks", sized_join(right, shelf.put("their-keys", pairs.select(*named("r")).distinct()), named("r"), "left_semi"))
    met = sized_join(sized_join(left, pairs, named("l"), "inner"), theirs, named("r"), "inner", otherwise="merge")
    across = met.select(*[f"{side}_{f}" for side in "lr" for f in fields]).mapInArrow(count(True), out)
    within = blocks.select(*fields).mapInArrow(count(False), out)
    return within.unionByName(across).groupBy("node").agg(F.sum("links").alias("n_links"))


def similar(docs: DataFrame, rule: JaccardRule = JaccardRule(), count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, n_links.

    ``n_links`` counts the classes (different sets) that the document's class links
    with, all of them; copies of a text aren't counted.  It is null unless asked for.
    """
    docs = docs.select("doc_id", "text")
    shelf = Shelf(docs.sparkSession)
    signed = shelf.put("signatures", signatures(docs, rule))
    # equal sets: one class; the rep is the smallest doc_id
    classes = shelf.put("classes", signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "fp_a", "fp_b").agg(F.min("doc_id").alias("class_id")))
    nodes = shelf.put("nodes", classes.select(F.col("class_id").alias("doc_id")).distinct())
    node_docs = sized_join(docs, nodes, "doc_id", "left_semi")
    counts = shingle_counts(node_docs, rule, shard_bits(docs.rdd.getNumPartitions()))
    rows = shelf.put("prefixes", prefix_rows(node_docs, counts, rule))
    discard(docs.sparkSession, counts.store.uri)
    roots = nodes.select("doc_id", F.col("doc_id").alias("root"))
    links = tried = None
    for draw in (None, *range(rule.rounds)):
        pairs = centre_pairs(shelf, _across(shelf, rows.join(roots, "doc_id")), rule, draw)
        pairs = shelf.put(f"centre-pairs-{draw}", pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        more = verified(shelf, docs, pairs, rule)
        links = shelf.put("links", more if links is None else links.unionByName(more))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = components(links, shelf)
        roots = nodes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
    rest = candidates(_across(shelf, rows.join(roots, "doc_id")), rule).join(tried, ["a", "b"], "left_anti")
    all_links = shelf.put("links", links.unionByName(verified(shelf, docs, shelf.put("pairs", rest), rule)).distinct())
    final = components(all_links, shelf)
    sizes = classes.groupBy(F.col("class_id").alias("node")).agg(F.min("n").alias("n"))
    none = F.lit(0 if count_links else None).cast("bigint")
    met = link_counts(shelf, docs, shelf.put("members", final.join(sizes, "node")), rule) if count_links else final.select("node", none.alias("n_links"))
    placed = shelf.put(
        "placed",
        classes.join(final.join(met, "node", "left").withColumnRenamed("node", "class_id"), "class_id", "left").select(
            F.col("n").alias("c_n"), F.col("fp_a").alias("c_a"), F.col("fp_b").alias("c_b"), "class_id", "root", F.coalesce("n_links", none).alias("n_links")
        ),
    )
    shelf.drop(*[name for name in shelf.paths if name not in ("signatures", "placed")])
    joined = signed.join(
        placed.hint("merge"),
        (F.col("n") == F.col("c_n")) & (F.col("fp_a") == F.col("c_a")) & (F.col("fp_b") == F.col("c_b")) & F.col("doc_id").isNotNull(),
        "left",
    )
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "class_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", none).alias("n_links"),
    )


def keep_one(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; columns as they came.

    Rows that repeat that doc_id are the same document and stay.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("doc_id")]
    dropped = stored(similar(docs, rule, count_links=False).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    inner = docs.toDF(*names)
    return sized_join(inner, dropped, inner[at] == dropped["_dropped"], "left_anti").toDF(*docs.columns)
