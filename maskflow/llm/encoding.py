"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words, and only the distinct words are segmented, in Spark:
substrings of bounded length are exploded and joined to the piece table, the
edges that remain are grouped by word (the rows are still dealt by word, so the
grouping needs no further exchange) and a higher-order ``aggregate`` folds the
best cut.  A long word's lattice comes in blocks of ``BLOCK`` ends: the fold goes
over blocks and within them, and carries no more scores than the longest piece has
characters, so its work grows with the word's length and not with the square.

The encodings go to the shared folder as arrays sorted by word hash; workers map
them and encode whole batches of texts by array arithmetic.  Each batch is decoded
and compared with its bytes; a word that differs (two words of one 64-bit hash) is
cut by itself.

Defined results: null and empty texts have no pieces and decode to an empty text;
a space mark in a text is a space, as in the tokenizer; repeated rows each get
their own row; an empty table gives an empty table; other columns pass through,
but a column ``_pieces`` is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.llm.arraystore import Shards, shard_bits
from maskflow.llm.pieces import DEFAULT_MODEL, SPACE, SPACE_BYTES, Decoder, PieceTable, Viterbi, load, spread
from maskflow.llm.shared import Shelf, release, scratch
from maskflow.llm.textbytes import as_bytes, slices, span_hashes

NEWLINE = ord("\n")


#: Distinct words that a task holds before it sends them.
HELD_WORDS = 200_000
RUNS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")


class WordSets:
    """The distinct words of texts: those behind a space without it, and the others."""

    def __init__(self):
        self.spaced: set[bytes] = set()
        self.plain: set[bytes] = set()

    def add(self, text: bytes) -> None:
        text = b" " + text.replace(SPACE_BYTES, b" ")
        if b"  " in text:  # words with several spaces before them
            self.plain.update(RUNS.findall(text))
            return
        lines = text.split(b"\n")
        for line in lines:
            parts = line.split(b" ")
            if parts[0]:
                self.plain.add(parts[0])
            self.spaced.update(parts)  # the first one too: a word more does no harm
        if len(lines) > 1:
            self.plain.add(b"\n")

    def __len__(self) -> int:
        return len(self.spaced) + len(self.plain)

    def all(self) -> list[bytes]:
        return [*{b" " + w for w in self.spaced} | self.plain]


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word): the distinct words of all texts, with spaces turned into marks; a task sends a word once for each load."""

    def emit(batches):
        import pyarrow as pa

        held = WordSets()
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for text in texts:
                    if text:
                        held.add(text)
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.all(), pa.binary()).cast(pa.string())], names=["word"])
                    held = WordSets()
        yield pa.RecordBatch.from_arrays([pa.array(held.all(), pa.binary()).cast(pa.string())], names=["word"])
        del held
        release()

    return docs.select("text").mapInArrow(emit, "word string").distinct().select(F.replace("word", F.lit(" "), F.lit(SPACE)).alias("word"))


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each text, word starts, word ends, first byte of each text)."""
    lead = [b" " + t.replace(SPACE_BYTES, b" ") if t else b"" for t in texts]
    text = np.frombuffer(b"".join(lead), np.uint8)
    sizes = np.fromiter(map(len, lead), np.int64, len(lead))
    begins = np.cumsum(sizes) - sizes
    space, line = text == 32, text == NEWLINE
    edge = line.copy()
    edge[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    edge[begins[sizes > 0]] = True
    starts = np.flatnonzero(edge)
    return text, starts, np.append(starts[1:], len(text)), begins


#: Distinct words in a task's lattice; the number of tasks follows from it.
WORDS_PER_TASK = 30_000
#: Characters of a word whose lattice is folded in one go, and of a block of a longer one.
BLOCK = 64
#: Characters of a long word that are cut out at once, before blocks are cut out of them.
STRETCH = 4096


def _piece_frame(spark, table: PieceTable) -> DataFrame:
    rows = pd.DataFrame(table.pieces, columns=["p_piece", "score", "id"])
    return spark.createDataFrame(rows, "p_piece string, score double, id int").withColumn("p_key", F.xxhash64("p_piece"))


#: An edge is one number: its end, its start, and its id as 32 bits; a step of a cut is that without the end.
END_BIT, START_BIT, START_MASK, STEP_MASK = 40, 32, 255, (1 << 40) - 1


def lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, edges): every edge of a word's lattice as (code, score), by end, then start.

    The join is on a hash of the substring, so that its key is a number, and then on
    the substring itself.  A character that is no piece has the id -1 - code point.
    Words are numbered, so that the grouping finds its rows in order.
    """
    pieces = F.broadcast(_piece_frame(words.sparkSession, table))  # a vocabulary: its size doesn't follow the data
    numbered = words.select("word", F.monotonically_increasing_id().alias("number"))
    ends = numbered.select("number", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    first = F.greatest(F.lit(0), F.col("end") - table.longest)
    substrings = ends.select("number", "word", "end", F.explode(F.sequence(first, F.col("end") - 1)).alias("start")).withColumn(
        "piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start"))
    )
    met = substrings.withColumn("key", F.xxhash64("piece")).join(pieces, F.col("key") == F.col("p_key"), "left")
    same = F.coalesce(F.col("piece") == F.col("p_piece"), F.lit(False))
    edges = met.filter(same | (F.col("start") + 1 == F.col("end")))
    number = F.when(same, F.col("id")).otherwise(-1 - F.ascii("piece")).cast("bigint") + (1 << 31)
    code = F.shiftleft(F.col("end").cast("bigint"), END_BIT) + F.shiftleft(F.col("start").cast("bigint"), START_BIT) + number
    edge = F.struct(code.alias("code"), F.when(same, F.col("score")).otherwise(F.lit(table.unknown_score)).alias("score"))
    return edges.groupBy("number", "word").agg(F.sort_array(F.collect_list(edge)).alias("edges")).select("word", "edges")


def _met(substrings: DataFrame, table: PieceTable) -> DataFrame:
    """The substrings (piece, len) that are pieces, with p_score and p_id; single characters stay in any case."""
    pieces = F.broadcast(_piece_frame(substrings.sparkSession, table)).select("p_piece", "p_key", F.col("score").alias("p_score"), F.col("id").alias("p_id"))
    return substrings.withColumn("p_hash", F.xxhash64("piece")).join(pieces, (F.col("p_hash") == F.col("p_key")) & (F.col("piece") == F.col("p_piece")), "left").filter(
        F.col("p_id").isNotNull() | (F.col("len") == 1)
    )


def long_lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(key, blocks) of long words (key, word): each block has the edges that end in it, as (end, start, score, id)."""
    over = table.longest - 1  # an edge reaches so far beyond the block it begins in

    def cut(text: str, size: int):
        """(number, part) of a text's parts of ``size`` characters that overlap the next by ``over``."""
        places = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
        return F.inline(F.transform(places, lambda k: F.struct(k.alias("number"), F.substring(F.col(text), k * size + 1, F.lit(size + over)).alias("part"))))

    stretches = words.select("key", cut("word", STRETCH)).select("key", F.col("number").alias("stretch"), F.col("part").alias("rest"))
    # a stretch's last blocks can lie in its overlap alone: they are the next one's
    parts = stretches.select("key", "stretch", cut("rest", BLOCK)).filter(F.col("number") < STRETCH // BLOCK)
    begun = parts.select("key", (F.col("stretch") * STRETCH + F.col("number") * BLOCK).alias("base"), "part")
    starts = begun.select("key", "base", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("part")))).alias("at"))
    substrings = starts.select(
        "key", "base", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.length("part") - F.col("at") + 1))).alias("len"), "part"
    ).select("key", (F.col("base") + F.col("at") - 1).alias("start"), "len", F.substring("part", F.col("at"), F.col("len")).alias("piece"))
    edge = F.struct(
        (F.col("start") + F.col("len")).alias("end"),
        "start",
        F.coalesce("p_score", F.lit(table.unknown_score)).alias("score"),
        F.coalesce("p_id", -1 - F.ascii("piece")).alias("id"),
    )
    block = F.floor((F.col("start") + F.col("len") - 1) / BLOCK).cast("int").alias("block")
    blocks = _met(substrings, table).groupBy("key", block).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "edges"))).alias("blocks"))


def best_long_cuts(lattices: DataFrame, longest: int) -> DataFrame:
    """(key, ids): the best cuts of long words; two nested folds forward, two back."""
    step, top = "struct<start:int,id:int>", "struct<score:double,start:int,id:int>"
    nothing = F.struct(F.lit(float("-inf")).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")).cast(top)

    def over_block(acc: Column, b: Column) -> Column:
        def grow(a: Column, e: Column) -> Column:
            same = a["end"] == e["end"]
            scores = F.when(same, a["scores"]).otherwise(F.array_append(a["scores"], a["top"]["score"]))
            back = F.struct(a["top"]["start"].alias("start"), a["top"]["id"].alias("id")).cast(step)
            backs = F.when(same, a["backs"]).otherwise(F.array_append(a["backs"], back))
            before = F.when(e["start"] == a["end"], a["top"]["score"]).otherwise(F.get(a["scores"], e["start"] - acc["base"]))
            score = before + e["score"]
            own = F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id")).cast(top)
            best = F.when(same & (score <= a["top"]["score"]), a["top"]).otherwise(own)
            return F.struct(scores.alias("scores"), backs.alias("backs"), e["end"].alias("end"), best.alias("top"))

        begin = F.struct(
            acc["scores"].alias("scores"),
            F.array().cast(f"array<{step}>").alias("backs"),
            (b["block"] * BLOCK + 1).cast("int").alias("end"),
            nothing.alias("top"),
        )

        def end(a: Column) -> Column:
            scores = F.array_append(a["scores"], a["top"]["score"])
            kept = F.slice(scores, F.greatest(F.size(scores) - longest + 1, F.lit(1)), F.lit(longest))
            back = F.struct(a["top"]["start"].alias("start"), a["top"]["id"].alias("id")).cast(step)
            return F.struct(
                kept.alias("scores"),
                (acc["base"] + F.greatest(F.size(scores) - longest, F.lit(0))).cast("int").alias("base"),
                F.array_append(acc["done"], F.array_append(a["backs"], back)).alias("done"),
            )

        return F.aggregate(b["edges"], begin, grow, end)

    begin = F.struct(F.array(F.lit(0.0)).alias("scores"), F.lit(0).alias("base"), F.array().cast(f"array<array<{step}>>").alias("done"))
    path = F.aggregate("blocks", begin, over_block)["done"]

    def back_over(acc: Column, b: Column) -> Column:
        first = b["number"] * BLOCK

        def one(a: Column, _: Column) -> Column:
            at = F.get(b["steps"], a["at"] - first - 1)
            more = F.struct(at["start"].alias("at"), F.array_append(a["ids"], at["id"]).alias("ids"))
            return F.when(a["at"] <= first, a).otherwise(more)

        begin = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b["steps"])),
            begin,
            one,
            lambda a: F.struct(a["at"].alias("at"), F.array_append(acc["parts"], a["ids"]).alias("parts")),
        )

    numbered = lattices.select("key", path.alias("done")).select(
        "key",
        F.transform("done", lambda steps, k: F.struct(k.alias("number"), steps.alias("steps"))).alias("numbered"),
        ((F.size("done") - 1) * BLOCK + F.size(F.element_at("done", -1))).alias("n"),
    )
    begin_back = F.struct(F.col("n").alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    parts = F.aggregate(F.reverse("numbered"), begin_back, back_over)["parts"]
    return numbered.select("key", F.reverse(F.flatten(parts)).alias("ids"))


def best_cuts(lattices: DataFrame) -> DataFrame:
    """(word, ids): the best cut.

    The fold carries the best score and step into every place before the current
    end, and the best so far into that end; edges come by end, then start, and a
    later one must be strictly better.
    """
    begin = F.struct(
        F.array(F.lit(0.0)).alias("scores"),
        F.array().cast("array<bigint>").alias("steps"),
        F.lit(1).cast("bigint").alias("end"),
        F.lit(float("-inf")).alias("top"),
        F.lit(0).cast("bigint").alias("step"),
    )

    def grow(acc: Column, e: Column) -> Column:
        end = F.shiftright(e["code"], END_BIT)
        start = F.shiftright(e["code"], START_BIT).bitwiseAND(START_MASK).cast("int")
        step = e["code"].bitwiseAND(STEP_MASK)
        in_place = F.get(acc["scores"], start) + e["score"]
        better = F.struct(acc["scores"].alias("scores"), acc["steps"].alias("steps"), acc["end"].alias("end"), in_place.alias("top"), step.alias("step"))
        before = F.when(start == acc["end"], acc["top"]).otherwise(F.get(acc["scores"], start))
        further = F.struct(
            F.array_append(acc["scores"], acc["top"]).alias("scores"),
            F.array_append(acc["steps"], acc["step"]).alias("steps"),
            end.alias("end"),
            (before + e["score"]).alias("top"),
            step.alias("step"),
        )
        return F.when(acc["end"] != end, further).when(in_place > acc["top"], better).otherwise(acc)

    folded = lattices.select("word", F.aggregate("edges", begin, grow, lambda acc: F.array_append(acc["steps"], acc["step"])).alias("steps"))
    n = F.size("steps")
    back = F.aggregate(
        "steps",
        F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda acc, _: F.when(acc["at"] <= 0, acc).otherwise(
            F.struct(
                F.shiftright(F.get("steps", acc["at"] - 1), 32).cast("int").alias("at"),
                F.array_append(acc["ids"], (F.get("steps", acc["at"] - 1) % (1 << 32) - (1 << 31)).cast("int")).alias("ids"),
            )
        ),
    )
    return folded.select("word", F.reverse(back["ids"]).alias("ids"))


def store_lexicon(cuts: DataFrame, uri: str, bits: int, bytes_from: int) -> Shards:
    """Write (word, ids) as arrays sorted by word hash; shard by shard, in tasks."""
    shards = Shards(uri, bits, ("offset", "count"))

    def hashed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def plain(ids):
            return ids if min(ids) >= 0 else [i for k in ids for i in ([k] if k >= 0 else [bytes_from + x for x in chr(-1 - k).encode()])]

        for batch in batches:
            raw = [w.replace(SPACE_BYTES, b" ") for w in as_bytes(batch.column(0))]
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
            ids = batch.column(1)
            if ids.flatten().to_numpy().min(initial=0) < 0:
                ids = pa.array([plain(x) for x in ids.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards.shard_of(hashes).astype(np.int32)), pa.array(hashes.view(np.int64)), pc.cast(ids, pa.list_(pa.int32()))], names=["shard", "hash", "ids"]
            )

    def write(key, table):
        import pyarrow as pa

        hashes = table.column("hash").to_numpy().view(np.uint64)
        ids = table.column("ids").combine_chunks()
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        starts = ids.offsets.to_numpy()[:-1].astype(np.int64)
        flat = ids.values.to_numpy()
        order = np.argsort(hashes, kind="stable")
        s = int(key[0].as_py())
        counts, starts = counts[order], starts[order]
        shards.store.write(f"{s}-ids", flat[spread(starts, counts)].astype(np.uint16 if len(flat) == 0 or flat.max() < 65536 else np.int32))
        shards.write(s, hashes[order], np.cumsum(counts) - counts, counts.astype(np.uint16 if len(counts) == 0 or counts.max() < 65536 else np.int64))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(hashes)], pa.int64())})

    rows = cuts.mapInArrow(hashed, "shard int, hash bigint, ids array<int>")
    rows.groupBy("shard").applyInArrow(write, "shard int, n bigint").agg(F.sum("n")).collect()
    return shards


class Encoder:
    """Encodes groups of texts by the mapped lexicon."""

    def __init__(self, table: PieceTable, shards: Shards):
        self.table, self.shards = table, shards
        self.decoder, self.viterbi = Decoder(table), None

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids, decoded bytes equal to the text's)."""
        text, starts, ends, begins = cut_words(texts)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
        codes, found_order = pd.factorize(span_hashes(text, starts, ends))
        order = np.argsort(found_order)
        distinct, rank = found_order[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[codes]
        found, pools, counts = self._known(distinct)
        for k in np.flatnonzero(~found).tolist():  # none, where the lexicon is of these texts
            at = int(np.argmax(which == k))
            own = self._own(text[starts[at] : ends[at]])
            pools.append((np.array([k]), own, np.array([0])))
            counts[k] = len(own)
        # one pool of ids for the distinct words of this group
        pool_at = np.cumsum(counts) - counts
        pool = np.empty(int(counts.sum()), np.int32)
        for ks, own, at in pools:
            pool[spread(pool_at[ks], counts[ks])] = own[spread(at, counts[ks])]
        lengths = counts[which]
        ids = pool[spread(pool_at[which], lengths)]
        word_end = np.concatenate([[0], np.cumsum(lengths)])
        offsets = word_end[np.searchsorted(starts, np.append(begins, len(text)))]
        same = np.array_equal(self.decoder(ids), text)
        if not same:
            ids, word_end = self._repaired(text, starts, ends, ids, word_end)
            offsets = word_end[np.searchsorted(starts, np.append(begins, len(text)))]
            same = np.array_equal(self.decoder(ids), text)
        ok = np.ones(len(texts), bool) if same else np.array([np.array_equal(self.decoder(ids[a:b]), text[c:d]) for a, b, c, d in zip(offsets[:-1], offsets[1:], begins, np.append(begins[1:], len(text)))])
        return ids, offsets, ok

    def _own(self, word: np.ndarray) -> np.ndarray:
        """The ids of a single word."""
        if self.viterbi is None:
            self.viterbi = Viterbi(self.table)
        return np.array(self.viterbi.encode(word.tobytes().decode("utf-8").replace(" ", SPACE)), np.int32)

    def _repaired(self, text, starts, ends, ids, word_end):
        """ids and ends of words, with those of words that decode to other bytes put right."""
        parts = [ids[a:b] for a, b in zip(word_end[:-1], word_end[1:])]
        for k, part in enumerate(parts):
            word = text[starts[k] : ends[k]]
            if not np.array_equal(self.decoder(part), word):
                parts[k] = self._own(word)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _known(self, distinct: np.ndarray):
        found, at, counts = self.shards.look_up(distinct)
        counts, at, pools = counts.astype(np.int64), at.astype(np.int64), []
        for s, b, e in self.shards.runs(distinct):
            ks = np.flatnonzero(found[b:e]) + b
            if len(ks):
                pools.append((ks, self.shards.array(s, "ids"), at[ks]))
        return found, pools, counts


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with a struct ``_pieces`` of ids, n_pieces and round_trip (decoding gives the text again)."""
    spark = docs.sparkSession
    table = load(model)
    bits = shard_bits(docs.rdd.getNumPartitions())
    shelf = Shelf(spark)
    words = shelf.put("words", distinct_words(docs))
    short = words.filter(F.length("word") <= BLOCK)
    dealt = short.repartition(words.count() // WORDS_PER_TASK + 1, "word")
    cuts = best_cuts(lattice(dealt, table))
    long = shelf.put("long-words", words.filter(F.length("word") > BLOCK).select(F.monotonically_increasing_id().alias("key"), "word"))
    if not long.isEmpty():
        found = best_long_cuts(long_lattice(long, table), table.longest)
        cuts = cuts.unionByName(long.join(found, "key").select("word", "ids"))
    shards = store_lexicon(cuts, scratch(spark, "lexicon"), bits, table.bytes_from)
    shelf.drop("words", "long-words")
    return encode_with(docs, table, shards.store.uri, bits)


def encode_with(docs: DataFrame, table: PieceTable, uri: str, bits: int) -> DataFrame:
    """Encode by a lexicon that is already stored."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_pieces"])
    names = docs.columns
    at = names.index("text")
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value, Shards(uri, bits, ("offset", "count")))
        for batch in batches:
            for b, e, texts in slices(batch.column(at)):
                ids, offsets, ok = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                part = batch.slice(b, e - b)
                pieces = pa.StructArray.from_arrays([lists, pa.array(np.diff(offsets)), pa.array(ok)], names=["ids", "n_pieces", "round_trip"])
                yield pa.RecordBatch.from_arrays([*part.columns, pieces], names=[*[f"c{i}" for i in range(len(names))], "_pieces"])
        del encoder
        release()

    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField("_pieces", kind)])
    done = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, inner)
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "_pieces")


def decode_ids(encoded: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of an array of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    out = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else decoder(np.array(x, np.int64)).tobytes()[1:].decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, out)
