"""Token counts by a count-only Viterbi pass.

For each word an Aho-Corasick automaton lists the vocabulary's pieces and dynamic
programming carries the best score and the number of pieces; no cut is kept.
Words recur, so each worker remembers the counts of the last words of up to
``REMEMBERED`` characters: when ``memory`` new ones have come, those not seen since the
time before are forgotten.

Defined results: null and empty texts have no tokens; a space mark in a text
counts as a space; repeated rows each get their own row; an empty table gives an
empty table; other columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maskflow.llm.pieces import DEFAULT_MODEL, SPACE, PieceTable, Viterbi, load

#: Longest word, in characters, whose count is remembered.
REMEMBERED = 64
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def words(text: str) -> list[str]:
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Counter:
    def __init__(self, table: PieceTable, memory: int):
        self.viterbi, self.memory, self.known, self.older = Viterbi(table), memory, {}, {}

    def __call__(self, text: str | None) -> tuple[int, float]:
        known, older, tokens, score = self.known, self.older, 0, 0.0
        for w in words(text or ""):
            got = known.get(w)
            if got is None and len(w) > REMEMBERED:
                got = self.viterbi.count(w)
            elif got is None:
                if len(known) >= self.memory:
                    older = self.older = known
                    known = self.known = {}
                got = known[w] = older.get(w) or self.viterbi.count(w)
            tokens += got[0]
            score += got[1]
        return tokens, score


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, memory: int = 300_000) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens, score (of the best cut)."""
    table = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size doesn't follow the data
    out = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_chars", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches):
        import pyarrow as pa

        count = Counter(table.value, memory)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counted = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([n for n, _ in counted], pa.int64()),
                    pa.array([s for _, s in counted], pa.float64()),
                ],
                names=out.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)
