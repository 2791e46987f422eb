"""Piece tables of public tokenizers, and unigram segmentation over them.

The table (pieces with scores, byte pieces for characters that no piece covers)
is read as a unigram vocabulary: a text is cut so that the sum of scores is
largest.  Tie rule of the tokenizer: of equal sums the cut whose last piece
begins earliest stays, as a later candidate must be strictly better.  A character
that is no piece of its own can be passed at the least score less 10 and is
written as its UTF-8 bytes.  Sums are exact in doubles for integer scores.

No piece crosses a word's beginning (the space mark after another character) or a
line break, so words can be cut on their own; :func:`load` checks that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class PieceTable:
    """``pieces``: (piece, score, id); ``bytes_from``: id of byte 0; ``texts``: the bytes each id stands for, spaces plain."""

    pieces: tuple[tuple[str, float, int], ...]
    bytes_from: int
    unknown_score: float
    longest: int
    texts: tuple[bytes, ...] = field(repr=False)


def load(model: str = DEFAULT_MODEL) -> PieceTable:
    """The piece table of a SentencePiece model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, texts, bytes_from = [], [], None
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_from = i if bytes_from is None else bytes_from
            if piece != f"<0x{i - bytes_from:02X}>":
                raise ValueError("byte pieces must be in order")
            texts.append(bytes([i - bytes_from]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece crosses words: {piece!r}")
            pieces.append((piece, sp.get_score(i), i))
            texts.append(piece.replace(SPACE, " ").encode())
    if bytes_from is None:
        raise ValueError("a table with byte pieces is needed")
    return PieceTable(
        tuple(pieces), bytes_from, min(s for _, s, _ in pieces) - UNKNOWN_PENALTY, max(len(p) for p, _, _ in pieces), tuple(texts)
    )


class Viterbi:
    """Best cuts of single words; an Aho-Corasick automaton lists the pieces that occur."""

    def __init__(self, table: PieceTable):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for piece, score, number in table.pieces:
            self.automaton.add_word(piece, (len(piece), score, number))
        self.automaton.make_automaton()

    def _ends(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each character the pieces that end there, longest first."""
        ends: list[list] = [[] for _ in word]
        for end, hit in self.automaton.iter(word):
            ends[end].append(hit)
        for hits in ends:
            if len(hits) > 1:
                hits.sort(key=lambda h: -h[0])
        return ends

    def count(self, word: str) -> tuple[int, float]:
        """(number of pieces, best score); no cut is kept."""
        unknown, lowest = self.table.unknown_score, float("-inf")
        best, counts = [0.0], [0]
        at, top, n, length_before = 0, lowest, 0, 0
        # the automaton gives the pieces by their ends, the longest of an end first
        for end, (length, score, _) in self.automaton.iter(word):
            while at < end:
                if length_before != 1:
                    s = best[at] + unknown
                    if s > top:
                        top, n = s, counts[at] + len(word[at].encode())
                best.append(top)
                counts.append(n)
                at += 1
                top, n, length_before = lowest, 0, 0
            start = end + 1 - length
            s = best[start] + score
            if s > top:
                top, n = s, counts[start] + 1
            length_before = length
        while at < len(word):
            if length_before != 1:
                s = best[at] + unknown
                if s > top:
                    top, n = s, counts[at] + len(word[at].encode())
            best.append(top)
            counts.append(n)
            at += 1
            top, n, length_before = lowest, 0, 0
        return counts[-1], best[-1]

    def encode(self, word: str) -> list[int]:
        unknown, zero = self.table.unknown_score, self.table.bytes_from
        best, back = [0.0], [(0, -1)]
        for e, hits in enumerate(self._ends(word)):
            top, how = float("-inf"), (e, -1)
            for length, score, number in hits:
                s = best[e + 1 - length] + score
                if s > top:
                    top, how = s, (e + 1 - length, number)
            if not hits or hits[-1][0] != 1:
                s = best[e] + unknown
                if s > top:
                    top, how = s, (e, -1)
            best.append(top)
            back.append(how)
        out: list[int] = []
        at = len(word)
        while at:
            start, number = back[at]
            out += [number] if number >= 0 else [zero + b for b in reversed(word[start:at].encode())]
            at = start
        return out[::-1]


def decode(table: PieceTable, ids) -> bytes:
    """The text of a sequence of ids, without the space that encoding puts before it."""
    return b"".join(table.texts[i] for i in ids)[1:]


class Decoder:
    """Bytes of many ids at once."""

    def __init__(self, table: PieceTable):
        self.blob = np.frombuffer(b"".join(table.texts), np.uint8)
        self.length = np.fromiter(map(len, table.texts), np.int64, len(table.texts))
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[spread(self.start[ids], self.length[ids])]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
