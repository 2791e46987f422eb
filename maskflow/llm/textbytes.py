"""Words of many texts at once: offsets and 64-bit hashes by whole-array arithmetic.

Texts are taken as UTF-8 bytes.  A byte table maps separators to a space and A-Z
to a-z, so words are runs of other bytes.  The hash of a word of up to ``SHORT``
bytes is a polynomial in its bytes modulo 2**64, read off prefix sums, then mixed
with its length.  Such polynomials agree for some long strings that differ (the
Thue-Morse ones, from about 512 bytes), so longer words have their XXH3.  Different
words share a 64-bit hash by chance alone, about once in 2**64 pairs.  Work goes
in slices of about a megabyte that end at separators; memory follows the slice,
not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
#: Longest word, in bytes, whose hash is a polynomial.
SHORT = 64
_BASE = 0x9E3779B97F4A7C55  # odd
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(separator) -> bytes:
    return bytes(32 if separator(c) else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: words: everything but white space
PLAIN = _table(lambda c: c == 32 or 9 <= c <= 13)
#: words: ASCII letters and digits and all other characters beyond ASCII
ALNUM = _table(lambda c: c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of each at least."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b ^ np.uint64(0xA0761D6478BD642F)))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**place; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) from their prefix sums."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't a space."""
    inside = np.empty(len(text) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(text, 32, out=inside[1:-1].view(bool))
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def hashed_words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of mapped bytes."""
    starts, ends = word_spans(text)
    return starts, ends, span_hashes(text, starts, ends)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of disjoint spans in order, slice by slice."""
    import xxhash

    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        stop = int(np.searchsorted(ends, base + SLICE, "right"))
        if stop > k:
            prefix = prefix_hash(text[base : ends[stop - 1]])
            hashes[k:stop] = span_hash(prefix, starts[k:stop] - base, ends[k:stop] - base)
        k = max(stop, k + 1)  # a word beyond a slice is a long one
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    return hashes


class Words:
    """Words of a group of texts: ``hashes`` in order; text i has hashes[first[i]:first[i + 1]]."""

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(texts).translate(table)
        self.buffer = np.frombuffer(joined, np.uint8)
        self.starts, self.ends, self.hashes = hashed_words(self.buffer)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.offsets)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes, nulls as empty ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in pc.cast(column, kind).to_pylist()] if column.null_count else pc.cast(column, kind).to_pylist()


def groups(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` bytes each, one item at least."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(column, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(begin, end, texts) of consecutive parts of an Arrow string column, of about ``most`` bytes each; one at a time is held."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for b, e in groups(sizes, most):
        yield b, e, as_bytes(column.slice(b, e - b))
