"""Deep-shallow sorting of strings, with the common prefixes of neighbours.

Shallow: multikey quicksort on eight-byte characters, three-way partitions of
index arrays.  Deep: a group that still agrees at the shallow depth, or is small,
goes into a blind trie, which keeps only the places where strings part; a string
descends by those, is compared once with the leaf that it meets, and branches
where the two differ.  Reading a trie in order gives the sorted group and, at the
branching nodes, the common prefixes.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 5  # eight-byte characters
SMALL = 24


def common_prefix(a: bytes, b: bytes) -> int:
    """Of two strings of equal length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Nodes are [depth, {byte: node or leaf}]; a leaf is a list of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def add(self, k: int) -> None:
        own = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        path = []
        while isinstance(node, tuple):
            path.append(node)
            depth, below = node
            node = below.get(own[depth]) or next(iter(below.values()))
        shared = common_prefix(own, self.strings[node[0]])
        if shared == len(own):
            node.append(k)
            return
        above = None
        for step in path:
            if step[0] >= shared:
                break
            above = step
        if above is None:
            target = self.root
        else:
            target = above[1].get(own[above[0]])
        if isinstance(target, tuple) and target[0] == shared:
            target[1][own[shared]] = [k]
            return
        sample = target
        while isinstance(sample, tuple):
            sample = next(iter(sample[1].values()))
        new = (shared, {self.strings[sample[0]][shared]: target, own[shared]: [k]})
        if above is None:
            self.root = new
        else:
            above[1][own[above[0]]] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and each one's common prefix with the one before (-1 for the first)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, tuple):
                depth, below = node
                keys = sorted(below)
                for j in range(len(keys) - 1, 0, -1):
                    stack.append((below[keys[j]], depth))
                stack.append((below[keys[0]], before))
            else:
                order += node
                shared += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def sort_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with the row before it (0 for the first)."""
    n, width = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    characters = padded.view(">u8")
    shallow = min(SHALLOW, characters.shape[1])
    order = np.empty(n, np.int64)
    shared = np.zeros(n, np.int64)
    at = 0
    rng = np.random.default_rng(7)
    stack = [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= SMALL or depth >= shallow:
            trie = BlindTrie([rows[k].tobytes() for k in group])
            for k in range(len(group)):
                trie.add(k)
            inner, prefixes = trie.ordered()
            order[at : at + len(group)] = group[inner]
            shared[at : at + len(group)] = prefixes
            shared[at] = -1
            at += len(group)
            continue
        c = characters[group, depth]
        pivot = c[rng.integers(len(c))]
        less, more = c < pivot, c > pivot
        for part, deeper in ((group[more], depth), (group[~less & ~more], depth + 1), (group[less], depth)):
            if len(part):
                stack.append((part, deeper))
    seams = np.flatnonzero(shared < 0)
    seams = seams[seams > 0]
    if len(seams):
        differ = rows[order[seams]] != rows[order[seams - 1]]
        shared[seams] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[0] = 0
    return order, shared
