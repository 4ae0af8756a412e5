"""Segmentation of many words at once by a byte-pair model, in arrays.

The automaton of ``pieces`` and its dynamic programme, a character of all words at a
time: states, fail links and output links are arrays, transitions and known pairs
stand in hash tables that answer for many keys at once.
"""

import numpy as np

from harbor.llm.pieces import PAIR, PieceModel
from harbor.llm.recent import in_rows

LONGEST = 64  # longer words are segmented one by one
KNOWN_PAIRS = 1 << 19
CHARACTER = 21  # bits of a code point


class Table:
    """Numbers by whole keys, for many keys at once; open addressing, at most half full."""

    EMPTY = np.iinfo(np.int64).min

    def __init__(self, most: int):
        bits = max(4, (2 * most - 1).bit_length())
        self.most, self.size = most, 0
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that is not there."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        rest = np.flatnonzero((there != keys) & (there != self.EMPTY))
        slots = slots[rest]
        while len(rest):
            slots = (slots + 1) & self.mask
            there, own = self.keys[slots], keys[rest]
            hit = there == own
            out[rest[hit]] = self.values[slots[hit]]
            more = ~hit & (there != self.EMPTY)
            rest, slots = rest[more], slots[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == self.EMPTY
            self.keys[slots[free]] = keys[free]  # of several one gets the place
            own = self.keys[slots] == keys
            self.values[slots[own]] = values[own]
            keys, values, slots = keys[~own], values[~own], (slots[~own] + 1) & self.mask


class SideBySide:
    """Prefix counts of words by a byte-pair model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.length = np.array(model.length, np.int64)
        nodes: dict[int, int] = {}
        parents, depths, own = [0], [0], [-1]
        for piece, number in model.piece_id.items():
            node = 0
            for depth, char in enumerate(piece):
                key = node << CHARACTER | ord(char)
                node = nodes.get(key)
                if node is None:
                    node = nodes[key] = len(own)
                    parents.append(key)
                    depths.append(depth + 1)
                    own.append(-1)
            own[node] = number
        keys, depth = np.array(parents, np.int64), np.array(depths)
        self.own = np.array(own, np.int64)  # the piece that a node spells
        self.moves = Table(len(own))
        self.moves.add(keys[1:], np.arange(1, len(own), dtype=np.int32))
        self.fail = np.zeros(len(own), np.int64)
        self.out = np.where(self.own >= 0, np.arange(len(own)), 0)  # the longest node with a piece that ends where a node does
        self.next = np.zeros(len(own), np.int64)  # the next shorter one
        for level in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == level)
            if level > 1:
                self.fail[at] = self._step(self.fail[keys[at] >> CHARACTER], keys[at] & (1 << CHARACTER) - 1)
            self.next[at] = self.out[self.fail[at]]
            self.out[at] = np.where(self.own[at] >= 0, at, self.next[at])
        self.pairs = Table(KNOWN_PAIRS)

    def _step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        found = self.moves.of(states << CHARACTER | chars).astype(np.int64)
        rest = np.flatnonzero((found < 0) & (states > 0))
        at = states[rest]
        while len(rest):
            at = self.fail[at]
            found[rest] = self.moves.of(at << CHARACTER | chars[rest])
            more = (found[rest] < 0) & (at > 0)
            rest, at = rest[more], at[more]
        return np.maximum(found, 0)

    def _apart(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether merging leaves each ``left`` and ``token`` as they are."""
        keys = left * PAIR + token
        known = self.pairs.of(keys)
        if (known < 0).any():
            new, first, which = np.unique(keys[known < 0], return_index=True, return_inverse=True)
            lefts, tokens = left[known < 0][first].tolist(), token[known < 0][first].tolist()
            tested = np.fromiter(map(self.model.left_apart, lefts, tokens), np.int32, len(new))
            if self.pairs.size + len(new) > KNOWN_PAIRS:
                self.pairs = Table(KNOWN_PAIRS)
            if len(new) <= KNOWN_PAIRS:
                self.pairs.add(new, tested)
            known[known < 0] = tested[which]
        return known > 0

    def prefix_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of the prefixes of 0, 1, ... characters of each word, as it stands in the marked text, in a row, and how many these are of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        long = np.count_nonzero(sizes > LONGEST)
        tables = [np.array(self.model.lattice(words[at])[1], np.int32) for at in order[:long].tolist()]
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        tables.append(self._counts(points, (np.cumsum(sizes) - sizes)[order[long:]], sizes[order[long:]]))
        begins = np.empty(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order] + 1) - sizes[order] - 1
        return in_rows(np.concatenate(tables), begins, sizes + 1), sizes + 1

    def _counts(self, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same of words that stand in ``points``, longer ones first."""
        width, longest = len(begins), int(lengths.max(initial=0))
        last, count = np.zeros((longest + 1, width), np.int64), np.zeros((longest + 1, width), np.int32)
        state = np.zeros(width, np.int64)
        for end in range(1, longest + 1):
            n = int(np.searchsorted(-lengths, -end, "right"))  # words of that many characters
            char = points[begins[:n] + end - 1]
            state = self._step(state[:n], char)
            node = self.out[state]
            at = np.flatnonzero(node)
            node = node[at]
            while len(at):  # longer pieces first
                token = self.own[node]
                begin = end - self.length[token]
                apart = self._apart(last[begin, at], token)
                won = at[apart]
                last[end, won] = token[apart]
                count[end, won] = count[begin[apart], won] + 1
                node, at = self.next[node[~apart]], at[~apart]
                node, at = node[node > 0], at[node > 0]
            self._fill(last, count, end, np.flatnonzero(last[end, :n] == 0), char)
        return count.T[np.arange(longest + 1) <= lengths[:, None]]

    def _fill(self, last: np.ndarray, count: np.ndarray, end: int, at: np.ndarray, char: np.ndarray) -> None:
        """Prefixes that no piece ends have a single character last, as in ``PieceModel``."""
        if not len(at):
            return
        char = char[at]
        node = self.moves.of(char)
        token = np.where(node > 0, self.own[node], -1)
        size = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        last[end, at] = np.where(token < 0, -1 - char, token)
        count[end, at] = count[end - 1, at] + np.where(token < 0, size, 1)
