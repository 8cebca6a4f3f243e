"""Context-tree weighting over bytes, in numpy.

A byte is eight binary decisions. For each decision (the bits of the byte so far) there is a tree of contexts:
the preceding bytes, up to DEPTH of them. Every node has a Krichevsky-Trofimov estimate of its own counts and
is weighted, one half each, against the product of its children; the weights after all training data mix the
estimates of all depths. As a byte with its context fixes all its nodes, the mixture is one number for each
code, a byte with its context. Codes that are only scored stand in the tree with the count 0, so their nodes
without data give one half, and bytes never seen after a context need no rule of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

DEPTH = 5
#: Depths before it are one small table (65,536 contexts with a byte at most); from it on, all codes of one context of SPLIT bytes are weighted together.
SPLIT = 2
#: Stands before the first byte and after the last; 0xFF occurs in no UTF-8 text.
START, END = b"\0", b"\xff"
PIECE = 1 << 20


def pieces(texts: Iterable[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner) in pieces of about PIECE bytes: each byte's context and itself packed into a number, and its text's position.

    The number's lowest byte is the byte itself, the next ones are those before it, nearest first.
    """
    chunk, owners, size = [], [], 0

    def packed():
        data = np.frombuffer(b"".join(chunk), np.uint8)
        own = np.repeat(np.array([o for o, _ in owners]), [n for _, n in owners])
        codes = np.zeros(len(data) - depth, np.int64)
        for k in range(depth + 1):
            codes |= data[depth - k : len(data) - k].astype(np.int64) << (8 * k)
        own = own[depth:]
        return codes[own >= 0], own[own >= 0]

    for number, text in enumerate(texts):
        text = text + END
        for at in range(0, len(text), PIECE):
            before = (START * depth + text[max(0, at - depth) : at])[-depth:]
            part = text[at : at + PIECE]
            chunk += [before, part]
            owners += [(-1, depth), (number, len(part))]
            size += len(part)
            if size >= PIECE:
                yield packed()
                chunk, owners, size = [], [], 0
    if chunk:
        yield packed()


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series eight steps higher."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Table:
    """Numbers by 63-bit key: tables of falling size, each holding what found its place taken in those before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(1.4 * len(keys)))))
            place = self._place(keys, bits, len(self.levels))
            held = np.full(1 << bits, -1, np.int64)
            held[place] = keys
            kept = held[place] == keys
            numbers = np.zeros(1 << bits, np.float32)
            numbers[place[kept]] = values[kept]
            self.levels.append((bits, held, numbers))
            keys, values = keys[~kept], values[~kept]

    @staticmethod
    def _place(keys, bits, level):
        odd = np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * level) & (2**64 - 1) | 1)
        return ((keys.view(np.uint64) * odd) >> np.uint64(64 - bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, and whether each key is there."""
        out, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        for level, (bits, held, numbers) in enumerate(self.levels):
            place = self._place(keys[rest], bits, level)
            here = held[place] == keys[rest]
            out[rest[here]] = numbers[place[here]]
            known[rest[here]] = True
            rest = rest[~here]
            if not len(rest):
                break
        return out, known


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def low(codes: np.ndarray, depth: int) -> np.ndarray:
    """The codes with so many bytes of context only."""
    return codes & ((1 << (8 * (depth + 1))) - 1)


class Tree:
    """The depths from first to last of the tree: sorted codes of last bytes of context, and how often each was learned (0: only scored)."""

    def __init__(self, codes: np.ndarray, numbers: np.ndarray, first: int = 0, last: int = DEPTH):
        self.first, self.codes, self.numbers, self.up = first, [codes], [numbers.astype(float)], [None]
        for d in range(last - 1, first - 1, -1):
            shorter, up = np.unique(low(self.codes[0], d), return_inverse=True)
            self.numbers.insert(0, np.bincount(up, self.numbers[0], len(shorter)))
            self.codes.insert(0, shorter)
            self.up.insert(1, up.astype(np.int32))

    def _nodes(self, k: int, below=None):
        """For each depth: each code's node, the estimate of its bit k there, and the nodes' weights of stopping; and (first code, logs) of the first depth's nodes.

        below, if given, has the logs one depth under the last: (node of the last depth, logs), summed by node.
        """
        out, deeper = [], None
        for d in reversed(range(len(self.codes))):
            codes, numbers = self.codes[d], self.numbers[d]
            at = _starts(codes >> (8 - k))
            of = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(codes)]))
            bit = ((codes >> (7 - k)) & 1).astype(bool)
            total = np.add.reduceat(numbers, at)
            ones = np.add.reduceat(np.where(bit, numbers, 0), at)
            own = log_kt(total - ones, ones)
            if deeper is not None:
                parent, logs = of[self.up[d + 1][deeper[0]]], deeper[1]
            elif below is not None:
                parent, logs = np.searchsorted(codes[at] >> (8 - k), below[0]), below[1]
            else:
                parent = None
            if parent is None:
                weighted, weight = own, np.ones(len(at))
            else:
                weighted = np.logaddexp(own, np.bincount(parent, logs, len(at))) + np.log(0.5)
                weight = np.exp(np.minimum(0, own + np.log(0.5) - weighted))
            out.append((of, np.where(bit, ((ones + 0.5) / (total + 1))[of], ((total - ones + 0.5) / (total + 1))[of]), weight))
            deeper = (at, weighted)
        return out[::-1], deeper

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(k, node, logs, total): of bit k, the first depth's nodes summed by the node above; k is 8 for numbers by code of the depth above."""
        out = []
        above = low(self.codes[0], self.first - 1)
        for k in range(8 if len(above) else 0):
            at, logs = self._nodes(k)[1]
            node, of = np.unique(above[at] >> (8 - k), return_inverse=True)
            out.append((np.full(len(node), k), node, np.bincount(of, logs, len(node)), np.zeros(len(node))))
        node, of = np.unique(above, return_inverse=True)
        out.append((np.full(len(node), 8), node, np.zeros(len(node)), np.bincount(of, self.numbers[0], len(node))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def mixed(self, entering=None, below=None) -> tuple[np.ndarray, list]:
        """The log2 probability of each code's byte after its context, and for each bit k what the last depth passes on: (mixed, left) of its codes.

        entering[k] has what the depth before the first passes to the first one's codes.
        """
        bits, passed = np.zeros(len(self.codes[-1])), []
        for k in range(8 if len(bits) else 0):
            nodes, _ = self._nodes(k, below and below[k])
            mixed, left = entering[k] if entering else (np.zeros(len(self.codes[0])), np.ones(len(self.codes[0])))
            for d, (of, estimate, weight) in enumerate(nodes):
                if d:
                    mixed, left = mixed[self.up[d]], left[self.up[d]]
                if d == len(nodes) - 1:
                    bits += np.log2(mixed + left * estimate)
                w = weight[of]
                mixed, left = mixed + left * w * estimate, left * (1 - w)
            passed.append((mixed, left))
        return bits, passed


def top_passed(k: np.ndarray, node: np.ndarray, logs: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, list]:
    """(codes, passed) of the depths before SPLIT, from the sums of all trees from SPLIT on, added up by k and node."""
    order = np.lexsort((node, k))
    k, node, logs, total = (x[order] for x in (k, node, logs, total))
    top = Tree(node[k == 8], total[k == 8], 0, SPLIT - 1)
    return top.codes[-1], top.mixed(below=[(node[k == b], logs[k == b]) for b in range(8)])[1]


def entering(top: tuple[np.ndarray, list], codes: np.ndarray) -> list:
    """What the depths before SPLIT pass to codes of SPLIT bytes of context."""
    known, passed = top
    up = np.searchsorted(known, low(codes, SPLIT - 1))
    return [(mixed[up], left[up]) for mixed, left in passed]
