"""Word shingles of whole texts as sorted arrays of 64-bit hashes (numpy, on the workers)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bytes that are hashed at once, or one word if it is longer.
PIECE = 1 << 18

#: What bytes.split() splits at.
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_SPACE = re.compile(rb"[ \t-\r]")
#: A number for each byte, and an odd base with its inverse: a word's hash is the value of a polynomial, taken from running sums.
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([c])) for c in range(256)], np.uint64)
_BASE = 0x2545F4914F6CDD1D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[bytes]:
    """The words of the text, A-Z lower-cased. bytes.lower() and bytes.split() know ASCII only, as wanted."""
    return (text or "").encode().lower().split()


def _powers_to(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; those for PIECE bytes and a word are kept."""
    if n <= len(_powers[0]):
        return [x[:n] for x in _powers]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(max(n, PIECE + 4_096), base, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    _powers[:] = [x[: PIECE + 4_096].copy() for x in made]
    return [x[:n] for x in made]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of data, in numpy over PIECE bytes at a time."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)  # pieces end at a space
        end = cut.start() if cut else len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.r_[False, ~_SPACES[x], False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, past = edge[::2], edge[1::2]
        power, inverse = _powers_to(len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * power, out=total[1:])
        h = (total[past] - total[first]) * inverse[first]
        h ^= (past - first).astype(np.uint64) * _MIX[1]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        h ^= h >> np.uint64(29)
        starts.append(first + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    s = h[:n] * _MIX[0]
    for k in range(1, width):
        s ^= s >> np.uint64(29)
        s *= _MIX[1]
        s += h[k : k + n] * _MIX[k % 4]
    s ^= s >> np.uint64(32)
    s *= _MIX[3]
    s ^= s >> np.uint64(29)
    return s


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct shingles; fewer words than width make one shingle, no words none. All texts are hashed together."""
    raw = [(t or "").encode() for t in texts]
    start, h = word_hashes(b"\n".join(raw).lower())
    at = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    every = _mixed(h, width) if len(h) >= width else None
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n < width:
            s = _mixed(np.r_[h[lo:hi], np.full(width - n, n, np.uint64)], width) if n else np.zeros(0, np.uint64)
        else:
            s = np.sort(every[lo : hi - width + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        out.append(s)
    return out


def shingles(found: list[bytes], width: int) -> np.ndarray:
    """The shingles of one text's words()."""
    return shingle_sets([b" ".join(found).decode()], width)[0] if found else np.zeros(0, np.uint64)


def node(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit names of a set: the first identifies it, the second tells whether the first is ambiguous."""
    digest = xxhash.xxh3_128(s.tobytes(), seed=seed).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
