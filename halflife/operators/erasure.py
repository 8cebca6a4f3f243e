"""Reed-Solomon shards of binary segments: k data and m parity shards, in numpy over whole shards.

Arithmetic is that of GF(256). Shard r of the parity is the sum of the data shards times (r + 1)^c, so the first k
shards are the data itself. Segments are rows of a table; coding is one Arrow pass, decoding one shuffle by segment.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.schema import EngineError

#: Fixed value: the field's polynomial, x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D
#: Bytes of segments that are coded together.
BYTES = 16_000_000


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of 2, twice around, and each element's exponent."""
    power = np.ones(510, np.int64)
    for i in range(1, 510):
        double = power[i - 1] << 1
        power[i] = double ^ POLYNOMIAL if double > 255 else double
    exponent = np.zeros(256, np.int64)
    exponent[power[:255]] = np.arange(255)
    return power.astype(np.uint8), exponent


def times(a, b) -> np.ndarray:
    power, exponent = _powers()
    a, b = np.broadcast_arrays(np.asarray(a, np.uint8), np.asarray(b, np.uint8))
    return np.where((a == 0) | (b == 0), 0, power[exponent[a] + exponent[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    if not a:
        raise EngineError("0 has no inverse")
    power, exponent = _powers()
    return int(power[(255 - exponent[a]) % 255])


def to_power(a: int, n: int) -> int:
    power, exponent = _powers()
    return 1 if not n else 0 if not a else int(power[exponent[a] * n % 255])


def coefficients(k: int, m: int) -> np.ndarray:
    """Shards by data shards: ones on the diagonal, then the parity's powers."""
    return np.concatenate([np.eye(k, dtype=np.uint8), np.array([[to_power(r + 1, c) for c in range(k)] for r in range(m)], np.uint8).reshape(m, k)])


def solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rows y with a y = x, by elimination on both at once. Raises EngineError where a has no inverse."""
    both, n = np.concatenate([a, x], axis=1), len(a)
    for c in range(n):
        rows = c + np.flatnonzero(both[c:, c])
        if not len(rows):
            raise EngineError("these shards do not determine the data")
        both[[c, rows[0]]] = both[[rows[0], c]]
        both[c] = times(both[c], inverse(both[c, c]))
        for r in np.flatnonzero(both[:, c]):
            if r != c:
                both[r] ^= times(both[r, c], both[c])
    return both[:, n:]


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    """k + m shards of equal length; the data is filled up with zeros."""
    size = -(-len(data) // k)
    x = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    parity = [functools.reduce(np.bitwise_xor, [times(f, part) for f, part in zip(row, x, strict=True)]) for row in coefficients(k, m)[k:]]
    return [part.tobytes() for part in [*x, *parity]]


def decode(shards: dict[int, bytes], k: int, m: int, n_bytes: int) -> bytes:
    """The data from the first k shards that are there. Raises EngineError if there are fewer."""
    have = sorted(shards)[:k]
    if len(have) < k:
        raise EngineError(f"{len(have)} of {k} shards")
    x = np.stack([np.frombuffer(shards[i], np.uint8) for i in have])
    return solve(coefficients(k, m)[have], x).tobytes()[:n_bytes]


def _product(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """matrix times x (segments, parts, bytes), by a table of 256 products for each factor."""
    out, every = np.zeros((len(x), len(matrix), x.shape[2]), np.uint8), np.arange(256)
    for r, row in enumerate(matrix):
        for c, f in enumerate(row):
            if f:
                out[:, r] ^= x[:, c] if f == 1 else times(f, every)[x[:, c]]
    return out


def _stacked(parts: list[bytes], size: int, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts) // k, k, size)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _runs(keys: np.ndarray, size: int):
    """Places of equal rows of keys, so many at a time that size bytes of each make BYTES at most."""
    _, group = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(group.ravel()[order])) + 1):
        step = max(1, BYTES // max(1, size))
        yield from (run[at : at + step] for at in range(0, len(run), step))


def encode_segments(segments: DataFrame, k: int, m: int) -> DataFrame:
    """(segment_id, n_bytes, shard, bytes) of (segment_id, data). Segments of one length are coded together."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            data, n = b.column("data").to_pylist(), k + m
            lengths = np.array([len(d) for d in data])
            for at in _runs(lengths[:, None], int(lengths.max()) * 2):
                length = int(lengths[at[0]])
                size = -(-length // k)
                x = _stacked([data[i].ljust(size * k, b"\0")[c * size : (c + 1) * size] for i in at for c in range(k)], size, k)
                made = np.concatenate([x, _product(coefficients(k, m)[k:], x)], axis=1).reshape(len(at) * n, size)
                yield pa.RecordBatch.from_arrays([b.column("segment_id").take(pa.array(np.repeat(at, n))), pa.array(np.full(len(at) * n, length), pa.int64()), pa.array(np.tile(np.arange(n), len(at)), pa.int32()), _binary(made)],
                                                 ["segment_id", "n_bytes", "shard", "bytes"])

    kind = segments.schema["segment_id"].dataType.simpleString()
    return segments.where("data is not null").select("segment_id", "data").mapInArrow(run, f"segment_id {kind}, n_bytes long, shard int, bytes binary")


def decode_segments(shards: DataFrame, k: int, m: int) -> DataFrame:
    """(segment_id, data, error) of what is left of encode_segments(); data is null where too few shards are left. Segments of one length with the same shards are solved together."""
    held = shards.groupBy("segment_id", "n_bytes").agg(F.collect_list(F.struct("shard", "bytes")).alias("shards"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            lists, keys, n_bytes = b.column("shards"), b.column("segment_id"), b.column("n_bytes").to_numpy()
            shard, parts = (lists.flatten().field(i) for i in (0, 1))
            shard, parts = shard.to_numpy(), parts.to_pylist()
            row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy())
            order = np.lexsort((shard, row))
            order = order[np.r_[(row[order][1:] != row[order][:-1]) | (shard[order][1:] != shard[order][:-1]), np.ones(min(1, len(order)), bool)]]  # of a shard twice the last
            found = np.bincount(row[order], minlength=len(b))
            begins = np.cumsum(found) - found
            place = np.arange(len(order)) - begins[row[order]]
            few = np.flatnonzero(found < k)
            if len(few):
                yield _decoded(keys, few, pa.nulls(len(few), pa.binary()), [f"{n} of {k} shards" for n in found[few]])
            whole = np.flatnonzero(found >= k)
            if not len(whole):
                continue
            chosen = order[(place < k) & (found[row[order]] >= k)].reshape(len(whole), k)
            for at in _runs(np.column_stack([n_bytes[whole], shard[chosen]]), int(n_bytes.max()) * 2):
                have, length = shard[chosen[at[0]]], int(n_bytes[whole[at[0]]])
                own = [parts[i] for i in chosen[at].ravel()]
                size = len(own[0])
                if any(len(x) != size for x in own):
                    raise ValueError("shards of one segment length differ in length")
                try:
                    back = solve(coefficients(k, m)[have], np.eye(k, dtype=np.uint8))
                except EngineError as e:
                    yield _decoded(keys, whole[at], pa.nulls(len(at), pa.binary()), [str(e)] * len(at))
                    continue
                made = _product(back, _stacked(own, size, k)).reshape(len(at), k * size)[:, :length]
                yield _decoded(keys, whole[at], _binary(made), [None] * len(at))

    return held.mapInArrow(run, f"segment_id {shards.schema['segment_id'].dataType.simpleString()}, data binary, error string")


def _decoded(keys: pa.Array, at: np.ndarray, data: pa.Array, errors: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), data, pa.array(errors, pa.string())], ["segment_id", "data", "error"])
