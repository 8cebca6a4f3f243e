"""Payload filters, edge type codes, hashes, text embedding and small arithmetic."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflife.schema import EDGE_TYPES, EngineError


def payload_filter(text: str, payload: Column | str = "payload") -> Column:
    """"key=value", split at the first "="; text without one, and the empty text, match everything."""
    if "=" not in text:
        return F.lit(True)
    key, value = text.split("=", 1)
    return F.coalesce((F.col(payload) if isinstance(payload, str) else payload)[key] == value, F.lit(False))


def edge_code(name: Column) -> Column:
    """The number of an edge type; an unknown one fails the query."""
    known = F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), name) - 1
    return F.when(name.isNull(), None).when(known < 0, F.raise_error(F.concat(F.lit("unknown edge type "), name)).cast("long")).otherwise(known)


def edge_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in EDGE_TYPES]), code.cast("int"))


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _fnv_batch(ids: pa.Array, n: int) -> pa.Array:
    """FNV-1a of a whole batch, byte place by byte place."""
    raw = [(x or "").encode() for x in ids.to_pylist()]
    lengths = np.array([len(x) for x in raw])
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    width = int(lengths.max()) if len(raw) else 0
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width) if width else np.zeros((len(raw), 0), np.uint8)
    for k in range(width):
        h = np.where(k < lengths, (h ^ table[:, k]) * np.uint64(0x100000001B3), h)
    return pa.array((h % np.uint64(n)).astype(np.int32))


def shard_of(id_column: Column | str, n: int) -> Column:
    """The shard of an id: its 64-bit FNV-1a hash modulo n. ANSI SQL cannot multiply modulo 2**64, so this is an Arrow UDF."""
    if n < 1:
        raise EngineError("a collection has at least one shard")
    return F.arrow_udf(lambda ids: _fnv_batch(ids, n), "int")(id_column)


def tokenize(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed_embedding(docs: DataFrame, dim_bits: int = 7, pattern: str = r"[^a-z0-9]+") -> DataFrame:
    """(doc_id, bucket, weight): texts as unit vectors of hashed words, in long form.

    A word's SHA-256 gives its bucket (the last dim_bits bits) and sign (bit 8); it weighs 1 + 0.15 for each
    character. Texts without words give no rows.
    """
    if not 1 <= dim_bits <= 7:
        raise EngineError("between 2 and 128 buckets")
    words = docs.select("doc_id", F.explode(F.array_remove(F.split(F.lower("text"), pattern), "")).alias("w"))
    # Hashed once a word; conv() is far slower than the places of three digits.
    words = words.select("doc_id", F.length("w").alias("n"), F.substring(F.sha2(F.col("w").cast("binary"), 256), 62, 3).alias("d"))
    four = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("d", k, 1)) - 1
    low = (four(2) * 16 + four(3)).bitwiseAND(F.lit((1 << dim_bits) - 1))
    sign = F.when(four(1).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    # A document's words lie together, so no more than its buckets are shuffled; then one row a document has its norm.
    each = words.select("doc_id", low.alias("bucket"), (sign * (1 + 0.15 * F.col("n"))).alias("x"))
    sums = each.groupBy("doc_id", "bucket").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "x")).alias("held"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).where(F.col("n") > 0)
    return whole.select("doc_id", "n", F.inline("held")).select("doc_id", "bucket", (F.col("x") / F.col("n")).alias("weight"))


def durability_loss(k: int, m: int, p: float) -> float:
    """The probability that more than m of k + m independent parts fail, each with probability p."""
    n = k + m
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m + 1, n + 1))


def durability_nines(k: int, m: int, p: float) -> float:
    """-log10 of the loss, plus 2 as this scale has it."""
    return -math.log10(durability_loss(k, m, p)) + 2


def pq_bytes(n_vectors: int, subspaces: int) -> int:
    return n_vectors * subspaces


def compression_ratio(dim: int, subspaces: int) -> float:
    return 4 * dim / subspaces


def scale_projection(n_measured: int, dim: int, subspaces: int, goal: int = 1_000_000_000) -> dict[str, float]:
    """Shards of the measured size that the goal takes, and terabytes as floats and as codes."""
    return {"shards": math.ceil(goal / n_measured), "raw_tb": goal * dim * 4 / 1e12, "pq_tb": goal * subspaces / 1e12, "ratio": compression_ratio(dim, subspaces)}


_PRIVATE = re.compile(r"^(localhost|.*\.local|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1\]?$|\[?f[cd])")


def host_allowed(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a callback address is http(s), public, and on the list if there is one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fine = url.rlike("^https?://") & ~F.coalesce(host.rlike(_PRIVATE.pattern), F.lit(True))
    return fine & host.isin(*allowed) if allowed else fine
