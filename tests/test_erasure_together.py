"""Segments are coded together by length, and solved together by the shards that are left, as one by one."""

import numpy as np
from pyspark.sql import functions as F

from halflife.operators import erasure


def test_product_is_that_of_single_segments():
    x = np.random.default_rng(5).integers(0, 256, (50, 4, 9), np.uint8)
    made = erasure._product(erasure.coefficients(4, 2)[4:], x)
    for i in range(len(x)):
        assert [p.tobytes() for p in made[i]] == erasure.encode(x[i].tobytes(), 4, 2)[4:]


def test_mixed_lengths_and_losses(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i:03}", bytes(rng.integers(0, 256, i % 13, np.uint8))) for i in range(200)]
    shards = erasure.encode_segments(spark.createDataFrame(rows, "segment_id string, data binary"), 4, 2)
    one = {(r["segment_id"], r["shard"]): bytes(r["bytes"]) for r in shards.collect()}
    assert one == {(s, i): p for s, d in rows for i, p in enumerate(erasure.encode(d, 4, 2))}
    lost = F.pmod(F.xxhash64("segment_id", "shard"), F.lit(3)) == 0
    left = shards.where(~lost)
    left = left.unionAll(left.where("shard = 5"))  # a shard twice counts once
    have = {s: set() for s, _ in rows}
    for r in left.collect():
        have[r["segment_id"]].add(r["shard"])
    got = {r["segment_id"]: (r["data"] if r["data"] is None else bytes(r["data"]), r["error"]) for r in erasure.decode_segments(left, 4, 2).collect()}
    assert got == {s: (d, None) if len(have[s]) >= 4 else (None, f"{len(have[s])} of 4 shards") for s, d in rows if have[s]}
    assert any(e for _, e in got.values())
