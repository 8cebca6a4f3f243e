"""Codes that find enough, however large the table."""

import numpy as np

from halflife.operators import ivf, quantize
from halflife.plans import fixtures as fx
from halflife.sources.scratch import scratch_path


def test_codes_are_made_finer_until_they_find_enough(spark, sf):
    rows = fx.vectors(spark, sf)
    coarse, _ = quantize.store(rows, ivf.sample_queries(rows), scratch_path(spark, "codes"), 4, 16, 0.0, fx.AT, fx.CONFIG)
    fine, path = quantize.store(rows, ivf.sample_queries(rows), scratch_path(spark, "codes"), 4, 16, 0.9, fx.AT, fx.CONFIG)
    assert coarse.subspaces == 4 < fine.subspaces and spark.read.parquet(path).count() == rows.count()


def test_codes_are_the_nearest_centres():
    x = np.random.default_rng(3).normal(size=(5_000, 8))
    book = quantize.Codebook(np.random.default_rng(4).normal(size=(4, 9, 2)))
    parts = x.reshape(len(x), 4, 2)
    assert (book.encode(x) == ((parts[:, :, None] - book.centres[None]) ** 2).sum(3).argmin(2)).all()
