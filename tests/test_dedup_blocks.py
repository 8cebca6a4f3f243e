"""Clusters that rule nothing out are not used: each of them would get a copy of every row."""

import numpy as np

from halflife.operators import writes


def test_vectors_without_structure_have_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(writes, "CLUSTER", 20)
    rng = np.random.default_rng(8)
    kind = "id long, embedding array<double>"
    plain = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(rng.normal(size=(200, 16)))], kind)
    near = spark.createDataFrame([(i, [float(a) for a in np.eye(16)[i % 10] + 0.01 * rng.normal(size=16)]) for i in range(200)], kind)
    assert writes._clustered(plain, 200, (4 * 0.3) ** 0.5)[1].shape == (1, 0)
    assert writes._clustered(near, 200, (4 * 0.02) ** 0.5)[1].shape[0] > 1
