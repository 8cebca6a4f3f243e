"""The k best rows of many queries: bounded tiles, exact ties, equal rows."""

import numpy as np
import pyarrow as pa

from halflife.operators import search

NAMES = ["query_id", "id", "score", "vector_score", "temporal_score"]


class Watched(search.Similarity):
    sizes: list = []

    def about(self, q, rows):
        score, off = super().about(q, rows)
        self.sizes.append(score.size)
        return score, off


def table(x, w):
    return pa.table({"id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64())), "w": w})


def found(q, blocks, k, method):
    best = search.Best(pa.array(range(len(q)), pa.int64()), q, k, method, NAMES)
    batches = [b for block in blocks for b in best.meet(block)]
    rows = pa.Table.from_batches(batches).to_pandas().sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return rows.groupby("query_id").head(k), sum(len(b) for b in batches)


def test_no_more_scores_than_a_tile():
    rng = np.random.default_rng(1)
    q, x, w = rng.normal(size=(3_000, 4)), rng.normal(size=(5_000, 4)), rng.random(5_000)
    Watched.sizes = []
    got, _ = found(q, [table(x[:3_000], w[:3_000]), table(x, w).slice(3_000)], 3, Watched("cosine", "unit", 0.3))
    assert max(Watched.sizes) <= search.TILE_SCORES < len(q) * 3_000
    score = 0.7 * search.similarities(q, x, "cosine") + 0.3 * w[None]
    assert got["id"].to_numpy().reshape(-1, 3).tolist() == np.argsort(-score, axis=1)[:, :3].tolist()


def test_equal_rows_go_by_id_and_stay_few():
    rng = np.random.default_rng(2)
    x, q = np.tile(rng.normal(size=(3, 7)), (400, 1)), rng.normal(size=(5, 7))
    for metric in ("cosine", "l2", "l2_squared", "dot"):
        got, rows = found(q, [table(x, np.ones(len(x)))], 4, search.Similarity(metric, "raw", 0.0))
        nearest = search.similarities(q, x[:3], metric, "raw").argmax(axis=1)
        assert got["id"].to_numpy().reshape(-1, 4).tolist() == [[c, c + 3, c + 6, c + 9] for c in nearest] and rows == 20
