"""LM scoring keeps every context: the blocks of Spark's tasks give what one model of all counts gives, whatever their size."""

import math

import numpy as np
import pytest

from halflife.llm import ctw, lmscore


def test_no_context_is_dropped(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lmscore.with_fold(df).collect()
    codes = np.concatenate([c for c, _ in ctw.pieces(((r["text"] or "").encode().lower() for r in rows if r["learn"]))])
    own = {r["doc_id"]: np.concatenate([c for c, _ in ctw.pieces([(r["text"] or "").encode().lower()])]) for r in rows}
    every, of = np.unique(np.concatenate([codes, *own.values()]), return_inverse=True)
    assert len(every) > 500
    bits, _ = ctw.Tree(every, np.bincount(of[: len(codes)], minlength=len(every))).mixed()
    expected = {i: bits[np.searchsorted(every, c)].sum() * math.log10(2) for i, c in own.items()}
    got = {r["doc_id"]: r["score"] for r in lmscore.score_texts(df, most=500).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], rel=1e-6) for k in got)
