"""Vector functions as Column expressions.

A query known when the plan is made is unrolled into plain arithmetic, which stays in generated code; two
columns are combined by higher-order functions. All sums are in DOUBLE.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from halflife.schema import check_metric

#: Longest query that is unrolled; generated methods would grow too large for the JIT beyond it.
UNROLL = 256
TINY = 1e-10

Vector = Column | str | Sequence[float]


def _col(v: Vector) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.array(*[F.lit(float(x)) for x in v])


def _is_query(v: Vector) -> bool:
    return not isinstance(v, Column | str)


def _sum(terms: list[Column]) -> Column:
    """A balanced sum: deep chains of additions are slow to analyse."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def _fold(a: Vector, b: Vector, f) -> Column:
    if _is_query(a):
        a, b = b, a
    if _is_query(b) and len(b) <= UNROLL:
        return _sum([f(F.get(_col(a), i).cast("double"), F.lit(float(x))) for i, x in enumerate(b)])
    both = F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def dot(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_squared(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Vector) -> Column | float:
    if _is_query(a):
        return math.sqrt(sum(float(x) * float(x) for x in a))
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Vector, b: Vector, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where the norms' product is below 1e-10. Norms may be given as columns kept with the rows."""
    n = _lit(norm_a if norm_a is not None else norm(a)) * _lit(norm_b if norm_b is not None else norm(b))
    return F.when(n < TINY, F.lit(0.0)).otherwise(dot(a, b) / n)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def similarity(a: Vector, b: Vector, metric: str = "cosine", score_space: str = "unit") -> Column:
    """cosine: (cos + 1) / 2, or cos in the raw score space; l2: 1 / (1 + distance); dot: itself."""
    check_metric(metric)
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return F.lit(1.0) / (F.lit(1.0) + l2_distance(a, b))
    c = cosine(a, b)
    return c if score_space == "raw" else (c + 1) / 2


def normalised(a: Vector) -> Column:
    """The vector over its norm; itself below 1e-10."""
    n = norm(a)
    return F.when(_lit(n) < TINY, F.transform(_col(a), lambda x: x.cast("double"))).otherwise(F.transform(_col(a), lambda x: x.cast("double") / n))


def adc_similarity(distance_squared: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance_squared)


def register_sql(spark: SparkSession) -> list[str]:
    """Defines the vector and time functions as temporary SQL functions of the session; returns their names."""
    double = "ARRAY<DOUBLE>"
    defs = {
        "hl_dot": (f"a {double}, b {double}", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
        "hl_l2_squared": (f"a {double}, b {double}", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
        "hl_l2_distance": (f"a {double}, b {double}", "sqrt(hl_l2_squared(a, b))"),
        "hl_norm": (f"a {double}", "sqrt(hl_dot(a, a))"),
        "hl_cosine": (f"a {double}, b {double}", "CASE WHEN hl_norm(a) * hl_norm(b) < 1e-10D THEN 0D ELSE hl_dot(a, b) / (hl_norm(a) * hl_norm(b)) END"),
        "hl_similarity": (f"a {double}, b {double}", "(hl_cosine(a, b) + 1D) / 2D"),
        "hl_temporal_weight": ("created_at BIGINT, at BIGINT, half_life BIGINT", "CASE WHEN at <= created_at THEN 1D ELSE pow(2D, -(at - created_at) / half_life) END"),
        "hl_blend": ("sim DOUBLE, weight DOUBLE, blend DOUBLE", "(1D - blend) * sim + blend * weight"),
        "hl_is_valid": ("valid_from BIGINT, valid_until BIGINT, at BIGINT", "coalesce(valid_from <= at, true) AND coalesce(at <= valid_until, true)"),
    }
    for name, (args, body) in defs.items():
        kind = "BOOLEAN" if name == "hl_is_valid" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(defs)
