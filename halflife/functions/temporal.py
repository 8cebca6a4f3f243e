"""Decay, blending, staleness and validity as Column expressions. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halflife.schema import DAY_MS, TemporalConfig


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ms(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x)).cast("long")


def temporal_weight(created_at: Column | str, at, half_life_ms: int) -> Column:
    """1 for what is not older than `at`, else halved with each half-life."""
    age = (_ms(at) - _col(created_at)).cast("double")
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -age / F.lit(float(half_life_ms))))


def blend(sim: Column, weight: Column, share: float) -> Column:
    return sim * (1.0 - share) + weight * share


def age_days(created_at: Column | str, at) -> Column:
    """Whole days, cut towards zero."""
    return ((_ms(at) - _col(created_at)) / F.lit(DAY_MS)).cast("long")


def is_stale(weight: Column, config: TemporalConfig) -> Column:
    return weight < config.staleness_threshold


def staleness_reason(weight: Column, created_at: Column | str, at, config: TemporalConfig, with_score: bool = True) -> Column:
    """The reason for a staleness flag, null without one; the score is cut, not rounded, after three places."""
    text = [age_days(created_at, at).cast("string"), F.lit(" days old")]  # the fixed wording of the flag
    if with_score:
        text += [F.lit(" (temporal_score="), F.substring(F.format_string("%.6f", weight), 1, 5), F.lit(")")]
    return F.when(is_stale(weight, config), F.concat(F.lit("Vector is "), *text))


def passes_cutoff(weight: Column, cutoff: float) -> Column:
    return F.lit(True) if cutoff <= 0 else weight >= cutoff


def is_valid_at(at, valid_from: Column | str = "valid_from", valid_until: Column | str = "valid_until") -> Column:
    """Both ends belong to the window; a missing end is open."""
    return F.coalesce(_col(valid_from) <= _ms(at), F.lit(True)) & F.coalesce(_ms(at) <= _col(valid_until), F.lit(True))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def with_ttl(created_at: Column | str, ttl_seconds: Column | int) -> Column:
    return _col(created_at) + _ms(ttl_seconds) * 1000
