"""Records, enumerations, option classes and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
#: Half-life presets in milliseconds (a month has 30 days, a year 365).
HALF_LIFE = {"hour": HOUR_MS, "day": DAY_MS, "week": 7 * DAY_MS, "month": 30 * DAY_MS, "year": 365 * DAY_MS}

#: Edge types in the order of their codes.
EDGE_TYPES = ("CAUSES", "CONTRADICTS", "UPDATES", "RELATED_TO", "ENTITY_OF", "SUPPORTS")
METRICS = ("cosine", "l2", "dot")
MODES = ("vector_only", "causal_expand", "contradiction_check", "entity_resolve")
STRATEGIES = ("exact", "ivf", "pq")

EDGE_STRUCT = T.StructType([
    T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("weight", T.FloatType()), T.StructField("created_at", T.LongType()),
])
VECTORS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("created_at", T.LongType()),
    T.StructField("valid_from", T.LongType()), T.StructField("valid_until", T.LongType()),
])
CHANGES = T.StructType([
    T.StructField("lsn", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("ts", T.LongType()),
    T.StructField("vec", VECTORS), T.StructField("del_id", T.StringType()), T.StructField("edge", EDGE_STRUCT),
])


class EngineError(ValueError):
    """A request that names what does not exist, or contradicts itself."""


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise EngineError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return name


def check_edge_type(name: str) -> str:
    if name not in EDGE_TYPES:
        raise EngineError(f"unknown edge type {name!r}; one of {', '.join(EDGE_TYPES)}")
    return name


def check_mode(name: str) -> str:
    if name not in MODES:
        raise EngineError(f"unknown mode {name!r}; one of {', '.join(MODES)}")
    return name


@dataclass(frozen=True)
class TemporalConfig:
    half_life_ms: int = 30 * DAY_MS
    blend: float = 0.3
    staleness_threshold: float = 0.20
    cutoff: float = 0.0

    def __post_init__(self):
        if self.half_life_ms <= 0 or not 0 <= self.blend <= 1:
            raise EngineError("half_life_ms must be positive and blend between 0 and 1")


@dataclass(frozen=True)
class AgentConfig:
    """Write rules of a collection: a time to live that overrides the rows' own, and a similarity above which new rows go."""

    enabled: bool = False
    agent_id: str = ""
    ttl_seconds: int = 0
    dedup_threshold: float | None = None
    cross_agent_readable: tuple[str, ...] = ()


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dim: int = 768
    index_type: str = "exact"
    metric: str = "cosine"
    n_shards: int = 4
    n_replicas: int = 1
    write_quorum: int = 1
    temporal: TemporalConfig = field(default_factory=TemporalConfig)
    agent: AgentConfig = field(default_factory=AgentConfig)

    def __post_init__(self):
        check_metric(self.metric)
        if self.index_type not in STRATEGIES:
            raise EngineError(f"unknown index type {self.index_type!r}")
        if self.n_shards == 0:  # unset on the wire
            object.__setattr__(self, "n_shards", 4)


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    #: None: the collection's blend and metric.
    blend: float | None = None
    metric: str | None = None
    mode: str = "vector_only"
    hops: int = 1
    filter: str = ""
    include_staleness: bool = True
    #: "unit": cosine as (cos + 1) / 2; "raw": cosine itself.
    score_space: str = "unit"
    direction: str = "out"

    def __post_init__(self):
        check_mode(self.mode)
        if self.metric is not None:
            check_metric(self.metric)
        if self.score_space not in ("unit", "raw") or self.direction not in ("out", "in") or self.top_k < 0:
            raise EngineError("bad score_space, direction or top_k")
