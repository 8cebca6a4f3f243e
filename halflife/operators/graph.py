"""The typed, directed edge multigraph: look-ups, bounded breadth-first search, search decorations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflife.schema import SearchOptions, check_edge_type
from halflife.sources.scratch import stored


def out_edges(edges: DataFrame, node, kind: str | None = None) -> DataFrame:
    rows = edges.where(F.col("src") == node)
    return rows.where(F.col("type") == check_edge_type(kind)) if kind else rows


def _of(edges: DataFrame, kind: str | None, direction: str = "out") -> DataFrame:
    rows = edges.where(F.col("type") == check_edge_type(kind)) if kind else edges
    ends = ("src", "tgt") if direction == "out" else ("tgt", "src")
    return rows.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).where("a is not null and b is not null").distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int, kind: str | None = None, direction: str = "out") -> DataFrame:
    """(seed, node, hop): what each seed reaches within so many hops, itself left out, with the fewest hops.

    One join a hop, on the frontier only; what was reached before is taken away with an anti join. From the
    third hop on each frontier is stored, else the plan would double with every hop; an empty one ends the search.
    """
    step = _of(edges, kind, direction)
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    seen = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.join(step, frontier["node"] == step["a"]).select("seed", F.col("b").alias("node")).distinct()
        frontier = found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hop"))
        if hop > 2:
            frontier = stored(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionAll(frontier)
    return seen.where("hop > 0")


def neighbours(edges: DataFrame, node, hops: int = 1, kind: str | None = None) -> DataFrame:
    """The nodes within so many hops of one node."""
    seed = edges.sparkSession.createDataFrame([(node,)], "seed " + edges.schema["src"].dataType.simpleString())
    return reach(edges, seed, hops, kind).select("node", "hop")


def contradictions(edges: DataFrame, node, direction: str = "out") -> DataFrame:
    """What the node contradicts (out), or what contradicts it (in)."""
    return _of(edges, "CONTRADICTS", direction).where(F.col("a") == node).select(F.col("b").alias("node")).where(F.col("node") != node)


def entity(edges: DataFrame, node) -> DataFrame:
    return neighbours(edges, node, 2, "ENTITY_OF").select("node")


def path_exists(edges: DataFrame, source, target, max_hops: int = 5) -> DataFrame:
    """One row: whether a path of at most max_hops leads there, and the fewest hops."""
    found = neighbours(edges, source, max_hops).where(F.col("node") == target)
    return found.agg((F.count("*") > 0).alias("path_exists"), F.min("hop").alias("hops"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The seeds and all they reach, each node once."""
    start = seeds.select(F.col(seeds.columns[0]).alias("node"))
    return start.unionAll(reach(edges, seeds, hops).select("node")).distinct()


def counts(edges: DataFrame) -> DataFrame:
    """Edges and nodes of the live graph."""
    ends = F.explode(F.array("src", "tgt")).alias("node")
    nodes = edges.select(ends).agg(F.count_distinct("node").alias("n_nodes"))
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(nodes)  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tgt").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Parallel edges stay; weight defaults to 1; an unknown type fails when it is read."""
    from halflife.functions.codec import edge_code

    checked = new.where(edge_code(F.col("type")) >= 0)
    for name, default in (("weight", F.lit(1.0).cast("float")), ("created_at", F.lit(None).cast("long"))):
        checked = checked.withColumn(name, F.coalesce(name, default) if name in new.columns else default)
    return edges.unionByName(checked.select(edges.columns))


def remove_edges(edges: DataFrame, source, target) -> DataFrame:
    return edges.where(~F.coalesce((F.col("src") == source) & (F.col("tgt") == target), F.lit(False)))


def remove_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those that begin or end at one of the ids."""
    gone = ids.select(F.col(ids.columns[0]).alias("gone")).distinct()
    return edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("tgt") == F.col("gone"), "left_anti")


def decorate(hits: DataFrame, edges: DataFrame, options: SearchOptions) -> DataFrame:
    """Adds to the hits (k rows) the sorted arrays causal_neighbors, contradicted_by and entities that the mode asks for."""
    none = F.array().cast("array<string>")
    wanted = {"causal_expand": ("causal_neighbors", options.hops, None, "out"), "contradiction_check": ("contradicted_by", 1, "CONTRADICTS", options.direction), "entity_resolve": ("entities", 2, "ENTITY_OF", "out")}
    out = hits
    for mode, (name, hops, kind, direction) in wanted.items():
        if mode == options.mode:
            found = reach(edges, hits.select("id"), hops, kind, direction).groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("found"))
            out = out.join(found, F.col("id") == F.col("seed"), "left").drop("seed").withColumn(name, F.coalesce(F.col("found").cast("array<string>"), none)).drop("found")
        else:
            out = out.withColumn(name, none)
    return out


def joined(array: Column | str) -> Column:
    return F.array_join(array, ",")
