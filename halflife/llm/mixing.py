"""Mixing sources to target weights by hash thresholds, without sorting documents.

Method: sum the sizes of each source by hash bucket; running sums over the buckets find the bucket in which
a budget ends; only that bucket is counted again at a finer hash; documents are then filtered by comparing
their hash with their source's thresholds. A larger budget's documents contain a smaller one's. Only built-in
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halflife.llm.common import SPACES, documents, one_of, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
#: Bits of the hash that one level of histograms resolves, and the number of levels. Two levels of 2^10 leave
#: a millionth of a source undivided, the third a billionth.
LEVEL_BITS = 10
LEVELS = 3
#: A source's documents are dealt over so many tasks where they meet its thresholds.
SALTS = 32
#: Up to so many sources are broadcast with their cuts; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(one_of(SPACES, but=True) + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling under the cap.

    Sources in code-point order, null last, take the weights in turn. All sources share share_percent of the
    total by weight; a target stops at cap times its source's size and the excess is shared again by weight.
    The level is the target per unit of weight of the sources that are not capped. Up to BROADCAST_SOURCES sources go
    through windows in one task; see _many_targets() for more.
    """
    if sizes.limit(BROADCAST_SOURCES + 1).count() > BROADCAST_SOURCES:
        return _many_targets(sizes, weights, share_percent, cap)
    # With sources ordered by cap/weight, the level after the first k are capped is (budget - caps) / (weights
    # left), which rises while sources are capped and falls afterwards; the level sought is its maximum.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (
        _weighed(sizes, F.row_number().over(order) - 1, weights, cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share_percent)) / 100)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def _weighed(sizes: DataFrame, place: Column, weights, cap: int) -> DataFrame:
    """sizes with the weight of the place in the order, and the most that a source gives."""
    turn = F.array(*[F.lit(w) for w in weights])
    return sizes.withColumn("weight", F.get(turn, (place % len(weights)).cast("int"))).withColumn("most", F.col("source_size") * cap)


def _many_targets(sizes: DataFrame, weights, share_percent: int, cap: int) -> DataFrame:
    """source_targets() without a task that sees all sources: places from a range partitioning, the level by capping until none is added."""
    by = F.col("source").asc_nulls_last()
    ordered = sizes.repartitionByRange(by).sortWithinPartitions(by)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = stored(ordered.select("source", "source_size", F.spark_partition_id().alias("part"), inside.alias("inside")), "mix-order")
    # One row a partition.
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.join(F.broadcast(parts.select("part", "offset")), "part")
    rows = stored(_weighed(placed, F.col("offset") + F.col("inside"), weights, cap).select("source", "source_size", "weight", "most"), "mix-weights")
    one = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    budget = (one["total"] or 0) * share_percent / 100
    level, capped = budget / one["weights"], -1
    while True:  # the level only rises, so a source that is capped stays so
        full = F.col("most") <= F.col("weight") * F.lit(level)
        got = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if got["n"] == capped or not got["weights"]:
            break
        capped, level = got["n"], (budget - (got["most"] or 0)) / got["weights"]
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cuts): the hash below which a document is taken, one for each copy.

    Copy number c has the budget min(source_size, max(0, target - c * source_size)). A budget of the whole
    source takes all of it; else the cut is the bucket boundary, after LEVELS refinements, whose sum is nearest
    to the budget.
    """
    bits = LEVEL_BITS
    # Copies that take nothing or all need no histogram.
    budgets = (
        targets.select("source", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("copy"))
        .withColumn("budget", F.least(F.col("source_size").cast("double"), F.greatest(F.lit(0.0), F.col("target") - F.col("copy") * F.col("source_size"))))
    )
    whole = F.col("budget") >= F.col("source_size")
    open_ = budgets.where((F.col("budget") > 0) & ~whole).select("source", "copy", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    cuts = None
    for level in range(LEVELS):
        shift = 60 - bits * (level + 1)
        # The sums of each source's buckets; from the second level on only of buckets where a budget ends.
        rows = sized.select("source", "size", F.shiftright("hash", shift).alias("bucket"))
        if level:
            ends = open_.select("source", F.col("prefix").alias("parent")).distinct()
            parents = rows.withColumn("parent", F.shiftright("bucket", bits))
            rows = parents.join(ends, [parents["source"].eqNullSafe(ends["source"]), parents["parent"] == ends["parent"]], "left_semi")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        here = open_.join(sums, [open_["source"].eqNullSafe(sums["source"]), F.shiftright(sums["bucket"], bits) == open_["prefix"]]).select(
            open_["source"], "copy", "left", "bucket", "size")
        run = Window.partitionBy("source", "copy").orderBy("bucket")
        last = here.withColumn("upto", F.sum("size").over(run)).withColumn("below", F.col("upto") - F.col("size"))
        last = last.where((F.col("below") < F.col("left")) & (F.col("left") <= F.col("upto")))
        if level < LEVELS - 1:
            open_ = stored(last.select("source", "copy", (F.col("left") - F.col("below")).alias("left"), F.col("bucket").alias("prefix")), "mix-level")
        else:
            nearer = F.when(F.col("upto") - F.col("left") <= F.col("left") - F.col("below"), F.col("bucket") + 1).otherwise(F.col("bucket"))
            cuts = last.select("source", "copy", F.shiftleft(nearer, shift).alias("cut"))
    named = budgets.alias("b").join(cuts.alias("c"), [F.col("b.source").eqNullSafe(F.col("c.source")), F.col("b.copy") == F.col("c.copy")], "left")
    return named.groupBy(F.col("b.source").alias("source")).agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.collect_list(F.when((F.col("budget") >= F.col("source_size")) & (F.col("source_size") > 0), F.lit(1 << 60)).otherwise(F.coalesce("cut", F.lit(0)))).alias("cuts"),
    )


def document_hash() -> Column:
    """60 bits from doc_id and text: reruns agree, and repeated rows share their fate."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(6), "doc_id", "text"), 4)


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every row of docs, and each source's targets and cuts."""
    hashed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), document_hash().alias("hash"))
    sized = stored(hashed, "mix-sizes")  # narrow rows; the texts are read once
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    return sized, stored(thresholds(sized, targets), "mix-cuts")


def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, hash and others) with source_size, target and copies of their source added: few sources are broadcast, many shuffled in salted groups."""
    few = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    r, c = rows.alias("r"), (F.broadcast(cuts) if few else cuts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))).alias("c")
    on = F.col("r.source").eqNullSafe(F.col("c.source"))
    joined = r.join(c, on if few else on & (F.pmod(F.col("r.hash"), F.lit(SALTS)) == F.col("c.salt")))
    copies = F.size(F.filter("c.cuts", lambda x: F.col("r.hash") < x)).cast("long")
    return joined.select("r.*", "c.source_size", "c.target", copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies), one row for each row of docs.

    Null sources are one source, weighed last; null texts have size 0 and are taken as their hash says. No
    document is taken more than MAX_REPEATS times, and each source's sum ends nearest to its target.
    """
    sized, cuts = plan(docs)
    return with_cuts(sized, cuts).select("doc_id", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with a column copies added: how often each is taken. A column copies of docs is replaced."""
    _, cuts = plan(docs)
    kept = [c for c in docs.columns if c != "copies"]
    # The rows travel as one struct, whatever their columns are called.
    rows = with_cuts(docs.select(F.struct(*kept).alias("row"), "source", document_hash().alias("hash")), cuts)
    return rows.where("copies > 0").select(*[F.col("row")[c].alias(c) for c in kept], "copies")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: sizes and targets."""
    return op6_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(2 * source_size) OVER w - 2 * source_size AS before, sum(weight) OVER v AS rest FROM s
  WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING), v AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max((budget - before) / rest) OVER () * weight) AS target FROM r)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
