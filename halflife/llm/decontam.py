"""Benchmark decontamination: documents that hold a window alike to a benchmark item.

Method: windows of the items' own sizes get a SimHash of their five-word shingles; a multi-index over four
blocks of the fingerprint finds every item within the Hamming radius (two fingerprints within RADIUS differ by
at most RADIUS // 4 in one block); the shingle bags of the candidates are then compared exactly. Only built-in
functions. A window that is alike to an item shares a shingle with it, so only windows around shared shingles
are fingerprinted: all of them, at every start, which loses nothing.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import NOT_LOWER, documents, one_of, stored

WIDTH = 5
SIMILARITY = 0.8
#: Items with more words are compared in parts of equal size; the counters of the fingerprint hold so many.
MAX_WORDS = 200
BITS = 56
BLOCKS = 4
#: At a similarity of 0.8 two fingerprints differ by 8.5 bits on average; 15 is reached by 99.5 % of such pairs.
RADIUS = 15
#: Up to so many bytes of the benchmark's side are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_LANES = 0x0001010101010101
_TOPS = 0x0080808080808080
_BLOCK_BITS = BITS // BLOCKS


def split_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; ASCII punctuation and white space separate."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), one_of(NOT_LOWER) + "+"), "")


def shingle_hashes(words: str) -> Column:
    """The hash of the shingle at each place of the column words; empty if there are fewer than WIDTH words."""
    return F.when(F.size(words) >= WIDTH, F.transform(
        F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, WIDTH))
    )).otherwise(F.array().cast("array<long>"))


def simhash(bag: str) -> Column:
    """The 56-bit SimHash of a bag of at most MAX_WORDS hashes.

    Eight sums count the bits: each adds seven byte-wide counters at once. A counter's top bit, after adding
    what half of the bag lacks of 128, tells whether the majority has the bit.
    """
    half = (F.lit(127) - F.floor(F.size(bag) / 2)).cast("long") * F.lit(_LANES)
    out = None
    for k in range(8):
        lanes = F.transform(bag, _lane(k))
        counts = F.aggregate(lanes, F.lit(0).cast("long"), lambda a, x: a + x)
        bits = F.shiftleft(F.shiftright((counts + half).bitwiseAND(F.lit(_TOPS)), 7), k)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def _lane(k: int):
    return lambda h: F.shiftright(h, k).bitwiseAND(F.lit(_LANES))


def _block(fingerprint: Column | str, b: int) -> Column:
    return F.shiftright(fingerprint, b * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))


def _few(table: DataFrame) -> bool:
    """Whether the rows, counted with their longest arrays and strings, have no more than BROADCAST_BYTES."""
    wide = {"array": lambda c: 24 + 8 * F.coalesce(F.size(c), F.lit(0)), "string": lambda c: 24 + F.coalesce(F.octet_length(c), F.lit(0))}
    row = reduce(lambda a, b: a + b, [wide.get(t.partition("<")[0], lambda c: F.lit(8))(F.col(c)) for c, t in table.dtypes], F.lit(16))
    return (table.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES


def _joined(big: DataFrame, small: DataFrame, on) -> DataFrame:
    return big.join(F.broadcast(small) if _few(small) else small, on)


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, n_words, bag, fingerprint) of items with WIDTH words or more, long ones in parts."""
    words = benchmark.where("item_id is not null and text is not null").select("item_id", split_words(F.col("text")).alias("all")).distinct()
    n = F.size("all")
    cut = words.where(n >= WIDTH).select("item_id", "all", F.ceil(n / MAX_WORDS).cast("int").alias("parts"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    at = [F.floor(n * (F.col("part") + k) / F.col("parts")).cast("int") for k in range(2)]
    cut = cut.select("item_id", "part", F.slice("all", at[0] + 1, at[1] - at[0]).alias("words"))
    cut = cut.select("item_id", "part", F.size("words").alias("n_words"), shingle_hashes("words").alias("bag"))
    return cut.select("*", simhash("bag").alias("fingerprint"))


def _variants() -> list[int]:
    """All ways to change at most RADIUS // BLOCKS bits of a block."""
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(_BLOCK_BITS), k)]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, part, start, hamming, similarity): the best window of each document and item.

    Similarity is the weighted Jaccard of shingle bags: the sum of the smaller over the sum of the larger
    counts. A document with fewer words than an item is one window. Null or short texts (under five words) hold
    nothing, and items of under five words match nothing. Rows without doc_id are compared too; repeated rows
    give one row. text_hash tells rows apart that share a doc_id.
    """
    goal = stored(items(benchmark), "items")
    anchors = stored(goal.select("n_words", F.explode("bag").alias("h")).distinct(), "anchors")
    words = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), split_words(F.col("text")).alias("words"))
    # Explode joins: one row for each place of a document, never shuffled while the benchmark is small.
    places = words.where(F.size("words") >= WIDTH).select("doc_id", "text_hash", F.size("words").alias("size"), F.posexplode(shingle_hashes("words")).alias("p", "h"))
    hits = _joined(places, anchors, "h").groupBy("doc_id", "text_hash", "size", "n_words").agg(F.collect_set("p").alias("places"))
    # Every start of an item-sized window that holds one of the shared shingles.
    last = F.greatest(F.col("size") - F.col("n_words"), F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(
        F.least(F.greatest(p - F.col("n_words") + WIDTH, F.lit(0)), last), F.least(p, last)))))
    hits = stored(hits.select("doc_id", "text_hash", "n_words", starts.alias("starts")), "hits")
    ids = hits.select("doc_id", "text_hash").distinct()
    few = _few(ids)
    same = [F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("w.text_hash") == F.col("i.text_hash")]
    held = words.alias("w").join(F.broadcast(ids).alias("i") if few else ids.alias("i"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held = held.select("doc_id", "text_hash", shingle_hashes("words").alias("all")).alias("d").join(
        hits.alias("h"), [F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("d.text_hash") == F.col("h.text_hash")])
    windows = held.select("d.doc_id", "d.text_hash", "n_words", "all", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "text_hash", "n_words", "start", F.slice("all", F.col("start") + 1, F.col("n_words") - (WIDTH - 1)).alias("bag"))
    windows = windows.select("*", simhash("bag").alias("fingerprint"))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block("fingerprint", b).alias("value")) for b in range(BLOCKS)])
    windows = windows.select("*", F.inline(blocks))
    index = goal.select("item_id", "part", "n_words", F.col("bag").alias("item_bag"), F.col("fingerprint").alias("item_fingerprint"),
                        F.inline(F.array(*[F.struct(F.lit(b).alias("block"), _block("fingerprint", b).alias("own")) for b in range(BLOCKS)])))
    index = index.select("item_id", "part", "n_words", "item_fingerprint", "block",
                         F.explode(F.transform(F.array(*[F.lit(v).cast("long") for v in _variants()]), lambda v: v.bitwiseXOR(F.col("own")))).alias("value"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    near = _joined(windows, index, ["n_words", "block", "value"]).where(F.bit_count(differ) <= RADIUS)
    # A pair that meets in several blocks counts in the first.
    first = F.lit(True)
    for b in range(BLOCKS - 1):
        first = first & ((F.col("block") <= b) | (F.bit_count(_block(differ, b)) > RADIUS // BLOCKS))
    near = near.where(first).select("doc_id", "text_hash", "item_id", "part", "start", "bag", F.bit_count(differ).alias("hamming"))
    near = _joined(near, goal.select("item_id", "part", F.col("bag").alias("item_bag")), ["item_id", "part"])

    def times(bag: str, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    shared = F.aggregate(F.array_distinct("item_bag"), F.lit(0), lambda n, x: n + F.least(times("item_bag", x), times("bag", x)))
    alike = near.select("doc_id", "text_hash", "item_id", "part", "start", "hamming", F.size("bag").alias("a"), F.size("item_bag").alias("b"), shared.alias("shared"))
    alike = alike.select("*", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = alike.groupBy("doc_id", "text_hash", "item_id", "part").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "part", (-F.col("best.back")).cast("long").alias("start"), F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_hash")
