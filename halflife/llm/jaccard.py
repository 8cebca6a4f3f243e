"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, and their components.

Method. Equal sets are one node. Each node is dealt to tiles, one for each shingle of its prefix: under one
order of all shingles (rare hash buckets first) two sets that reach the threshold must meet in a prefix. Tiles
are cut into bands of sizes that can reach the threshold together. Within a tile's band a hashed
bitmap of each set, or of slices of a large set, (every shingle flips one of BITS bits) bounds the overlap from above: the bits that differ
are at most the elements that differ. Surviving pairs make clusters; within a cluster the sorted shingle
arrays are intersected exactly, but for pairs that are connected already. Clusters of any size are dealt in
blocks, so no group meets in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import LOWER, UPPER, documents, small_batches, stored, text_hash
from halflife.llm.components import components
from halflife.llm.shingles import node, shingle_sets

WIDTH = 4
PERCENT = 85
BITS = 512
#: Larger sets are cut into 2, 4, 8, ... slices.
SLICE = 1_000
#: The order of shingles comes from counts of so many hash buckets over all documents.
BUCKET_BITS = 17
#: Rows of a tile's block, and blocks of a tile that all meet in pairs; nodes and shingles of a cluster's block.
TILE = 1_024
PAIRED = 16
BLOCK = 512
BLOCK_ITEMS = 2_000_000
#: Nodes of a large cluster that every block of it sees.
LEADERS = 8
#: Up to so many ids are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Up to so many bitmaps (30 MB) are broadcast.
BROADCAST_BITMAPS = 300_000
#: Up to so many places of nodes in blocks (32 MB) are broadcast.
BROADCAST_PLACES = 250_000
#: Rounds. So many shingles of all sets go to a tile row that gets its bitmap in one round, and to a shingle that is compared
#: exactly in one round: what a round shuffles is a fraction of the texts, however many documents are alike.
PER_ROW = 32
PER_SHINGLE = 4

_SHIFT = np.uint64(64 - BUCKET_BITS)


def _out(schema: list[tuple[str, pa.DataType]], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _texts(batches, n_columns: int, rows: int = 256):
    """Lists of so many rows, so that memory follows the texts of a list and not of a batch."""
    for b in batches:
        for at in range(0, len(b), rows):
            part = b.slice(at, rows)
            yield list(zip(*(part.column(k).to_pylist() for k in range(n_columns)), strict=True))


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> _SHIFT).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Bit b is set if an odd number of shingles hash to b."""
    odd = np.bincount(((s >> np.uint64(16)) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which two sets that reach the threshold share at least one."""
    n = len(s) - (percent * len(s) + 99) // 100 + 1
    order = rank[_buckets(s)].astype(np.int64) << 32 | np.arange(len(s))  # s is sorted, so its places order equal ranks
    if n < len(s):
        order = np.partition(order, n - 1)[:n]
    return s[order & 0xFFFFFFFF]


def slices(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(parts, part, shingles): a large set cut by hash so that a bitmap can tell its slices apart.

    If two sets reach the threshold, some slice of theirs does, as ratios of sums go. Both must be cut into
    equally many parts, so a set whose smallest partner has half as many comes in both cuts.
    """
    def parts(n: int) -> int:
        return 1 << max(0, (max(n - 1, 0) // SLICE).bit_length())

    out = []
    for n in sorted({parts(len(s)), parts((percent * len(s)) // 100)}):
        part = s & np.uint64(n - 1)
        out += [(n, c, s if n == 1 else s[part == c]) for c in range(n)]
    return [x for x in out if len(x[2])]


def sizes_fit(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small >= percent * large


def may_link(sizes_a, bits_a, sizes_b, bits_b, percent: int) -> np.ndarray:
    """Whether the overlap's upper bound reaches the threshold, for all pairs of a (rows) and b (columns)."""
    out = np.empty((len(sizes_a), len(sizes_b)), bool)
    for i in range(len(sizes_a)):
        differ = np.bitwise_count(bits_a[i] ^ bits_b).sum(axis=1, dtype=np.int64)
        both = sizes_a[i] + sizes_b
        most = np.minimum((both - differ) // 2, np.minimum(sizes_a[i], sizes_b))
        out[i] = 100 * most >= percent * (both - most)
    return out


class Union:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def describe(docs: DataFrame, width: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """One row (doc_id, text_hash, size, node, twin) for each row of docs, and the rank of each hash bucket.

    One pass over the texts. The bucket counts are summed on the way: they have a fixed size on the driver.
    """
    schema = [(c, pa.int64()) for c in ("doc_id", "text_hash", "size", "node", "twin", "bucket")]

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for texts in _texts(batches, 3):
            sets = shingle_sets([t for _, t, _ in texts], width)
            counts += np.bincount(_buckets(np.concatenate(sets)), minlength=len(counts))
            names = [node(s, seed) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield _out(schema, [[i for i, _, _ in texts], [h for _, _, h in texts], [len(s) for s in sets], [a for a, _ in names], [b for _, b in names], none])
        full = np.flatnonzero(counts)
        for at in range(0, len(full), 10_000):
            part = full[at : at + 10_000]
            none = pa.nulls(len(part), pa.int64())
            yield _out(schema, [none, none, counts[part], none, none, part])

    every = stored(docs.select("doc_id", "text", text_hash()).mapInArrow(run, ", ".join(f"{c} long" for c, _ in schema)), "sets")
    sums = every.where("bucket is not null").groupBy("bucket").agg(F.sum("size").alias("n")).toPandas()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    rank = np.empty(len(counts), np.int32)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=np.int32)
    return every.where("bucket is null").drop("bucket"), rank


def tile_rows(docs: DataFrame, rank, width: int, percent: int, seed: int) -> DataFrame:
    """(tile, node, size, slice, band) for the slices of nodes that meet another of a fitting size in a tile.

    A slice is named by the number of parts plus its own number. A band is a run of sizes in which neighbours fit; it bears its smallest size.
    """
    schema = [("tile", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("slice", pa.int64()), ("band", pa.int64())]
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # of a fixed size

    def deal(batches):
        rank, seen = shared.value, set()
        for texts in _texts(batches, 1):
            out = []
            for s in shingle_sets([t for (t,) in texts], width):
                if len(s) and (name := node(s, seed)[0]) not in seen:
                    seen.add(name)
                    for n, c, part in slices(s, percent):
                        p = prefix(part, rank, percent) ^ np.uint64(n - 1)  # other cuts, other tiles
                        out.append((p.view(np.int64), *(np.full(len(p), v) for v in (name, len(part), n + c))))
            if out:
                yield _out(schema[:4], [np.concatenate(c) for c in zip(*out, strict=True)])

    def meet(batches):
        # Rows come sorted by tile, size and node: a row has a partner of a fitting size if a neighbour fits,
        # and sizes on two sides of a gap never fit, so a gap begins a new band.
        last, last_kept, last_band = None, False, 0
        for b in batches:
            x = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            if last is not None:
                x = np.concatenate([last[None], x])
            x = x[np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]]
            fits = (x[1:, 0] == x[:-1, 0]) & sizes_fit(x[:-1, 2], x[1:, 2], percent)
            keep = np.r_[last_kept, fits] | np.r_[fits, False]
            starts = np.flatnonzero(np.r_[True, ~fits])
            band = np.repeat(x[starts, 2], np.diff(np.r_[starts, len(x)]))
            if last is not None:
                band[: starts[1] if len(starts) > 1 else len(x)] = last_band
            last, last_kept, last_band = x[-1].copy(), bool(keep[-1]), band[-1]
            k = np.flatnonzero(keep[:-1])
            if len(k):
                yield _out(schema, [*x[k].T, band[k]])
        if last is not None and last_kept:
            yield _out(schema, [[v] for v in (*last, last_band)])

    kind = "tile long, node long, size long, slice long"
    dealt = docs.where("text is not null").select("text").mapInArrow(deal, kind)
    return dealt.repartition("tile").sortWithinPartitions("tile", "size", "node").mapInArrow(meet, f"{kind}, band long")


def chosen_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids; small id tables are broadcast, others shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _of_texts(docs: DataFrame, ids: DataFrame, schema, kind: str, columns) -> DataFrame:
    """columns(texts) of the documents in ids, a list of texts at a time."""
    def run(batches):
        for texts in _texts(batches, 1):
            yield _out(schema, columns([t for (t,) in texts]))

    return chosen_docs(docs.select("doc_id", "text"), ids).select("text").mapInArrow(run, kind)


def bitmaps(docs: DataFrame, ids: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """(node, slices) of the documents in ids: the bitmap of each slice."""
    of_slices = pa.list_(pa.struct([("slice", pa.int64()), ("bits", pa.binary())]))

    def columns(found):
        sets = shingle_sets(found, width)
        return [[node(s, seed)[0] for s in sets], [[{"slice": n + c, "bits": bitmap(p)} for n, c, p in slices(s, percent)] for s in sets]]

    return _of_texts(docs, ids, [("node", pa.int64()), ("slices", of_slices)], "node long, slices array<struct<slice: long, bits: binary>>", columns)


def arrays(docs: DataFrame, places: DataFrame, repeated: bool, width: int, seed: int) -> DataFrame:
    """(cluster, block, side, node, size, bits, set) of places (node, doc_id, cluster, block, side): the sorted shingle arrays, 8 bytes an element.

    Places find their texts, so an array is shuffled to its blocks only.
    """
    schema = [("size", pa.int64()), ("bits", pa.binary()), ("set", pa.binary())]

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                own = pa.array([node(s, seed)[0] == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
                made = _out(schema, [[len(s) for s in sets], [bitmap(s) for s in sets], [s.tobytes() for s in sets]])
                kept = ["node", "cluster", "places"]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.columns], [*kept, *made.schema.names])
                yield out.filter(own)

    few = places.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    dealt = places.groupBy("doc_id", "node", "cluster").agg(F.collect_list(F.struct("block", "side")).alias("places"))
    texts = docs.select("doc_id", "text").join(F.broadcast(dealt) if few else dealt, "doc_id").select("text", "node", "cluster", "places")
    known = texts.mapInArrow(run, "node long, cluster long, places array<struct<block: int, side: int>>, size long, bits binary, set binary")
    known = known.dropDuplicates(["node"]) if repeated else known
    return known.select("cluster", "node", "size", "bits", "set", F.inline("places"))


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, BITS // 64)


def _groups(batches, n_keys: int):
    """Lists of column arrays, one for each run of equal keys in the first n_keys columns."""
    held = []
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = np.stack([t.column(k).to_numpy() for k in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            part, key = t.slice(lo, hi - lo), tuple(keys[lo])
            if held and held[0][0] != key:
                yield pa.concat_tables([p for _, p in held])
                held = []
            held.append((key, part))
    if held:
        yield pa.concat_tables([p for _, p in held])


def candidates(rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each size-banded tile edges that span what the bitmaps let through.

    rows has tile, band, node, size and slice, bits the bitmap of each node and slice. Tiles of over TILE rows are cut into blocks that meet in pairs; with over
    PAIRED blocks, a group of near copies as a rule, nodes that leaders join already do not meet again.
    """
    schema = [("u", pa.int64()), ("v", pa.int64())]
    key = ["tile", "band", "i", "j"]

    def edges(x) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, (x["key"][1:] != x["key"][:-1]).any(axis=1)])
        lengths = np.diff(np.r_[starts, len(x["node"])])
        run, n = np.repeat(np.arange(len(starts)), lengths), np.repeat(lengths, lengths)
        found = [np.zeros((0, 2), np.int64)]
        # Small runs all at once, by the distance of two rows; others one by one.
        for step in range(1, 8):
            a = np.flatnonzero((run[step:] == run[:-step]) & (n[step:] <= 8))
            b = a + step
            a, b = (v[((x["side"][a] == 2) | (x["side"][a] != x["side"][b])) & (x["node"][a] != x["node"][b])] for v in (a, b))
            differ = np.bitwise_count(x["bits"][a] ^ x["bits"][b]).sum(axis=1, dtype=np.int64)
            sa, sb = x["size"][a], x["size"][b]
            most = np.minimum((sa + sb - differ) // 2, np.minimum(sa, sb))
            may = 100 * most >= percent * (sa + sb - most)
            found.append(np.stack([x["node"][a[may]], x["node"][b[may]]], axis=1))
        for at, length in zip(starts[lengths > 8], lengths[lengths > 8], strict=True):
            nodes, sizes, side, bits = (x[c][at : at + length] for c in ("node", "size", "side", "bits"))
            linked = Union(length)
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            for i in a:
                hit = may_link(sizes[i : i + 1], bits[i : i + 1], sizes[b], bits[b], percent)[0]
                for j in b[hit & (nodes[b] != nodes[i])]:
                    linked.join(int(i), int(j))
            roots = linked.roots()
            found.append(np.stack([nodes, nodes[roots]], axis=1)[roots != np.arange(length)])
        return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)

    def cross(batches):
        held = None
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in ("node", "size", "side")}
            x["key"], x["bits"] = np.stack([b.column(c).to_numpy() for c in key], axis=1), _bits(b.column("bits").to_pylist())
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            cut = len(x["node"]) - int((x["key"] == x["key"][-1]).all(axis=1)[::-1].argmin() or len(x["node"]))
            held = {c: v[cut:] for c, v in x.items()}
            if cut:
                yield _out(schema, list(edges({c: v[:cut] for c, v in x.items()}).T))
        if held is not None:
            yield _out(schema, list(edges(held).T))

    def met(dealt):
        return dealt.select(*key, "node", "size", "bits", "side").repartition(*key).sortWithinPartitions(*key).mapInArrow(cross, "u long, v long")

    # side 2: a block with itself; 0 and 1: the two blocks of a pair.
    alone = F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")
    large = stored(rows.groupBy("tile", "band").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "tiles")
    rows = rows.join(bits, ["node", "slice"])
    if not large.limit(1).count():
        return met(rows.select("*", *alone))
    small = met(rows.join(large, ["tile", "band"], "left_anti").select("*", *alone))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    wide = rows.join(large, ["tile", "band"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = small.unionAll(met(_all_blocks(wide.where(F.col("n") <= TILE * PAIRED))))
    huge = wide.where(F.col("n") > TILE * PAIRED)
    if not large.where(F.col("n") > TILE * PAIRED).limit(1).count():
        return found
    # Huge tiles: blocks that all see the same few leaders join most nodes; only what stays outside a tile's
    # largest part then meets every block of the tile.
    huge = stored(huge, "huge")
    turn = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(LEADERS)).alias("turn")
    lead = huge.groupBy("tile", "band", turn).agg(F.min("node").alias("node")).select("tile", "band", "node")
    lead = huge.join(lead, ["tile", "band", "node"], "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).where("i <> own")
    own = huge.select("*", F.col("own").alias("i"))
    first = stored(met(own.unionByName(lead).select("*", F.lit(-1).alias("j"), F.lit(2).alias("side"))), "first-edges")
    parts = stored(huge.select("tile", "band", "node").join(components(first), "node", "left").select("tile", "band", "node", F.coalesce("root", "node").alias("part")), "parts")
    biggest = parts.groupBy("tile", "band", "part").agg(F.count("*").alias("n")).groupBy("tile", "band").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    outside = parts.join(biggest, ["tile", "band", "part"], "left_anti").select("tile", "band", "node")
    outside = stored(outside, "outside")
    turns = stored(outside.groupBy("tile", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("turns")), "turns")
    rest = huge.join(outside, ["tile", "band", "node"], "left_semi").join(turns, ["tile", "band"]).withColumn("j", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("turns")).cast("int"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("side"))
    against = huge.join(turns, ["tile", "band"]).select("*", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("j"), F.lit(1).alias("side"))
    return found.unionAll(first).unionAll(met(rest.select(against.columns).unionAll(against)))


def _all_blocks(wide: DataFrame) -> DataFrame:
    """Every pair of a tile's blocks."""
    cut = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))


def verify(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of the exact sets that span each group of (cluster, block, side, node, size, bits, set).

    All pairs of side 0 with side 0 and 1 are tested, but for pairs that are connected by then.
    """
    schema = [("u", pa.int64()), ("v", pa.int64())]

    def run(batches):
        for g in _groups(batches, 2):
            nodes, sizes, side = (g.column(c).to_numpy() for c in ("node", "size", "side"))
            bits = _bits(g.column("bits").to_pylist())
            sets = [np.frombuffer(x, np.uint64) for x in g.column("set").to_pylist()]
            linked = Union(len(nodes))
            for i in np.flatnonzero(side == 0):
                roots = linked.roots() if i % 16 == 0 or len(nodes) < 64 else roots
                may = may_link(sizes[i : i + 1], bits[i : i + 1], sizes, bits, percent)[0]
                may[: i + 1] &= side[: i + 1] != 0  # pairs within side 0 once
                for j in np.flatnonzero(may & (roots != roots[i])):
                    if nodes[j] == nodes[i] or linked.find(int(i)) == linked.find(int(j)):
                        continue
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (len(both) - same):
                        linked.join(int(i), int(j))
            roots = linked.roots()
            own = np.flatnonzero(roots != np.arange(len(roots)))
            if len(own):
                yield _out(schema, [nodes[own], nodes[roots[own]]])

    columns = ["cluster", "block", "side", "node", "size", "bits", "set"]
    return dealt.select(columns).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "side").mapInArrow(run, "u long, v long")


def _union(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, found)


def guesses(rows: DataFrame, bits: DataFrame, whole: int, percent: int) -> DataFrame:
    """candidates() of all tiles, in rounds of whole tiles: bitmaps are much larger than tile rows, and near copies have all their tiles in common."""
    rounds = max(1, -(-PER_ROW * rows.count() // max(1, whole)))
    if rounds == 1:
        return candidates(rows, bits, percent)
    turn = F.pmod(F.xxhash64("tile"), F.lit(rounds))
    return _union([stored(candidates(rows.where(turn == r), bits, percent).distinct(), "guesses") for r in range(rounds)])


def compared(docs: DataFrame, places: DataFrame, repeated: bool, whole: int, width: int, percent: int, seed: int) -> DataFrame:
    """verify() of all places, in rounds of whole blocks. Only places are stored: arrays are made anew from the texts for each round."""
    places = stored(places.select("node", "doc_id", "size", "cluster", F.col("block").cast("int").alias("block"), F.col("side").cast("int").alias("side")), "places")
    rounds = max(1, -(-PER_SHINGLE * (places.agg(F.sum("size")).first()[0] or 0) // max(1, whole)))
    turn = F.pmod(F.xxhash64("cluster", "block"), F.lit(rounds))
    return _union([stored(verify(arrays(docs, places.where(turn == r), repeated, width, seed), percent), "links") for r in range(rounds)])


def links(docs: DataFrame, nodes: DataFrame, repeated: bool, rank, width: int, percent: int, seed: int) -> DataFrame:
    """(u, v) between nodes: edges that have the components of all links, each of them a link or implied by links.

    nodes has node, first (the smallest doc_id) and size, one row for each set; repeated tells whether a doc_id may have several texts.
    """
    rows = stored(tile_rows(docs, rank, width, percent, seed), "tile-rows")
    ids = stored(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("doc_id"), "size"), "ids")
    bits = bitmaps(docs, ids.select("doc_id").distinct(), width, percent, seed)
    bits = stored((bits.dropDuplicates(["node"]) if repeated else bits).select("node", F.inline("slices")), "bitmaps")
    small = bits.limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS
    whole = nodes.agg(F.sum("size")).first()[0] or 0
    clusters = components(guesses(rows, F.broadcast(bits) if small else bits, whole, percent)).withColumnRenamed("root", "cluster")
    # Only what bitmaps could not tell apart is compared exactly, so only its arrays are made.
    members = stored(ids.join(clusters, "node"), "members")
    # A cluster's blocks hold BLOCK nodes and BLOCK_ITEMS shingles or so.
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_ITEMS))).cast("int")
    large = stored(members.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    found = compared(docs, members.join(large, "cluster", "left_anti").select("*", F.lit(0).alias("block"), F.lit(0).alias("side")), repeated, whole, width, percent, seed)
    if not large.limit(1).count():
        return found
    # Large clusters: blocks that all see the same few leaders join most nodes; what stays outside a cluster's
    # largest part then meets every block of the cluster, again in blocks.
    wide = stored(members.join(large, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "wide")
    leaders = wide.groupBy("cluster", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(LEADERS)).alias("turn")).agg(F.min("node").alias("node")).select("node")
    lead = wide.join(leaders, "node", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    own = wide.select("*", F.col("own").alias("block"), F.lit(0).alias("side"))
    first = compared(docs, own.unionByName(lead.where("block <> own")), repeated, whole, width, percent, seed)
    parts = stored(wide.select("cluster", "node", "size").join(components(first), "node", "left").select("cluster", "node", "size", F.coalesce("root", "node").alias("part")), "parts")
    biggest = parts.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    outside = stored(parts.join(biggest, ["cluster", "part"], "left_anti"), "outside")
    turns = stored(outside.groupBy("cluster").agg(blocks.alias("turns")), "turns")
    meet = wide.join(turns, "cluster")
    rest = meet.join(outside.select("node"), "node", "left_semi").withColumn("turn", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("turns")).cast("int"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.lit(0).alias("side"))
    rest = rest.withColumn("block", F.col("other") * F.col("turns") + F.col("turn"))
    against = meet.select("*", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(1).alias("side"))
    against = against.withColumn("block", F.col("own") * F.col("turns") + F.col("turn"))
    second = compared(docs, rest.select(against.columns).unionByName(against), repeated, whole, width, percent, seed)
    return found.unionAll(first).unionAll(second)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row of docs.

    A document's set has its distinct shingles of width words (A-Z lower-cased); fewer words make one shingle.
    Documents link if 100 * intersection >= percent * union; component_id is the smallest doc_id that links
    reach. Texts without words, and null texts, have empty sets and link with nothing. Rows of one doc_id with
    different texts are documents of their own that share the id. Rows without doc_id are returned with a
    null component_id and link with nothing. No cap: every pair that reaches the threshold is found, copies
    count through their common set.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    for seed in range(8):
        sets, rank = describe(docs, width, seed)
        # Combined before the shuffle, so a set that very many documents have is no burden.
        nodes = sets.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("size").alias("size"), F.min("twin").alias("a"), F.max("twin").alias("b"))
        nodes = stored(nodes, "nodes")
        if not nodes.where("a <> b").limit(1).count():  # else two sets share a name: name them anew
            break
    repeated = sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    found = components(links(known, nodes.select("node", "first", "size"), repeated, rank, width, percent, seed))
    named = stored(nodes.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    # A root's nodes, and a node's documents, may be very many. What they meet is stored first: a join of two plain
    # shuffles can be split where a key is skewed, one on top of an aggregate cannot.
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = stored(named.join(least, "root").select("node", "component_id"), "named")
    return sets.join(named, "node", "left").select(
        "doc_id", "text_hash", F.col("size").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("text_hash")


#: All pairs of sets that share a shingle, and the smallest doc_id that links reach.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n u ON a = u.doc_id JOIN n v ON b = v.doc_id WHERE 100 * i >= 85 * (u.n + v.n - i)),
r(a, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, m FROM r JOIN links USING (a))
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON a = n.doc_id GROUP BY a
"""
