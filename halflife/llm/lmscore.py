"""LM scoring: code lengths under context-tree weighting, beside a word base, learned from part of the corpus."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from halflife.llm.common import LOWER, UPPER, documents, small_batches, stored
from halflife.llm.ctw import DEPTH, SPLIT, Table, Tree, entering, pieces, top_passed
from halflife.llm.shingles import words

#: Contexts of two bytes are dealt to so many parts, each weighted whole; a part's codes are dealt to so many cells.
PARTS = 512
CELLS = 8
#: Parts are weighted together until they have so many codes; a larger part goes alone, whole.
TOGETHER = 500_000
#: Codes in one row of the table of all.
ROW = 200_000
#: Bytes of packed codes that a worker passes on at once.
SENT = 4 << 20
#: Frequent words are looked up on the workers: so many at most, by a digest beyond so many bytes. Others are joined.
FREQUENT = 100_000
LONGEST = 64
#: Rows of a worker's counters before they are passed on.
FLUSH = 400_000
FOLDS, HELD_OUT = 7, 2


def with_fold(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, learn): held_out where crc32(doc_id as text) mod 7 is 2; rows without doc_id are neither."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return docs.select("doc_id", "text", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learn"))


def _rows(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over the texts of train: every word, and the end of a text as the empty word."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    def out(seen):
        return _rows([("word", pa.array(list(seen), pa.binary())), ("n", pa.array(list(seen.values()), pa.int64()))])

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _merged(held) -> tuple[np.ndarray, np.ndarray]:
    codes, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, numbers = codes[order], numbers[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[at], np.add.reduceat(numbers, at)


def _packed(x: np.ndarray) -> bytes:
    """Longs by place of their bytes, which compress well; sorted codes are packed as differences."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _codes(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x))


def _runs(x: np.ndarray):
    """(first, end) of the stretches of equal numbers."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a column batch: one number for each Arrow batch of rows. Store it: another run may number otherwise."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), (task << 32) + number))], [*b.schema.names, "batch"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("batch", LongType())]))


def cell_of(codes: np.ndarray) -> np.ndarray:
    """A part of the two nearest context bytes, times CELLS, plus a hash of the whole code."""
    part = (((codes >> 8) & 0xFFFF) * 40_503 & 0xFFFF) * PARTS >> 16
    return part * CELLS + ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).view(np.int64) % CELLS


def _dealt(codes: np.ndarray, *numbers: np.ndarray):
    """(cell, codes, numbers...) of each cell, codes sorted."""
    cell = cell_of(codes)
    order = np.argsort(cell, kind="stable")
    cell, codes, *numbers = (x[order] for x in (cell, codes, *numbers))
    for i, j in _runs(cell):
        yield int(cell[i]), codes[i:j], *(x[i:j] for x in numbers)


def batch_codes(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(cell, batch, codes, n): each batch's codes by cell, once each, and how often its rows to learn have them (0 where only others do)."""
    def run(batches):
        for b in batches:
            number = b.column("batch").to_numpy()
            for lo, hi in _runs(number):
                held, size = [], 0
                texts, learn = b.column("text").slice(lo, hi - lo), b.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                for wanted in (True, False):
                    picked = texts.filter(pa.array(learn == wanted))
                    for codes, _ in pieces(((t.as_py() or "").encode().lower() for t in picked), depth):
                        codes, n = np.unique(codes, return_counts=True)
                        held.append((codes, n if wanted else np.zeros_like(n)))
                        size += len(codes)
                        if size > TOGETHER + 2 * len(held[0][0]):
                            held = [_merged(held)]
                            size = len(held[0][0])
                ready = [(cell, _packed(np.diff(codes, prepend=0)), _packed(n)) for cell, codes, n in _dealt(*_merged(held))]
                cell, codes, n = zip(*ready, strict=True)
                yield _rows([
                    ("cell", pa.array(cell, pa.int32())), ("batch", pa.array(np.full(len(cell), number[lo]), pa.int64())),
                    ("codes", pa.array(codes, pa.binary())), ("n", pa.array(n, pa.binary())),
                ])

    return rows.select("batch", "learn", "text").mapInArrow(run, "cell int, batch long, codes binary, n binary")


def _by(batches, key: str):
    """(key, the row's other columns), row by row."""
    for b in batches:
        names = [n for n in b.schema.names if n != key]
        for number, *x in zip(b.column(key).to_pylist(), *(b.column(n) for n in names), strict=True):
            yield number, dict(zip(names, x, strict=True))


class _Sender:
    """Collects rows of (cell or batch, packed codes, packed numbers) until they have SENT bytes."""

    def __init__(self, **kinds):
        self.kinds, self.rows, self.size = kinds, [], 0

    def add(self, *row):
        self.rows.append(row)
        self.size += len(row[1]) + len(row[2])
        return [self.take()] if self.size > SENT else []

    def take(self):
        columns = zip(*self.rows, strict=True)
        out = _rows([(c, pa.array(x, kind)) for (c, kind), x in zip(self.kinds.items(), columns, strict=True)])
        self.rows, self.size = [], 0
        return out

    def rest(self):
        return [self.take()] if self.rows else []


def context_table(pairs: DataFrame, tasks: int) -> DataFrame:
    """(cell, codes, n): every code of batch_codes() with its number, whole, in rows of ROW codes at most."""
    def run(batches):
        now, held, size, sender = None, [], 0, _Sender(cell=pa.int32(), codes=pa.binary(), n=pa.binary())

        def full():
            codes, n = _merged(held)
            for at in range(0, len(codes), ROW):
                yield from sender.add(now, _packed(np.diff(codes[at : at + ROW], prepend=0)), _packed(n[at : at + ROW]))

        for cell, row in _by(batches, "cell"):
            if cell != now and held:
                yield from full()
                held, size = [], 0
            now = cell
            held.append((_codes(row["codes"].as_py()), _unpacked(row["n"].as_py())))
            size += len(held[-1][0])
            if size > TOGETHER + 2 * len(held[0][0]):
                held = [_merged(held)]
                size = len(held[0][0])
        if held:
            yield from full()
        yield from sender.rest()

    dealt = pairs.select("cell", "codes", "n").repartition(tasks, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "cell int, codes binary, n binary")


def _whole_parts(table: DataFrame) -> DataFrame:
    """The rows of context_table with a column part, each part in one task. They have each code once, however often it occurs."""
    part = F.floor(F.col("cell") / CELLS).cast("int")
    return table.select(part.alias("part"), "codes", "n").repartition("part").sortWithinPartitions("part")


def _trees(batches, depth: int, most: int):
    """Trees of whole parts, of most codes or so; a larger part alone."""
    now, held, size = None, [], 0
    for part, row in _by(batches, "part"):
        if part != now and size >= most:
            yield Tree(*_merged(held), SPLIT, depth)
            held, size = [], 0
        now = part
        held.append((_codes(row["codes"].as_py()), _unpacked(row["n"].as_py())))
        size += len(held[-1][0])
    if held:
        yield Tree(*_merged(held), SPLIT, depth)


def train_top(table: DataFrame, depth: int = DEPTH, most: int = TOGETHER) -> tuple[np.ndarray, list]:
    """The depths before SPLIT, as top_passed() gives them. At most 8 x 65,536 sums and 65,536 numbers reach the driver, whatever the corpus."""
    def run(batches):
        for tree in _trees(batches, depth, most):
            k, node, logs, total = tree.sums()
            yield _rows([("k", pa.array(k, pa.int32())), ("node", pa.array(node)), ("logs", pa.array(logs)), ("total", pa.array(total))])

    sums = _whole_parts(table).mapInArrow(run, "k int, node long, logs double, total double")
    got = sums.groupBy("k", "node").agg(F.sum("logs").alias("logs"), F.sum("total").alias("total")).toArrow()
    return top_passed(*(got.column(c).to_numpy() for c in ("k", "node", "logs", "total")))


def weighted_codes(table: DataFrame, top, depth: int = DEPTH, most: int = TOGETHER) -> DataFrame:
    """(cell, codes, bits): the code length (float) of each code's byte after its context, negative where the code was learned once."""
    shared = table.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        sender = _Sender(cell=pa.int32(), codes=pa.binary(), bits=pa.binary())
        for tree in _trees(batches, depth, most):
            bits, _ = tree.mixed(entering(shared.value, tree.codes[0]))
            bits = np.where(tree.numbers[-1] == 1, bits, -bits).astype(np.float32)  # log2 of a probability is below 0
            for cell, codes, mine in _dealt(tree.codes[-1], bits):
                yield from sender.add(cell, _packed(np.diff(codes, prepend=0)), mine.tobytes())
        yield from sender.rest()

    return _whole_parts(table).mapInArrow(run, "cell int, codes binary, bits binary")


def code_bits(pairs: DataFrame, weighted: DataFrame, tasks: int) -> DataFrame:
    """(batch, codes, bits): for each batch its codes' numbers of weighted_codes(), a cell in a row."""
    def run(batches):
        now, held, sender = None, [], _Sender(batch=pa.int64(), codes=pa.binary(), bits=pa.binary())
        for cell, row in _by(batches, "cell"):
            if cell != now:
                now, held, codes = cell, [], None
            if row["batch"].as_py() is None:
                held.append((_codes(row["codes"].as_py()), np.frombuffer(row["bits"].as_py(), np.float32)))
                continue
            if codes is None:  # a cell has one row of the table
                (codes, bits), held = held[0], []
            packed = row["codes"].as_py()
            yield from sender.add(row["batch"].as_py(), packed, bits[np.searchsorted(codes, _codes(packed))].tobytes())
        yield from sender.rest()

    rows = weighted.select("cell", F.lit(None).cast("long").alias("batch"), "codes", "bits")
    rows = rows.unionAll(pairs.select("cell", "batch", "codes", F.lit(None).cast("binary").alias("bits")))
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell", F.asc_nulls_first("batch")).mapInArrow(run, "batch long, codes binary, bits binary")


def score_texts(docs: DataFrame, depth: int = DEPTH, most: int = TOGETHER) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_once.

    score is the log10 probability of the text, A-Z lower-cased, with its end, under context-tree weighting
    of depth bytes (2 at least) learned from the rows that with_fold() gives to training; base_score adds log10((c + 1) / (N + V + 1)) over
    the tokens, the end included. n_once counts the bytes that training has once after their context, so a text that is nowhere repeated
    has some of its own where one that occurs twice has none. Null texts are empty: one token, the end. With no training rows counts are 0
    and every byte costs eight bits. Repeated rows count and are scored each; rows without doc_id are scored only.
    The model keeps every context. Parts of the contexts are weighted apart, and the log2 probabilities of a batch's
    codes come back to it by a shuffle; most bounds how many small parts are weighted at a time, and no result.
    """
    if depth < SPLIT:
        raise ValueError(f"depth is {SPLIT} at least")
    small_batches(docs.sparkSession)
    docs = stored(numbered(with_fold(docs)), "texts", "zstd")
    # As many tasks as batches, so what a task reads does not grow with the corpus.
    known = docs.agg(F.count_distinct("batch").alias("n"), F.max(F.shiftright("batch", 32)).alias("task")).first()
    tasks, writers = max(1, known["n"]), (known["task"] or 0) + 1
    train = docs.where("learn")
    counts = stored(word_counts(train), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    short = F.when(F.length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit(b"\0"), F.unhex(F.sha2("word", 256))))
    top = counts.orderBy(F.desc("n"), F.xxhash64("word")).limit(FREQUENT).select(short.alias("word"), "n").toArrow()
    frequent = {w: math.log10(c + 1) for w, c in zip(*(c.to_pylist() for c in top.columns), strict=True)}
    # Bounded: FREQUENT words of LONGEST bytes.
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    pairs = stored(batch_codes(docs, depth), "codes", "zstd")
    table = stored(context_table(pairs, min(tasks, PARTS * CELLS)), "contexts", "zstd")

    def slices(batches):
        """(rows, table of bits) of at most 256 rows of one batch."""
        now, held, known = None, [], None
        for b in batches:
            number, coded = b.column("batch").to_numpy(), ~b.column("codes").is_null().to_numpy(zero_copy_only=False)
            for lo, hi in _runs(number * 2 + coded):
                if number[lo] != now:
                    now, held, known = number[lo], [], None
                if coded[lo]:
                    for c, x in zip(b.column("codes").slice(lo, hi - lo), b.column("bits").slice(lo, hi - lo), strict=True):
                        held.append((_codes(c.as_py()), np.frombuffer(x.as_py(), np.float32)))
                    continue
                if known is None:
                    known, held = Table(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for at in range(lo, hi, 256):
                    yield b.slice(at, min(256, hi - at)), known

    def run(batches):
        frequent = shared.value
        for part, known_bits in slices(batches):
            texts = [(t or "").encode().lower() for t in part.column("text").to_pylist()]
            bits, once = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for codes, owner in pieces(texts, depth):
                found = known_bits.get(codes)[0]
                bits -= np.bincount(owner, np.abs(found), len(texts))
                once += np.bincount(owner[found < 0], minlength=len(texts))
            tokens, known, logs, rare, times = [], [], [], [], []
            for t in texts:
                seen = Counter(t.split())
                seen[b""] = 1
                tokens.append(sum(seen.values()))
                hits, log, rest, rest_times = 0, 0.0, [], []
                for w, k in seen.items():
                    if (x := frequent.get(w if len(w) <= LONGEST else b"\0" + hashlib.sha256(w).digest())) is None:
                        rest.append(w)
                        rest_times.append(k)
                    else:
                        hits += k
                        log += k * x
                known.append(hits)
                logs.append(log)
                rare.append(rest)
                times.append(rest_times)
            yield _rows([
                ("doc_id", part.column("doc_id")), ("held_out", part.column("held_out")), ("n_bytes", pa.array([len(t) for t in texts], pa.int64())),
                ("n_tokens", pa.array(tokens, pa.int64())), ("known", pa.array(known, pa.int64())), ("logs", pa.array(logs, pa.float64())), ("bits", pa.array(bits)), ("n_once", pa.array(once)),
                ("rare", pa.array(rare, pa.list_(pa.binary()))), ("times", pa.array(times, pa.list_(pa.int64()))),
            ])

    kind = "doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, logs double, bits double, n_once long, rare array<binary>, times array<long>"
    scored = code_bits(pairs, weighted_codes(table, train_top(table, depth, most), depth, most), min(tasks, PARTS * CELLS))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = docs.select("batch", "doc_id", "held_out", "text", none("codes", "binary"), none("bits", "binary"))
    rows = rows.unionAll(scored.select("batch", none("doc_id", "long"), none("held_out", "boolean"), none("text", "string"), "codes", "bits"))
    # The first batches of all tasks that numbered them, then the second ones, each in a partition of its own but for few.
    place = F.col("batch").bitwiseAND(F.lit(0xFFFFFFFF)) * writers + F.shiftright("batch", 32)
    rows = rows.repartitionById(2 * tasks, F.pmod(place, F.lit(2 * tasks)).cast("int")).sortWithinPartitions("batch", F.col("codes").isNull()).mapInArrow(run, kind)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # stored, so the numbers stay
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    added = each.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"))
    log2 = float(np.log10(2))
    return rows.drop("rare", "times").join(added, "row", "left").select(
        "doc_id", "held_out", "n_bytes", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("bits") * log2).alias("score"), (-F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"), "n_once",
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: folds, tokens and the word base."""
    rows = op1_lm_score(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: CRC-32 bit by bit; the end of a text is the empty word.
BASE = r"""
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '@upper', '@lower'), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)), xor(h, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 2 AS held_out FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS w FROM f),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id
""".replace("@upper", UPPER).replace("@lower", LOWER)
