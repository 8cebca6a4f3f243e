"""Quality rules: boosted trees over document statistics.

The statistics are counted over whole texts in Arrow batches; the trees are fitted on a bounded sample of
labelled documents and scored with numpy in the same pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm import gbt
from halflife.llm.common import documents, small_batches

#: The trees are fitted on the labelled documents with the smallest hashes, so many at most.
SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is kept if the trees give it at least this probability of good quality.
KEEP_FROM = 0.5

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which the log odds of good quality may move with them (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "exclamation_share": -1, "digit_share": -1, "distinct_share": 0, "stop_share": 0,
}
MONOTONE = tuple(FEATURES.values())

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, list(b" \t\n\x0b\x0c\r"))
_STARTS = (_BYTE & 0xC0) != 0x80  # bytes that begin a code point
_WORD_CHAR = (_STARTS & ~_SPACE).astype(np.int64)
_SYMBOL = np.isin(_BYTE, list(SYMBOLS)).astype(np.int64)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words lie in three-word windows found twice or more, and how many distinct words there are."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(words) < 4 or len(seen) == len(words):
        return 0, len(seen)
    n = len(seen)
    code = ids[:-2] * n + ids[1:-1]
    if n > 2_000_000:  # n**3 would leave 64 bits
        code = np.unique(code, return_inverse=True)[1]
    _, at, times = np.unique(code * n + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= twice
    return int(covered.sum()), n


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts and the features of one UTF-8 text. An empty text has zeros."""
    words = text.split()  # bytes.split() separates at \x20 and \x09-\x0D exactly
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars, symbols = int(per_byte @ _WORD_CHAR), int(per_byte @ _SYMBOL)
    repeats, distinct = repeated_words(words)
    dup = len(full) - len(set(full))
    n, c = max(len(words), 1), max(chars, 1)
    return [len(words), chars, symbols, dup, repeats], [
        float(np.log1p(len(words))), chars / n, symbols / c, dup / max(len(full), 1), repeats / n,
        per_byte[65:91].sum() / c, per_byte[33] / n, per_byte[48:58].sum() / c, distinct / n, per_byte[46] / n,
    ]


def assess(docs: DataFrame, forest: gbt.Forest | None) -> DataFrame:
    """(row, quality) for every row of docs: its columns as a struct, and a struct of the counts, features, score, base_failed and kept.

    A null text counts as empty. The column is computed in one pass over the whole text; without a forest
    score and verdict are those of the base rules alone.
    """
    fields = [(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in FEATURES] + [("score", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    schema = ", ".join(f"{n}: {'bigint' if t == pa.int64() else 'double' if t == pa.float64() else 'boolean'}" for n, t in fields)

    def batch(texts: pa.Array) -> pa.Array:
        both = [statistics(t or b"") for t in texts.to_pylist()]
        counts = np.array([x for x, _ in both], np.int64).reshape(len(both), len(COUNTS))
        features = np.array([x for _, x in both], float).reshape(len(both), len(FEATURES))
        score = forest.probability(features) if forest else np.ones(len(both))
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        columns = [*counts.T, *features.T, score, failed, ~failed & (score >= KEEP_FROM)]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    # Non-deterministic only to the optimizer: a filter on the verdict then does not compute the column twice.
    small_batches(docs.sparkSession)
    udf = F.arrow_udf(batch, f"struct<{schema}>").asNondeterministic()
    return docs.select(F.struct(*docs.columns).alias("row"), udf(F.col("text").cast("binary")).alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gbt.Forest:
    """Trees fitted on at most sample_rows labelled documents, chosen by the hash of their doc_id.

    A doc_id with several labels counts as its lowest; labels or documents with nulls are left out. Only the
    sample's features reach the driver. Without two classes nothing is rejected by the trees.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # Bounded: sample_rows rows of two numbers.
    rows = assess(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), None)
    got = rows.select("row.doc_id", "row.good", *[F.col(f"quality.{c}") for c in FEATURES]).toPandas().sort_values("doc_id", kind="stable")
    y = (got["good"] > 0).to_numpy(float)
    return gbt.fit(got[list(FEATURES)].to_numpy(float), y, MONOTONE) if len(set(y)) == 2 else gbt.constant(0.999)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = train(docs, labels(spark, sf_dir))
    return assess(docs.select("doc_id", "text"), forest).select("row.doc_id", *[F.col(f"quality.{c}") for c in (*COUNTS, "base_failed", "kept", "score")])


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the counts and the base rules."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


COUNTED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE times > 1) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""
