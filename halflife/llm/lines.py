"""Line dedup: lines that many documents share stay in one document only.

Method: explode normalised lines, hash them, count the distinct documents of each hash, drop the lines
over the threshold and put each document together again by line position. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import SPACES, ascii_lower, documents, hash128, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Up to so many keys to drop (24 MB) are broadcast; where lines meet more of them, a key's rows are dealt over SALTS tasks.
BROADCAST_KEYS = 1_000_000
SALTS = 16


def line_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, positions): the lines that each document loses; documents without any are absent.

    A line's key is the line without white space at its ends and with A-Z lower-cased; keys shorter than
    min_chars code points never count. Documents are told apart by doc_id, so repeated rows of one doc_id
    are one document. Rows without doc_id are left alone: they neither count nor lose lines.
    """
    lines = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", F.trim(F.col("line"), F.lit(SPACES)).alias("line"))
        .where(F.length("line") >= min_chars)  # lower-casing keeps the length
        .select("doc_id", "text_hash", "pos", hash128(ascii_lower(F.col("line"))).alias("key"))
        .select("doc_id", "text_hash", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    )
    # Split once: the keys are counted, and meet those to drop, from a narrow table.
    lines = stored(lines, "line-keys")
    # Two steps: the distinct (key, document) pairs spread a frequent key over all tasks, the counts are then small.
    frequent = (
        lines.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("a", "b", "keeper")
    )
    frequent = stored(frequent, "lines")
    if frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        met = lines.join(F.broadcast(frequent), ["a", "b"])
    else:
        each = frequent.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(each, ["a", "b", "salt"])
    return met.where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept, no_text, rest) for every row of docs; rest has its columns but text, no_text tells whether that is null.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines except
    in the largest doc_id holding them. A null or empty text is one empty line. Repeated rows are treated
    alike; no row is lost or added. Columns besides text pass through inside rest.
    """
    drops = line_drops(docs, min_chars, min_docs)
    base = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"),
        F.col("text").isNull().alias("no_text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"),
    )
    lines = F.split("text", "\n")
    cut = base.join(drops, ["doc_id", "text_hash"], "left").select("doc_id", "rest", "no_text", "positions", "text", lines.alias("lines"))
    # array_except works on a hash set: linear in the lines, however many go.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))
    kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("positions"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"), "no_text", "rest",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
