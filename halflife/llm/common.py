"""What the text operators share: shared scratch tables, row keys, ASCII lower-casing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.sources.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space that separates words and is stripped from lines: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

#: ASCII but for letters and digits, and but for lower-case letters and digits.
PUNCTUATION = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
NOT_LOWER = PUNCTUATION + UPPER


def one_of(characters: str, but: bool = False) -> str:
    """A regular expression of one of these characters, or of any other. Each is named, as Java looks named ones up in a table and tries ranges one by one."""
    return f"[{'^' if but else ''}{''.join(f'\\x{ord(c):02x}' for c in characters)}]"


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the bytes of an Arrow batch to 16 MB where the session has the default: texts are long, workers are small."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "16m")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, everything else stays (lower() would change other scripts too)."""
    return F.translate(text, UPPER, LOWER)


def hash128(x: Column) -> Column:
    """128 bits as a struct of two longs, for keys of which a collision may not happen in practice."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(0x5BD1E995), x).alias("b"))


#: Up to so many ids (16 MB) are broadcast.
BROADCAST_IDS = 1_000_000


def text_hash() -> Column:
    return F.xxhash64("text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id and text_hash() are in gone (doc_id, text_hash); null is a doc_id like others.

    A small table, checked by a count, is broadcast; a larger one is joined by a shuffle.
    """
    gone = stored(gone.select("doc_id", "text_hash").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d, g = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_hash().alias("text_hash")).alias("d"), (F.broadcast(gone) if few else gone).alias("g")
    kept = d.join(g, [F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), F.col("d.text_hash") == F.col("g.text_hash")], "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
