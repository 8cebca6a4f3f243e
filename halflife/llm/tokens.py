"""Token counts by a two-tier look-up of pre-tokens, without a shuffle of the texts' pre-tokens.

Method: frequent pre-tokens and their token counts travel to every worker in a small broadcast table; the
others are encoded by the library in batches and kept in a bounded cache of the worker. A text is split into
pre-tokens here only if the tokenizer's split is the known one and all the text's characters are of a set on which it is sure
to be the library's own; any other text is encoded by the library as a whole. Either way the count is the library's.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import documents, small_batches

#: Entries of the frequent table. It is made of the FROM_TASK most frequent pre-tokens of every task over all
#: documents; it only saves work, a count never depends on it.
FREQUENT = 50_000
FROM_TASK = 10_000
#: Words that a task counts at once; beyond it the rarer half is forgotten.
COUNTED = 400_000
#: Entries of a worker's cache; beyond it the cache starts anew.
CACHE = 400_000
LONGEST_CACHED = 64
OVER_LIMIT = 2_048

#: The normalizer and the split of which pre_tokens() is a copy. Tokenizers with others encode whole texts.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Characters for which lower-casing, composition and character classes are beyond doubt: printable ASCII,
#: its white space and the letters of Latin-1. "<|" could begin a special token, so texts with it are not split.
_SURE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


@functools.lru_cache(maxsize=2)
def _lengths(spec: bytes):
    """A function from texts to their token counts: of the tokenizers library for JSON, of sentencepiece for anything else."""
    if not spec.lstrip().startswith(b"{"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec.decode())
    made.no_truncation()
    made.no_padding()
    return lambda texts: [len(x) for x in made.encode_batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def splits(spec: bytes) -> bool:
    """Whether pre_tokens() is the tokenizer's own split: see KNOWN; its special tokens all begin with "<|"."""
    if not spec.lstrip().startswith(b"{"):
        return False
    got = json.loads(spec)
    return all(got.get(k) == v for k, v in KNOWN.items()) and all(t["content"].startswith("<|") for t in got.get("added_tokens") or [])


@functools.lru_cache(maxsize=2)
def _cache(spec: bytes) -> dict[str, int]:
    return {}


def words(text: str) -> list[str] | None:
    """The text's words, lower-cased, none of which shares a pre-token with another; or None where only the library can tell."""
    return None if "<|" in text or not _SURE.fullmatch(text) else text.lower().split()


def pre_tokens(word: str) -> list[str]:
    return _SPLIT.findall(word)


def count_batch(texts: list[str], spec: bytes, frequent: dict[str, int]) -> list[int]:
    lengths, cache, split = _lengths(spec), _cache(spec), splits(spec)
    if len(cache) > CACHE:
        cache.clear()
    found = [words(t) if split else None for t in texts]
    own: dict[str, int | None] = {w: frequent.get(w, cache.get(w)) for w in set().union(*(s for s in found if s))}
    # A word that is one pre-token is looked up as it is; others, and misses, are put together once a batch.
    apart = {w: pre_tokens(w) for w, n in own.items() if n is None}
    missed = list(dict.fromkeys(p for pieces in apart.values() for p in pieces if p not in frequent and p not in cache))
    new = {}
    for part in _parts(missed, 10_000):
        new.update(zip(part, lengths(part), strict=True))
    for w, pieces in apart.items():
        own[w] = sum(new[p] if p in new else frequent[p] if p in frequent else cache[p] for p in pieces)
    whole = iter(n for part in _parts([t for t, s in zip(texts, found, strict=True) if s is None], 32) for n in lengths(part))
    counts = [next(whole) if s is None else sum(map(own.__getitem__, s)) for s in found]
    # The bound is kept between batches, so it cannot lose a pre-token that is needed now.
    cache.update((p, n) for p, n in new.items() if len(p) <= LONGEST_CACHED)
    return counts


def _parts(x: list, n: int):
    return (x[i : i + n] for i in range(0, len(x), n))


def frequent_table(docs: DataFrame, spec: bytes, entries: int = FREQUENT) -> dict[str, int]:
    """Pre-token to token count for the most frequent pre-tokens of all documents, as the tasks' counters have them."""
    if not splits(spec):
        return {}

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()) or ())
                if len(seen) > COUNTED:
                    seen = Counter(dict(nlargest(COUNTED // 2, seen.items(), key=lambda x: x[1])))
        pieces: Counter = Counter()
        for w, n in seen.items():
            for p in pre_tokens(w):
                if len(p) <= LONGEST_CACHED:
                    pieces[p] += n
        top = nlargest(FROM_TASK, pieces.items(), key=lambda x: x[1])
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["p", "n"])

    counted = docs.where("text is not null").select("text").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "p").limit(entries).toArrow().column("p").to_pylist()  # bounded: entries
    return dict(zip(top, (n for part in _parts(top, 10_000) for n in _lengths(spec)(part)), strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, entries: int = FREQUENT) -> DataFrame:
    """docs with the columns n_bytes (UTF-8) and n_tokens added; a null text is empty and has 0 of both.

    Counts are those of the library for the file (tokenizers for JSON, sentencepiece for a model), without added special
    tokens; special strings inside texts are what the library makes of them by default. Rows are independent:
    repeated rows repeat. Columns of docs named n_bytes or n_tokens are replaced.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    spark = docs.sparkSession
    # Bounded: one tokenizer file, and `entries` pre-tokens of LONGEST_CACHED characters.
    shared = spark.sparkContext.broadcast((spec, frequent_table(docs, spec, entries)))

    def batch(texts: pa.Array) -> pa.Array:
        spec, frequent = shared.value
        return pa.array(np.array(count_batch([t or "" for t in texts.to_pylist()], spec, frequent), np.int64))

    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": F.arrow_udf(batch, "long")(text)})


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))
