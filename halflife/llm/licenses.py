"""License scans: an exact set-similarity join of text blocks with license templates.

Method: the tokens of all templates are put in one order, by their frequency over all blocks, rare first. A block is a
window of words, whatever the lines, of the size of its templates: windows of 2 s words, s words apart, for templates of up to s
words, so a statement that is wrapped over lines, or stands in a long line, lies whole in one block, and a block is never much longer
than what it is held against. A block meets a template if it contains at least THRESHOLD of the template's distinct tokens and
all of its required ones. Both sides then share a token within their prefixes under that order; length and position bounds
remove more pairs before the overlap of those left is counted exactly. Only built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import LOWER, NOT_LOWER, PUNCTUATION, UPPER, ascii_lower, documents, one_of, stored

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Label, words of a clause of a public license text or of its notice, and the words that a block must have.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may obtain a copy of the license at www apache org licenses license 2 0", "obtain apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable writing basis"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "neither endorse"),
    ("cc-by", "licensed under cc by nc 4 0", "licensed cc by"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", "creative commons sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived neighboring"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu general"),
    ("gpl", "released under the gpl license", "gpl license"),
    ("gpl", "licensed under the gnu license version 2", "gnu license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted obtaining"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission substantial"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla license"),
    ("reserved", "copyright all rights reserved", "copyright rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain"),
)
#: Share of a template's tokens that a block must contain, in percent.
THRESHOLD = 80
#: Steps of the windows; a template has no more words than the largest.
STEPS = (5, 8, 16, 32)

#: What separates words once A-Z is lower-cased, and a word before.
_BREAKS = one_of(NOT_LOWER) + "+"
_WORD = one_of(PUNCTUATION, but=True) + "+"


def _needed(n: int, threshold: int) -> int:
    return -(-threshold * n // 100)


def _step(words: str) -> int:
    return next(s for s in STEPS if len(words.split()) <= s)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _strings_of(sets) -> Column:
    return F.array(*[_strings(s) for s in sets])


def block_tokens(docs: DataFrame, vocabularies: dict[int, tuple[list[str], int]], marks: list[str]) -> DataFrame:
    """(doc_id, text_hash, step, start, tokens): each window's distinct template tokens, where it has as many as a template needs.

    vocabularies has, by step, the tokens of its templates and the fewest that one of them needs. Texts without any of
    the marks, one required token of each template, are not split.
    """
    # lower() is faster and no less: what ascii_lower() finds it finds. It stands in an array to be computed once.
    may = F.exists(F.array(F.lower("text")), lambda low: reduce(lambda x, y: x | y, [low.contains(m) for m in marks]))
    words = docs.where(may).select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split(ascii_lower(F.col("text")), _BREAKS), "").alias("words"))

    def windows(step: int) -> Column:
        vocabulary, least = vocabularies[step]
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - (step + 1), F.lit(0)), F.lit(step))
        # array_intersect hashes; its result has each token once.
        cut = F.transform(starts, lambda i: F.struct(F.lit(step).alias("step"), i.alias("start"), F.array_intersect(F.slice("words", i + 1, 2 * step), _strings(vocabulary)).alias("tokens")))
        return F.filter(cut, lambda w: F.size(w["tokens"]) >= least)

    return words.select("doc_id", "text_hash", F.inline(F.concat(*[windows(s) for s in sorted(vocabularies)])))


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, start, template, label, containment) for every block that meets a template.

    template numbers the templates, start is the block's first word. Copies of a row count once. Null and empty texts
    meet nothing, nor do words that are no template's.
    """
    sets = [sorted(set(words.split())) for _, words, _ in templates]
    steps = [_step(words) for _, words, _ in templates]
    needed = [_needed(len(s), threshold) for s in sets]
    required = [sorted(set(must.split())) for _, _, must in templates]
    vocabulary = sorted(set().union(*sets))
    used = sorted(set(steps))
    vocabularies = {s: (sorted(set().union(*[x for x, k in zip(sets, steps, strict=True) if k == s])), min(n for n, k in zip(needed, steps, strict=True) if k == s)) for s in used}
    blocks = stored(block_tokens(docs, vocabularies, sorted({max(r, key=lambda t: (len(t), t)) for r in required})), "blocks")
    # The templates bound the vocabulary, so its frequencies fit the driver at any size of the corpus.
    counted = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda t: (counted.get(t, 0), t))
    index = [
        (token, step, number, at, len(s), need, label)
        for number, ((label, _, _), s, need, step) in enumerate(zip(templates, sets, needed, steps, strict=True))
        for at, token in enumerate(sorted(s, key=order.index)[: len(s) - need + 1])
    ]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "token string, step int, template int, at int, length int, needed int, label string")
    # array_intersect keeps the order of its first array, which is that of the frequencies.
    ordered = blocks.select("doc_id", "text_hash", "step", "start", F.array_intersect(_strings(order), "tokens").alias("tokens"))
    fewest = reduce(lambda out, s: F.when(F.col("step") == s, F.lit(vocabularies[s][1])).otherwise(out), used, F.lit(1))
    dealt = ordered.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - fewest + 1)).alias("place", "token"))
    near = dealt.join(F.broadcast(prefixes), ["token", "step"]).where(
        (F.size("tokens") >= F.col("needed")) & (1 + F.least(F.col("length") - F.col("at") - 1, F.size("tokens") - F.col("place") - 1) >= F.col("needed"))
    )
    # Of several shared prefix tokens the first one reports the pair.
    shared = F.array_intersect("tokens", F.get(_strings_of(sets), F.col("template")))
    must = F.size(F.array_except(F.get(_strings_of(required), F.col("template")), F.col("tokens"))) == 0
    met = near.where((F.get(shared, F.lit(0)) == F.col("token")) & must).select(
        "doc_id", "text_hash", "start", "template", "label", F.size(shared).alias("overlap"), "needed", "length").where("overlap >= needed").dropDuplicates(["doc_id", "text_hash", "start", "template"])
    return met.select("doc_id", "text_hash", "start", "template", "label", (F.col("overlap") / F.col("length")).alias("containment"))


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """An array of structs (place, label) of the phrases' places in the array words, in order."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))

    def here(phrase: str, i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase.split()):
            out = out & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return out

    found = [F.transform(F.filter(at, _bind(here, phrase)), _label(label)) for phrase, label in phrases.items()]
    return F.array_sort(F.concat(*found))


def _bind(here, phrase):
    return lambda i: here(phrase, i)


def _label(label):
    return lambda i: F.struct(i.alias("place"), F.lit(label).alias("label"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of 0-9, a-z and non-ASCII after A-Z is lower-cased. n_base counts all places of the phrases;
    labels adds those of templates that a block contains. score is 1 where a phrase stands, else the largest
    containment that meets the threshold, else 0. A null text is empty: no words, no labels (""), null places.
    """
    may = "(?i)" + "|".join(p.replace(" ", one_of(PUNCTUATION) + "+") for p in PHRASES)
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"),
        # Word places only where a phrase can stand.
        F.when(text.rlike(may), F.array_remove(F.split(ascii_lower(text), _BREAKS), "")).alias("words"),
    )
    base = base.select("doc_id", "text_hash", "n_words", F.when(F.array_size("words") > 0, phrase_places(F.col("words"))).alias("found"))
    labels = template_matches(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    b, m = base.alias("b"), labels.alias("m")
    joined = b.join(m, [F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("b.text_hash") == F.col("m.text_hash")], "left")
    none = F.array().cast("array<string>")
    own = F.array_sort(F.array_distinct(F.coalesce(F.col("found.label"), none)))
    n = F.coalesce(F.array_size("found"), F.lit(0)).cast("long")
    place = lambda f: F.when(n > 0, f("found.place").cast("long"))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"), "n_words", n.alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, F.coalesce("added", none))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    sets = [sorted(set(words.split())) for _, words, _ in TEMPLATES]
    rows = ", ".join(f"({k}, '{label}', {_step(words)}, {len(s)}, {_needed(len(s), THRESHOLD)}, '{t}', {t in must.split()})" for k, ((label, words, must), s) in enumerate(zip(TEMPLATES, sets, strict=True)) for t in s)
    steps = ", ".join(f"({s})" for s in STEPS)
    ways = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM places WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items())
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    return f"""
WITH t(template, label, step, length, needed, token, must) AS (VALUES {rows}),
r AS (SELECT template, count(*) FILTER (must) AS musts FROM t GROUP BY template), steps(step) AS (VALUES {steps}),
d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w, {low} AS low FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM ({ways}) GROUP BY doc_id),
blocks AS (SELECT doc_id, step, w, unnest(range(0, greatest(len(w) - step - 1, 0) + 1, step)) AS i FROM d, steps),
tokens AS (SELECT DISTINCT doc_id, step, i, unnest(w[i + 1 : i + 2 * step]) AS token FROM blocks),
met AS (SELECT doc_id, i, template, any_value(label) AS label, count(*) / any_value(length) AS share FROM tokens JOIN t USING (step, token) JOIN r USING (template)
        GROUP BY doc_id, i, template HAVING count(*) >= any_value(needed) AND count(*) FILTER (must) = any_value(musts)),
added AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM met GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(added.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN added USING (doc_id)
"""


ORACLE = _oracle()
