"""Each operator against a plain computation, on odd rows and on the small test tables."""

import collections
import gzip
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflife.llm import components, ctw, decontam, gbt, jaccard, licenses, lines, lmscore, mixing, quality, repeats, shingles, tokens, warc

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(rows)


# Line dedup -----------------------------------------------------------------------------------------------

def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(UP)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return bag(out)


def spark_lines(df, **kw):
    return bag(tuple(r) for r in lines.drop_repeated_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect())


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_line_dedup(spark, sf, docs_of, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", broadcast)
    df = docs_of(odd_rows)
    assert spark_lines(df, min_docs=4) == plain_lines(odd_rows, min_docs=4)
    assert spark_lines(df, min_chars=2, min_docs=2) == plain_lines(odd_rows, 2, 2)
    assert spark_lines(table(spark, sf)) == plain_lines(pairs(table(spark, sf)))
    assert lines.drop_repeated_lines(docs_of([])).count() == 0


# Mixing ----------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1)):
    """sizes: source -> size, in the order of sources."""
    weight = {s: weights[k % 3] for k, s in enumerate(sizes)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (left - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= over


def check_mix(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = plain_targets({s: sizes[s] for s in order})
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r["doc_id"], len(words_of(r["text"]))) for r in rows), key=str)
    taken, largest = collections.Counter(), collections.Counter()
    known = collections.defaultdict(list)
    for s in order:
        known[(sizes[s], round(want[s], 6))].append(s)
    for r in got:
        s = known[(r["source_size"], round(r["target"], 6))][0]
        assert r["copies"] in (0, 1, 2)
        taken[s] += r["size"] * r["copies"]
        largest[s] = max(largest[s], r["size"])
    for s, group in ((g[0], g) for g in known.values()):
        assert abs(taken[s] - want[s] * len(group)) <= largest[s] * 2 * len(group)
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["copies"]) for r in got)


def test_mixing(spark, sf, docs_of, odd_rows):
    df = table(spark, sf)
    assert check_mix(df) == check_mix(df.repartition(3))  # reruns agree
    check_mix(docs_of([(i, t, ["b", None, "a", "Z"][k % 4]) for k, (i, t) in enumerate(odd_rows)]))
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mix(docs_of([(1, None)])).first()["target"] == 0
    many = mixing.BROADCAST_SOURCES
    mixing.BROADCAST_SOURCES = 0
    try:
        assert check_mix(df) == check_mix(df.coalesce(1))
    finally:
        mixing.BROADCAST_SOURCES = many
    kept = mixing.mixture(docs_of([(1, "a b"), (2, "c")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "size", "row", "copies"] and kept.where("copies < 1").count() == 0


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1}, {"a": 1, "b": 1000, "c": 1000, "d": 5}, {"a": 0, None: 50}, {"a": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_targets_of_many_sources(spark, monkeypatch):
    """Without a task that sees all sources, the same."""
    rng = np.random.default_rng(6)
    sizes = {f"s{i:04}": int(rng.zipf(1.4)) for i in range(700)} | {None: 12, "": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert {r["source"]: r["target"] for r in mixing.source_targets(df).collect()} == pytest.approx(want)


# Jaccard join ----------------------------------------------------------------------------------------------

def plain_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words_of((t or "").translate(UP))
        s = frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[k:] for k in range(width)], strict=False))
        sets.append((i, s))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, u) = sets[a], sets[b]
            if i is not None and j is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return bag((i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets))


def near_rows():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for length in (5, 30, 31, 120, 700, 2500):
        base = [f"w{rng.integers(400)}" for _ in range(length)]
        for _ in range(9):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, length // 60)))):
                w[int(rng.integers(length))] = f"x{rng.integers(10**6)}"
            rows.append((n, " ".join(w if rng.random() < 0.7 else [x.upper() for x in w])))
            n += 1
    return rows


@pytest.mark.parametrize("paired", [0, 1, 16])
def test_jaccard_components(docs_of, odd_rows, monkeypatch, paired):
    if paired:  # the ways for large tiles, with and without leaders, clusters and id tables
        for name, value in (("TILE", 4), ("PAIRED", paired), ("BLOCK", 3), ("BROADCAST_IDS", 0), ("SLICE", 50), ("LEADERS", 2)):
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(components, "MANY", 3)
    rows = near_rows() + odd_rows
    got = bag(tuple(r) for r in jaccard.jaccard_components(docs_of([(i if i is None or n < 54 else i + 1000, t) for n, (i, t) in enumerate(rows)]), 4, 85).drop("text_hash").collect())
    assert got == plain_components([(i if i is None or n < 54 else i + 1000, t) for n, (i, t) in enumerate(rows)], 4, 85)


def test_jaccard_on_tables(spark, sf, docs_of):
    df = table(spark, sf)
    assert bag(tuple(r) for r in jaccard.jaccard_components(df, 5, 80).drop("text_hash").collect()) == plain_components(pairs(df), 5, 80)
    assert jaccard.jaccard_components(docs_of([])).count() == 0 and jaccard.jaccard_components(docs_of([(3, None)])).drop("text_hash").collect() == [(3, 0, 3)]


def test_bitmap_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**62, int(rng.integers(1, 300))).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**62, int(rng.integers(1, 100))).astype(np.uint64)])
        differ = int(np.bitwise_count(np.frombuffer(jaccard.bitmap(a), np.uint64) ^ np.frombuffer(jaccard.bitmap(b), np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(nodes) and {tuple(r) for r in got} == {(x, find(x)) for x in nodes}


def test_shingles_know_ascii_only():
    assert shingles.words("A\x1cB É x\x0by") == [b"a\x1cb", "É x".encode(), b"y"]
    assert len(shingles.shingles(shingles.words("a a a a a a"), 4)) == 1 and len(shingles.shingles([b"a"], 4)) == 1


# Suffix-array dedup ----------------------------------------------------------------------------------------

def plain_repeats(rows, length):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return bag(out)


def repeat_rows():
    rng = np.random.default_rng(7)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    shared = [word(n) for n in (199, 200, 201, 260, 600)]
    rows = [(k, word(int(rng.integers(0, 80))) + "é" * (k % 3) + shared[k % 5][int(rng.integers(0, 3)) :] + word(int(rng.integers(0, 50)))) for k in range(40)]
    return rows + [(50, "ab" * 400), (51, "a" * 199), (52, "b" * 200), (53, "c" * 201), (54, shared[4] + shared[4][:250]), (55, word(5000)), (56, shared[3])]


@pytest.mark.parametrize("many", [20_000, 2])
def test_suffix_dedup(docs_of, odd_rows, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rows = repeat_rows() + [(i if i is None else i + 100, t) for i, t in odd_rows]
    assert bag(tuple(r) for r in repeats.remove_repeats(docs_of(rows)).collect()) == plain_repeats(rows, 200)


def test_suffix_dedup_on_tables(spark, sf, docs_of, monkeypatch):
    assert bag(tuple(r) for r in repeats.remove_repeats(table(spark, sf)).collect()) == plain_repeats(pairs(table(spark, sf)), 200)
    assert repeats.remove_repeats(docs_of([])).count() == 0
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    rows = repeat_rows()
    assert bag(tuple(r) for r in repeats.remove_repeats(docs_of(rows)).collect()) == plain_repeats(rows, 200)


def test_interval_tree():
    assert sorted(repeats.intervals([0, 1, 3, 0, 0, 2])) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]
    assert repeats.common(b"abcd", b"abxd") == 2 and repeats.common(b"ab", b"abc") == 2 and repeats.common(b"x", b"y") == 0


# License scans ---------------------------------------------------------------------------------------------

def plain_licenses(text):
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(UP)) if w]
    w = split(text or "")
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    base, labels, best = {x for _, x in places}, set(), 0.0
    for label, t, must in licenses.TEMPLATES:
        want, step = set(t.split()), next(s for s in (5, 8, 16, 32) if len(t.split()) <= s)
        for at in range(0, max(len(w) - step - 1, 0) + 1, step):
            have = set(w[at : at + 2 * step])
            if len(have & want) >= -(-licenses.THRESHOLD * len(want) // 100) and set(must.split()) <= have:
                labels.add(label)
                best = max(best, len(have & want) / len(want))
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else best


def test_license_scan(spark, sf, docs_of, odd_rows):
    more = [(20, "CC-BY 4.0\nCC\nby"), (21, "General  Public\nLicense. All rights reserved; all RIGHTS reserved"), (22, "released under the license of mit"), (23, "accc by byx cc byte"),
            (24, "Licensed under the Apache License, Version 2.0."), (25, "\n".join(["Redistribution and use in source and binary forms with or without modification are"] * 3)), (26, "cc by"), (27, "Released under the"), (28, "éCC by cc byé")]
    for df in (docs_of(odd_rows + more), table(spark, sf)):
        got = bag(tuple(r)[0:1] + tuple(r)[1:] for r in licenses.scan(df).collect())
        assert got == bag((i, *plain_licenses(t)) for i, t in pairs(df))
    assert licenses.scan(docs_of([])).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_license_labels(docs_of):
    """Statements get their own label and no other, wrapped over lines or in a long line; prose about licenses gets none."""
    filler = " ".join(WORDS_OF_NOTHING[i % 7] for i in range(500))
    apache = "Unless required by applicable law or agreed to in writing,\nsoftware distributed under the License is distributed on an\n// \"AS IS\" BASIS, WITHOUT WARRANTIES"
    cases = [
        ("This software is released under the GPL license", "gpl"), ("Licensed under the GNU license, version 2.0", "gpl"),
        ("the book was released last year under a new publisher; a fishing license is needed in the park", ""),
        (MIT, "mit"), (f"{filler} {MIT}".replace("\n", " "), "mit"), (apache, "apache-2.0"), (f"{filler}\n{apache}\n{filler}", "apache-2.0"),
        ("You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that", "bsd"),
        ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"), ("Released under the MIT \u212aicense", ""),
        ("mit students released a note under the old bridge and later they lost their boat license", ""), ("mozilla made a browser", ""),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs_of([(n, t) for n, (t, _) in enumerate(cases)])).collect()}
    assert [got[n] for n in range(len(cases))] == [x for _, x in cases]


def test_every_template_meets_itself(docs_of):
    """Whole, and at every offset in a longer text."""
    rows, want = [], {}
    for n, (label, text, _) in enumerate(licenses.TEMPLATES):
        for offset in range(0, 70, 7):
            rows.append((100 * n + offset, " ".join(["filler"] * offset + [text] + ["filler"] * 70)))
            want[100 * n + offset] = label
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs_of(rows)).collect()}
    assert all(label in got[i] for i, label in want.items())


WORDS_OF_NOTHING = "river stone cloud bread paper garden winter".split()


# Decontamination -------------------------------------------------------------------------------------------

def plain_leaks(docs, bench, limit=0.8):
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").lower()) if w]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    items = {k: split(t) for k, t in bench if k is not None and len(split(t)) >= 5}
    found = {}
    for d, t in docs:
        w = split(t)
        if len(w) < 5:
            continue
        g = grams(w)
        for k, item in items.items():
            n, b = len(item), collections.Counter(grams(item))
            if not set(b) & set(g):
                continue
            for at in range(max(0, len(w) - n) + 1):
                a = collections.Counter(g[at : at + n - 4])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= limit and s > found.get((d, k), (0,))[0]:
                    found[d, k] = (s, at)
    return {(d, k, round(s, 9), at) for (d, k), (s, at) in found.items()}


def leak_rows():
    rng = np.random.default_rng(11)
    w = lambda n: [f"t{rng.integers(5000)}" for _ in range(n)]
    bench = [(k, " ".join(w(n))) for k, n in enumerate((5, 9, 20, 40, 40, 77, 150))] + [(50, None), (51, ""), (52, "too short"), (None, "an item without any id at all")]
    docs = []
    for k, t in bench[:7]:
        item = t.split()
        edited = list(item)
        edited[-1] = "edited"
        docs += [(10 * k, t), (10 * k + 1, " ".join(w(30) + item + w(30))), (10 * k + 2, " ".join(w(3) + edited + w(8)).upper()), (10 * k + 3, " ".join(item[: len(item) // 2] + w(20))),
                 (10 * k + 4, ", ".join(item[: -max(1, len(item) // 30)])), (10 * k + 5, " ".join(w(200)))]
    return docs, bench


def test_fingerprints_near_the_limit(spark, docs_of):
    """Windows at a similarity of exactly 0.8, and a little above: the radius of the fingerprints loses next to none."""
    rng = np.random.default_rng(12)
    w = lambda n: [f"t{rng.integers(50_000)}" for _ in range(n)]
    bench = [(k, w(40)) for k in range(300)]
    edited = lambda t, at: [*t[:at], "edited", *t[at + 1 :]]
    docs = docs_of([(k, " ".join(w(25) + edited(t, 2 + k % 2) + w(25))) for k, t in bench])  # 33 of 39, or 32 of 40 shingles
    found = decontam.leaks(docs, spark.createDataFrame([(k, " ".join(t)) for k, t in bench], "item_id long, text string")).collect()
    hits = collections.Counter(r["doc_id"] % 2 for r in found if r["doc_id"] == r["item_id"])
    assert len(found) == sum(hits.values()) and hits[0] >= 149 and hits[1] >= 146


def test_decontamination(spark, sf, docs_of, odd_rows, monkeypatch):
    docs, bench = leak_rows()
    b = spark.createDataFrame(bench, "item_id long, text string")
    df = docs_of(docs + [(i if i is None else i + 500, t) for i, t in odd_rows])

    def got(frame, items):
        return {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start"]) for r in decontam.leaks(frame, items).collect()}

    want = plain_leaks(pairs(df), bench)
    assert got(df, b) == want and len(want) > 20
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert got(df, b) == want
    real = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert got(table(spark, sf), table(spark, sf, "benchmark")) == plain_leaks(pairs(table(spark, sf)), real)
    assert got(docs_of([]), b) == set() and got(df, b.limit(0)) == set()


def test_long_items_go_in_parts(spark, docs_of):
    text = " ".join(f"u{i}" for i in range(450))
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = decontam.leaks(docs_of([(1, "x y z " + text + " tail"), (2, " ".join(text.split()[:150]))]), b).collect()
    assert {(r["doc_id"], r["part"]) for r in found} == {(1, 0), (1, 1), (1, 2), (2, 0)}


# Token counts ----------------------------------------------------------------------------------------------

def test_token_counts(spark, sf, docs_of, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    more = [(20, "it's I'LL you've 'S 12 34"), (21, "<|endoftext|> x <|startoftext|>"), (22, "é İ ß   \x85 \x1c ﬁ"), (23, "!!!'s ''' '' a'b'c")]
    for df, entries in ((docs_of(odd_rows + more), 3), (table(spark, sf), 500), (docs_of(odd_rows + more), 50_000)):
        rows = tokens.count_tokens(df, path, entries=entries).select("doc_id", "n_bytes", "n_tokens").collect()
        assert bag(tuple(r) for r in rows) == bag((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in pairs(df))
    assert tokens.count_tokens(docs_of([]), path).count() == 0
    small = tokens.CACHE
    tokens.CACHE = 0
    try:
        spec = open(path, "rb").read()
        assert [tokens.count_batch(["zyxwv qqq"], spec, {}) for _ in range(3)] == [[len(lib.encode("zyxwv qqq"))]] * 3
    finally:
        tokens.CACHE = small


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(spark, sf, docs_of, odd_rows, name):
    """Another normalizer or split: the library counts whole texts."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        count = lambda t: len(lib.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(lib.encode(t))
    df = docs_of(odd_rows + [(20, "It's  HERE,\n\n and THERE"), (21, "<|endoftext|> <s>")])
    rows = tokens.count_tokens(df, path).select("doc_id", "n_tokens").collect()
    assert bag(tuple(r) for r in rows) == bag((i, count(t or "")) for i, t in pairs(df))


# Quality rules ---------------------------------------------------------------------------------------------

def plain_counts(text):
    w = words_of(text)
    ls = [x for x in (text or "").split("\n") if words_of(x)]
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit)


def test_quality_counts(spark, sf, docs_of, odd_rows):
    more = [(20, "a b c a b c a"), (21, "a a a a"), (22, "x y\nx y\n\nx y "), (23, "a b a b a b")]
    for df in (docs_of(odd_rows + more), table(spark, sf)):
        rows = quality.assess(df, None).select("row.doc_id", *[f"quality.{c}" for c in quality.COUNTS], "quality.base_failed", "quality.kept").collect()
        want = []
        for i, t in pairs(df):
            c = plain_counts(t)
            failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
            want.append((i, *c, failed, not failed))
        assert bag(tuple(r) for r in rows) == bag(want)


def test_trees_keep_their_directions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.normal(size=3000) > 0.5 + 0.3 * x[:, 1]).astype(float)
    forest = gbt.fit(x, y, (1, -1, 0))
    grid = np.linspace(0, 1, 200)
    for at in rng.random((20, 3)):
        for j, sign in ((0, 1), (1, -1)):
            line = np.tile(at, (200, 1))
            line[:, j] = grid
            assert (np.diff(forest.log_odds(line)) * sign >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85


def test_quality_is_learned(spark, sf):
    df, labels = (f(spark, "/root/testdata/sf0.01") for f in (table, quality.labels))
    half = labels.where("doc_id % 2 = 0")
    forest = quality.train(df, half)
    scored = quality.assess(df, forest).select("row.doc_id", "quality.score")
    got = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("score", "quality").collect()
    assert sum((r["score"] >= quality.KEEP_FROM) == (r["quality"] == 1) for r in got) / len(got) >= 0.95
    assert quality.train(df, labels.limit(0)).probability(np.zeros((1, len(quality.FEATURES))))[0] > 0.99
    dirty = labels.unionAll(labels.select("doc_id", F.lit(None).cast("int"), "toxic")).unionAll(labels.limit(1).select(F.lit(None).cast("long"), "quality", "toxic"))
    assert quality.train(df, dirty).bias == quality.train(df, labels).bias


# LM scoring ------------------------------------------------------------------------------------------------

class PlainCtw:
    """Context-tree weighting written out node by node: a node is (context bytes, nearest first, and the byte's bits so far)."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.known = depth, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set), {}
        for t in texts:
            for context, byte in self.steps(t):
                for d in range(depth + 1):
                    for bits, bit in self.decisions(byte):
                        self.counts[context[:d], bits][bit] += 1
                        if d < depth:
                            self.children[context[:d], bits].add(context[: d + 1])

    def steps(self, text):
        whole = b"\0" * self.depth + text + b"\xff"
        return [(whole[i - self.depth : i][::-1], whole[i]) for i in range(self.depth, len(whole))]

    @staticmethod
    def decisions(byte):
        return [(f"{byte:08b}"[:k], int(f"{byte:08b}"[k])) for k in range(8)]

    def logs(self, context, bits):
        """(the node's own estimate, the product of its children, the weighted one)."""
        if (context, bits) not in self.known:
            zeros, ones = self.counts.get((context, bits), (0, 0))
            own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
            below = sum(self.logs(c, bits)[2] for c in self.children.get((context, bits), ()))
            both = max(own, below) + math.log1p(math.exp(-abs(own - below))) + math.log(0.5)
            self.known[context, bits] = own, below, own if len(context) == self.depth else both
        return self.known[context, bits]

    def bits(self, text):
        out = 0.0
        for context, byte in self.steps(text):
            for bits, bit in self.decisions(byte):
                p, left = 0.0, 1.0
                for d in range(self.depth + 1):
                    n = self.counts.get((context[:d], bits), (0, 0))
                    own, _, both = self.logs(context[:d], bits)
                    stop = 1.0 if d == self.depth else math.exp(own + math.log(0.5) - both)
                    p += left * stop * (n[bit] + 0.5) / (sum(n) + 1)
                    left *= 1 - stop
                out -= math.log2(p)
        return out


@pytest.mark.parametrize("depth", [2, 3])
def test_ctw_is_context_tree_weighting(spark, sf, docs_of, depth):
    """Bits a byte of training and held-out texts, bytes never seen after their context included."""
    made = [(r["doc_id"], (r["text"] or "")[:600]) for r in table(spark, sf).orderBy("doc_id").limit(70).collect()]
    made += [(1_000, "Zq\U0001f600 ~|~"), (1_001, ""), (1_002, None), (1_003, "\u65e5\u672c " * 9)]
    rows = lmscore.score_texts(docs_of(made), depth, most=300).collect()
    low = lambda t: (t or "").translate(UP).encode()
    texts = dict(made)
    plain = PlainCtw([low(texts[r["doc_id"]]) for r in rows if not r["held_out"]], depth)
    learned = collections.Counter(x for r in rows if not r["held_out"] for x in plain.steps(low(texts[r["doc_id"]])))
    assert {r["held_out"] for r in rows} == {True, False} and len(rows) == len(made)
    for r in rows:
        n = len(low(texts[r["doc_id"]])) + 1
        assert -r["score"] / math.log10(2) / n == pytest.approx(plain.bits(low(texts[r["doc_id"]])) / n, abs=1e-6)
        steps = [(c, b) for c, b in plain.steps(low(texts[r["doc_id"]]))]
        assert r["n_once"] == sum(learned[x] == 1 for x in steps)


def test_ctw_adds_up_and_fits(spark, docs_of):
    learned = np.concatenate([c for c, _ in ctw.pieces((b"the cat sat on the mat. the dog sat on the log. " * 40, b"a cat and a dog " * 30), 3)])
    every = np.array([(c << 8) | b for c in (0, 0x746865, 0x616161, 0xFFFFFF) for b in range(256)], np.int64)
    codes, of = np.unique(np.r_[learned, every], return_inverse=True)
    numbers = np.bincount(of[: len(learned)], minlength=len(codes))
    bits, _ = ctw.Tree(codes, numbers, 0, 3).mixed()
    assert np.exp2(bits[of[len(learned) :]]).reshape(4, 256).sum(axis=1) == pytest.approx([1, 1, 1, 1], abs=1e-9)
    # Whole, and with the depths from SPLIT on apart.
    below = ctw.Tree(codes, numbers, ctw.SPLIT, 3)
    apart, _ = below.mixed(ctw.entering(ctw.top_passed(*below.sums()), below.codes[0]))
    assert apart == pytest.approx(bits, abs=1e-9)


def test_pieces(monkeypatch):
    texts = [b"hello", b"", b"x" * 50]
    whole = [np.concatenate(x) for x in zip(*ctw.pieces(texts, 3), strict=True)]
    monkeypatch.setattr(ctw, "PIECE", 7)
    cut = [np.concatenate(x) for x in zip(*ctw.pieces(texts, 3), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) == 58


def test_tables_of_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**48, 5000))
    t = ctw.Table(keys, np.arange(len(keys)))
    got, known = t.get(np.r_[keys, keys + 1])
    assert (got[: len(keys)] == np.arange(len(keys))).all() and known[: len(keys)].all() and (known[len(keys) :] == np.isin(keys + 1, keys)).all()
    assert not ctw.Table(keys[:0], keys[:0]).get(keys)[1].any()


def plain_base(rows):
    tokens_of = lambda t: [*words_of((t or "").translate(UP)), None]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    c = collections.Counter(x for i, t in rows if fold(i) not in (None, 2) for x in tokens_of(t))
    n, v = sum(c.values()), len(c)
    return bag((i, fold(i) == 2, len(tokens_of(t)), sum(c[x] > 0 for x in tokens_of(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens_of(t)), 5)) for i, t in rows)


def test_lm_scores(spark, sf, docs_of, odd_rows, monkeypatch):
    df = table(spark, sf)
    monkeypatch.setattr(lmscore, "FREQUENT", 50)  # most words take the join
    rows = lmscore.score_texts(df).collect()
    key = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
    assert bag(map(key, rows)) == plain_base(pairs(df))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert bag(map(key, lmscore.score_texts(docs_of(odd_rows), most=500).collect())) == plain_base(odd_rows)
    assert lmscore.score_texts(docs_of([])).count() == 0
    lone = lmscore.score_texts(docs_of([(None, "ab")])).first()
    assert lone["train_tokens"] == 0 and lone["score"] == pytest.approx(-3 * 8 * math.log10(2))


def test_held_out_code_length(spark):
    df = table(spark, "/root/testdata/sf0.01")
    held = [r for r in lmscore.score_texts(df).collect() if r["held_out"]]
    assert sum(-r["score"] for r in held) / math.log10(2) / sum(r["n_bytes"] for r in held) < 3.0


# ARC and WARC ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    content = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\nWARC/1.0\r\n\n</html>"
    records = [({"URL": "http://a.example/", "IP-address": "192.0.2.7", "Archive-date": "19990102030405", "Content-type": "text/html"}, content),
               ({"URL": "dns:a.example", "Archive-date": "19990102030406", "Content-type": "text/dns"}, b"19990102\na.example A 192.0.2.7\n"), ({"URL": "http://b.example/", "Archive-date": "1999", "Content-type": "x"}, b"")]
    got = list(warc.parse_arc(warc.write_arc(version, "x.arc", records)))
    assert [r.content for r in got[1:]] == [c for _, c in records] and got[0].url == "filedesc://x.arc" and {r.version for r in got} == {version}
    made = [warc.convert(r) for r in got]
    back = list(warc.parse_warc(io.BufferedReader(io.BytesIO(b"".join(m + b"\r\n\r\n" for m in made)))))
    assert [h["WARC-Type"] for h, _ in back] == ["warcinfo", "response", "resource", "resource"]
    head, block = back[1]
    assert block == content and head["WARC-Date"] == "1999-01-02T03:04:05Z" and head["WARC-IP-Address"] == "192.0.2.7" and head["WARC-Record-ID"].startswith("<urn:uuid:")
    assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(content.split(b"\r\n\r\n", 1)[1]).hexdigest() and made == [warc.convert(r) for r in got]


def test_broken_arcs():
    good = warc.write_arc(1, "x.arc", [({"URL": "u", "Archive-date": "20200101000000", "Content-type": "t"}, b"abc")])
    for bad in (b"", good[:-4], good.replace(b"u - ", b"u "), b"http://x 1.2.3.4 20200101000000 t 3\nabc", good.replace(b"1 0 halflife", b"9 0 halflife")):
        with pytest.raises(warc.ArcError):
            list(warc.parse_arc(bad))


@pytest.mark.parametrize("gap", [b"\n\n", b"\r\n\r\n", b"\n\r\n"])
def test_heads_with_bare_line_feeds(gap):
    head = b"HTTP/1.0 200 OK" + gap[: len(gap) // 2] + b"Content-Type: text/html" + gap
    body = b"<html>\r\n\r\nx\n\ny</html>"
    assert warc.http_parts(head + body) == (head, body) and warc.http_parts(b"HTTP/1.0 200 OK\n") == (b"HTTP/1.0 200 OK\n", b"") and warc.http_parts(b"x\n\ny") == (b"", b"x\n\ny")
    arc = warc.write_arc(1, "x.arc", [({"URL": "http://a/", "Archive-date": "19970102030405", "Content-type": "text/html"}, head + body)])
    (made,) = [warc.convert(r) for r in warc.parse_arc(arc)][1:]
    assert hashlib.sha256(body).hexdigest().encode() in made and made.endswith(head + body)


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_arcs_in_chunks(size):
    records = [({"URL": f"http://a/{i}", "Archive-date": "19970102030405", "Content-type": "t"}, bytes([i % 256]) * (i * 37 % 900)) for i in range(30)]
    arc = warc.write_arc(2, "x.arc", records)
    read = lambda data, errors=None: [(r.url, r.content) for r in warc.read_arc([data[i : i + size] for i in range(0, len(data), size)], errors)]
    want = [(v["URL"], c) for v, c in records]
    assert read(arc)[1:] == want
    errors = []
    line = warc.arc_line(2, records[4][0], records[4][1])
    broken = arc.replace(line, line.replace(b" t - - - - - ", b" t - - "))  # a field is missing; its content is passed over
    assert read(broken, errors)[1:] == want[:4] + want[5:] and len(errors) == 1
    assert read(arc[:-40], errors)[1:] == want[:29] and len(errors) == 2
    with pytest.raises(warc.ArcError):
        read(broken)


def test_each_record_is_a_gzip_member(spark, tmp_path):
    big = np.random.default_rng(0).integers(0, 256, 17 << 20).astype(np.uint8).tobytes()  # its length has a high byte
    records = [warc.warc_record({"WARC-Type": "resource", "WARC-Date": f"2024-01-01T00:00:{n:02}Z"}, body) for n, body in enumerate([b"", b"a\0b\r\n\r\n", big, b"z" * 5_000])]
    path = str(tmp_path / "warc")
    df = spark.createDataFrame([(r,) for r in records], "record binary").coalesce(1)
    warc.write_warc(df, path, file_bytes=1_000)
    files = sorted((tmp_path / "warc").rglob("part-*"))
    assert len(files) == 3  # two small ones, the large one, the last
    assert sorted((r + b"\r\n\r\n") for r in records) == sorted(warc_members(files))
    back = warc.read_warc(spark, path).collect()
    assert sorted(r["payload_bytes"] for r in back) == [0, 7, 5_000, 17 << 20]


def warc_members(files):
    """The texts of the gzip members of some files, but for empty ones."""
    out = []
    for f in files:
        data = f.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data)
            assert one.eof
            data = one.unused_data
            out += [text] if text else []
    return out


def test_archives_on_disk(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    body = bytes(range(256)) * 3
    good = warc.write_arc(2, "x.arc", [({"URL": "u", "Archive-date": "20200101000000", "Content-type": "image/png"}, body)] * 2)
    (tmp_path / "arc/a.arc").write_bytes(good)
    (tmp_path / "arc/b.arc.gz").write_bytes(gzip.compress(good))
    (tmp_path / "arc/c.arc").write_bytes(good[:-9])
    report = {r["path"][-5:]: (r["n_records"], r["error"] is None) for r in warc.convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc")).collect()}
    assert report == {"a.arc": (3, True), "rc.gz": (3, True), "c.arc": (2, False)}  # the good records of a broken file stay
    back = warc.read_warc(spark, str(tmp_path / "warc")).where("headers['WARC-Type'] = 'resource'").collect()
    assert len(back) == 5 and {(r["payload_bytes"], r["payload_digest"]) for r in back} == {(768, hashlib.sha256(body).hexdigest())}


def test_pages(spark, tmp_path):
    big = "<p>é</p>" * 30
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (3, None, None), (4, "http://c", "short"), (5, "http://d", "short"), (None, "http://e", big), (7, "http://f", "HTTP/1.1 x\r\n\r\nWARC/1.1\r\n" * 9), (1, "http://a/ b", big), (8, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    got = bag(tuple(r) for r in warc.op5_arc_to_warc(spark, str(tmp_path)).collect())
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        refers = 1 if html == big and i != 1 else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers else "response", refers))
    assert got == bag(want)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op5_arc_to_warc(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_meeting_in_two_steps(spark, monkeypatch):
    """Rows that share a key, whatever the batches; copies are one row, and a key's task gets one row a batch."""
    rng = np.random.default_rng(2)
    rows = [(int(k), int(n), int(p)) for k, n, p in zip(rng.zipf(1.3, 3_000) % 900, rng.integers(0, 40, 3_000), rng.integers(0, 30, 3_000), strict=True)]
    want = collections.defaultdict(set)
    for k, n, p in rows:
        want[k].add((k, n, p))
    want = {r for g in want.values() if len(g) > 1 for r in g}

    def roles(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, len(b), 250):
                x = repeats._spoken_for(np.stack([c.to_numpy() for c in b.slice(at, 250).columns], axis=1), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], ["k", "n", "p", "role"])

    def meet(batches):
        import pyarrow as pa

        for x in repeats._shared_rows(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], ["k", "n", "p"])

    found = spark.createDataFrame(rows, "k long, n long, p long").repartition(3).mapInArrow(roles, "k long, n long, p long, role long")
    got = [tuple(r) for r in repeats._meeting(found, ["k", "n", "p"], 1).mapInArrow(meet, "k long, n long, p long").collect()]
    assert set(got) == want
    assert found.where("role <> 2").groupBy("k").count().agg(F.max("count")).first()[0] <= 14  # batches


def test_reach_of_nested_repeats():
    """Against every pair of contexts, on strings that nest deeply."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        n = int(rng.integers(2, 40))
        made = {(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)), b"k" + bytes(rng.integers(97, 99, rng.integers(0, 14)).astype(np.uint8))) for _ in range(n)}
        contexts = sorted(made)
        if len(contexts) < 2:
            continue
        got = repeats.repeat_reach(contexts, 6)
        for i, (left, right) in enumerate(contexts):
            want = set()
            for j, (a, b) in enumerate(contexts):
                if i != j:
                    x, y = repeats.common(left, a), repeats.common(right, b)
                    if x + y >= 6:
                        want.add((x, y))
            spans = lambda pairs: {(-x, y) for x, y in pairs if not any((u, v) != (x, y) and u >= x and v >= y for u, v in pairs)}
            assert spans(want) == spans(set(got[i])), trial


def test_verdicts_are_those_of_the_trees(spark, sf):
    """Every tree walked node by node, for each document of the table."""
    docs = table(spark, sf)
    forest = quality.train(docs, quality.labels(spark, sf))
    assert len(forest.feature) > 0

    def walk(x):
        odds = forest.bias
        for feature, threshold, left, right, value in zip(forest.feature, forest.threshold, forest.left, forest.right, forest.value, strict=True):
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] <= threshold[at] else right[at]
            odds += value[at]
        return 1 / (1 + math.exp(-odds))

    got = {r["doc_id"]: r for r in quality.op9_quality_rules(spark, sf).collect()}
    for i, t in pairs(docs):
        counts, features = quality.statistics((t or "").encode())
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        p = walk(features)
        assert got[i]["score"] == pytest.approx(p) and got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and p >= 0.5)
