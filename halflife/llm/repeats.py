"""Suffix-array dedup: repeated byte strings of LENGTH bytes or more, over all documents, removed everywhere.

Method. Every string of LENGTH bytes names an anchor within itself: the K bytes with the smallest hash, the last
of equals. Equal strings name equal anchors at equal places, so strings that occur twice meet at an anchor that
occurs twice. The suffixes that begin at the occurrences of one anchor, as far as the strings around it reach,
are sorted into a suffix array with the lengths of common prefixes; a scan with a stack walks its tree of
common-prefix intervals. In each interval the left contexts are ordered the same way: where they differ at once
the repeat is as long as it can be to the left, and all occurrences that share a left part belong to it. So each
occurrence meets all others and not only its neighbours. Anchors with very many occurrences go another exact
way: their strings are hashed start by start and dealt by hash. Wherever rows meet by a key, rows of one batch that share
it are known to be shared and only one of them goes to the key's task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.llm.common import documents, small_batches, stored

LENGTH = 200
K = 48
#: Occurrences of an anchor above which its strings are dealt by hash.
MANY = 20_000
#: Rows of anchors, or of starts, among which a worker looks for shared ones before it passes them on.
AT_ONCE = 200_000
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
#: Up to so many text names (16 MB) are broadcast.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)
_WORD = 2**64


def _table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)).astype(np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


_BYTES = _table()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each place, by doubling."""
    out, done, part, width = None, 0, _BYTES[data], 1
    while True:
        if k & width:
            if out is None:
                out, done = part, width
            else:  # what is done, then the next width bytes
                n = len(out) - width
                out = out[:n] * np.uint64(pow(_BASE, width, _WORD)) + part[done : done + n]
                done += width
        if done == k:
            break
        part = part[: len(part) - width] * np.uint64(pow(_BASE, width, _WORD)) + part[width:]
        width *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Rows (hash, place, first, last): the strings of length bytes that start from first to last name the anchor at place."""
    found = []
    for at in range(0, max(len(text) - length + 1, 0), PIECE):
        data = np.frombuffer(text[at : at + PIECE + length - 1], np.uint8)
        if len(data) < length:
            break
        h = gram_hashes(data, k)
        # The smallest hash, the last of equals: places stand reversed in the low bits.
        low = window_least((h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), length - k + 1)
        place = (_LOW - (low & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        found.append(np.stack([h[place[first]].view(np.int64), place[first] + at, first + at, last + at], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def intervals(lcp: list[int]):
    """(length, first, last) of each interval of a suffix array whose neighbours' common prefixes are lcp[1:], inner ones first."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        length = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and length < stack[-1][0]:
            top, first = stack.pop()
            yield top, first, i - 1
        if length >= 0 and (not stack or length > stack[-1][0]):
            stack.append((length, first))


def _commons(texts: list[bytes], order: list[int]) -> list[int]:
    """The common prefix of each text in this order with the one before, and 0 for the first."""
    return [0] + [common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)]


def _least_between(values: list[int]):
    """f(i, j): the least of values[i + 1 : j + 1], by tables of doubling width."""
    rows = [np.array(values, np.int64)]
    while 2 << (len(rows) - 1) <= len(values):
        half, x = 1 << (len(rows) - 1), rows[-1]
        rows.append(np.minimum(x[: len(x) - half], x[half:]))

    def least(i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return int(min(rows[k][i + 1], rows[k][j + 1 - (1 << k)]))

    return least


def repeat_reach(contexts: list[tuple[bytes, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (left, right) around one anchor, left reversed: the (left, right) lengths of its maximal repeats.

    Contexts are distinct. Only repeats of at least length bytes count, and of those with equal left lengths the longest;
    every other context with which they are shared is one of the given. An interval's members are kept in the order
    of their left contexts; it takes over the largest of its parts and inserts the others, and only contexts whose
    neighbours change reach anew, so n contexts cost n log n insertions however deep the intervals nest.
    """
    n = len(contexts)
    reach: list[list[tuple[int, int]]] = [[] for _ in contexts]
    rights, lefts = [r for _, r in contexts], [x for x, _ in contexts]
    order = sorted(range(n), key=rights.__getitem__)
    by_left = sorted(range(n), key=lefts.__getitem__)
    place = [0] * n
    for i, c in enumerate(by_left):
        place[c] = i
    least = _least_between(_commons(lefts, by_left))
    held: dict[int, tuple[int, list[int]]] = {}  # by first place of an interval: its last place, and members by left place
    for right, first, last in intervals(_commons(rights, order)):
        if right == 0:
            continue
        parts, at = [], first
        while at <= last:
            end, members = held.pop(at, (at, None))
            parts.append([place[order[at]]] if members is None else members)
            at = end + 1
        parts.sort(key=len)
        members, changed = parts.pop(), set()
        for x in (x for part in parts for x in part):
            i = bisect_left(members, x)
            members.insert(i, x)
            changed.update(members[max(0, i - 1) : i + 2])
        held[first] = last, members
        need = length - right
        for x in changed:
            i = bisect_left(members, x)
            left = max(least(members[i - 1], x) if i else 0, least(x, members[i + 1]) if i + 1 < len(members) else 0)
            if left >= need:
                reach[by_left[x]].append((left, right))
    return reach


def _batch(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


#: What a row is to its key: the only one of its batch, the one that speaks for its batch's others, one that others speak for.
ALONE, SPEAKS, SPOKEN_FOR = 0, 1, 2


def _spoken_for(x: np.ndarray, n_key: int) -> np.ndarray:
    """The rows of x, copies once, with a last column: see ALONE. What shares its first n_key columns within x is known to be shared."""
    x = x[np.lexsort(x.T[::-1])]
    x = x[np.r_[True, (x[1:] != x[:-1]).any(axis=1)]]
    same = (x[1:, :n_key] == x[:-1, :n_key]).all(axis=1)
    before, after = np.r_[False, same], np.r_[same, False]
    return np.c_[x, np.where(before, SPOKEN_FOR, np.where(after, SPEAKS, ALONE))]


def _meeting(rows: DataFrame, names: list[str], n_key: int) -> DataFrame:
    """rows (names and role) dealt by their key, but for those that others speak for: they are known to be shared and go anywhere.

    So a key has one row a batch in its task, however many rows it has.
    """
    anywhere = F.xxhash64(*names[n_key:])
    key = [F.when(F.col("role") == SPOKEN_FOR, anywhere if not i else F.lit(0)).otherwise(F.col(c)) for i, c in enumerate(names[:n_key])]
    dealt = rows.select("*", F.xxhash64(*key).alias("deal"))
    return dealt.repartition("deal").drop("deal").select("role", *names).sortWithinPartitions((F.col("role") == SPOKEN_FOR), *names)


def _shared_rows(batches, n_key: int):
    """Of the rows of _meeting(): those whose key another, different row shares; copies once. The column role goes."""
    last, kept, last_known = None, False, None
    for b in batches:
        x = np.stack([b.column(i).to_numpy() for i in range(b.num_columns)], axis=1).astype(np.int64)
        known = x[:, 0] == SPOKEN_FOR
        if known.any():
            y, x = x[known][:, 1:], x[~known]
            new = np.r_[last_known is None or (y[0] != last_known).any(), (y[1:] != y[:-1]).any(axis=1)]
            last_known = y[-1]
            if new.any():
                yield y[new]
        if last is not None:
            x = np.concatenate([last[None], x])
        if not len(x):
            continue
        # Equal rows lie together; if one of them speaks for others, the copy does.
        first = np.flatnonzero(np.r_[True, (x[1:, 1:] != x[:-1, 1:]).any(axis=1)])
        x = np.c_[np.maximum.reduceat(x[:, 0], first), x[first, 1:]]
        same = (x[1:, 1 : n_key + 1] == x[:-1, 1 : n_key + 1]).all(axis=1)
        keep = np.r_[kept, same] | np.r_[same, False] | (x[:, 0] == SPEAKS)
        last, kept = x[-1].copy(), bool(keep[-1])
        if keep[:-1].any():
            yield x[:-1][keep[:-1]][:, 1:]
    if last is not None and kept:
        yield last[None, 1:]


def _runs(batches):
    """(hash, list of rows) of a stream sorted by hash, one group at a time."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row)
    if held:
        yield key, held


def named_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, name, n_bytes, sha256) of each row of docs and the seed of the names: 64-bit hashes that no two texts share."""
    text = F.coalesce("text", F.lit(""))
    for seed in range(8):
        rows = docs.select("doc_id", F.xxhash64(F.lit(seed), text).alias("name"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"))
        rows = stored(rows, "names")
        if not rows.groupBy("name").agg(F.min("sha256").alias("a"), F.max("sha256").alias("b")).where("a <> b").limit(1).count():
            break
    return rows, seed


def repeated_anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(hash, name, place, first, last) of the anchors whose hash occurs more than once, from (name, text); copies once."""
    fields = ["hash", "name", "place", "first", "last"]

    def find(batches):
        seen = set()
        for b in batches:
            out, size = [], 0
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name in seen:
                    continue
                seen.add(name)
                a = anchors(t.encode(), length)
                out.append(np.c_[a[:, :1], np.full(len(a), name), a[:, 1:]])
                size += len(a)
                if size > AT_ONCE:
                    yield rows(out)
                    out, size = [], 0
            if size:
                yield rows(out)

    def rows(out):
        return _batch([*fields, "role"], [pa.array(np.ascontiguousarray(c)) for c in _spoken_for(np.concatenate(out), 1).T])

    def meet(batches):
        for x in _shared_rows(batches, 1):
            yield _batch(fields, [pa.array(np.ascontiguousarray(c)) for c in x.T])

    kind = ", ".join(f"{f} long" for f in fields)
    found = texts.where(F.octet_length("text") >= length).mapInArrow(find, f"{kind}, role long")
    return _meeting(found, fields, 1).mapInArrow(meet, kind)


def repeated_spans(docs_named: DataFrame, names: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(name, spans) and the texts (name, text) that have any: the spans of repeats, as arrays of (start, end), overlapping."""
    rows = stored(repeated_anchors(docs_named.select("name", "text"), length), "anchors")
    many = stored(rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("hash"), "many")
    per_text = rows.groupBy("name").agg(F.collect_list(F.struct("hash", "place", "first", "last")).alias("anchors"))
    chosen = names.groupBy("name").agg(F.min("doc_id").alias("doc_id")).join(rows.select("name").distinct(), "name", "left_semi")
    chosen = stored(chosen, "chosen")
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d, c = docs_named.alias("d"), (F.broadcast(chosen) if few else chosen).alias("c")
    texts = d.join(c, [F.col("d.name") == F.col("c.name"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))], "left_semi").select("name", "text").repartition("name")

    def cut(batches):
        names_ = ["hash", "name", "place", "left", "right"]
        for b in batches:
            for name, t, found in zip(*(col.to_pylist() for col in b.columns), strict=True):
                t = t.encode()
                for at in range(0, len(found), 5_000):
                    part = found[at : at + 5_000]
                    yield _batch(names_, [
                        pa.array([x["hash"] for x in part]), pa.array([name] * len(part)), pa.array([x["place"] for x in part]),
                        pa.array([t[x["first"] : x["place"]][::-1] for x in part], pa.binary()), pa.array([t[x["place"] : x["last"] + length] for x in part], pa.binary()),
                    ])

    def reach(batches):
        for _, held in _runs(batches):
            classes: dict[tuple[bytes, bytes], set] = {}
            for _, name, place, left, right in held:
                classes.setdefault((left, right), set()).add((name, place))
            contexts = list(classes)
            spans = repeat_reach(contexts, length) if len(contexts) > 1 else [[]]
            out = []
            for (left, right), found in zip(contexts, spans, strict=True):
                if len(classes[left, right]) > 1:
                    found = [(len(left), len(right))]
                out += [(name, place - a, place + b) for name, place in classes[left, right] for a, b in found]
            if out:
                yield _batch(["name", "start", "end"], [pa.array(v, pa.int64()) for v in zip(*out, strict=True)])

    strings = ["a", "b", "name", "start"]

    def starts(batches):
        held, size = [], 0
        for b in batches:
            for _, name, place, left, right in zip(*(col.to_pylist() for col in b.columns), strict=True):
                data, at = left[::-1] + right, place - len(left)
                hashes = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(data) - length + 1)]
                x = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                held.append(np.c_[x, np.full(len(x), name), np.arange(at, at + len(x))])
                size += len(x)
                if size > AT_ONCE:
                    yield found_starts(held)
                    held, size = [], 0
        if size:
            yield found_starts(held)

    def found_starts(held):
        return _batch([*strings, "role"], [pa.array(np.ascontiguousarray(c)) for c in _spoken_for(np.concatenate(held), 2).T])

    def twice(batches):
        for x in _shared_rows(batches, 2):
            yield _batch(["name", "start", "end"], [pa.array(np.ascontiguousarray(x[:, 2])), pa.array(np.ascontiguousarray(x[:, 3])), pa.array(x[:, 3] + length)])

    kind, span = "hash long, name long, place long, left binary, right binary", "name long, start long, end long"
    around = texts.join(per_text, "name").select("name", "text", "anchors").mapInArrow(cut, kind)
    if many.limit(1).count():
        often = around.join(many, "hash", "left_semi").mapInArrow(starts, "a long, b long, name long, start long, role long")
        often = _meeting(often, strings, 2).mapInArrow(twice, span)
        usual = around.join(many, "hash", "left_anti")
    else:
        often, usual = None, around
    found = usual.repartition("hash").sortWithinPartitions("hash").mapInArrow(reach, span)
    found = found.unionAll(often) if often is not None else found
    return found.groupBy("name").agg(F.collect_set(F.struct("start", "end")).alias("spans")), texts


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many went, and the number of maximal removed runs."""
    kept, at, runs, gone = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
            gone += end - start
            at = end
        elif end > at:
            gone += end - at
            at = end
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Each byte goes that a string of length bytes covers which also starts anywhere else, in the same text or
    another row's; strings are judged on the input, and never cross texts. So repeated rows, and copies of a
    text of length bytes or more, go wholly. Null texts are empty and keep nothing. Bytes may be cut within a
    character: the hash is of the bytes that remain.
    """
    small_batches(docs.sparkSession)
    names, seed = named_texts(docs)
    named = docs.where("text is not null").select("doc_id", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("name"), "text")
    spans, texts = repeated_spans(named, names, length)

    def apply(batches):
        fields = ["name", "n_removed", "n_spans", "kept_sha256"]
        for b in batches:
            out = []
            for name, t, found in zip(*(col.to_pylist() for col in b.columns), strict=True):
                kept, gone, runs = remove_spans(t.encode(), [(x["start"], x["end"]) for x in found])
                out.append((name, gone, runs, hashlib.sha256(kept).hexdigest()))
            if out:
                yield _batch(fields, [pa.array(v) for v in zip(*out, strict=True)])

    cut = texts.join(spans, "name").select("name", "text", "spans").mapInArrow(apply, "name long, n_removed long, n_spans long, kept_sha256 string")
    cut = stored(cut.dropDuplicates(["name"]), "cut")
    copies = stored(names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    both = cut.join(copies, "name", "full")
    rows = names.join(stored(both, "both"), "name", "left")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


#: Every start of a string of 200 bytes by the hash of its bytes, as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(n - 199)) AS i, unnest(list_transform(range(n - 199), lambda i: hash(substr(h, (2 * i + 1)::BIGINT, 400)))) AS a FROM d WHERE n >= 200),
k AS (SELECT a FROM s GROUP BY a HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS first FROM s SEMI JOIN k USING (a) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
o AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last FROM runs GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT), '' ORDER BY lo) AS kept FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN p USING (doc_id)
"""
