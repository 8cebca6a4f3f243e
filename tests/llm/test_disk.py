"""What the operators leave and take on disk while they run."""

import os
import threading
import time

import numpy as np

from halflife.llm import common, components, jaccard
from halflife.sources import scratch


def size(*tops):
    total = 0
    for top in tops:
        for folder, _, names in os.walk(top):
            for n in names:
                try:
                    total += os.lstat(f"{folder}/{n}").st_size
                except OSError:  # it went meanwhile
                    pass
    return total


def local_dirs(spark):
    return [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]


def test_shuffles_go_when_a_table_is_stored(spark):
    def stay():
        return {n for top in local_dirs(spark) for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", stay()
    was = spark.conf.get(key)
    with scratch.scope(spark):
        out = scratch.stored(spark.range(100_000).repartition(4, "id").groupBy("id").count(), "sums")
        end = time.time() + 20
        while (left := stay() - before) and time.time() < end:
            time.sleep(0.2)
        assert not left and out.count() == 100_000
    assert spark.conf.get(key) == was


def test_near_copies_take_little_disk(spark, tmp_path, monkeypatch):
    """Every document has near copies, so all tile rows and all arrays of it are needed, and id tables are large."""
    for module, name in ((jaccard, "BROADCAST_IDS"), (jaccard, "BROADCAST_BITMAPS"), (jaccard, "BROADCAST_PLACES"), (common, "BROADCAST_IDS"), (components, "MANY")):
        monkeypatch.setattr(module, name, 100)
    rng = np.random.default_rng(1)
    vocabulary = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20_000)])
    texts = [" ".join(vocabulary[(20_000 * rng.random(400) ** 3).astype(int)]) for _ in range(1_200)]
    rows = [(i * 10 + k, f"{t} the last words of copy {k}") for i, t in enumerate(texts) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, given = spark.read.parquet(str(tmp_path / "docs")), size(tmp_path / "docs")
    peak, over, tops = 0, threading.Event(), [*local_dirs(spark), scratch.shared_dir(spark).removeprefix("file://")]
    base = size(*tops)

    def watch():
        nonlocal peak
        while not over.is_set():
            peak = max(peak, size(*tops) - base)
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        with scratch.scope(spark):
            got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs, 5, 80).collect()}
    finally:
        over.set()
        watcher.join()
    assert got == {(i, i // 10 * 10) for i, _ in rows}
    assert peak < 4 * given, peak / given
