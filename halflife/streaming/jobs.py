"""Structured Streaming forms: rate limits, failure detection, change streams, streamed upserts and searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(times: list[float], rate: float, burst: float, tokens: float | None = None, last: float | None = None):
    """(allowed flags, tokens, last refill): a bucket starts full and is refilled only when it holds less than one token."""
    out = []
    for at in times:
        if tokens is None:
            tokens, last = burst, at
        if tokens < 1:
            tokens, last = min(burst, tokens + max(0.0, at - last) * rate), at
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def rate_limit(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(client, at, request_id, allowed) of a stream of (client, at in seconds, request_id); each client has a bucket as state."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        flags, tokens, last = token_bucket(rows["at"].tolist(), rate, burst, tokens, last)
        state.update((tokens, last))
        yield rows.assign(client=key[0], allowed=flags)[["client", "at", "request_id", "allowed"]]

    return requests.groupBy("client").applyInPandasWithState(
        run, f"client {requests.schema['client'].dataType.simpleString()}, at double, request_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def rate_limit_batch(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """The same over a bounded table, one client at a time."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "request_id"])
        return rows.assign(allowed=token_bucket(rows["at"].tolist(), rate, burst)[0])[["client", "at", "request_id", "allowed"]]

    return requests.groupBy("client").applyInPandas(run, f"client {requests.schema['client'].dataType.simpleString()}, at double, request_id long, allowed boolean")


def failures(beats: DataFrame, limit_ms: int) -> DataFrame:
    """(node_id, status, at) changes of a stream of beats (node_id, at ms, as event time `ts`): FAILED at a gap over the limit, HEALTHY after it."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(x for b in batches for x in b["at"]):
            if last is None:
                out.append((key[0], "HEALTHY", at))
            elif at - last > limit_ms:
                out += [(key[0], "FAILED", last + limit_ms), (key[0], "HEALTHY", at)]
            last = at if last is None else max(last, at)
        state.update((last,))
        yield pd.DataFrame(out, columns=["node_id", "status", "at"])

    return beats.groupBy("node_id").applyInPandasWithState(
        run, f"node_id {beats.schema['node_id'].dataType.simpleString()}, status string, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id of a change stream (lsn, id, op), as an update-mode aggregate; the state has one row an id."""
    return changes.groupBy("id").agg(F.max(F.struct("lsn", "op")).alias("last")).select("id", F.col("last.lsn").alias("lsn"), F.col("last.op").alias("op"))


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Feeds micro-batches to apply(batch, number), such as Engine.upsert; a batch is one commit."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """Answers a stream of queries (query_id, embedding) batch by batch with search(batch), such as Engine.batch_search; a batch's hits are one commit of Parquet."""
    def answer(batch: DataFrame, number: int) -> None:
        search(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return upsert_stream(queries, answer, checkpoint, once)


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, through Parquet; update-mode batches are numbered."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
