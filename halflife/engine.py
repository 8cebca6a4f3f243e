"""The façade: collections of vectors and edges by name, with the operators behind short calls."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.operators import drift, graph, ivf, quantize, search, trace, writes
from halflife.schema import EDGE_STRUCT, STRATEGIES, VECTORS, AgentConfig, CollectionConfig, EngineError, SearchOptions, TemporalConfig
from halflife.sources.json_io import REGISTRY
from halflife.sources.scratch import stored
from halflife.sources.tables import KEEP, Tables, last_changes

#: Logged batches of a collection beyond which a write folds them into a whole version.
FOLD_AFTER = 32


def now_ms() -> int:
    return int(time.time() * 1000)


class Engine:
    """All tables of an engine live under root; several processes may read it, one writes.

    Writes append a batch to a change log; reads merge the newest whole version with the log; compact() folds it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)
        self._configs: dict[str, CollectionConfig] = {}
        self._migrations: dict[str, drift.Migration] = {}
        self._recover()

    def _recover(self) -> None:
        if self.tables.exists("_registry"):
            for r in self.tables.read("_registry").collect():
                row = r.asDict(recursive=True)
                agent = row.pop("agent", None) or {}
                agent |= {"cross_agent_readable": tuple(agent.get("cross_agent_readable") or ())}
                self._configs[row["name"]] = CollectionConfig(**{**row, "temporal": TemporalConfig(**row["temporal"]), "agent": AgentConfig(**agent)})

    def _save(self) -> None:
        rows = [asdict(c) for c in self._configs.values()]
        self.tables.write("_registry", self.spark.createDataFrame(rows, REGISTRY).coalesce(1))

    def config(self, name: str) -> CollectionConfig:
        if name not in self._configs:
            raise EngineError(f"no collection {name!r}")
        return self._configs[name]

    def create_collection(self, name: str, **settings) -> CollectionConfig:
        if name in self._configs:
            raise EngineError(f"collection {name!r} exists")
        made = CollectionConfig(name, **settings)
        self.tables.write(name, self.spark.createDataFrame([], VECTORS))
        self.tables.write(f"{name}.edges", self.spark.createDataFrame([], EDGE_STRUCT))
        self._configs[name] = made
        self._save()
        return made

    def drop_collection(self, name: str) -> None:
        self.config(name)
        self.tables.drop(name)
        self.tables.drop(f"{name}.edges")
        del self._configs[name]
        self._save()

    def list_collections(self, counts: bool = False) -> DataFrame:
        """The collections by name; with counts, the rows of each too."""
        rows = [(c.name, c.dim, c.index_type, c.metric, c.n_shards) for c in self._configs.values()]
        out = self.spark.createDataFrame(rows, "name string, dim int, index_type string, metric string, n_shards int")
        if counts and rows:
            each = [self.vectors(n).agg(F.count("*").alias("n_vectors")).select(F.lit(n).alias("name"), "n_vectors") for n in self._configs]
            out = out.join(reduce(DataFrame.unionAll, each), "name")
        return out.orderBy("name")

    def exists(self, name: str) -> bool:
        return name in self._configs

    def stats(self, name: str) -> DataFrame:
        c = self.config(name)
        return self.vectors(name).agg(F.count("*").alias("n_vectors")).select(F.lit(name).alias("name"), "n_vectors", F.lit(c.n_shards).alias("n_shards"), F.lit(c.dim).alias("dim"), F.lit(c.metric).alias("metric"))

    def total_vectors(self) -> int:
        return sum(self.vectors(n).count() for n in self._configs)

    def set_temporal(self, name: str, **settings) -> TemporalConfig:
        """Settings that are not named go back to their defaults; the change takes effect at once."""
        made = TemporalConfig(**settings)
        self._configs[name] = replace(self.config(name), temporal=made)
        self._save()
        return made

    def set_agent(self, name: str, agent: AgentConfig) -> None:
        self._configs[name] = replace(self.config(name), agent=agent)
        self._save()

    def _base(self, table: str, at: int | None = None):
        row = self.tables.current(table, at)
        if row is None:
            raise EngineError(f"no table {table!r}" if at is None else f"no version of {table!r} at {at}")
        return row

    def _changes(self, table: str, after: int, at: int | None = None) -> DataFrame | None:
        """The verified log after a number; None where nothing was logged."""
        if not self.tables.log_batches(table, after, at):
            return None
        return writes.verified(self.tables.log(table, after, at))

    def vectors(self, name: str, at: int | None = None) -> DataFrame:
        """The collection now, or as it was at a time: the newest whole version with the changes logged since."""
        self.config(name)
        base = self._base(name, at)
        return _merged(self.spark.read.parquet(base["path"]), self._changes(name, base["version"], at))

    def edges(self, name: str, at: int | None = None) -> DataFrame:
        self.config(name)
        table = f"{name}.edges"
        base = self._base(table, at)
        rows, log = self.spark.read.parquet(base["path"]), self._changes(table, base["version"], at)
        if log is None:
            return rows
        gone = log.where("op = 'DELETE'").select(F.col("del_id").alias("id"))
        return graph.remove_nodes(rows, gone).unionByName(writes.replay_edges(log).select(rows.columns))

    def _append(self, table: str, changes: DataFrame) -> int:
        number = self.tables.append_changes(table, changes)
        if len(self.tables.log_batches(table, self._base(table)["version"])) > FOLD_AFTER:
            self.compact(table.removesuffix(".edges"))
        return number

    def compact(self, name: str) -> int:
        """Folds the logged changes into a new whole version of vectors and edges; returns the vectors' number."""
        vectors, edges = self.vectors(name), self.edges(name)
        self.tables.write(f"{name}.edges", edges)
        return self.tables.write(name, vectors)

    def upsert(self, name: str, rows: DataFrame, now: int | None = None) -> int:
        """Logs the rows as added or replaced, in one batch; inline edges go to the edge log. Returns the batch's number.

        With an agent's dedup_threshold, rows that are as similar to a row of the collection, or to an earlier one of the batch, go.
        """
        c = self.config(name)
        new = writes.apply_agent(writes.checked_dim(writes.with_defaults(rows, now_ms() if now is None else now), c.dim), c.agent)
        new = new.dropDuplicates(["id"])
        plain = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in VECTORS.fields])
        if c.agent.enabled and c.agent.dedup_threshold is not None:
            old = self.vectors(name).join(plain.select("id"), "id", "left_anti")
            both = old.select("id", "embedding", F.lit(0).alias("created_at"), F.lit(False).alias("new")).unionByName(plain.select("id", "embedding", F.lit(1).alias("created_at"), F.lit(True).alias("new")))
            plain = plain.join(writes.later_rows(both, c.agent.dedup_threshold, F.col("new")), "id", "left_anti")
        number = self._append(name, plain.select(F.lit("UPSERT").alias("op"), F.col("created_at").alias("ts"), F.struct(*plain.columns).alias("vec")))
        run = self._migrations.get(name)
        if run and run.phase == "MIGRATING" and "new_embedding" in new.columns:
            run.add(new.join(plain.select("id"), "id", "left_semi").select("id", F.col("new_embedding").alias("embedding")))
        if "edges" in rows.columns:
            from halflife.sources.json_io import inline_edges

            self.add_edges(name, inline_edges(new))
        return number

    def _log_deletes(self, name: str, ids: DataFrame) -> None:
        gone = ids.select(F.lit("DELETE").alias("op"), F.lit(now_ms()).alias("ts"), F.col("id").alias("del_id"))
        self._append(name, gone)
        self._append(f"{name}.edges", gone)

    def delete(self, name: str, ids: Sequence[str]) -> int:
        """Logs the deletion and returns how many of the ids were there; their edges go too."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        n = writes.deleted_count(self.vectors(name), gone).first()[0]
        self._log_deletes(name, gone)
        return n

    def purge(self, name: str, at: int) -> int:
        """Deletes the rows that are no longer valid at the time; returns how many."""
        before = self.vectors(name)
        gone = stored(before.join(writes.purge_expired(before, at).select("id"), "id", "left_anti").select("id"), "purged")
        n = gone.count()
        if n:
            self._log_deletes(name, gone)
        return n

    def add_edges(self, name: str, rows: DataFrame) -> None:
        added = graph.add_edges(self.spark.createDataFrame([], EDGE_STRUCT), rows)
        self._append(f"{name}.edges", added.select(F.lit("ADD_EDGE").alias("op"), F.col("created_at").alias("ts"), F.struct(*added.columns).alias("edge")))

    def build_index(self, name: str, n_lists: int | None = None, subspaces: int | None = None, recall: float = 0.95) -> int:
        """Writes inverted lists with product-quantized codes of the whole collection, which is compacted first; returns their number.

        Every row is indexed; centres and codebook are fitted on a bounded sample. How many lists a search probes is
        measured, for the recall wanted, with a bounded sample of rows as queries against all rows.
        """
        c = self.config(name)
        self.compact(name)
        rows = self.tables.read(name)
        n = rows.count()
        if not n:
            raise EngineError("an empty collection has no index")
        path = f"{self.tables.root}/{name}/_index/{uuid.uuid4().hex[:12]}"
        book = quantize.train(rows, subspaces or max(d for d in range(1, max(1, c.dim // 2) + 1) if c.dim % d == 0))
        book.save(self.spark, f"{path}/book")
        lists = ivf.store(quantize.encode(rows, book), path, n_lists or max(1, round(n**0.5)))
        ivf.save_probes(self.spark, lists, ivf.probes_for(lists, rows, ivf.sample_queries(rows), recall, now_ms(), c.temporal, c.metric))
        number = self.tables.next_number(name)
        self.tables._note(name, number, path, "index", None)
        return number

    def _index(self, name: str):
        """The newest index that is not older than the whole version it was built of, or None."""
        base = self._base(name)["version"]
        return self.tables.manifests(name).where((F.col("kind") == "index") & (F.col("version") > base)).orderBy(F.desc("version")).first()

    def _strategy(self, name: str, strategy: str | None):
        """(strategy, index): what is named, or the collection's index_type; exact where there is no index."""
        c = self.config(name)
        strategy = strategy or c.index_type
        if strategy not in (*STRATEGIES, "auto"):
            raise EngineError(f"unknown strategy {strategy!r}")
        index = None if strategy == "exact" else self._index(name)
        if index is None:
            return "exact", None
        if strategy == "auto":
            strategy = search.choose_strategy(self.spark.read.parquet(self._base(name)["path"]).count(), 0.95, c.dim)
        return strategy, index

    def candidates(self, name: str, query: Sequence[float], strategy: str | None = None, options: SearchOptions = SearchOptions(), at: int | None = None, n_probe: int | None = None, factor: int = 20) -> tuple[str, DataFrame]:
        """(strategy used, the rows that a search scores exactly).

        exact: all rows. ivf: the rows of the probed lists. pq: the factor * top_k best of those by their codes. auto: see
        choose_strategy(). What was logged since the index was built is always scored; without an index all rows are.
        """
        c, at = self.config(name), now_ms() if at is None else at
        strategy, index = self._strategy(name, strategy)
        if strategy == "exact":
            return strategy, self.vectors(name)
        lists = ivf.load(self.spark, index["path"])
        rows = ivf.probe(lists.rows(self.spark), lists.centres, query, n_probe or lists.n_probe)
        log = self._changes(name, index["version"])
        if log is not None:
            rows = rows.join(last_changes(log).select("id").distinct(), "id", "left_anti")
        columns = [f.name for f in VECTORS.fields]
        if strategy == "pq":
            book = quantize.Codebook.load(self.spark, f"{index['path']}/book")
            rows = quantize.pq_pool(rows, book, query, at, c.temporal, options, factor)
        rows = rows.select(columns)
        return strategy, rows if log is None else rows.unionByName(writes.replay(last_changes(log)).select("vec.*").select(columns))

    def get(self, name: str, id_value: str) -> DataFrame:
        return search.point(self.vectors(name), id_value)

    def search(self, name: str, query: Sequence[float], options: SearchOptions = SearchOptions(), at: int | None = None, strategy: str | None = None, n_probe: int | None = None) -> DataFrame:
        """The k best rows by the collection's index_type or the strategy named: see candidates()."""
        c = self.config(name)
        if len(query) != c.dim:
            raise EngineError(f"dimension {c.dim} expected, got {len(query)}")
        at = now_ms() if at is None else at
        _, rows = self.candidates(name, query, strategy, options, at, n_probe)
        hits = search.search(rows, query, at, c.temporal, options, c.metric)
        return graph.decorate(hits, self.edges(name), options)

    def search_one(self, name: str, query: Sequence[float], at: int | None = None) -> DataFrame:
        return self.search(name, query, SearchOptions(top_k=1), at)

    def batch_search(self, name: str, queries: DataFrame, options: SearchOptions = SearchOptions(), at: int | None = None, strategy: str | None = None, n_probe: int | None = None, factor: int = 20) -> DataFrame:
        """The k best rows of each query (query_id, embedding), by the collection's index_type or the strategy named: see candidates()."""
        c, at = self.config(name), now_ms() if at is None else at
        strategy, index = self._strategy(name, strategy)
        options = replace(options, metric=options.metric or c.metric)
        if strategy == "exact":
            return search.batch_search(self.vectors(name), queries, at, c.temporal, options)
        lists, book = ivf.load(self.spark, index["path"]), quantize.Codebook.load(self.spark, f"{index['path']}/book")
        rows, log = lists.rows(self.spark), self._changes(name, index["version"])
        if log is not None:
            new = writes.replay(last_changes(log)).select("vec.*")
            kept = rows.join(last_changes(log).select("id").distinct(), "id", "left_anti").select(rows.columns)
            rows = kept.unionByName(ivf.assign(quantize.encode(new, book), lists.centres).select(rows.columns))
        if strategy == "pq":
            return quantize.batch_pq_search(rows, book, queries, at, c.temporal, options, factor).drop("approximate")
        return ivf.batch_ivf_search(rows, lists.centres, queries, n_probe or lists.n_probe, at, c.temporal, options)

    def trace(self, name: str, query: Sequence[float], options: SearchOptions = SearchOptions(), at: int | None = None) -> DataFrame:
        c = self.config(name)
        return trace.trace(self.vectors(name), self.edges(name), query, now_ms() if at is None else at, c.temporal, options, collection=name)

    def migrate(self, name: str, new_embeddings: DataFrame) -> DataFrame:
        """Re-embeds the collection as a new version in one go and returns the progress row."""
        self.start_migration(name)
        self.add_migrated(name, new_embeddings)
        return self.finish_migration(name)

    def start_migration(self, name: str) -> None:
        """Begins a migration, one a collection at a time. While it runs, upserted rows with a column new_embedding go to its shadow too."""
        self.config(name)
        if name in self._migrations and self._migrations[name].phase == "MIGRATING":
            raise EngineError(f"a migration of {name!r} is running")
        self._migrations[name] = drift.Migration(self.vectors(name), f"{self.tables.root}/{name}/_shadow/{uuid.uuid4().hex[:12]}")
        self._migrations[name].start()

    def _migration(self, name: str) -> drift.Migration:
        self.config(name)
        if name not in self._migrations:
            raise EngineError(f"no migration of {name!r}")
        self._migrations[name].vectors = self.vectors(name)  # rows that came since the start
        return self._migrations[name]

    def add_migrated(self, name: str, batch: DataFrame) -> None:
        self._migration(name).add(batch)

    def migration_status(self, name: str) -> DataFrame:
        return self._migration(name).status()

    def finish_migration(self, name: str) -> DataFrame:
        """The new embeddings become the collection's next version; returns the progress row."""
        run = self._migration(name)
        moved = run.finish()
        status = stored(drift.progress(moved), "progress")
        self.tables.write(name, moved.select(*[f.name for f in VECTORS.fields]))
        return status

    def abort_migration(self, name: str) -> None:
        """The collection stays as it is; the shadow is not read again."""
        self._migration(name).abort()

    def snapshot(self, name: str, at: int | None = None) -> int:
        """A whole version, logged changes included, that later writes do not touch."""
        return self.tables.write(name, self.vectors(name), "snapshot", at)

    def snapshots(self, name: str) -> DataFrame:
        self.config(name)
        return self.tables.snapshots(name)

    def restore(self, name: str, at: int) -> int:
        """Vectors and edges become what they were at a time; what they are now is kept as a snapshot first."""
        then, edges = self.vectors(name, at), self.edges(name, at)
        self.snapshot(name)
        self.tables.write(f"{name}.edges", edges, "restore")
        return self.tables.write(name, then, "restore")

    def prune(self, name: str, keep: int = KEEP) -> int:
        """Removes old whole versions and the log before the oldest kept; returns how many folders went."""
        self.config(name)
        return sum(self.tables.prune(t, keep) + self.tables.truncate_log(t) for t in (name, f"{name}.edges"))


def _merged(base: DataFrame, log: DataFrame | None) -> DataFrame:
    if log is None:
        return base
    changes = last_changes(log)
    kept = base.join(changes.select("id").distinct(), "id", "left_anti").select(base.columns)
    return kept.unionByName(writes.replay(changes).select("vec.*").select(base.columns))
