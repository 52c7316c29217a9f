"""The engine: sets views up from snapshots, applies changes exactly once, streams a log, reports and tears down.

A batch of changes is applied in one commit: each touched view's change is folded and written as a further run of its state,
and the manifest that names the runs and the new position is published in one rename.  A commit costs what the batch
holds, not what the state holds.  Runs are added up when they are read; when there are more than ``RUNS``, the
newest ones are merged into one, each with the older ones that are not much larger, so that a row is
rewritten about once for each doubling of the state.  Changes up to the manifest's position are skipped, so a batch that is delivered
again has no effect, and the position in the manifest, not Spark's checkpoint, is the truth.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidefold.errors import EngineError, SchemaDriftError, SetupError
from tidefold.functions.shared import qualified
from tidefold.operators import algebra, changes as ch, verify
from tidefold.plans.spec import Config, ViewSpec
from tidefold.sources import changelog
from tidefold.streaming.commits import CommitStore, Manifest, Run, ViewVersion

log = logging.getLogger("tidefold")

#: A commit that finds this many runs of a state merges the newest half into its own; an older run joins in if it is at most ``RATIO`` times as large as those together.
RUNS, RATIO = 16, 4
#: Up to this many changes, or bytes of them as Spark estimates, one task folds a batch, which saves the exchange.
SMALL, SMALL_BYTES = 100_000, 64 << 20


class Engine:
    """Views of one configuration kept below ``root``, a folder that all executors share.

    ``runs``: how many runs a state may have before some are merged.
    ``at``: called with the name of each step of a commit, for tests that stop there.
    """

    def __init__(self, spark: SparkSession, config: Config, root: str, runs: int = RUNS, at: Callable[[str], None] = lambda step: None) -> None:
        self.spark, self.config, self.runs, self.at = spark, config, runs, at
        self.store = CommitStore(spark, root)
        self.views = {v.name: v for v in config.views}
        self._columns: dict[object, object] = {}

    # setting up and tearing down

    def setup(self, snapshots: dict[str, DataFrame], lsn: int, force: bool = False) -> None:
        """Backfill every view from snapshots of the sources, each as of the position ``lsn``, where streaming goes on."""
        if missing := [s for s in self.config.sources if s not in snapshots]:
            raise SetupError(f"no source table {', '.join(missing)}")
        for v in self.config.views:
            try:
                algebra.check_source(v, snapshots[v.source].schema)
            except SchemaDriftError as e:
                raise SetupError(str(e)) from e
        if self.store.numbers():
            if not force:
                raise SetupError(f"{self.store.root} is set up already; force starts over")
            self.store.remove("manifests")
        made = {}
        for v in self.config.views:
            source = snapshots[v.source]
            schema = algebra.state_schema(v, source.schema)
            made[v.name] = ViewVersion(schema.jsonValue(), source.schema.jsonValue(), (self._write(v, algebra.backfill(v, source)),))
            log.info("view %s: backfilled", v.name)
        self.at("backfilled")
        self.store.publish(Manifest(0, self.config.slot, lsn, None, made, uuid.uuid4().hex))

    def teardown(self) -> None:
        self.store.remove_all()

    def resync(self, name: str, snapshot: DataFrame) -> Manifest:
        """Backfill one view again from its source as of the checkpoint; the others and the position stay."""
        m, view = self.manifest(), self.views[name]
        algebra.check_source(view, snapshot.schema)
        schema = algebra.state_schema(view, snapshot.schema)
        made = ViewVersion(schema.jsonValue(), snapshot.schema.jsonValue(), (self._write(view, algebra.backfill(view, snapshot)),))
        return self._publish(m, m.checkpoint_lsn, m.batch_id, m.views | {name: made})

    # reading

    def manifest(self) -> Manifest:
        m = self.store.latest()
        if m is None:
            raise EngineError(f"{self.store.root} has no checkpoint; run setup first")
        return m

    def state(self, name: str, m: Manifest | None = None) -> DataFrame:
        """A view's state: one row for each group that has rows; a group with fewer than none raises."""
        version, view = (m or self.manifest()).views[name], self.views[name]
        return algebra.total(view, self._read(version, version.runs))

    def view(self, name: str, m: Manifest | None = None) -> DataFrame:
        """What users see of a view, at the newest manifest or at ``m``."""
        return algebra.project(self.views[name], self.state(name, m))

    def verify(self, snapshots: dict[str, DataFrame]) -> DataFrame:
        """All views against their sources as of the checkpoint, all at one manifest: ``view, problem, column, key`` of each difference."""
        m, out = self.manifest(), None
        for v in self.config.views:
            found = verify.differences(v, verify.ground_truth(v, snapshots[v.source]), self.view(v.name, m))
            key = F.to_json(F.struct(*v.group_by)) if v.group_by else F.lit("{}")
            found = found.select(F.lit(v.name).alias("view"), "problem", "column", key.alias("key"))
            out = found if out is None else out.unionByName(found)
        return out

    # applying changes

    def _read(self, version: ViewVersion, runs: tuple[Run, ...]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(version.state)).parquet(*[r.path for r in runs])

    def _write(self, view: ViewSpec, state: DataFrame) -> Run:
        folder = self.store.new_folder(view.name)
        state.write.parquet(folder)
        return Run(folder, self.store.size(folder))

    def _publish(self, m: Manifest, lsn: int, batch_id: int | None, views: dict[str, ViewVersion]) -> Manifest:
        gone = {r.path for v in m.views.values() for r in v.runs} - {r.path for v in views.values() for r in v.runs}
        due, now = {p for p, _ in self.store.due(m)}, time.time()
        retired = (*(x for x in m.retired if x[0] not in due), *((p, now) for p in sorted(gone)))
        after = Manifest(m.number + 1, m.slot, lsn, batch_id, views, m.setup, retired)
        self.store.publish(after)
        return after

    def _once(self, key: object, make: Callable[[], object]):
        """Column expressions do not depend on the batch and are built once, since each part of one is a call into the JVM."""
        if key not in self._columns:
            self._columns[key] = make()
        return self._columns[key]

    def apply(self, changes: DataFrame, batch_id: int | None = None) -> Manifest:
        """Apply change rows of whole transactions; returns the manifest that then holds."""
        started, m = time.time(), self.manifest()
        after = self._apply_at_once(changes, batch_id, m) if len(self.config.views) == 1 else None
        if after is None:
            after = self._apply_by_table(changes, batch_id, m)
        log.info("applied up to %s in %d ms", after.checkpoint_lsn, 1000 * (time.time() - started))
        return after

    def _apply_at_once(self, changes: DataFrame, batch_id: int | None, m: Manifest) -> Manifest | None:
        """The usual batch for a single view: folded and written while its positions are observed, with no job before.

        None if the batch turns out to hold a truncation, no row of the source, or something that was applied before, or if it
        fails, which it may do for the sake of changes that do not count; what was written is removed then.
        """
        table, seen, versions, sent = self.config.sources[0], Observation(), dict(m.views), changes.schema["new"].dataType
        small = int(str(changes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
        new = changes.observe(seen, *self._once("seen", self._seen))
        made: list[Run] = []
        try:
            self._fold_into(new, sent, table, None, small, m, versions, made)
            # not waited for: they come with the end of the job, or the batch is applied in steps
            got = seen.get if seen._jo.getOrEmpty().contains("n") else {}
        except SchemaDriftError:
            raise
        except Exception as e:
            log.info("batch is applied in steps: %s", str(e)[:200])
            got = {}
        if not got.get("n") or got["truncated"] or got["first"] <= m.checkpoint_lsn:
            for run in made:
                self.store.delete(run.path)
            return None
        self.at("written")
        after = self._publish(m, got["lsn"], batch_id, versions)
        self.at("published")
        return after

    def _seen(self) -> list:
        mine = f"`table` = '{self.config.sources[0]}'"
        return [F.min("end_lsn").alias("first"), F.max("end_lsn").alias("lsn"), F.expr(f"count_if({mine} AND op IN ('I', 'U', 'D', 'T')) AS n"), F.expr(f"count_if({mine} AND op = 'T') AS truncated")]

    def _apply_by_table(self, changes: DataFrame, batch_id: int | None, m: Manifest) -> Manifest:
        new = changes.persist()
        try:
            by, *found = self._once("found", self._found)
            tables = new.groupBy(by).agg(*found).collect()  # a row for each source
            if any(r["first"] <= m.checkpoint_lsn for r in tables):
                # only where something is delivered again: a filter with another number in it is compiled each time
                new.unpersist()
                new = changes.where(F.col("end_lsn") > m.checkpoint_lsn).persist()
                tables = new.groupBy(by).agg(*found).collect()
            if not tables:
                return m
            versions, sent = dict(m.views), new.schema["new"].dataType
            for r in tables:
                if r["table"] is not None and r["n"]:
                    self._fold_into(new, sent, r["table"], tuple(r["cut"]) if r["cut"] else None, r["n"] <= SMALL, m, versions, [])
            self.at("written")
            after = self._publish(m, max(r["lsn"] for r in tables), batch_id, versions)
            self.at("published")
        finally:
            new.unpersist()
        return after

    def _found(self) -> list:
        wanted = F.when(F.col("table").isin(*self.config.sources), F.col("table")).alias("table")
        return [wanted, F.min("end_lsn").alias("first"), F.max("end_lsn").alias("lsn"), F.expr("count_if(op IN ('I', 'U', 'D', 'T')) AS n"), F.expr("max(CASE WHEN op = 'T' THEN struct(end_lsn, seq) END) AS cut")]

    def _fold_into(self, new: DataFrame, sent: T.DataType, table: str, cut: tuple[int, int] | None, small: bool, m: Manifest, versions: dict[str, ViewVersion], made: list[Run]) -> None:
        """Write what the changes of a table do to each of its views; ``made`` gets the runs."""
        views = [v for v in self.config.views if v.source == table]
        source = T.StructType.fromJson(m.views[views[0].name].source)
        needed = tuple(dict.fromkeys(c for v in views for c in v.needed))
        if isinstance(sent, T.StructType):
            for c in needed:
                if c not in sent.fieldNames() or sent[c].dataType != source[c].dataType:
                    raise SchemaDriftError(f"{table}: the column {c} is missing or has another type")
        texts, shape = isinstance(sent, T.MapType), source.json()
        signed = self._once((table, texts, shape), lambda: ch.signed_column(texts, source, needed))
        rows = ch.after_cut(new.where(F.col("table") == table), cut)
        rows = (rows.coalesce(1) if small else rows).select(signed)
        for v in views:
            delta = rows.groupBy(*v.group_by).agg(*self._once((v.name, shape), lambda v=v: algebra.fold_columns(v, source)))
            versions[v.name] = self._apply_view(v, versions[v.name], delta, cut is not None)
            made.append(versions[v.name].runs[-1])

    def _apply_view(self, view: ViewSpec, old: ViewVersion, delta: DataFrame, truncated: bool) -> ViewVersion:
        runs = () if truncated else old.runs  # behind a truncation nothing older counts
        if len(runs) >= self.runs:
            k = len(runs) - max(1, self.runs // 2)
            size = sum(r.bytes for r in runs[k:])
            while k and runs[k - 1].bytes <= RATIO * size:
                k -= 1
                size += runs[k].bytes
            rows = self._read(old, runs[k:]).unionByName(delta)
            # only with the oldest run among them are the sums whole
            delta, runs = algebra.added(view, rows) if k else algebra.total(view, rows), runs[:k]
        return ViewVersion(old.state, old.source, (*runs, self._write(view, delta)))

    # streaming

    def run(self, log_path: str, checkpoint: str, poll_ms: int | None = None) -> StreamingQuery:
        """Follow a log of changes from the manifest's position on; each micro-batch holds whole transactions and is one commit.

        Spark's own checkpoint is kept in a folder of the manifest's name below ``checkpoint``, so that no offset of an earlier setup, or
        of a state that is gone, is gone on from; those of other manifests are removed.
        """
        m = self.manifest()
        changelog.register(self.spark)
        own = f"{m.setup}-{m.number}"
        changelog.keep_only(self.spark, checkpoint, own)
        rows = self.spark.readStream.format(changelog.FORMAT).option("path", qualified(self.spark, log_path)).option("start_lsn", str(m.checkpoint_lsn)).option("max_txns", str(self.config.max_txns)).option("tables", ",".join(self.config.sources)).load()

        def step(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id)

        return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{own}").trigger(processingTime=f"{poll_ms or self.config.max_ms} milliseconds").start()

    @staticmethod
    def stop(query: StreamingQuery, seconds: float = 60) -> None:
        """Stop between two micro-batches; one that takes longer than ``seconds`` is broken off, which loses nothing."""
        end = time.time() + seconds
        while query.isActive and query.status["isTriggerActive"] and time.time() < end:
            time.sleep(0.02)
        query.stop()

    def catch_up(self, log_path: str, upto: int | None = None, max_txns: int | None = None) -> Manifest:
        """Apply a log's files up to a position by Spark's own scan, in batches of about ``max_txns`` transactions (all at once by default)."""
        m, held, txns, log_path = self.manifest(), None, 0, qualified(self.spark, log_path)
        for f in changelog.list_log(log_path, m.checkpoint_lsn):
            if upto is not None and f.first > upto:
                continue
            held, txns = f.last, txns + f.txns
            if max_txns and txns >= max_txns:
                m, txns = self.apply(changelog.read_log(self.spark, log_path, m.checkpoint_lsn, held if upto is None else min(held, upto))), 0
        return self.apply(changelog.read_log(self.spark, log_path, m.checkpoint_lsn, held if upto is None else min(held, upto))) if txns else m

    def wait_for(self, lsn: int, seconds: float = 120) -> bool:
        """Whether the checkpoint reaches a position in time."""
        end = time.time() + seconds
        while self.manifest().checkpoint_lsn < lsn:
            if time.time() > end:
                return False
            time.sleep(0.1)
        return True

    def barrier(self, log_path: str, seconds: float = 120) -> bool:
        """Whether everything that the log held when this was called is in the views in time."""
        return self.wait_for(changelog.latest_lsn(qualified(self.spark, log_path)), seconds)

    def status(self, log_path: str | None = None, query: StreamingQuery | None = None) -> dict[str, object]:
        """The slot, positions, lag and each view's rows; None for what isn't there."""
        m, log_path = self.store.latest(), log_path and qualified(self.spark, log_path)
        latest = changelog.latest_lsn(log_path) if log_path else None
        acknowledged = changelog.acknowledged(log_path) if log_path else None
        rows = {v: self.state(v, m).count() if m and v in m.views else None for v in self.views}
        at = m.checkpoint_lsn if m else None
        return {"slot": self.config.slot, "exists": m is not None, "active": bool(query and query.isActive), "checkpoint_lsn": at, "acknowledged_lsn": acknowledged, "current_lsn": latest, "lag": None if at is None or latest is None else max(0, latest - at), "updated_at": m.updated_at if m else None, "manifest": m.number if m else None, "batch": m.batch_id if m else None, "runs": {v: len(m.views[v].runs) for v in self.views if m and v in m.views}, "views": rows}

    def metrics(self, log_path: str | None = None, query: StreamingQuery | None = None) -> str:
        """The status in the text format that Prometheus scrapes."""
        info = self.status(log_path, query)
        found = {"up": int(info["active"]), "checkpoint_lsn": info["checkpoint_lsn"], "current_lsn": info["current_lsn"], "lag": info["lag"]}
        lines = [f'tidefold_{k}{{slot="{self.config.slot}"}} {v}' for k, v in found.items() if v is not None]
        lines += [f'tidefold_view_rows{{slot="{self.config.slot}",view="{k}"}} {v}' for k, v in info["views"].items() if v is not None]
        return "\n".join(lines) + "\n"
