"""Queries over the test tables, one or more for each operator of the views engine, and their DuckDB equivalents.

``orders`` has no nulls, so null keys, values and coupons are derived from the order's key on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.lsn import lsn_from_text, lsn_to_text
from tidefold.functions.shared import shared_dir
from tidefold.operators import algebra, changes as ch, extensions, verify
from tidefold.plans.spec import ROWS, AggSpec, Config, ViewSpec
from tidefold.sources import changelog, pgoutput, wire
from tidefold.streaming.engine import Engine

COUNT, COUPON, REVENUE, AVERAGE = AggSpec("count", None, "order_count"), AggSpec("count", "coupon", "with_coupon"), AggSpec("sum", "total", "revenue"), AggSpec("avg", "total", "avg_order_value")
ALL = (COUNT, COUPON, REVENUE, AVERAGE)
TABLE = "public.orders"
COLUMNS = ("id", "status", "total", "coupon", "priority")


def view(*aggregates: AggSpec, by: tuple[str, ...] = ("status",), name: str = "orders_view") -> ViewSpec:
    return ViewSpec(name, "public", "orders", by, aggregates or ALL)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    total = F.when(key % 10 != 0, F.col("o_totalprice").cast("decimal(18,2)"))
    return o.select(key.alias("id"), F.when(key % 13 != 0, F.col("o_orderstatus")).alias("status"), total.alias("total"), F.when(key % 3 == 0, F.col("o_orderpriority")).alias("coupon"), F.col("o_orderpriority").alias("priority"))


ORDERS_SQL = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_totalprice AS DECIMAL(18, 2)) END AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS coupon, o_orderpriority AS priority FROM orders)"""
PARTS_SQL = {COUNT: "CAST(count(*) AS BIGINT) AS order_count", COUPON: "CAST(count(coupon) AS BIGINT) AS with_coupon", REVENUE: "CAST(sum(total) AS DECIMAL(38, 2)) AS revenue", AVERAGE: "CAST(avg(total) AS DECIMAL(38, 6)) AS avg_order_value"}


def view_sql(v: ViewSpec, rows: str = "o", more: str = "") -> str:
    keys = ", ".join(v.group_by)
    return f"WITH {ORDERS_SQL}{more} SELECT {', '.join([*v.group_by, *(PARTS_SQL[a] for a in v.aggregates)])} FROM {rows}" + (f" GROUP BY {keys}" if keys else "")


def _row(**put) -> Column:
    return F.struct(*[put.get(c, F.col(c)).alias(c) for c in COLUMNS])


def change(rows: DataFrame, lsn: int, op: str, old: Column | None = None, new: Column | None = None, unchanged: list[str] | None = None) -> DataFrame:
    """Change rows of one transaction at a position, one for each row given."""
    none = F.lit(None).cast(rows.select(_row().alias("r")).schema["r"].dataType)
    kept = F.array(*[F.lit(c) for c in unchanged]) if unchanged else F.lit(None)
    return rows.select(F.lit(lsn).cast("long").alias("end_lsn"), F.col("id").cast("int").alias("seq"), F.lit(op).alias("op"), F.lit(TABLE).alias("table"), (none if old is None else old).alias("old"), (none if new is None else new).alias("new"), kept.cast("array<string>").alias("unchanged"))


def _truncate(o: DataFrame, lsn: int) -> DataFrame:
    return change(o.sparkSession.createDataFrame([(0, None, None, None, None)], o.schema), lsn, "T")


def _texts(changes: DataFrame) -> DataFrame:
    """The same changes with values as texts, as logs have them."""
    m = lambda side: F.when(F.col(side).isNotNull(), F.map_from_arrays(F.array(*[F.lit(c) for c in COLUMNS]), F.array(*[F.col(f"{side}.{c}").cast("string") for c in COLUMNS]))).alias(side)
    return changes.select("end_lsn", "seq", "op", "table", m("old"), m("new"), "unchanged")


def history(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot of nine tenths of the orders, and the changes after it: the rest comes, a seventh moves to status X and doubles, an eleventh goes."""
    new = o.where("id % 7 = 3")
    doubled = _row(status=F.when(F.col("id") % 7 == 3, "X").otherwise(F.col("status")), total=F.when(F.col("id") % 7 == 3, F.col("total") * 2).otherwise(F.col("total")).cast("decimal(18,2)"))
    log = change(o.where("id % 10 = 1"), 100, "I", new=_row()).unionByName(change(new, 200, "U", _row(), _row(status=F.lit("X"), total=(F.col("total") * 2).cast("decimal(18,2)")))).unionByName(change(o.where("id % 11 = 5"), 300, "D", doubled))
    return o.where("id % 10 <> 1"), log


FINAL_SQL = """, f AS (SELECT id, CASE WHEN id % 7 = 3 THEN 'X' ELSE status END AS status, CASE WHEN id % 7 = 3 THEN total * 2 ELSE total END AS total, coupon, priority FROM o WHERE id % 11 <> 5)"""


def maintained(v: ViewSpec, snapshot: DataFrame, changes: DataFrame, truncated: bool = False) -> DataFrame:
    """The view after the changes: backfill, fold, merge, project."""
    cut = ch.last_truncate(changes) if truncated else None
    state = algebra.empty_state(snapshot.sparkSession, v, snapshot.schema) if cut else algebra.backfill(v, snapshot)
    signed = ch.signed_rows(ch.of_table(changes, TABLE), snapshot.schema, v.needed, cut)
    return algebra.project(v, algebra.merge(v, state, algebra.fold(v, signed)))


def _fresh(v: ViewSpec) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: verify.ground_truth(v, orders(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four aggregates by status, maintained through inserts, updates and deletes."""
    return maintained(view(), *history(orders(spark, sf_dir)))


def _insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(), o.limit(0), change(o, 100, "I", new=_row()))


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(), o, change(o.where("id % 11 = 5"), 100, "D", _row()))


def _update_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(), o, change(o.where("id % 7 = 3"), 100, "U", _row(), _row(total=(F.col("total") * 2).cast("decimal(18,2)"))))


def _move(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(), o, change(o.where("id % 7 = 3"), 100, "U", _row(), _row(status=F.lit("X"))))


def _truncate_insert(v: ViewSpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = orders(spark, sf_dir)
        log = change(o.where("id % 5 = 1"), 100, "D", _row()).unionByName(_truncate(o, 200)).unionByName(change(o.where("id % 4 = 2"), 300, "I", new=_row()))
        return maintained(v, o, log, truncated=True)

    return run


def _truncate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(by=()), o, _truncate(o, 200), truncated=True)


def _cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return maintained(view(), o, change(o.where("status = 'P'"), 100, "D", _row()))


def _unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose coupon was not sent, in the log's form of texts."""
    o = orders(spark, sf_dir)
    lost = _row(total=(F.col("total") * 2).cast("decimal(18,2)"), coupon=F.lit(None).cast("string"))
    return maintained(view(), o, _texts(change(o.where("id % 7 = 3"), 100, "U", _row(), lost, ["coupon"])))


def _engine(spark: SparkSession, *views: ViewSpec) -> tuple[Engine, str]:
    root = f"{shared_dir(spark)}/views-{uuid.uuid4().hex}"
    return Engine(spark, Config("file", views), f"{root}/state", runs=4), root


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, log = history(orders(spark, sf_dir))
    engine, _ = _engine(spark, view())
    engine.setup({TABLE: snapshot}, 50)
    engine.apply(log.where("end_lsn <= 200"))
    engine.apply(log)
    engine.apply(log)
    return engine.view("orders_view")


def _spread(log: DataFrame, rows: int = 40) -> DataFrame:
    """The same changes in many small transactions."""
    return log.withColumn("end_lsn", F.col("end_lsn") * 1_000_000_000 + F.expr(f"seq div {rows}"))


def _small_batches(spark: SparkSession, sf_dir: str, batches: int = 6) -> DataFrame:
    """The log in many small transactions, applied in several commits."""
    snapshot, log = history(orders(spark, sf_dir))
    engine, root = _engine(spark, view())
    engine.setup({TABLE: snapshot}, 50)
    changelog.append(_spread(_texts(log)), f"{root}/log", txns_per_file=50)
    txns = sum(f.txns for f in changelog.list_log(f"{root}/log"))
    engine.catch_up(f"{root}/log", max_txns=-(-txns // batches))
    return engine.view("orders_view")


def _two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, log = history(orders(spark, sf_dir))
    engine, _ = _engine(spark, view(name="by_status"), view(by=("priority",), name="by_priority"))
    engine.setup({TABLE: snapshot}, 50)
    engine.apply(log)
    a = engine.view("by_status").select(F.lit("status").alias("kind"), F.col("status").alias("key"), *[x.alias for x in ALL])
    return a.unionByName(engine.view("by_priority").select(F.lit("priority").alias("kind"), F.col("priority").alias("key"), *[x.alias for x in ALL]))


def _relation(rel_id: int, name: str, columns: list[tuple[str, int]]) -> bytes:
    return wire.encode(wire.Relation(rel_id, "public", name, "f", tuple(wire.Column(c, oid, -1, False) for c, oid in columns)))


def _begin(lsn: int) -> bytes:
    return wire.encode(wire.Begin(lsn, wire.EPOCH, 1))


def _commit(lsn: int) -> bytes:
    return wire.encode(wire.Commit(0, lsn, lsn, wire.EPOCH))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of replication frames that insert the rows, a hundred to a transaction."""
    first = True
    for batch in batches:
        out, rows = [], batch.to_pylist()
        for i in range(0, len(rows), 100):
            part = rows[i : i + 100]
            lsn = part[0]["id"] + 1
            out += [(lsn, _begin(lsn)), (lsn, _relation(7, "orders", [("id", 20), ("status", 25), ("total", 1700), ("coupon", 25), ("priority", 25)]))] if first or i == 0 else [(lsn, _begin(lsn))]
            first = False
            out += [(lsn, wire.encode(wire.Insert(7, tuple(r[c] for c in COLUMNS)))) for r in part]
            out += [(lsn, wire.encode(wire.Origin(1, "o"))), (lsn, _commit(lsn))]
        segment = rows[0]["id"] if rows else 0
        yield pa.record_batch([pa.array([segment] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["segment", "n", "payload"])


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    log = pgoutput.decode_log(o.mapInArrow(_frames, "segment long, n long, payload binary"), {TABLE: COLUMNS})
    return maintained(view(), o.limit(0), log)


def _no_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    snapshot, log = history(o)
    final = o.where("id % 11 <> 5").select(*[x.alias(c) for c, x in zip(COLUMNS, (F.col("id"), F.when(F.col("id") % 7 == 3, "X").otherwise(F.col("status")), F.when(F.col("id") % 7 == 3, F.col("total") * 2).otherwise(F.col("total")).cast("decimal(18,2)"), F.col("coupon"), F.col("priority")), strict=True)])
    v = view()
    wrong = verify.differences(v, verify.ground_truth(v, final), maintained(v, snapshot, log))
    return wrong.agg(F.count("*").alias("n_differences"))


EVENTS = ViewSpec("events_view", "public", "events", ("event_type",), (AggSpec("count", None, "n_events"), AggSpec("sum", "value", "total_value")))


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    engine, root = _engine(spark, EVENTS)
    engine.setup({"public.events": e.limit(0)}, 0)
    new = F.map_from_arrays(F.array(F.lit("event_type"), F.lit("value")), F.array(F.col("event_type"), F.col("value").cast("string")))
    none = F.lit(None).cast("map<string, string>")
    log = e.select((F.expr("event_id div 25") + 1).alias("end_lsn"), (F.col("event_id") % 25).cast("int").alias("seq"), F.lit("I").alias("op"), F.lit("public.events").alias("table"), none.alias("old"), new.alias("new"), F.lit(None).cast("array<string>").alias("unchanged"))
    changelog.append(log, f"{root}/log", txns_per_file=250)
    query = engine.run(f"{root}/log", f"{root}/stream")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    if engine.manifest().checkpoint_lsn != changelog.latest_lsn(f"{root}/log"):
        raise RuntimeError("the stream did not reach the end of the log")
    return engine.view("events_view")


def _float_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ViewSpec("events_view", "public", "events", ("event_type",), (AggSpec("count", "value", "n_values"), AggSpec("sum", "value", "total_value")))
    return verify.ground_truth(v, spark.read.parquet(f"{sf_dir}/events.parquet"))


def _all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(by=("is_tenth",))
    rows = orders(spark, sf_dir).withColumn("is_tenth", F.col("id") % 10 == 0)
    return verify.ground_truth(v, rows)


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = lsn_to_text(F.col("o_orderkey") * 97_500_059)
    return o.select("o_orderkey", text.alias("lsn_text"), lsn_from_text(text).alias("lsn"))


def _live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's hidden count of rows, whose groups with none are gone."""
    v = view()
    snapshot, log = history(orders(spark, sf_dir))
    state = algebra.merge(v, algebra.backfill(v, snapshot), algebra.fold(v, ch.signed_rows(log, snapshot.schema, v.needed)))
    return state.select("status", F.col(ROWS).alias("live_rows"), F.col("revenue__sum").alias("state_sum"), F.col("revenue__nn").alias("state_nn"))


def _maintained(v: ViewSpec) -> Callable[[SparkSession, str], DataFrame]:
    """A view kept through the changes of ``history``."""
    return lambda spark, sf_dir: maintained(v, *history(orders(spark, sf_dir)))


def _follow(engine: Engine, root: str) -> None:
    """Stream the log to its end."""
    query = engine.run(f"{root}/log", f"{root}/stream")
    try:
        query.processAllAvailable()
    finally:
        engine.stop(query)
    if engine.manifest().checkpoint_lsn != changelog.latest_lsn(f"{root}/log"):
        raise RuntimeError("the stream did not reach the end of the log")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, and everything after it through the stream."""
    snapshot, log = history(orders(spark, sf_dir))
    engine, root = _engine(spark, view())
    engine.setup({TABLE: snapshot}, 50)
    changelog.append(_spread(_texts(log), rows=1000), f"{root}/log", txns_per_file=50)
    _follow(engine, root)
    return engine.view("orders_view")


def _after_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set up again on a log that was streamed before: all of it counts again, once."""
    o = orders(spark, sf_dir)
    engine, root = _engine(spark, view())
    changelog.append(_spread(_texts(change(o, 1, "I", new=_row())), rows=5000), f"{root}/log", txns_per_file=50)
    for force in (False, True):
        engine.setup({TABLE: o.limit(0)}, 0, force=force)
        _follow(engine, root)
    return engine.view("orders_view")


def _truncated_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    engine, _ = _engine(spark, view())
    engine.setup({TABLE: o}, 50)
    engine.apply(change(o.where("id % 5 = 1"), 100, "D", _row()).unionByName(_truncate(o, 200)).unionByName(change(o.where("id % 4 = 2"), 300, "I", new=_row())))
    return engine.view("orders_view")


def _empty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without rows, or with those of other tables, move the checkpoint and nothing else."""
    o = orders(spark, sf_dir)
    engine, _ = _engine(spark, view())
    engine.setup({TABLE: o}, 50)
    engine.apply(spark.createDataFrame([(90, 0, "C", None, None, None, None), (120, 0, "I", "public.other", None, {"x": "1"}, None)], ch.CHANGE_DDL))
    at = engine.manifest().checkpoint_lsn
    return engine.view("orders_view").agg(F.sum("order_count").cast("long").alias("n_orders")).withColumn("checkpoint_lsn", F.lit(at).cast("long"))


def _one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a log of two tables the reader gives out one; of the other, positions only."""
    log = _texts(change(orders(spark, sf_dir), 100, "I", new=_row()))
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    changelog.append(_spread(log.unionByName(log.withColumn("table", F.lit("public.other")))), root, txns_per_file=100)
    changelog.register(spark)
    got = spark.read.format(changelog.FORMAT).option("path", root).option("tables", TABLE).load()
    return got.where("op <> 'C'").groupBy("table", "op").agg(F.count("*").alias("n_changes"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, log = history(orders(spark, sf_dir))
    engine, _ = _engine(spark, view(name="by_status"), view(by=(), name="everything"), view(by=("priority",), name="by_priority"))
    engine.setup({TABLE: snapshot}, 50)
    engine.apply(log)
    info = engine.status()
    return spark.createDataFrame([(v, n, info["checkpoint_lsn"]) for v, n in info["views"].items()], "view string, n_rows long, checkpoint_lsn long")


def _all_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with every kind of frame: what a truncation ends, inserts, updates with an old row and an unsent value, deletes with an old row, and tables without views."""
    columns = [("id", 20), ("status", 25), ("total", 1700), ("coupon", 25), ("priority", 25)]
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        plain = lambda r: tuple(r[c] for c in COLUMNS)
        doubled = lambda r: r | {"status": "X", "total": r["total"] and 2 * r["total"]} if r["id"] % 7 == 3 else r
        out = [wire.encode(wire.Type(99, "public", "mood")), _begin(1), _relation(7, "orders", columns), wire.encode(wire.Insert(7, (-1, "lost", "1", None, None))), _commit(1)]
        out += [_begin(2), _relation(8, "other", [("x", 25)]), wire.encode(wire.Insert(8, ("y",))), wire.encode(wire.Truncate(0, (7, 8, 9999))), _commit(2), _begin(3), _commit(3)]
        for i in range(0, len(rows), 100):
            part, lsn = rows[i : i + 100], rows[i]["id"] + 10
            out += [_begin(lsn), wire.encode(wire.Origin(lsn, "o")), *[wire.encode(wire.Insert(7, plain(r))) for r in part]]
            for r in part:
                if r["id"] % 7 == 3:
                    out.append(wire.encode(wire.Update(7, plain(r), None, tuple(wire.UNCHANGED if c == "coupon" else doubled(r)[c] for c in COLUMNS))))
                if r["id"] % 11 == 5:
                    out.append(wire.encode(wire.Delete(7, plain(doubled(r)), None)))
            out.append(_commit(lsn))
        yield pa.record_batch([pa.array([rows[0]["id"]] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], names=["segment", "n", "payload"])


def _every_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    log = pgoutput.decode_log(o.mapInArrow(_all_frames, "segment long, n long, payload binary"), {TABLE: COLUMNS})
    return maintained(view(), o.limit(0), log, truncated=True)


def _planted_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verifier says of a view with a group too few, one too many and wrong cells; an average that is off by 1e-7 is right."""
    v, truth = view(), verify.ground_truth(view(), orders(spark, sf_dir))
    put = lambda c, when, value: F.when(when, value).otherwise(F.col(c)).alias(c)
    target = truth.where("status is null or status <> 'P'").select(
        "status", "order_count", put("with_coupon", F.col("status").isNull(), F.col("with_coupon") + 1), put("revenue", F.col("status") == "F", F.col("revenue") + F.lit("0.01").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"),
        (F.col("avg_order_value").cast("double") + 1e-7).alias("avg_order_value"),
    )
    extra = target.where("status = 'F'").withColumn("status", F.lit("Q"))
    return verify.differences(v, truth, target.unionByName(extra)).select("status", "problem", F.col("column").alias("column_name"))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without rows, in sums from which they were not removed."""
    v, o = view(), orders(spark, sf_dir)
    gone = ch.signed_rows(change(o.where("status = 'P'"), 100, "D", _row()), o.schema, v.needed)
    state = algebra.added(v, algebra.backfill(v, o).unionByName(algebra.fold(v, gone)))
    return verify.dead_groups(state).select("status", F.col(ROWS).alias("live_rows"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two changing tables, from what it was and the signed rows of both."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"))
    sign = lambda rows, x: rows.withColumn(algebra.SIGN, F.lit(x))
    left, right = o.where("id % 10 <> 1"), c.where("cust % 5 <> 0")
    delta = extensions.joined_changes(left, sign(o.where("id % 10 = 1"), 1).unionByName(sign(left.where("id % 11 = 5"), -1)), right, sign(c.where("cust % 5 = 0"), 1), ["cust"])
    v = ViewSpec("joined", "public", "joined", ("segment",), (AggSpec("count", None, "n_orders"), AggSpec("sum", "total", "revenue")))
    return algebra.project(v, algebra.merge(v, algebra.backfill(v, left.join(right, "cust")), algebra.fold(v, delta)))


def _extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest total by status, through inserts, updates and deletes."""
    snapshot, log = history(orders(spark, sf_dir))
    signed = ch.signed_rows(log, snapshot.schema, ("status", "total"))
    state = extensions.value_counts(snapshot.withColumn(algebra.SIGN, F.lit(1)), ["status"], "total")
    return extensions.extremes(extensions.merge_counts(state, extensions.value_counts(signed, ["status"], "total")), ["status"], "total", "lowest", "highest")


_BY_STATUS = view()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_count_star_by_status": _maintained(view(COUNT)),
    "a2_count_col_by_status": _maintained(view(COUPON)),
    "a3_sum_by_status": _maintained(view(REVENUE)),
    "a3_sum_all_null_group": _all_null,
    "a4_avg_by_status": _maintained(view(AVERAGE)),
    "a5_live_rows": _live_rows,
    "a6_multi_key": _maintained(view(by=("status", "priority"))),
    "a7_null_group_key": lambda spark, sf_dir: verify.ground_truth(_BY_STATUS, orders(spark, sf_dir)).where("status IS NULL"),
    "a8_global": _maintained(view(by=())),
    "a8_global_empty": lambda spark, sf_dir: verify.ground_truth(view(by=()), orders(spark, sf_dir).where("id < 0")),
    "a12_multi_aggregate_view": flagship,
    "a13_float_sum_events": _float_sum,
    "a15_group_cancellation": _cancelled,
    "c3_backfill_plus_stream": _streamed,
    "d1_pgoutput_decode": _decoded,
    "d7_frames_of_every_kind": _every_frame,
    "d16_positions": _positions,
    "p4_two_views_one_source": _two_views,
    "p5_unchanged_toast": _unchanged,
    "s1_stream_events": _stream_events,
    "s9_table_filter": _one_table,
    "t2_redelivery_skip": _redelivered,
    "t3_insert_stream": _insert_only,
    "t4_delete": _delete,
    "t5_update_in_group": _update_in_group,
    "t5_update_move_group": _move,
    "t6_truncate_then_insert": _truncate_insert(view()),
    "t6_truncate_global": _truncate_only,
    "t6_truncate_global_then_insert": _truncate_insert(view(by=())),
    "t7_truncate_by_engine": _truncated_by_engine,
    "t9_many_small_batches": _small_batches,
    "t10_restart_after_force": _after_force,
    "t11_empty_transactions": _empty_transactions,
    "u3_status": _status,
    "v3_verify_diff": _no_differences,
    "v4_planted_differences": _planted_differences,
    "v5_dead_groups": _dead,
    "x1_joined_tables": _joined,
    "x2_extremes": _extremes,
}
_SET = ", ".join(PARTS_SQL[a] for a in ALL)
ORACLE_SQL: dict[str, str] = {
    "a1_count_star_by_status": view_sql(view(COUNT), "f", FINAL_SQL),
    "a2_count_col_by_status": view_sql(view(COUPON), "f", FINAL_SQL),
    "a3_sum_by_status": view_sql(view(REVENUE), "f", FINAL_SQL),
    "a3_sum_all_null_group": f"WITH {ORDERS_SQL} SELECT id % 10 = 0 AS is_tenth, {_SET} FROM o GROUP BY 1",
    "a4_avg_by_status": view_sql(view(AVERAGE), "f", FINAL_SQL),
    "a5_live_rows": f"WITH {ORDERS_SQL}{FINAL_SQL} SELECT status, CAST(count(*) AS BIGINT) AS live_rows, CAST(coalesce(sum(total), 0) AS DECIMAL(38, 2)) AS state_sum, CAST(count(total) AS BIGINT) AS state_nn FROM f GROUP BY status",
    "a6_multi_key": view_sql(view(by=("status", "priority")), "f", FINAL_SQL),
    "a7_null_group_key": view_sql(_BY_STATUS) + " HAVING status IS NULL",
    "a8_global": view_sql(view(by=()), "f", FINAL_SQL),
    "a8_global_empty": view_sql(view(by=()), "o WHERE id < 0"),
    "a12_multi_aggregate_view": view_sql(_BY_STATUS, "f", FINAL_SQL),
    "a13_float_sum_events": "SELECT event_type, CAST(count(value) AS BIGINT) AS n_values, CAST(sum(CAST(CAST(value AS VARCHAR) AS DECIMAL(38, 18))) AS DECIMAL(38, 18)) AS total_value FROM events GROUP BY event_type",
    "a15_group_cancellation": view_sql(_BY_STATUS, "(SELECT * FROM o WHERE status IS DISTINCT FROM 'P')"),
    "c3_backfill_plus_stream": view_sql(_BY_STATUS, "f", FINAL_SQL),
    "d1_pgoutput_decode": view_sql(_BY_STATUS),
    "d16_positions": "SELECT o_orderkey, upper(printf('%x', (o_orderkey * 97500059) >> 32)) || '/' || upper(printf('%x', (o_orderkey * 97500059) & 4294967295)) AS lsn_text, o_orderkey * 97500059 AS lsn FROM orders",
    "p4_two_views_one_source": f"WITH {ORDERS_SQL}{FINAL_SQL} SELECT 'status' AS kind, status AS key, {_SET} FROM f GROUP BY status UNION ALL SELECT 'priority', priority, {_SET} FROM f GROUP BY priority",
    "p5_unchanged_toast": view_sql(_BY_STATUS, "(SELECT status, coupon, CASE WHEN id % 7 = 3 THEN total * 2 ELSE total END AS total FROM o)"),
    "s1_stream_events": "SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS total_value FROM events GROUP BY event_type",
    "t2_redelivery_skip": view_sql(_BY_STATUS, "f", FINAL_SQL),
    "t3_insert_stream": view_sql(_BY_STATUS),
    "t4_delete": view_sql(_BY_STATUS, "(SELECT * FROM o WHERE id % 11 <> 5)"),
    "t5_update_in_group": view_sql(_BY_STATUS, "(SELECT status, coupon, CASE WHEN id % 7 = 3 THEN total * 2 ELSE total END AS total FROM o)"),
    "t5_update_move_group": view_sql(_BY_STATUS, "(SELECT coupon, total, CASE WHEN id % 7 = 3 THEN 'X' ELSE status END AS status FROM o)"),
    "t6_truncate_then_insert": view_sql(_BY_STATUS, "(SELECT * FROM o WHERE id % 4 = 2)"),
    "t6_truncate_global": view_sql(view(by=()), "o WHERE id < 0"),
    "t6_truncate_global_then_insert": view_sql(view(by=()), "(SELECT * FROM o WHERE id % 4 = 2)"),
    "t9_many_small_batches": view_sql(_BY_STATUS, "f", FINAL_SQL),
    "d7_frames_of_every_kind": view_sql(_BY_STATUS, "f", FINAL_SQL),
    "s9_table_filter": "SELECT 'public.orders' AS \"table\", 'I' AS op, count(*) AS n_changes FROM orders",
    "t7_truncate_by_engine": view_sql(_BY_STATUS, "(SELECT * FROM o WHERE id % 4 = 2)"),
    "t10_restart_after_force": view_sql(_BY_STATUS),
    "t11_empty_transactions": "SELECT count(*) AS n_orders, CAST(120 AS BIGINT) AS checkpoint_lsn FROM orders",
    "u3_status": f"WITH {ORDERS_SQL}{FINAL_SQL} SELECT 'by_status' AS view, (SELECT count(*) FROM (SELECT DISTINCT status FROM f)) AS n_rows, CAST(300 AS BIGINT) AS checkpoint_lsn UNION ALL SELECT 'everything', 1, 300 UNION ALL SELECT 'by_priority', (SELECT count(*) FROM (SELECT DISTINCT priority FROM f)), 300",
    "v4_planted_differences": f"WITH {ORDERS_SQL} SELECT DISTINCT status, CASE WHEN status = 'P' THEN 'missing group' ELSE 'cell' END AS problem, CASE WHEN status IS NULL THEN 'with_coupon' WHEN status = 'F' THEN 'revenue' END AS column_name FROM o WHERE status IS NULL OR status IN ('P', 'F') UNION ALL SELECT 'Q', 'extra group', NULL",
    "v5_dead_groups": f"WITH {ORDERS_SQL} SELECT DISTINCT status, CAST(0 AS BIGINT) AS live_rows FROM o WHERE status = 'P'",
    "x1_joined_tables": "SELECT c_mktsegment AS segment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey % 11 = 5 AND o_orderkey % 10 <> 1) GROUP BY 1",
    "x2_extremes": f"WITH {ORDERS_SQL}{FINAL_SQL} SELECT status, CAST(min(total) AS DECIMAL(18, 2)) AS lowest, CAST(max(total) AS DECIMAL(18, 2)) AS highest FROM f WHERE total IS NOT NULL GROUP BY status",
    "v3_verify_diff": "SELECT CAST(0 AS BIGINT) AS n_differences",
}
