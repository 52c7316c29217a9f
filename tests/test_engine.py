"""The engine: exactly once through crashes, redelivery and any cut of the log; streaming; commands."""

import os
import subprocess
import sys
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tidefold import cli, queries as q
from tidefold.errors import EngineError, SchemaDriftError, SetupError
from tidefold.operators import changes as ch, verify
from tidefold.plans.spec import Config
from tidefold.sources import changelog
from tidefold.streaming.engine import Engine

VIEWS = (q.view(name="by_status"), q.view(by=(), name="everything"), q.view(by=("status", "priority"), name="by_both"))


@pytest.fixture(scope="module")
def orders(spark, sf):
    return q.orders(spark, sf).where("id < 300").cache()


def make(spark, root, at=lambda step: None):
    return Engine(spark, Config("file", VIEWS, max_txns=5), str(root), runs=3, at=at)


def final(orders):
    moved = F.col("id") % 7 == 3
    return orders.where("id % 11 <> 5").select("id", F.when(moved, "X").otherwise(F.col("status")).alias("status"), F.when(moved, F.col("total") * 2).otherwise(F.col("total")).cast("decimal(18,2)").alias("total"), "coupon", "priority")


def agree(engine, rows):
    for v in VIEWS:
        assert verify.differences(v, verify.ground_truth(v, rows), engine.view(v.name)).isEmpty(), v.name
        assert not v.group_by or verify.dead_groups(engine.state(v.name)).isEmpty()


def test_backfill_and_log_meet(spark, orders, tmp_path):
    snapshot, log = q.history(orders)
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: snapshot}, 50)
    agree(engine, snapshot)
    assert engine.apply(log).checkpoint_lsn == 300
    agree(engine, final(orders))
    number = engine.manifest().number
    assert engine.apply(log).number == number  # all of it is behind the checkpoint
    engine.store.sweep(keep=1)
    agree(engine, final(orders))
    assert engine.store.numbers() == [number]


@pytest.mark.parametrize("step", ["written", "published"])
def test_crash_at_each_step(spark, orders, tmp_path, step):
    snapshot, log = q.history(orders)
    left = [1]

    def crash(at):
        if at == step and left:
            left.pop()
            raise KeyboardInterrupt

    engine = make(spark, tmp_path / "s", crash)
    engine.setup({q.TABLE: snapshot}, 50)
    with pytest.raises(KeyboardInterrupt):
        engine.apply(log.where("end_lsn <= 200"))
    again = make(spark, tmp_path / "s")  # another process
    assert again.manifest().checkpoint_lsn == (50 if step == "written" else 200)
    again.apply(log.where("end_lsn <= 200"))
    again.apply(log)
    agree(again, final(orders))


def test_any_cut_of_the_log(spark, orders, tmp_path):
    snapshot, log = q.history(orders)
    spread = q._spread(q._texts(log), rows=60)
    changelog.append(spread, f"{tmp_path}/log", txns_per_file=2)
    files = changelog.list_log(f"{tmp_path}/log")
    assert sum(f.txns for f in files) == spread.select("end_lsn").distinct().count() and all(f.txns <= 2 for f in files)
    for most in (3, None):
        engine = make(spark, tmp_path / f"s{most}")
        engine.setup({q.TABLE: snapshot}, 50)
        engine.catch_up(f"{tmp_path}/log", max_txns=most)
        agree(engine, final(orders))
    changelog.register(spark)
    assert Counter(map(str, spark.read.format(changelog.FORMAT).option("path", f"{tmp_path}/log").load().collect())) == Counter(map(str, spread.collect()))


def test_stream_restarts_where_it_was(spark, orders, tmp_path):
    snapshot, log = q.history(orders)
    spread = q._spread(q._texts(log), rows=60)
    end = spread.agg(F.max("end_lsn")).first()[0]
    half = spread.agg(F.percentile_approx("end_lsn", 0.5)).first()[0]
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: snapshot}, 50)
    for upto in (half, end):
        changelog.append(spread.where((F.col("end_lsn") > engine.manifest().checkpoint_lsn) & (F.col("end_lsn") <= upto)), f"{tmp_path}/log", txns_per_file=3)
        query = engine.run(f"{tmp_path}/log", f"{tmp_path}/c", poll_ms=50)
        try:
            query.processAllAvailable()
            assert engine.status(f"{tmp_path}/log", query)["active"]
        finally:
            engine.stop(query)
        assert engine.manifest().checkpoint_lsn == upto
    agree(engine, final(orders))
    status = engine.status(f"{tmp_path}/log")
    assert status["lag"] == 0 and not status["active"] and status["views"]["everything"] == 1
    assert status["acknowledged_lsn"] is None or status["acknowledged_lsn"] <= end


def test_runs_are_merged_and_replaced_ones_go(spark, orders, tmp_path, monkeypatch):
    """Whatever number of runs an engine allows, they add up to the view; and nothing is left behind."""
    snapshot, log = q.history(orders)
    spread = q._texts(q._spread(log, rows=70)).cache()
    ends = sorted(r[0] for r in spread.select("end_lsn").distinct().collect())
    make(spark, tmp_path / "s").setup({q.TABLE: snapshot}, 50)
    for k, end in enumerate(ends):
        engine = Engine(spark, Config("file", VIEWS), str(tmp_path / "s"), runs=2 + k % 5)
        monkeypatch.setattr(engine.store, "RETAIN_SECONDS", 0.0)
        m = engine.apply(spread.where(F.col("end_lsn") <= end))
        assert all(len(v.runs) <= 6 for v in m.views.values()) and m.checkpoint_lsn == end
    agree(engine, final(orders))
    assert len(engine.store.numbers()) <= engine.store.KEEP
    engine.apply(q.change(orders.limit(0), end + 1, "I", new=q._row()).unionByName(q.change(orders.limit(1), end + 1, "I", new=q._row()).withColumn("table", F.lit("public.other"))))
    there = {f"{v}/{x}" for v in os.listdir(tmp_path / "s/views") for x in os.listdir(tmp_path / "s/views" / v)}
    held = {"/".join(r.path.split("/")[-2:]) for v in engine.manifest().views.values() for r in v.runs}
    assert there - held <= {"/".join(p.split("/")[-2:]) for p, _ in engine.manifest().retired}


def test_a_group_with_fewer_rows_than_none_raises(spark, orders, tmp_path):
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: orders.limit(0)}, 5)
    engine.apply(q.change(orders.where("id = 1"), 10, "D", q._row()))
    with pytest.raises(Exception, match="fewer rows than none"):
        engine.view("by_status").collect()


def streamed(engine, log, checkpoint):
    query = engine.run(log, checkpoint, poll_ms=50)
    try:
        query.processAllAvailable()
    finally:
        engine.stop(query)


def test_setup_again_streams_the_log_again(spark, orders, tmp_path):
    """The stream's own checkpoint from before ``force`` or teardown is not gone on from."""
    log, stream = f"{tmp_path}/log", f"{tmp_path}/c"
    changelog.append(q._spread(q._texts(q.change(orders, 1, "I", new=q._row())), rows=20), log, txns_per_file=3)
    other = spark.createDataFrame([(10**10, 0, "I", "public.other", None, {"x": "1"}, None)], ch.CHANGE_DDL)
    changelog.append(other, log)
    for again in (None, "force", "teardown"):
        engine = make(spark, tmp_path / "s")
        if again == "teardown":
            engine.teardown()
        engine.setup({q.TABLE: orders.limit(0)}, 0, force=again == "force")
        streamed(engine, log, stream)
        assert engine.manifest().checkpoint_lsn == 10**10 == changelog.latest_lsn(log) and engine.barrier(log, 1)
        agree(engine, orders)
        assert engine.verify({q.TABLE: orders}).isEmpty() and not engine.verify({q.TABLE: orders.where("id > 9")}).isEmpty()
    assert len(os.listdir(stream)) == 1
    assert not [f for f in changelog.list_log(log, changelog.acknowledged(log) or 0)] or changelog.acknowledged(log) < 10**10


def test_position_is_that_of_the_tables():
    ends = iter([3, 4, 4, 4])
    assert cli._consistent(lambda: "tables", lambda: next(ends)) == ("tables", 4)
    moving = iter(range(100))
    with pytest.raises(SetupError, match="stand still"):
        cli._consistent(lambda: "tables", lambda: next(moving))


def test_transactions_without_rows_move_the_checkpoint(spark, orders, tmp_path):
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: orders}, 5)
    empty = spark.createDataFrame([(9, 0, "C", None, None, None, None), (12, 0, "I", "public.other", None, {"x": "1"}, None)], ch.CHANGE_DDL)
    before = engine.manifest().views
    assert engine.apply(empty).checkpoint_lsn == 12 and engine.manifest().views == before
    assert engine.apply(empty.limit(0)).checkpoint_lsn == 12


def test_truncate(spark, orders, tmp_path):
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: orders}, 5)
    engine.apply(q._truncate(orders, 10))
    assert engine.view("by_status").isEmpty() and [tuple(r) for r in engine.view("everything").collect()] == [(0, 0, None, None)]
    few = orders.where("id < 20")
    engine.apply(q.change(few, 20, "I", new=q._row()).unionByName(q._truncate(orders, 15)))
    agree(engine, few)


def test_resync_and_metrics(spark, orders, tmp_path):
    engine = make(spark, tmp_path / "s")
    engine.setup({q.TABLE: orders.where("id < 100")}, 5)
    engine.resync("by_status", orders)
    v = VIEWS[0]
    assert verify.differences(v, verify.ground_truth(v, orders), engine.view("by_status")).isEmpty()
    assert engine.manifest().checkpoint_lsn == 5 and engine.view("everything").first()["order_count"] == 100
    assert 'tidefold_view_rows{slot="tidefold",view="everything"} 1' in engine.metrics()


def test_setup_rules(spark, orders, tmp_path):
    engine = make(spark, tmp_path / "s")
    with pytest.raises(EngineError, match="setup"):
        engine.manifest()
    with pytest.raises(SetupError, match="no source"):
        engine.setup({}, 0)
    with pytest.raises(SetupError, match="no column"):
        engine.setup({q.TABLE: orders.drop("total")}, 0)
    engine.setup({q.TABLE: orders}, 0)
    with pytest.raises(SetupError, match="already"):
        engine.setup({q.TABLE: orders}, 0)
    engine.setup({q.TABLE: orders.limit(0)}, 7, force=True)
    assert engine.manifest().checkpoint_lsn == 7 and engine.view("by_status").isEmpty()
    with pytest.raises(SchemaDriftError):
        engine.apply(q.change(orders, 9, "I", new=q._row()).withColumn("new", F.col("new").dropFields("total")))
    with pytest.raises(EngineError, match="another engine"):
        engine.store.publish(engine.manifest())
    engine.teardown()
    assert not os.path.exists(tmp_path / "s") and engine.status()["checkpoint_lsn"] is None


CONFIG = """
database: {dsn: file}
views:
  - name: by_status
    source: orders
    group_by: [status]
    aggregates: [{fn: count, as: n}, {fn: sum, column: total, as: revenue}]
"""


def test_commands(spark, orders, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(CONFIG)
    orders.write.parquet(f"{tmp_path}/t/orders.parquet")
    base = ["-c", f"{tmp_path}/c.yaml", "--root", f"{tmp_path}/s"]
    assert cli.main(["status", *base]) == 0 and "absent" in capsys.readouterr().out
    assert cli.main(["setup", *base, "--tables", f"{tmp_path}/nowhere"]) == 1 and "error: no table" in capsys.readouterr().err
    assert cli.main(["setup", *base, "--tables", f"{tmp_path}/t"]) == 0 and "next:" in capsys.readouterr().out
    assert cli.main(["setup", *base, "--tables", f"{tmp_path}/t"]) == 1
    capsys.readouterr()
    assert cli.main(["status", *base]) == 0
    assert "by_status: " in (out := capsys.readouterr().out) and "inactive" in out
    assert cli.main(["teardown", *base]) == 2 and cli.main(["teardown", *base, "--yes"]) == 0
    assert cli.main(["status", "-c", f"{tmp_path}/none", "--root", "x"]) == 1
    with pytest.raises(SystemExit):
        cli.main([])


def test_module_runs():
    out = subprocess.run([sys.executable, "-m", "tidefold", "--version"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.returncode == 0 and out.stdout.startswith("tidefold ")


def test_money_stays_exact(spark, tmp_path):
    v = q.view()
    rows = spark.createDataFrame([(1, "a", D("0.10"), None, "p"), (2, "a", D("0.20"), None, "p")], "id long, status string, total decimal(18,2), coupon string, priority string")
    assert verify.ground_truth(v, rows).first()["revenue"] == D("0.30")
