"""The algebra: states, folds, merges, and what users see."""

from collections import Counter
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.errors import SchemaDriftError, SetupError
from tidefold.operators import algebra, changes as ch, verify
from tidefold.plans.spec import ROWS, AggSpec, ViewSpec

AGGREGATES = (AggSpec("count", None, "n"), AggSpec("count", "coupon", "with_coupon"), AggSpec("sum", "total", "revenue"), AggSpec("avg", "total", "mean"))
VIEW, GLOBAL = ViewSpec("v", "public", "orders", ("status",), AGGREGATES), ViewSpec("g", "public", "orders", (), AGGREGATES)
SCHEMA = T.StructType().add("status", "string").add("total", T.DecimalType(10, 2)).add("coupon", "string")
LOG = T.StructType().add("end_lsn", "long").add("seq", "integer").add("op", "string").add("table", "string").add("old", SCHEMA).add("new", SCHEMA).add("unchanged", T.ArrayType(T.StringType()))
A, B = ("paid", D("10.50"), "x"), ("paid", None, None)


def log(spark, *rows):
    full = [(r[0], r[1], r[2], "public.orders", r[3], r[4], r[5] if len(r) > 5 else None) for r in rows]
    return spark.createDataFrame(full, LOG)


def folded(spark, changes, view=VIEW, truncated=False):
    cut = ch.last_truncate(changes) if truncated else None
    return {r[0] if view.group_by else None: tuple(r)[len(view.group_by) :] for r in algebra.fold(view, ch.signed_rows(changes, SCHEMA, view.needed, cut)).collect()}


@pytest.mark.parametrize(
    "changes,expected",
    [
        ([(1, 0, "I", None, A), (1, 1, "I", None, B)], {"paid": (2, 1, D("10.50"), 1, D("10.50"), 1)}),
        ([(1, 0, "D", ("paid", D("4.20"), "c"), None)], {"paid": (-1, -1, D("-4.20"), -1, D("-4.20"), -1)}),
        ([(1, 0, "U", ("paid", D(10), None), ("shipped", D(10), None))], {"paid": (-1, 0, D(-10), -1, D(-10), -1), "shipped": (1, 0, D(10), 1, D(10), 1)}),
        ([(1, 0, "U", ("paid", D(10), None), ("paid", D("12.5"), None))], {"paid": (0, 0, D("2.5"), 0, D("2.5"), 0)}),
        ([(1, 0, "I", None, (None, D(1), None)), (1, 1, "I", None, (None, D(2), None))], {None: (2, 0, D(3), 2, D(3), 2)}),
        ([(1, 0, "I", None, A), (2, 0, "D", A, None)], {"paid": (0, 0, D(0), 0, D(0), 0)}),
    ],
)
def test_deltas(spark, changes, expected):
    got = folded(spark, log(spark, *changes))
    assert {k: (v[0], v[2], *v[3:]) for k, v in got.items()} == expected and all(v[0] == v[1] for v in got.values())


def test_truncation_discards_what_was_before(spark):
    changes = log(spark, (1, 0, "I", None, ("pending", D(99), None)), (1, 1, "T", None, None), (1, 2, "I", None, ("paid", D(5), None)))
    assert ch.last_truncate(changes) == (1, 1) and set(folded(spark, changes, truncated=True)) == {"paid"}
    state = algebra.merge(GLOBAL, algebra.empty_state(spark, GLOBAL, SCHEMA), algebra.fold(GLOBAL, ch.signed_rows(log(spark, (1, 0, "I", None, A), (2, 0, "T", None, None)), SCHEMA, GLOBAL.needed, (2, 0))))
    assert [tuple(r) for r in algebra.project(GLOBAL, state).collect()] == [(0, 0, None, None)]


def test_unchanged_values_are_the_old_ones(spark):
    changes = log(spark, (1, 0, "U", ("paid", D(1), "kept"), ("shipped", D(2), None), ["coupon"]))
    assert {k: v[2] for k, v in folded(spark, changes).items()} == {"paid": -1, "shipped": 1}
    texts = spark.createDataFrame([(1, 0, "U", "public.orders", {"status": "a", "total": "1.25", "coupon": "k"}, {"status": "a", "total": "2.50"}, ["coupon"])], ch.CHANGE_DDL)
    assert folded(spark, texts)["a"][3] == D("1.25")


def test_group_lifecycle(spark):
    rows = spark.createDataFrame([A, B, (None, D(1), None)], SCHEMA)
    state = algebra.backfill(VIEW, rows)
    gone = algebra.merge(VIEW, state, algebra.fold(VIEW, ch.signed_rows(log(spark, (1, 0, "D", A, None), (1, 1, "D", B, None)), SCHEMA, VIEW.needed)))
    assert [r["status"] for r in gone.collect()] == [None] and verify.dead_groups(gone).isEmpty()
    with pytest.raises(Exception, match="fewer rows"):
        algebra.merge(VIEW, gone, algebra.fold(VIEW, ch.signed_rows(log(spark, (1, 0, "D", A, None)), SCHEMA, VIEW.needed))).collect()
    assert gone.schema == state.schema == algebra.empty_state(spark, VIEW, SCHEMA).schema or [f.dataType for f in gone.schema] == [f.dataType for f in algebra.state_schema(VIEW, SCHEMA)]


def test_exact_sums(spark):
    v = ViewSpec("v", "public", "t", (), (AggSpec("sum", "x", "s"),))
    assert algebra.project(v, algebra.backfill(v, spark.createDataFrame([(0.1,), (0.2,), (1e16,), (1.0,), (-1e16,)], "x double"))).first()["s"] == D("1.3")
    assert algebra.project(v, algebra.backfill(v, spark.createDataFrame([(0.1,), (0.2,)], "x float"))).first()["s"] == D("0.3")
    assert algebra.project(v, algebra.backfill(v, spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x long"))).first()["s"] == 3 * 2**62
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="not finite"):
            algebra.backfill(v, spark.createDataFrame([(bad,)], "x double")).collect()


def test_sources_are_checked(spark):
    with pytest.raises(SchemaDriftError):
        algebra.backfill(VIEW, spark.createDataFrame([], "status string"))
    for kind in ("string", "boolean", "timestamp"):
        with pytest.raises(SetupError):
            algebra.backfill(VIEW, spark.createDataFrame([], f"status string, coupon string, total {kind}"))
    with pytest.raises(SchemaDriftError):
        ch.signed_rows(log(spark), SCHEMA, ("absent",))


@pytest.mark.parametrize("row,match", [((1, 0, "U", None, A), "old row"), ((1, 0, "D", None, None), "old row"), ((1, 0, "I", None, A, ["total"]), "lacks the column")])
def test_rows_that_lack_values_halt(spark, row, match):
    with pytest.raises(Exception, match=match):
        ch.signed_rows(log(spark, row), SCHEMA, VIEW.needed).collect()


def test_texts_that_lack_columns_or_are_no_numbers_halt(spark):
    for new in ({"status": "a", "coupon": None}, {"status": "a", "coupon": None, "total": "x"}):
        with pytest.raises(Exception, match="lacks the column|CAST_INVALID"):
            ch.signed_rows(spark.createDataFrame([(1, 0, "I", "public.orders", None, new, None)], ch.CHANGE_DDL), SCHEMA, VIEW.needed).collect()


def test_verifier_sees_every_kind_of_difference(spark):
    truth = verify.ground_truth(VIEW, spark.createDataFrame([A, B, (None, D(1), None), ("z", D(3), None)], SCHEMA))
    assert verify.differences(VIEW, truth, truth).isEmpty()
    wrong = truth.where("status IS DISTINCT FROM 'z'").withColumn("n", F.when(F.col("status").isNull(), F.col("n") + 1).otherwise(F.col("n"))).withColumn("mean", F.col("mean") + F.lit(D("0.0000005"))).unionByName(truth.where("status = 'z'").withColumn("status", F.lit("new")))
    got = Counter((r["problem"], r["column"], r["status"]) for r in verify.differences(VIEW, truth, wrong).collect())
    assert got == Counter({("missing group", None, "z"): 1, ("extra group", None, "new"): 1, ("cell", "n", None): 1})
    g = verify.ground_truth(GLOBAL, spark.createDataFrame([A], SCHEMA))
    assert verify.differences(GLOBAL, g, g).isEmpty() and verify.differences(GLOBAL, g, g.limit(0)).count() == 1
    assert [r["status"] for r in verify.in_order(VIEW, truth).collect()] == [None, "paid", "z"]


OPS = st.lists(st.tuples(st.sampled_from("IIIUDT"), st.integers(0, 9), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-500, 500)), st.sampled_from(["c", None])), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(OPS, st.integers(1, 24))
def test_any_history_equals_a_fresh_aggregation(spark, ops, split):
    """A random log, applied in two batches, gives what the replayed table gives."""
    table, rows = {}, []
    for lsn, (op, key, status, cents, coupon) in enumerate(ops, 1):
        new = (status, None if cents is None else D(cents) / 100, coupon)
        if op == "T":
            table.clear()
            rows.append((lsn, 0, "T", None, None))
        elif op == "D":
            if key in table:
                rows.append((lsn, 0, "D", table.pop(key), None))
        else:
            rows.append((lsn, 0, "U" if key in table else "I", table.get(key), new))
            table[key] = new
    state = {v: algebra.empty_state(spark, v, SCHEMA) for v in (VIEW, GLOBAL)}
    for part in ([r for r in rows if r[0] < split], [r for r in rows if r[0] >= split]):
        changes = log(spark, *part)
        cut = ch.last_truncate(changes)
        for v in state:
            base = algebra.empty_state(spark, v, SCHEMA) if cut else state[v]
            state[v] = algebra.merge(v, base, algebra.fold(v, ch.signed_rows(changes, SCHEMA, v.needed, cut)))
    for v, s in state.items():
        fresh = verify.ground_truth(v, spark.createDataFrame(list(table.values()), SCHEMA))
        assert Counter(map(tuple, algebra.project(v, s).collect())) == Counter(map(tuple, fresh.collect()))
        assert v is GLOBAL or s.where(F.col(ROWS) <= 0).isEmpty()
