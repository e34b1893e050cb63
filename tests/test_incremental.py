from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.operators import incremental as inc


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40))), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40))))
@settings(max_examples=150, deadline=None)
def test_interval_algebra(a, b):
    def points(parts):
        return {x for lo, hi in parts for x in range(lo, hi + 1)}

    assert points(inc.merge(a)) == points(a)
    assert points(inc.subtract(a, b)) == points(a) - points(b)
    m = inc.merge(a)
    assert all(x[1] + 1 < y[0] for x, y in zip(m, m[1:]))


def test_islands_cross_blocks(spark):
    edge = 1 << inc.SHIFT
    rows = spark.createDataFrame([(x,) for x in [1, 2, 3, 3, 7, edge - 1, edge, edge + 1, None]], "s bigint")
    assert sorted((r["lo"], r["hi"]) for r in inc.islands(rows, "s").collect()) == [(1, 3), (7, 7), (edge - 1, edge + 1)]


def _intervals(ledger):
    return sorted((r["lo"], r["hi"]) for r in ledger.intervals().collect())


def test_ledger_late_rows_and_failures(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    edge = 1 << inc.SHIFT
    source = lambda xs: spark.createDataFrame([(x, f"v{x}") for x in xs], "seq bigint, v string")
    first = ledger.run(source([1, 2, 5]), "seq", lambda df: df)
    assert sorted(r["seq"] for r in first.collect()) == [1, 2, 5]
    later = [1, 2, 3, 5, 6, edge - 1, edge, None]
    with pytest.raises(ZeroDivisionError):
        ledger.run(source(later), "seq", lambda df: 1 / 0)
    again = ledger.run(source(later), "seq", lambda df: df)
    assert sorted(r["seq"] for r in again.collect()) == [3, 6, edge - 1, edge]
    assert _intervals(ledger) == [(1, 3), (5, 6), (edge - 1, edge)]
    assert ledger.run(source(later), "seq", lambda df: df).count() == 0
    assert sorted(r["seq"] for r in ledger.output().collect()) == [1, 2, 3, 5, 6, edge - 1, edge]


def test_a_crash_between_output_and_commit(spark, tmp_path, monkeypatch):
    """Output and intervals are on disk, the manifest is not: the next run finds the same gaps, and nothing comes twice."""
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/crash")
    source = spark.createDataFrame([(x,) for x in [1, 2, 4]], "seq bigint")

    def crash(body):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger, "_publish", crash)
        with pytest.raises(OSError):
            ledger.run(source, "seq", lambda df: df)
    assert ledger.output() is None and ledger.state()["n"] == 0
    assert sorted(r["seq"] for r in ledger.run(source, "seq", lambda df: df).collect()) == [1, 2, 4]
    assert sorted(r["seq"] for r in ledger.output().collect()) == [1, 2, 4]


def test_a_commit_is_made_once(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/l2")
    ledger._publish({"n": 1, "intervals": None, "outputs": ["a"]})
    with pytest.raises(RuntimeError):
        ledger._publish({"n": 1, "intervals": None, "outputs": ["b"]})
    assert ledger.state()["outputs"] == ["a"]


def test_placed(spark):
    parts = spark.createDataFrame([(0, 2, 4, "x"), (0, 7, 7, "y"), (1, 1 << inc.SHIFT, (1 << inc.SHIFT) + 1, "z")], inc.INTERVALS + ", r string")
    rows = spark.createDataFrame([(x, "k") for x in [1, 2, 4, 5, 7, 8, (1 << inc.SHIFT) + 1, 4, None]], "seq bigint, lo string")
    got = sorted((r["seq"], r["part"]["r"]) for r in inc.placed(rows, "seq", parts).collect() if r["part"])
    assert got == [(2, "x"), (4, "x"), (4, "x"), (7, "y"), ((1 << inc.SHIFT) + 1, "z")]


D = lambda m, d=1: datetime(2025, m, d)


def test_replay(spark):
    runs = spark.createDataFrame([(1, D(2), "success"), (2, D(3), " Failed"), (3, D(4), "SUCCESS "), (4, D(6), "success"), (5, None, "success")], "run_no int, started_at timestamp_ntz, status string")
    rows = [
        ("a", 1, D(1), "x"), ("a", 2, D(3, 5), "x"), ("b", 3, D(1), "x"), ("b", 4, D(3, 5), "y"), ("b", 5, D(3, 6), "x"), ("c", 6, D(2, 5), "n"), ("c", 6, D(2, 5), "n"), ("d", 7, D(1), "x"), ("d", 8, D(3, 5), None), ("d", 9, D(5), "x"),
        ("e", 10, D(4), "at the start"), ("f", 11, D(3, 5), "one"), ("f", 12, D(3, 5), "two"), (None, 13, D(3), "x"), ("g", 14, None, "x"), ("h", 15, D(9), "x"),
    ]
    df = spark.createDataFrame(rows, "k string, s bigint, at timestamp_ntz, content string").withColumn("r", F.lit(1))
    got = sorted((r["run_no"], r["rec_key"]) for r in inc.replay(df, runs, "k", "s", "at", F.col("content")).collect())
    assert got == [(3, "c"), (3, "f"), (4, "d"), (4, "e")]
    led = sorted((r["run_no"], r["lo"], r["hi"]) for r in inc.run_ledger(df, runs, "s", "at").collect())
    assert led == [(1, 1, 1), (1, 3, 3), (1, 7, 7), (3, 2, 2), (3, 4, 6), (3, 8, 8), (3, 11, 13), (4, 9, 10)]


def test_no_runs(spark):
    runs = spark.createDataFrame([], "run_no int, started_at timestamp_ntz, status string")
    df = spark.createDataFrame([("a", 1, D(1), "x")], "k string, s bigint, at timestamp_ntz, content string")
    assert inc.replay(df, runs, "k", "s", "at", F.col("content")).count() == 0
