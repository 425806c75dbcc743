"""Shared-folder tables and size-checked broadcasts."""

from folioform import session


def test_materialize_and_release(spark):
    t = session.materialize(spark.range(5), "t")
    assert t.count() == 5 and "Scan parquet" in t._jdf.queryExecution().toString()
    assert session.release(spark) >= 1 and session.release(spark) == 0


def test_broadcast_only_if_small(spark):
    big, small = spark.range(100), spark.range(3)
    plan = lambda x: big.join(session.broadcast_if_small(x, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small) and "strategy=broadcast" not in plan(big)


def test_broadcast_only_if_few_bytes(spark):
    wide = spark.range(5).selectExpr("id", "repeat('x', 1000) AS t")
    plan = lambda size: spark.range(9).join(session.broadcast_if_small(wide, 10, size), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10_000) and "strategy=broadcast" not in plan(4_000)


def test_scratch_deletes_its_own_tables_only(spark):
    kept = session.materialize(spark.range(2), "kept")
    with session.scratch(spark):
        gone = session.materialize(spark.range(3), "gone")
        assert gone.count() == 3
    assert kept.count() == 2
    path = gone.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    import os

    assert not os.path.exists(path) and session.release(spark) >= 1
