"""What keeps the driver small: its garbage and what its threads have freed are given back between tables, and during long ones;
it builds no large broadcasts, whatever the session allows."""

import time

import pytest

from parcelyze import tables


def test_the_native_heap_is_trimmed_after_a_table(spark, monkeypatch):
    """Some 30 tables of a dry run left the driver's threads 150 MB and more that were free, but not given back."""
    done = []
    real = tables._trim
    monkeypatch.setattr(tables, "_trim", lambda jvm: done.append(real(jvm)))  # appends only what did not fail
    assert tables.written(spark.range(3), "t").count() == 3
    assert done


def test_the_driver_is_tidied_while_a_table_is_written(spark, monkeypatch):
    """A table of a million parcels takes minutes, in which its tasks' events fill the heap."""
    called = []
    monkeypatch.setattr(tables, "_tidy", lambda session: called.append(session))
    with tables._tidied(spark, 0.05):
        time.sleep(0.5)
    assert len(called) > 2
    n = len(called)
    time.sleep(0.3)
    assert len(called) == n


@pytest.mark.parametrize("key", ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"])
def test_a_written_join_is_not_broadcast_by_estimate(spark, key):
    """With Spark's usual 10 MB the driver could not build the broadcasts of a dry run over 1,200,000 parcels in its 750 MB."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", key)}
    a, b = (tables.written(spark.range(200_000).selectExpr("id * 7 % 1000003 as k", f"id as {n}"), n) for n in "ab")
    store = spark._jsparkSession.sharedState().statusStore()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
        spark.conf.set(key, "10m")
        joined = tables.written(a.join(b, "k"), "joined")
        done = store.executionsList()
        plan = done.apply(done.size() - 1).physicalPlanDescription()
        assert spark.conf.get(key) == "10m"
    finally:
        for k, text in before.items():
            spark.conf.unset(k) if text is None else spark.conf.set(k, text)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert joined.count() == 200_000
