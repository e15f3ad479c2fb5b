"""Closures over long chains."""

from codexlake.operators.joins import closure


def test_closure_has_no_bound(spark):
    rows = [(f"t{i}", f"t{i + 1}") for i in range(45)] + [("t45", "t0"), ("other", "t0")]
    edges = spark.createDataFrame(rows, "caller string, callee string").coalesce(1)
    start = spark.createDataFrame([("t0",)], "name string")
    assert sorted(r.name for r in closure(edges, start).collect()) == sorted(f"t{i}" for i in range(46))
