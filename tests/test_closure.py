import pytest

from factloom.operators import graph


def test_closure_has_no_silent_bound(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    want = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.id: r.depth for r in graph.closure(links, seeds).collect()} == want
    assert graph.closure.__kwdefaults__["most_rounds"] is None
    assert graph.closure(links, seeds, most_rounds=3).count() == 4
    with pytest.raises(ValueError, match="further than 2"):
        graph.closure(links, seeds, most_rounds=2)
