import pytest

from siltstone.llm import components as module
from siltstone.llm.components import components


def test_rounds_that_end_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0} and components(edges).count() == 301
    with pytest.raises(RuntimeError, match="not complete"):
        components(edges, rounds=2)


def test_stars_end_the_rounds(spark, monkeypatch):
    tables, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, *a, **k: tables.append(1) or write(df, *a, **k))
    for edges, most in (([(5, 1), (9, 1), (7, 2), (2, 7), (4, 4)], 1), ([(5, 1), (5, 2), (8, 5), (12, 11)], 3)):  # 5 tables for the first before
        tables.clear()
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = {5: 1, 9: 1, 7: 2, 1: 1, 2: 2} if most == 1 else {1: 1, 2: 1, 5: 1, 8: 1, 12: 11, 11: 11}
        assert got == want and len(tables) <= most
