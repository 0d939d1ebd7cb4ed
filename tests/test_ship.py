"""Tables written on the way to a settled one are removed."""

from pathlib import Path

import pytest
from svloom.ship import removed, settled, shared_dir, written


def tables(spark):
    return {p.name for p in (Path(shared_dir(spark)) / "svloom").glob("settle-*")}


def test_tables_on_the_way_are_removed(spark):
    outside = written(spark.range(3), "settle-outside")
    before = tables(spark)

    def inner():
        return written(spark.range(5), "settle-a").where("id > 1")

    def outer():
        low, path = settled(spark, inner, "settle-b")
        assert {p.split("/")[-1] for p in [path]} == tables(spark) - before
        return low.join(written(outside, "settle-c"), "id")

    out, path = settled(spark, outer, "settle-d")
    assert [r["id"] for r in out.collect()] == [2] and outside.count() == 3
    assert tables(spark) - before == {path.split("/")[-1]}
    removed(spark, [path, path])
    assert tables(spark) == before


def test_a_failure_leaves_nothing(spark):
    before = tables(spark)

    def fails():
        return written(spark.range(5), "settle-a").selectExpr("assert_true(id < 3) as x")

    with pytest.raises(Exception, match="is not true"):
        settled(spark, fails, "settle-b")
    assert tables(spark) == before
    assert written(spark.range(1), "settle-e").count() == 1
