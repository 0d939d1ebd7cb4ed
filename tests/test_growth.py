"""Steps whose cost a larger table multiplies: each is done once and in few shuffles, with the same results."""

import random

from pyspark.sql import functions as F

from svloom.functions import flags as fl
from svloom.operators import links
from svloom.options import Options
from svloom.plans import queries as q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merging_inversions_names_the_class_once(spark):
    cls = fl.merged_inversions(F.col("id"))
    got = spark.range(11).select(cls.alias("x"))
    assert plan(got).split("\n")[0].count("id#") == 1
    assert [r["x"] for r in got.collect()] == [fl.FF if k == fl.RR else k for k in range(11)]


def test_statistics_come_from_one_pass(spark):
    a = q.analysis(spark, SF, True)
    assert not any("orders" in plan(x) for x in (a.hist, a.files, a.covered, a.density))


def test_islands_know_their_first_and_last_reads(spark):
    a = q.analysis(spark, SF)
    rows = a.anomalous.select("tid", "pos", "rev", "qname", "mate", "island", "opens", "closes").collect()
    rows.sort(key=lambda r: tuple(r)[:5])
    at = [r["island"] for r in rows]
    assert [r["opens"] for r in rows] == [i == 0 or at[i - 1] != x for i, x in enumerate(at)]
    assert [r["closes"] for r in rows] == [i + 1 == len(at) or at[i + 1] != x for i, x in enumerate(at)]
    assert "orders" not in plan(a.anomalous)


def test_batches_of_regions_are_walked_many_a_task(spark):
    rng = random.Random(3)
    rows = sorted({(a, a + rng.randrange(9)) for a in (rng.randrange(200) for _ in range(700))})
    edge = spark.createDataFrame([(*r, 2) for r in rows], "a long, b long, weight long")
    order = lambda df: sorted(map(tuple, df.collect()))
    whole = links.visit_order(edge, Options(buffer=4))
    assert "MapInPandas" in whole._jdf.queryExecution().executedPlan().toString()
    want = order(whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert order(links.visit_order(edge, Options(buffer=4))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    few = order(links.visit_order(edge.where("b < 15"), Options(buffer=4)))
    assert len({r[0] for r in want}) > 30 and few == [r for r in want if r[0] < 3]


def test_estimator_sorts_only_what_its_stops_can_need(spark):
    from svloom.operators import estimate

    d = q.legacy(spark, SF)
    good = d.where((F.col("bdqual") > 35) & F.col("lib").isNotNull())
    rows = sorted((r["bam_file"], r["lib"], r["tid"], r["pos"]) for r in good.collect())
    for most in (50, 10**6):
        got = sorted((r["bam_file"], r["lib"], r["tid"], r["pos"]) for r in good.where(estimate._reach(good, most)).collect())
        want = []
        for key in sorted({r[:2] for r in rows}):
            own = [r for r in rows if r[:2] == key]
            want += [r for r in own if len(own) < most or r <= own[most - 1]]
        assert got == want and (len(got) < len(rows)) == (most == 50)
