"""Printed rows: precision that follows the visiting order, as in the published table; numbers of the header."""

from pyspark.sql import functions as F

from svloom import sinks
from svloom.options import Options

CALLS = "flush long, rank long, tid1 int, pos1 long, fwd1 long, rev1 long, tid2 int, pos2 long, fwd2 long, rev2 long, type string, size long, score int, num_reads long, support array<struct<key:string,reads:long>>, copy_number map<string,double>, allele_frequency double"


def rows(spark):
    # copy numbers and frequencies of the published calls, then rows between contigs and of other sizes
    own = [
        (0, 0, 29185056, 23, 2, 29185377, 23, 2, "INS", -226, 2, [("a", 1), ("b", 1)], {}, None),
        (0, 1, 29185462, 23, 2, 29186122, 2, 22, "DEL", 545, 21, [("a", 21)], {"a": 176.5796, "b": 167.8911}, -85.11768),
        (1, 0, 34808937, 8, 6, 34809799, 3, 4, "INV", 737, 2, [("b", 2)], {"a": 847.39, "b": 878.83}, -430.553),
        (2, 0, 5, 1, 1, 9, 1, 1, "CTX", 0, 2, [("a", 2)], {"a": 1.0}, 0.5),
    ]
    return spark.createDataFrame([(f, r, 0, p, a, b, 0, q, d, e, t, n, 99, k, s, m, x) for f, r, p, a, b, q, d, e, t, n, k, s, m, x in own], CALLS)


def test_precision_follows_the_visiting_order(spark):
    contigs = spark.createDataFrame([(0, "21")], "tid int, contig string")
    get = lambda **o: [r["value"] for r in sinks.call_lines(rows(spark).repartition(3), contigs, ["a", "b"], Options(allele_frequency=True, **o)).orderBy("flush", "rank").collect()]
    assert get() == [
        "21\t29185056\t23+2-\t21\t29185377\t23+2-\tINS\t-226\t99\t2\ta|1:b|1\tNA\tNA\tNA",
        "21\t29185462\t23+2-\t21\t29186122\t2+22-\tDEL\t545\t99\t21\ta|21\t-85.1177\t176.58\t167.89",
        "21\t34808937\t8+6-\t21\t34809799\t3+4-\tINV\t737\t99\t2\tb|2\t-430.55\t847.39\t878.83",
        "21\t5\t1+1-\t21\t9\t1+1-\tCTX\t0\t99\t2\ta|2\t0.50",
    ]
    # by library no copy number is printed by file: all frequencies keep six digits
    assert [x.split("\t")[-1] for x in get(per_library=True)] == ["NA", "-85.1177", "-430.553", "0.5"]


def test_general_numbers(spark):
    d = spark.createDataFrame([(x,) for x in (475.76, 90.0, 525.5, 0.0410481123, 0.108495, 1e-5, 1234567.0, 0.0, -0.25, 100000.0, 1.5e-7)], "x double")
    assert [r[0] for r in d.select(sinks.general(F.col("x"))).collect()] == ["475.76", "90", "525.5", "0.0410481", "0.108495", "1e-05", "1.23457e+06", "0", "-0.25", "100000", "1.5e-07"]
