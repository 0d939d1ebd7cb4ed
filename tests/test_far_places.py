"""Places beyond 32 bits: the same rows as nearer ones, moved."""

import re

import pytest
from pyspark.sql import functions as F

from svloom.plans import queries as q

SF = "/root/testdata/sf0.001"
#: Customers' shift that keeps contigs and kinds of fragments, and bases by which it moves them.
SHIFT = 3_600_000
BASES = SHIFT // 5 * 3000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("far")
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_custkey", F.col("o_custkey") + SHIFT).write.parquet(f"{path}/orders.parquet")
    return str(path)


def moved(value: str, *fields: int) -> str:
    cells = value.split("\t")
    for k in fields:
        cells[k] = str(int(cells[k]) + BASES)
    return "\t".join(cells)


def test_calls(spark, far):
    near = [r.asDict(recursive=True) for r in q.sv_calls(spark, SF).collect()]
    got = [r.asDict(recursive=True) for r in q.sv_calls(spark, far).collect()]
    want = [{**r, "pos1": r["pos1"] + BASES, "pos2": r["pos2"] + BASES} for r in near]
    order = lambda rows: sorted(rows, key=lambda r: (r["flush"], r["rank"]))
    assert len(want) > 20 and BASES > 1 << 31 and order(got) == order(want)


def test_call_text(spark, far):
    near, got = (sorted((r["flush"], r["rank"], r["value"]) for r in q.s9_p10_p12_call_text(spark, sf).collect()) for sf in (SF, far))
    assert len(got) > 20 and got == [(*k, moved(v, 1, 4)) for *k, v in near]


def test_bed_text(spark, far):
    near, got = ([tuple(r) for r in q.s10_bed_text(spark, sf).collect()] for sf in (SF, far))
    at = lambda m: m[1] + str(int(m[2]) + BASES) + m[3]
    track = lambda v: re.sub(r"( chr\d )(\d+)( )", at, re.sub(r"(=chr\d_)(\d+)(_)", at, v))
    want = [(a, b, no, track(v) if no == "0" else moved(v, 1, 2, 6, 7)) for a, b, no, v in near]
    assert len(got) > 100 and {no[0] for _, _, no, _ in got} == {"0", "1"} and sorted(got) == sorted(want)


def test_a_column_of_32_bits_holds_no_place_beyond_them(spark, far):
    assert dict(q.s4_pooled_reads(spark, SF).dtypes)["pos"] == "int"
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        q.s4_pooled_reads(spark, far).collect()
