"""Stateful stream operators against the batch operators: several batches, a restart, state that shrinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from svloom.operators import links, regions
from svloom.streaming import state

READS = "tid int, pos int, rev int, qname string, mate int, qlen int"


def some_reads(rnd, n=300):
    """Sorted reads of three contigs; most names twice, some three times."""
    rows = []
    for i in range(n):
        tid, pos = rnd.randrange(3), rnd.randrange(0, 20_000)
        for m in range(rnd.choice([1, 2, 2, 2, 3])):
            rows.append((tid, min(20_000, pos + m * rnd.randrange(0, 900)), m % 2, f"q{i}", m + 1, 50 + i % 3))
    return sorted(rows)


def streamed(spark, folder, operator, parts, stop_after):
    """Rows that the stream gives, one file a batch; with a restart from the checkpoint after ``stop_after`` files."""
    (folder / "in").mkdir()
    end = (4, 0, 0, "end", 1, 1)  # moves the watermark over all places
    reports = []
    for k, part in enumerate([*parts, [end], [(5, 0, 0, "end2", 1, 1)]]):
        (folder / "in" / f"{k:03d}.json").write_text("\n".join(json.dumps(dict(zip([x.split()[0] for x in READS.split(", ")], r, strict=True))) for r in part))
        if k + 1 not in (stop_after, len(parts) + 2):
            continue
        d = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        q = operator(d).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        reports += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(folder / "out")), reports


@pytest.fixture
def parts():
    rows = some_reads(random.Random(5))
    return [rows[i : i + 170] for i in range(0, len(rows), 170)]


def test_islands_equal_the_batch_over_batches_and_a_restart(spark, tmp_path, parts):
    rows = [r for p in parts for r in p]
    window = spark.range(1).select(F.lit(150).cast("long").alias("window"))
    batch = regions.islands(spark.createDataFrame(rows, READS), window)
    per = {r["tid"]: r["low"] for r in batch.groupBy("tid").agg(F.min("island").alias("low")).collect()}
    want = sorted((*r[:6], r["island"] - per[r["tid"]] + 1) for r in batch.select("tid", "pos", "rev", "qname", "mate", "qlen", "island").collect())
    got, _ = streamed(spark, tmp_path, lambda d: state.stream_islands(d, 150, 1000), parts, stop_after=2)
    got = sorted(tuple(r) for r in got.where("tid < 4").select("tid", "pos", "rev", "qname", "mate", "qlen", "island").collect())
    assert got == want and len({(r[0], r[6]) for r in want}) > 30


def test_mates_equal_the_batch_and_state_shrinks(spark, tmp_path, parts):
    rows = [r for p in parts for r in p]
    more = {"region": F.col("pos"), "cls": F.lit(1), "lib": F.lit("l"), "bam_file": F.lit("f"), "lib_index": F.lit(0), "isize": F.lit(0), "bdqual": F.lit(9)}
    batch = links.mate_pairs(spark.createDataFrame(rows, READS).withColumns(more))
    want = sorted((r["qname"], r["earlier"]["pos"], r["earlier"]["mate"], r["later"]["pos"], r["later"]["mate"]) for r in batch.collect())
    got, sizes = streamed(spark, tmp_path, lambda d: state.stream_mates(d, 5000), parts, stop_after=2)
    assert sorted((r["qname"], r["first_pos"], r["first_mate"], r["second_pos"], r["second_mate"]) for r in got.collect()) == want
    names = len({r[3] for r in rows})
    assert max(sizes) < names and sizes[-1] < max(sizes) / 2
