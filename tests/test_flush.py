"""Calls over a stream against the batch analysis: several micro-batches, a failure before the state, a replay, a restart."""

import os

import pytest
from pyspark.sql import functions as F

from svloom.operators.regions import ORDER
from svloom.options import Options
from svloom.plans.pipeline import Analysis
from svloom.plans.queries import LIBS, RG_LIB
from svloom.sources.reads import READS, reads_from_orders
from svloom.streaming.flush import CallStream

SF = "/root/testdata/sf0.001"
OPTS = Options(buffer=59, score_threshold=0)


class Broken(CallStream):
    """Fails once, after all of micro-batch 1 is written but its state."""

    def _commit(self, state, batch):
        if batch == 1:
            raise RuntimeError("lost")
        super()._commit(state, batch)


def plain(rows):
    return sorted(repr(r.asDict(recursive=True)) for r in rows)


@pytest.fixture(scope="module")
def batch(spark):
    return Analysis(reads_from_orders(spark, SF), LIBS, RG_LIB, OPTS, window=250)


def files_in_order(spark, folder, n):
    rows = reads_from_orders(spark, SF).withColumn("rev", F.expr("(flag & 16) div 16")).orderBy(*ORDER).drop("rev").toPandas()
    folder.mkdir()
    size = -(-len(rows) // n)
    for k in range(n):
        rows.iloc[k * size : (k + 1) * size].to_json(folder / f"{k}.json", orient="records", lines=True)
        os.utime(folder / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))


def test_calls_equal_the_batch_once_after_failure_and_restart(spark, tmp_path, batch):
    files_in_order(spark, tmp_path / "in", 4)

    def analysis(d):
        a = Analysis(d, LIBS, RG_LIB, OPTS, window=250)
        a.hist, a.files, a.covered = batch.hist, batch.files, batch.covered
        return a

    def run(kind):
        sink = kind(spark, str(tmp_path / "out"), analysis)
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = sink.start(stream, availableNow=True)
        return sink, q

    _, q = run(Broken)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(240)
    sink, q = run(CallStream)
    assert q.awaitTermination(240)
    want = batch.calls.collect()
    assert len({r["flush"] for r in want}) > 3
    last = max(r["flush"] for r in want)
    early = sink.calls().collect()
    assert plain(early) == plain(r for r in want if r["flush"] in {x["flush"] for x in early})
    assert 2 < len({r["flush"] for r in early}) <= last + 1
    assert plain(sink.finish().collect()) == plain(want)
    # the last micro-batch again, as Spark replays it
    sink(spark.read.schema(READS).json(str(tmp_path / "in" / "3.json")), 3)
    assert plain(sink.calls().where(F.col("flush") < last).collect()) == plain(r for r in want if r["flush"] < last)
    with pytest.raises(ValueError, match="begins at"):
        sink(spark.read.schema(READS).json(str(tmp_path / "in" / "0.json")), 4)
