"""Regions as session windows: one base is one millisecond of event time, so a gap is a duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col
#: Bases from the begin of a contig to that of the next in event time (fixed: positions are 32-bit).
CONTIG = 1 << 31


def position_time(tid: F.Column, pos: F.Column) -> F.Column:
    """Contigs lie one after another, in the order of their numbers; records without a contig come last."""
    return F.timestamp_millis(F.when(tid < 0, F.lit(CONTIG)).otherwise(tid).cast("long") * CONTIG + pos)


def region_sessions(reads: DataFrame, window: int, delay: int = 0) -> DataFrame:
    """(tid, start, end, n, bases) of reads no further than ``window`` apart, of a batch or a stream sorted by contig and position.

    Spark joins events at exactly the gap, as the batch operator does. On a
    stream the watermark trails the furthest place by ``delay`` bases, over
    contigs in their order, so nothing of a later contig comes late; regions
    that the watermark has not passed stay open.
    """
    d = reads.withColumn("at", position_time(c("tid"), c("pos")))
    if reads.isStreaming:
        d = d.withWatermark("at", f"{delay} milliseconds")
    g = d.groupBy("tid", F.session_window("at", f"{window} milliseconds")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.sum("qlen").alias("bases"))
    return g.drop("session_window")
