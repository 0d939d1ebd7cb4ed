"""Regions: anomalous reads of a contig in order, parted where the gap exceeds the window.

All running sums work in two levels, so that no contig has to fit a task: within
buckets of positions by a window, across buckets by a window over a row for
each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import flags as fl
from ..options import Options
from ..ship import written

c = F.col
#: The total order of reads, and bases in a bucket.
ORDER, BUCKET = ["tid", "pos", "rev", "qname", "mate"], 1 << 20


def _buckets(df: DataFrame, bucket: int) -> DataFrame:
    return df.withColumn("bucket", F.floor(c("pos") / bucket))


def running(df: DataFrame, sums: dict[str, F.Column], bucket: int = BUCKET) -> DataFrame:
    """Adds running sums, in the total order over all contigs, of the given whole-number Columns."""
    d = _buckets(df, bucket)
    w = Window.partitionBy("tid", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    per = d.groupBy("tid", "bucket").agg(*[F.sum(x).alias(f"_{n}") for n, x in sums.items()])
    contigs = per.groupBy("tid").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = lambda n, by: F.coalesce(F.sum(f"_{n}").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("tid", "bucket", *[before(n, Window.partitionBy("tid").orderBy("bucket")).alias(f"b_{n}") for n in sums])
    # a row per contig: the header's size
    firsts = contigs.select("tid", *[before(n, Window.orderBy("tid")).alias(f"c_{n}") for n in sums])
    d = d.select("*", *[F.sum(x).over(w).alias(f"w_{n}") for n, x in sums.items()]).join(offsets, ["tid", "bucket"]).join(F.broadcast(firsts), "tid")
    out = d.select(*df.columns, *[(c(f"w_{n}") + c(f"b_{n}") + c(f"c_{n}")).cast("long").alias(n) for n in sums])
    return out


def running_before(buckets: DataFrame, sums: list[str], many: int = 4096) -> DataFrame:
    """Of a row per (tid, bucket): the sums of all rows before it, in order of contig and bucket; ``many`` buckets are added up at a time."""
    d = buckets.withColumn("_group", F.floor(c("bucket") / many))
    upto = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("tid", "_group").agg(*[F.sum(n).alias(n) for n in sums])
    contigs = per.groupBy("tid").agg(*[F.sum(n).alias(n) for n in sums])
    # a row per contig: the header's size
    firsts = contigs.select("tid", *[F.coalesce(F.sum(n).over(upto(Window.orderBy("tid"))), F.lit(0)).alias(f"_c_{n}") for n in sums])
    groups = per.select("tid", "_group", *[F.coalesce(F.sum(n).over(upto(Window.partitionBy("tid").orderBy("_group"))), F.lit(0)).alias(f"_g_{n}") for n in sums])
    own = Window.partitionBy("tid", "_group").orderBy("bucket")
    d = d.select("tid", "_group", "bucket", *[F.coalesce(F.sum(n).over(upto(own)), F.lit(0)).alias(n) for n in sums])
    d = d.join(groups, ["tid", "_group"]).join(F.broadcast(firsts), "tid")
    return d.select("tid", "bucket", *[(c(n) + c(f"_g_{n}") + c(f"_c_{n}")).alias(n) for n in sums])


def islands(df: DataFrame, window: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``island``, numbered from 1 in order: a new one where the contig changes or the gap exceeds ``window`` (one row); ``opens`` and ``closes`` mark an island's first and last read.

    Reads are shuffled and sorted once and written with their numbers inside a
    bucket; what lies before each bucket is joined from a row per bucket.
    """
    by = Window.partitionBy("tid", "bucket").orderBy(*ORDER)
    d = _buckets(df, bucket).crossJoin(F.broadcast(window.select(c("window").alias("_window"))))
    d = d.withColumns({"_before": F.lag("pos").over(by), "_after": F.lead("pos").over(by)})
    # null at a bucket's first and last read
    d = d.withColumns({"_opens": c("pos") - c("_before") > c("_window"), "_closes": c("_after") - c("pos") > c("_window")})
    inside = F.count_if("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    d = written(d.select(*df.columns, "bucket", "_window", "_opens", "_closes", inside.alias("_inside")), "ordered")
    per = d.groupBy("tid", "bucket").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("_inside").alias("k"), F.first("_window").alias("gap"))
    next_to = Window.partitionBy("tid").orderBy("bucket")
    far = lambda a, b: F.coalesce(b - a > c("gap"), F.lit(True))
    per = per.withColumns({"_first": far(F.lag("last").over(next_to), c("first")), "_last": far(c("last"), F.lead("first").over(next_to))})
    per = per.select("tid", "bucket", "_first", "_last", c("_first").cast("long").alias("own"), (c("k") + c("_first").cast("long")).alias("k"))
    # tables of a row per bucket, and per contig: the header's size
    per = written(per, "buckets")
    before = running_before(per.select("tid", "bucket", c("k").alias("_offset")), ["_offset"])
    offsets = written(per.join(before, ["tid", "bucket"]).select("tid", "bucket", "_first", "_last", (c("own") + c("_offset")).alias("_offset")), "offsets")
    d = d.join(offsets, ["tid", "bucket"])
    return d.select(*df.columns, (c("_inside") + c("_offset")).alias("island"), F.coalesce("_opens", "_first").alias("opens"), F.coalesce("_closes", "_last").alias("closes"))


def island_table(reads: DataFrame) -> DataFrame:
    """A row per island, of reads with ``opens``. nucleotides and max_len count reads 2..n and the first read of the next island."""
    t = reads.groupBy("tid", "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.sum("qlen").alias("all_bases"), F.max(F.when(c("opens"), c("qlen"))).alias("first_len"),
        F.max(F.when(~c("opens"), c("qlen"))).alias("rest_len"), F.count_if(c("rev") == 0).alias("fwd"), F.count_if(c("rev") == 1).alias("rev"),
    )
    t = written(t, "island-sums")
    nxt = t.select((c("island") - 1).alias("island"), c("first_len").alias("next_len"))
    t = t.join(nxt, "island", "left")
    return t.select(
        "tid", "island", "start", "end", "n", "fwd", "rev", (c("all_bases") - c("first_len") + F.coalesce("next_len", F.lit(0))).alias("nucleotides"),
        F.greatest(F.coalesce("rest_len", F.lit(0)), F.coalesce("next_len", F.lit(0))).cast("int").alias("max_len"),
    )


def coverage() -> F.Column:
    return c("nucleotides") / (c("end") - c("start") + 1 + c("max_len"))


def numbered(t: DataFrame) -> DataFrame:
    """Adds ``region`` 0, 1, 2.. in island order, contig by contig with offsets."""
    per = t.groupBy("tid").agg(F.count("*").alias("k"))
    per = per.select("tid", F.coalesce(F.sum("k").over(Window.orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return t.join(F.broadcast(per), "tid").withColumn("region", F.row_number().over(Window.partitionBy("tid").orderBy("island")) - 1 + c("base")).drop("base")


def regions(table: DataFrame, opts: Options = Options()) -> DataFrame:
    """Accepted islands: longer than min_len, below the coverage limit."""
    ok = table.where((c("end") - c("start") > opts.min_len) & (coverage() < opts.coverage_limit))
    return numbered(ok).withColumn("coverage", coverage())


def region_reads(reads: DataFrame, accepted: DataFrame, opts: Options = Options()) -> DataFrame:
    """Reads of accepted regions that hold enough valid reads (on one contig, inter-contig reads are not valid)."""
    if not opts.contig:
        return reads.join(accepted.where(c("n") >= opts.min_read_pair).select("island", "region"), "island")
    r = reads.join(accepted.select("island", "region"), "island")
    enough = r.groupBy("region").agg(F.count_if(c("cls") != fl.CTX).alias("valid")).where(c("valid") >= opts.min_read_pair).select("region")
    return r.join(enough, "region")
