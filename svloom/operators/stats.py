"""Statistics of the counting pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flags as fl
from ..options import Options
from .filters import counted

c = F.col


def counting_pass(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """The one pass over all placed primary records: a few rows per file, library and contig, from which the statistics follow.

    ``df`` holds records of libraries that are not configured too; they are not counted.
    """
    kept = ~fl.either_unmapped()
    if opts.only_ctx:
        kept = kept & fl.interchromosomal()
    marks = {"counted": counted(), "proper": fl.proper_pair(), "kept": kept}
    return df.groupBy("bam_file", "lib", "tid", "cls", *[x.alias(n) for n, x in marks.items()]).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _total(of: Column) -> Column:
    return F.coalesce(F.sum(F.when(of, c("n"))), F.lit(0))


def flag_histogram(counts: DataFrame) -> DataFrame:
    """Per library: proper pairs, and anomalous reads by class n0..n10 (a null library's rows are none)."""
    good = ~c("cls").isin(fl.NA, fl.NORMAL_FR, fl.NORMAL_RF) & c("kept")
    sums = [_total(good & (c("cls") == k)).alias(f"n{k}") for k in range(11)]
    return counts.where("counted").groupBy("lib").agg(_total(c("proper")).alias("reads"), *sums)


def file_counts(counts: DataFrame) -> DataFrame:
    return counts.where("counted").groupBy("bam_file").agg(_total(c("proper")).alias("reads"))


def covered_length(counts: DataFrame) -> DataFrame:
    """One row: the longest covered reference of a file, from all placed primary records."""
    spans = counts.groupBy("bam_file", "tid").agg((F.max("last") - F.min("first")).cast("long").alias("span"))
    return spans.groupBy("bam_file").agg(F.sum("span").alias("covered")).agg(F.max("covered").alias("covered"))


def coverage(hist: DataFrame, libs: DataFrame, covered: DataFrame) -> DataFrame:
    """Sequence and physical coverage of each library."""
    x = libs.join(hist, "lib", "left").crossJoin(F.broadcast(covered)).withColumn("reads", F.coalesce("reads", F.lit(0)))
    seq = F.when((c("reads") > 0) & (c("covered") > 0), c("reads") * c("readlen") / c("covered")).otherwise(0.0)
    phys = F.coalesce(F.try_divide(c("reads") * c("mean"), c("covered") * 2), F.lit(0.0))
    return x.select("lib", "reads", "covered", seq.alias("sequence_coverage"), phys.alias("physical_coverage"))


def density(hist: DataFrame, files: DataFrame, covered: DataFrame, per_library: bool = False) -> DataFrame:
    """Normal reads per base by library, or by file."""
    if per_library:
        d = F.when(c("reads") > 0, c("reads") / c("covered")).otherwise(1e-6)
        return hist.crossJoin(F.broadcast(covered)).select(c("lib").alias("key"), d.alias("density"))
    return files.crossJoin(F.broadcast(covered)).select(c("bam_file").alias("key"), (c("reads") / c("covered")).alias("density"))


def first_window(libs: DataFrame) -> DataFrame:
    """One row: the smallest whole mean - 2 readlen, from 50 up to 1e8."""
    return libs.agg(F.greatest(F.lit(50), F.least(F.lit(100_000_000), F.min((c("mean") - 2 * c("readlen")).cast("int")))).cast("long").alias("window"))


def window_size(hist: DataFrame, libs: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: the gap that parts regions, narrowed where anomalous reads lie dense."""
    n = F.coalesce("n2", F.lit(0)) + F.coalesce("n3", F.lit(0))
    own = libs.join(hist, "lib", "left").crossJoin(F.broadcast(covered)).select(F.when(n > 0, F.floor(c("covered") / n)).otherwise(50).alias("w"))
    return own.agg(F.min("w").alias("w")).crossJoin(first_window(libs)).select(F.least("w", "window").cast("long").alias("window"))
