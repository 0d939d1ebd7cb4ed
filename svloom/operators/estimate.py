"""Estimation of the libraries' insert sizes."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..ship import ship, written
from ..sources import alignments, bam

c = F.col


def sampled(df: DataFrame, n: int = 10_000) -> DataFrame:
    """The first n + 1 usable observations of each library in reading order."""
    w = Window.partitionBy("lib").orderBy("tid", "pos", "qname", "mate")
    return df.withColumn("_k", F.row_number().over(w)).where(c("_k") <= n + 1).drop("_k")


def _observation() -> F.Column:
    return c("code").isin(18, 20) & (c("dist") >= 0)


#: Bases of a bucket in which records are counted to find how far a library is read.
WIDE = 1 << 16


def _reach(good: DataFrame, most: int) -> Column:
    """Holds for the first ``most`` records of each library of a file and those at the last one's position; for all where there are fewer.

    Records are counted by bucket, then by position in the bucket where the count
    is reached; a place per library goes to the driver, so that the condition
    stands before whatever else is computed of a record.
    """
    own = Window.partitionBy("bam_file", "lib")
    upto = lambda by: F.sum("n").over(own.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    d = good.select("bam_file", "lib", "tid", "pos", F.floor(c("pos") / WIDE).alias("bucket"))
    per = d.groupBy("bam_file", "lib", "tid", "bucket").agg(F.count("*").alias("n")).withColumn("upto", upto(["tid", "bucket"]))
    at = per.where((c("upto") >= most) & (c("upto") - c("n") < most)).select("bam_file", "lib", "tid", "bucket", (c("upto") - c("n")).alias("before"))
    fine = d.join(F.broadcast(at), ["bam_file", "lib", "tid", "bucket"]).groupBy("bam_file", "lib", "tid", "before", "pos").agg(F.count("*").alias("n"))
    fine = fine.withColumn("upto", upto(["pos"]) + c("before")).where(c("upto") >= most)
    return _before(fine.groupBy("bam_file", "lib", "tid").agg(F.min("pos").alias("pos")))


def _before(ends: DataFrame) -> Column:
    """Up to the positions in ``ends`` (a row for each library of a file that ends); libraries without are read whole."""
    near = F
    for r in ends.select("bam_file", "lib", "tid", "pos").collect():
        place = (c("tid") < r["tid"]) | ((c("tid") == r["tid"]) & (c("pos") <= r["pos"]))
        near = near.when((c("bam_file") == r["bam_file"]) & (c("lib") == r["lib"]), place)
    return F.lit(True) if near is F else near.otherwise(True)


def stops(df: DataFrame, libraries: dict[str, int], n: int = 10_000, min_mapq: int = 35, min_share: float = 1e-4) -> DataFrame:
    """(bam_file, lib, until, single, full): the last place (tid, pos, qname, mate) at which each library is read, null: to the end; full: at its record the whole file ends.

    Reading in order, a library is done with its observation n + 1, and a file
    with good record 3 * libraries * n + 1 of the libraries not yet done;
    libraries: how many each file's header names. A library is single-ended, and
    read no further, once its observations before a good record are less than
    ``min_share`` of its good records so far (none counts as one). No library
    needs more records than its file can take: only so many are sorted (``_reach``).
    """
    place, most = F.struct("tid", "pos", "qname", "mate"), {f: 3 * k * n + 1 for f, k in libraries.items()}
    order = ["tid", "pos", "qname", "mate"]
    own = Window.partitionBy("bam_file", "lib").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    g = df.where((c("bdqual") > min_mapq) & c("lib").isNotNull() & c("bam_file").isin(*most))
    g = g.where(_reach(g, max(most.values(), default=0))).select("bam_file", "lib", *order, F.coalesce(_observation(), F.lit(False)).cast("int").alias("obs"))
    g = g.withColumn("k", F.row_number().over(own)).where(c("k") <= max(most.values(), default=0))
    g = g.withColumn("seen", F.coalesce(F.sum("obs").over(before), F.lit(0)))
    g = g.withColumn("single", F.greatest("seen", F.lit(1)) / c("k") < min_share)
    g = g.withColumn("gone", F.coalesce(F.max("single").over(before), F.lit(False))).where((c("seen") <= n) & ~c("gone"))
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv]) if most else F.lit(None).cast("map<string,int>")
    g = g.withColumn("no", F.row_number().over(Window.partitionBy("bam_file").orderBy(*order))).withColumn("full", c("no") >= F.element_at(limit, c("bam_file")))
    ends = g.where(c("full")).groupBy("bam_file").agg(F.min(place).alias("end"))
    g = g.join(F.broadcast(ends), "bam_file", "left").where(c("end").isNull() | (place <= c("end")))
    done = F.min(F.when((c("seen") + c("obs") > n) | c("single"), place))
    return g.groupBy("bam_file", "lib").agg(F.coalesce(done, F.first("end")).alias("until"), F.max("single").alias("single"), F.coalesce(F.max("full"), F.lit(False)).alias("full"))


def until_stop(df: DataFrame, stop: DataFrame) -> DataFrame:
    """The records that are read before ``stops``, of the libraries that are not single-ended; ``stop`` has a row for each configured library."""
    place = F.struct(*[df[x] for x in ("tid", "pos", "qname", "mate")])
    return df.join(F.broadcast(stop.where("not single")), ["bam_file", "lib"]).where(c("until").isNull() | (place <= c("until"))).select(*[df[x] for x in df.columns])


def sampled_files(spark: SparkSession, paths: dict[str, int], prepare: Callable[[DataFrame], DataFrame], n: int = 10_000, min_mapq: int = 35, min_share: float = 1e-4, first: int = 64 << 20, split: int = bam.SPLIT) -> tuple[DataFrame, DataFrame, int]:
    """(records up to each library's stop, stops, bytes read) of sorted BAM files, read from their begin as far as the stops need.

    paths: how many libraries each file's header names. ``prepare`` adds what
    ``stops`` takes (lib, bdqual, code, dist). Round by round the splits that
    begin in a file's first ``first`` bytes are read, then twice as many, of the
    files alone whose stops are not found; so at most some four times the bytes up
    to a stop are read, and no record behind them is sorted. A stop counts if records
    of a later position have been read, or the file's end.
    """
    sizes = {}
    for p in paths:
        with bam.opened(p) as f:
            sizes[p] = f.seek(0, 2)
    name = {p: p.rsplit("/", 1)[-1] for p in paths}
    if len(set(name.values())) < len(paths):
        raise ValueError("files are told apart by their names, which repeat")
    left, upto, read, found, ends = sorted(paths), first, 0, [], []
    while left:
        d = prepare(alignments.read_files(spark, left, with_seq=False, split=split, upto=upto))
        d = written(d, "begin-of-files")
        read += sum(min(sizes[p], -(-upto // split) * split) for p in left)
        libraries = {name[p]: paths[p] for p in left}
        stop = written(stops(d, libraries, n, min_mapq, min_share), "stops")
        last = d.where("tid >= 0").groupBy("bam_file").agg(F.max(F.struct("tid", "pos")).alias("last"))
        far = F.max(F.struct(c("until.tid").alias("tid"), c("until.pos").alias("pos"))).alias("far")
        # a row for each file
        seen = stop.groupBy("bam_file").agg(F.count("until").alias("stopped"), F.max("full").alias("full"), far).join(last, "bam_file")
        done = {r["bam_file"] for r in seen.where("far < last").collect() if r["full"] or r["stopped"] >= libraries[r["bam_file"]]}
        ready = [p for p in left if name[p] in done or upto >= sizes[p]]
        if ready:
            these = [name[p] for p in ready]
            found.append(until_stop(d.where(c("bam_file").isin(these)), stop))
            ends.append(stop.where(c("bam_file").isin(these)))
        left, upto = [p for p in left if p not in ready], 2 * upto
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, ends), read


def out_of_order(df: DataFrame, no: str = "no", bits: int = 33) -> DataFrame:
    """Records that lie before the record read just before them in their file, on the same contig.

    no: reading order, as monotonically_increasing_id gives it while a file is
    read; its bits from ``bits`` on tell the split. Splits are compared inside,
    and the first of each with the last of the one before it.
    """
    d = df.withColumn("_split", F.shiftright(no, bits))
    at = F.struct(no, "tid", "pos")
    per = d.groupBy("bam_file", "_split").agg(F.max(at).alias("_end"))
    per = per.withColumn("_prior", F.lag("_end").over(Window.partitionBy("bam_file").orderBy("_split"))).drop("_end")
    d = d.join(per, ["bam_file", "_split"]).withColumn("_last", F.coalesce(F.lag(at).over(Window.partitionBy("bam_file", "_split").orderBy(no)), c("_prior")))
    return d.where((c("_last.tid") == c("tid")) & (c("pos") < c("_last.pos"))).select(*df.columns)


def assert_sorted(df: DataFrame, no: str = "no") -> None:
    """Raises an error if a record is out of order."""
    bad = out_of_order(df, no).select("bam_file", "tid", "pos").head(1)
    if bad:
        raise ValueError(f"not sorted by position: {bad[0]['bam_file']}, contig {bad[0]['tid']}, position {bad[0]['pos']}")


def usable(df: DataFrame, min_mapq: int = 35) -> DataFrame:
    """Good records of normal pairs, seen from the end whose distance is not negative."""
    return df.where((c("bdqual") > min_mapq) & _observation())


def read_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("lib").agg(F.avg("qlen").alias("readlen"))


def kept(obs: DataFrame, cut: float = 5.0) -> DataFrame:
    """(lib, dist, m, s): observations up to their library's mean m + cut * its deviation s."""
    first = obs.groupBy("lib").agg(F.avg("dist").alias("m"), F.stddev_samp("dist").alias("s"))
    return obs.select("lib", "dist").join(F.broadcast(first), "lib").where(c("s").isNull() | (c("dist") <= c("m") + cut * c("s")))


def insert_stats(obs: DataFrame, cut: float = 5.0) -> DataFrame:
    """(lib, n, mean, std) after dropping what exceeds mean + cut * std, once."""
    return kept(obs, cut).groupBy("lib").agg(F.count("*").alias("n"), F.avg("dist").alias("mean"), F.stddev_samp("dist").alias("std"), F.first("m").alias("m"), F.first("s").alias("s"))


def one_sided(obs: DataFrame, stats: DataFrame, cut: float = 5.0) -> DataFrame:
    """Adds sd_below and sd_above: deviations on either side of the mean over one less than that side's count."""
    x = obs.select("lib", "dist").join(F.broadcast(stats), "lib").where(c("s").isNull() | (c("dist") <= c("m") + cut * c("s")))
    low, sq = c("dist") <= c("mean"), (c("dist") - c("mean")) * (c("dist") - c("mean"))
    side = lambda on: F.sqrt(F.try_divide(F.sum(F.when(on, sq)), F.nullif(F.count_if(on) - 1, F.lit(0))))
    return x.groupBy("lib").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"), side(low).alias("sd_below"), side(~low).alias("sd_above"))


def cutoffs(stats: DataFrame, sd: float = 4.0) -> DataFrame:
    return stats.withColumn("upper", c("mean") + sd * c("sd_above")).withColumn("lower", F.greatest(F.lit(0.0), c("mean") - sd * c("sd_below")))


def good_libraries(stats: DataFrame, min_mean: float = 50, max_cv: float = 1.0, min_n: int = 100) -> DataFrame:
    return stats.where((c("mean") >= min_mean) & (c("std") / c("mean") < max_cv) & (c("n") >= min_n))


def code_histogram(df: DataFrame) -> DataFrame:
    """(rg, code, n, percent, total) of every read group's codes."""
    n = df.groupBy(F.coalesce("rg", F.lit("NA")).alias("rg"), "code").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("rg"))
    return n.select("rg", "code", "n", (c("n") * 100.0 / total).alias("percent"), total.alias("total"))


def size_histogram(obs: DataFrame, width: int = 10) -> DataFrame:
    return obs.groupBy("lib", (F.floor(c("dist") / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def config_lines(stats: DataFrame) -> DataFrame:
    """Configuration lines; needs rg, bam_file, lib, readlen, n, lower, upper, mean, std; normality (a text), if there."""
    parts = [F.concat(F.lit("readgroup:"), c("rg")), F.lit("platform:illumina"), F.concat(F.lit("map:"), c("bam_file")), F.format_string("readlen:%.2f", "readlen"), F.concat(F.lit("lib:"), c("lib")), F.format_string("num:%d", "n")]
    parts += [F.format_string(f"{x}:%.2f", x) for x in ("lower", "upper", "mean", "std")]
    if "normality" in stats.columns:
        parts.append(F.concat(F.lit("SWnormality:"), c("normality")))  # a null is left out
    return stats.select(F.concat_ws("\t", *parts, F.lit("exe:samtools view")).alias("value"))


def estimated(df: DataFrame, libraries: dict[str, int], n: int = 10_000, min_mapq: int = 35, cut: float = 5.0, sd: float = 4.0) -> DataFrame:
    """What the estimator reports of the good libraries of one file: lib, readlen, n, mean, std, lower, upper, normality.

    df: records with code and dist; libraries: as for ``stops``. The records up
    to the stops, few of a long file's, are written to the shared folder once.
    """
    stop = written(stops(df, libraries, n, min_mapq), "stops")
    near = _before(stop.where("until is not null").select("bam_file", "lib", "until.tid", "until.pos"))
    rows = written(until_stop(df.where(near), stop).select("lib", "qlen", "bdqual", "code", "dist"), "estimator")
    obs = usable(rows, min_mapq)
    first = insert_stats(obs, cut)
    limits = cutoffs(one_sided(obs, first.drop("n"), cut), sd).select("lib", "lower", "upper")
    good = good_libraries(first).select("lib", "n", "mean", "std").join(limits, "lib").join(read_lengths(rows), "lib")
    return good.join(normality(kept(obs, cut)).select("lib", c("field").alias("normality")), "lib", "left")


# Coefficients of algorithm AS R94 (Royston 1995), constant term first.
C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.5440, -0.39978, 0.025054, -0.0006714)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)
G = (-2.273, 0.459)


#: P of a small sample beyond the approximation's range, and the deviate from which the normal tail is 0.
LEAST, TAIL = 1e-19, 18.66


def shapiro_wilk(x: np.ndarray) -> float:
    """p-value of normality of ascending values; or a code: -1 for fewer than 3 values, -2.2 when all are equal, -2.3 when they do not ascend.

    (Code -2.1 stands for samples of which more than 80 % are censored; nothing is censored here.)
    """
    poly = lambda k, t: float(np.polynomial.polynomial.polyval(t, k))
    x, n = np.asarray(x, float), len(x)
    if n < 3:
        return -1.0
    if x[-1] - x[0] < 1e-19:
        return -2.2
    if (np.diff(x) < 0).any():
        return -2.3
    half = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
        total, r = 2 * float(m @ m), 1 / math.sqrt(n)
        a1 = poly(C1, r) - m[0] / math.sqrt(total)
        if n > 5:
            a2 = poly(C2, r) - m[1] / math.sqrt(total)
            f = math.sqrt((total - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1**2 - 2 * a2**2))
            a = np.concatenate(([a1, a2], -m[2:] / f))
        else:
            f = math.sqrt((total - 2 * m[0] ** 2) / (1 - 2 * a1**2))
            a = np.concatenate(([a1], -m[1:] / f))
    w = float(a @ (x[::-1][:half] - x[:half])) ** 2 / float(((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = poly(G, n)
        if y >= gamma:
            return LEAST
        y, mean, sd = -math.log(gamma - y), poly(C3, n), math.exp(poly(C4, n))
    else:
        mean, sd = poly(C5, math.log(n)), math.exp(poly(C6, math.log(n)))
    z = (y - mean) / sd
    return 0.0 if z > TAIL else 0.5 * math.erfc(z / math.sqrt(2))


def normality_field(p: float) -> str:
    """The text of a p-value or code in a configuration line."""
    if p < 0:
        return f"data not qualified {p:g}"
    return f"{math.log10(p):.2f}" if p else "minus infinity"


def normality(obs: DataFrame) -> DataFrame:
    """(lib, p, log10_p, field) of each library's observations; p: p-value or code, log10_p: null for a code.

    A library's observations meet in one task: hand over those read up to
    ``stops`` or taken by ``sampled``, whose number a parameter bounds.
    """
    ship(obs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = shapiro_wilk(np.sort(pdf["dist"].to_numpy(float)))
        log = None if p < 0 else math.log10(p) if p else -math.inf
        return pd.DataFrame({"lib": [pdf["lib"].iloc[0]], "p": [p], "log10_p": pd.array([log], "Float64"), "field": [normality_field(p)]})

    return obs.select("lib", "dist").groupBy("lib").applyInPandas(run, "lib string, p double, log10_p double, field string")
