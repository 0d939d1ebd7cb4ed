"""Structural-variant candidates from owned pairs: type, place, size, copy number, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flags as fl
from ..functions.score import fisher, log_poisson_sf, phred
from ..options import Options
from .regions import coverage

c = F.col


def majority_flag(n: str = "n", cls: str = "cls") -> Column:
    """Aggregate: the class with most pairs, of equal ones the lowest."""
    return F.max_by(c(cls), F.struct(c(n), -c(cls)))


def flag_votes(owned: DataFrame) -> DataFrame:
    """Per call (ea, eb): majority class, its pairs, all pairs."""
    per = owned.groupBy("ea", "eb", "flush", "rank", "cls").agg(F.count("*").alias("n"))
    return per.groupBy("ea", "eb", "flush", "rank").agg(majority_flag().alias("flag"), F.max("n").alias("flag_pairs"), F.sum("n").alias("pairs"))


def evidence(owned: DataFrame, votes: DataFrame) -> DataFrame:
    """Per call and library: pairs of the majority class and the sum of their sizes."""
    return owned.join(votes.select("ea", "eb", "flag"), ["ea", "eb"]).where("cls = flag").groupBy("ea", "eb", "lib", "bam_file").agg(F.count("*").alias("n"), F.sum("size").alias("span"))


def pad_lengths(table: DataFrame, accepted: DataFrame, opts: Options) -> DataFrame:
    """(flush, pad): the longest read known when a batch of regions closes: that of its last region, for the last batch that of the last island."""
    step = opts.buffer + 1
    closing = accepted.where(c("region") % step == opts.buffer).select(F.expr(f"region div {step}").alias("flush"), c("max_len").alias("pad"))
    last = table.agg(F.max(F.struct("tid", "island", "max_len")).alias("x")).select(c("x.max_len").alias("last_pad"))
    flushes = accepted.select(F.expr(f"region div {step}").alias("flush")).distinct()
    return flushes.join(closing, "flush", "left").crossJoin(F.broadcast(last)).select("flush", F.coalesce("pad", "last_pad").alias("pad"))


def breakpoints(df: DataFrame) -> DataFrame:
    """Adds pos1, pos2 (0-based) from flag, start1/end1, start2/end2 (null in one region) and pad."""
    one, pad = c("start2").isNull(), c("pad") - 5
    pos1 = F.when(one | c("flag").isin(fl.RF, fl.RR), c("start1")).otherwise(c("end1"))
    pos2 = F.when(one, c("end1")).when(c("flag").isin(fl.RF, fl.FF), c("end2") + pad).otherwise(c("start2"))
    return df.withColumn("pos1", pos1.cast("long")).withColumn("pos2", pos2.cast("long"))


def padded(pos1: Column, pos2: Column) -> Column:
    """The printed start: moved by the pad where that stays before the end."""
    pad = c("pad") - 5
    return F.when(~c("flag").isin(fl.RF, fl.RR) & (pos1 + pad < pos2), pos1 + pad).otherwise(pos1)


def log_score(df: DataFrame, support: DataFrame, hist: DataFrame, covered: DataFrame, opts: Options = Options()) -> DataFrame:
    """(ea, eb, log_p): summed log tails over the libraries of a call; ``df`` has ea, eb, flag, span_size (of its regions)."""
    by_class = F.element_at(F.array(*[c(f"n{k}") for k in range(11)]), c("flag") + 1)
    s = support.join(df.select("ea", "eb", "flag", "span_size"), ["ea", "eb"]).join(F.broadcast(hist.drop("reads")), "lib", "left").crossJoin(F.broadcast(covered))
    rate = F.try_divide(c("span_size").cast("double") * F.coalesce(by_class, F.lit(0)), c("covered"))
    s = s.withColumn("log_p", log_poisson_sf(c("n"), F.coalesce(rate, F.lit(0.0))))
    out = s.groupBy("ea", "eb").agg(F.sum("log_p").alias("log_p"), F.count("*").alias("k"))
    return out.select("ea", "eb", fisher(c("log_p"), c("k")).alias("log_p") if opts.fisher else c("log_p"))


def copy_numbers(between: DataFrame, density: DataFrame, places: DataFrame) -> DataFrame:
    """Per call and key: reads between the regions, as copies; ``places`` has ea, eb, pos1, pos2 before padding."""
    x = between.select(c("a").alias("ea"), c("b").alias("eb"), "key", "reads").join(places.select("ea", "eb", "pos1", "pos2"), ["ea", "eb"]).join(F.broadcast(density), "key", "left")
    return x.select("ea", "eb", "key", "reads", F.try_divide(c("reads").cast("double"), c("density") * (c("pos2") - c("pos1"))).alias("ratio")).select("ea", "eb", "key", "reads", (c("ratio") * 2).alias("copies"))


def call_size(support: DataFrame, libs: DataFrame) -> DataFrame:
    """(ea, eb, size): mean deviation of the pairs' sizes from their libraries' means, rounded half up, cut toward zero."""
    x = support.join(F.broadcast(libs.select("lib", "mean")), "lib").groupBy("ea", "eb").agg(F.sum(c("span") - c("n") * c("mean")).alias("d"), F.sum("n").alias("n"))
    return x.select("ea", "eb", F.try_divide(c("d"), c("n")).alias("x")).select("ea", "eb", (c("x") + 0.5).cast("long").alias("size"))


def assemble(owned: DataFrame, accepted: DataFrame, table: DataFrame, between: DataFrame, density: DataFrame, hist: DataFrame, covered: DataFrame, libs: DataFrame, opts: Options = Options(), pad_length: int | None = None) -> DataFrame:
    """The typed call table, in no order: sort by flush, rank for the visiting order.

    ``pad_length`` replaces the batch-dependent read length of the coordinates.
    """
    votes = flag_votes(owned).where((c("pairs") >= opts.min_read_pair) & (c("flag_pairs") >= opts.min_read_pair))
    support = evidence(owned, votes)
    end = lambda n, k: accepted.select(c("region").alias(k), *[c(x).cast("long").alias(f"{x}{n}") for x in ("start", "end", "fwd", "rev")], c("tid").alias(f"tid{n}"))
    x = votes.join(end(1, "ea"), "ea").join(end(2, "eb"), "eb")
    x = x.withColumn("span_size", c("end1") - c("start1") + 1 + F.when(c("ea") == c("eb"), 0).otherwise(c("end2") - c("start2") + 1))
    x = x.withColumn("start2", F.when(c("ea") != c("eb"), c("start2")))
    x = x.withColumn("pad", F.lit(pad_length)) if pad_length is not None else x.join(pad_lengths(table, accepted, opts), "flush")
    x = breakpoints(x)
    cn = copy_numbers(between, density, x)
    per_key = cn.groupBy("ea", "eb").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "copies")))).alias("copy_number"), (1 - F.sum("copies") / (2.0 * F.count("*"))).alias("allele_frequency"))
    key = "lib" if opts.per_library else "bam_file"
    merged = support.groupBy("ea", "eb", c(key).alias("key")).agg(F.sum("n").alias("reads"))
    lists = merged.groupBy("ea", "eb").agg(F.array_sort(F.collect_list(F.struct("key", "reads"))).alias("support"))
    out = x.join(lists, ["ea", "eb"]).join(call_size(support, libs), ["ea", "eb"]).join(log_score(x, support, hist, covered, opts), ["ea", "eb"]).join(per_key, ["ea", "eb"], "left")
    out = out.withColumn("score", phred(c("log_p"))).where(c("score") > opts.score_threshold)
    return out.select(
        "flush", "rank", "ea", "eb", "tid1", (padded(c("pos1"), c("pos2")) + 1).alias("pos1"), "fwd1", "rev1", "tid2", (c("pos2") + 1).alias("pos2"), "fwd2", "rev2", "flag",
        fl.call_type(c("flag"), opts.long_insert).alias("type"), "size", "score", c("flag_pairs").alias("num_reads"), "support", "copy_number", "allele_frequency",
    )


__all__ = ["assemble", "breakpoints", "call_size", "copy_numbers", "coverage", "evidence", "flag_votes", "log_score", "majority_flag", "pad_lengths", "padded"]
