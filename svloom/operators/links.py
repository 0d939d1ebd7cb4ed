"""Read pairs between regions, the region graph, and which call owns a pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..options import Options
from ..ship import ship, written
from .regions import ORDER, running_before

c = F.col
#: Bases of a bucket in which reads are compared one by one.
FINE = 4096


def mate_pairs(reads: DataFrame) -> DataFrame:
    """A row per name seen twice or more: of its first two reads regions a <= b, and class, library and size of the later one; one shuffle by name.

    Each task sends two reads of a name on at most, so a name that very many
    reads share (none, or ``*``) burdens no task.
    """
    s = F.struct("tid", "pos", "rev", "mate", "region", "cls", "lib", "bam_file", "lib_index", F.abs("isize").alias("size"), "qlen", "bdqual").alias("r")
    first = reads.select("qname", s).withColumn("_k", F.row_number().over(Window.partitionBy("qname").orderBy("r"))).where("_k <= 2")
    p = first.groupBy("qname").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.count("*").alias("n")).where("n = 2")
    a, b = c("x"), c("y")
    return p.select("qname", F.least(a["region"], b["region"]).alias("a"), F.greatest(a["region"], b["region"]).alias("b"), b["cls"].alias("cls"), b["lib"].alias("lib"), b["bam_file"].alias("bam_file"), b["size"].alias("size"), a.alias("earlier"), b.alias("later"))


def edges(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def visit_order(edge: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds flush (the batch of regions in which the later end lies) and rank (place in its breadth-first walk).

    Batches hold buffer + 1 regions each and are independent, so each is walked
    by itself over its edges alone.
    """
    ship(edge.sparkSession)
    least = opts.min_read_pair
    strong = edge.where(c("weight") >= least).withColumn("flush", F.expr(f"b div {opts.buffer + 1}"))

    def walk(edge: list[tuple[int, int]]) -> list[int]:
        near: dict[int, set[int]] = {}
        for a, b in edge:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        rank: dict[tuple[int, int], int] = {}
        for root in sorted(near):
            level = [root]
            while level:
                below = []
                for v in level:
                    for w in sorted(near.get(v, ())):
                        rank[min(v, w), max(v, w)] = len(rank)
                        near[w].discard(v)
                        below.append(w)
                    near.pop(v, None)
                level = below
        return [rank[e] for e in edge]

    def walks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in parts:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            flush = pdf["flush"].to_numpy()
            # the last batch of regions may go on in the next part
            whole = int(np.searchsorted(flush, flush[-1])) if len(flush) else 0
            yield from ranked(pdf[:whole])
            left = pdf[whole:]
        if left is not None:
            yield from ranked(left)

    def ranked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        ends = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        cuts = [0, *(np.flatnonzero(np.diff(pdf["flush"].to_numpy())) + 1).tolist(), len(pdf)]
        yield pdf.assign(rank=np.concatenate([walk(ends[i:j]) for i, j in pairwise(cuts)]))

    # many batches a task: a group each would cost more than its walk
    sorted_ = strong.select("flush", "a", "b", "weight").repartition("flush").sortWithinPartitions("flush")
    return sorted_.mapInPandas(walks, "flush long, a long, b long, weight long, rank long")


def owned_pairs(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs with the edge (ea, eb) that consumes them: their own, or for a pair inside one region the region's first-visited edge."""
    when = F.struct("flush", "rank", c("a").alias("ea"), c("b").alias("eb"))
    first = order.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("v"), when.alias("w")).groupBy("v").agg(F.min("w").alias("w"))
    of = order.where("a <> b").select("a", "b", when.alias("w")).unionByName(first.select(c("v").alias("a"), c("v").alias("b"), "w"))
    return pairs.join(of, ["a", "b"]).select(*pairs.columns, "w.*")


def normal_counts(admitted: DataFrame, anomalous: DataFrame, keys: list[str], key: str, accepted: DataFrame) -> DataFrame:
    """Per accepted region: running counts of proper-pair reads of every key at its first (lo) and last (hi) anomalous read.

    Reads are counted by small buckets of positions, whose sums run on; only in
    buckets that hold a region's end are single reads compared with it. Nothing
    is sorted.
    """
    from ..functions import flags as fl

    names = [f"k{i}" for i in range(len(keys))]
    proper = admitted.where(fl.proper_pair()).select(*ORDER, F.floor(c("pos") / FINE).alias("bucket"), *[F.when(c(key) == k, 1).otherwise(0).alias(n) for n, k in zip(names, keys, strict=True)])
    at = F.struct(*ORDER)
    ends = anomalous.where("opens or closes").select("island", "opens", "closes", "tid", F.floor(c("pos") / FINE).alias("bucket"), at.alias("end")).join(accepted.select("island", "region"), "island")
    sides = F.array_compact(F.array(F.when(c("opens"), "lo"), F.when(c("closes"), "hi")))
    ends = written(ends.select("region", F.explode(sides).alias("side"), "tid", "bucket", "end"), "region-ends")
    inside = proper.withColumn("read", at).drop("pos", "rev", "qname", "mate").join(ends, ["tid", "bucket"]).where(c("read") <= c("end"))
    inside = inside.groupBy("region", "side").agg(*[F.sum(n).alias(n) for n in names])
    # sums before each bucket: over the buckets of a large one, then over the large ones; buckets that only regions have count none
    used = ends.select("tid", "bucket", *[F.lit(0).alias(n) for n in names])
    fine = written(proper.select("tid", "bucket", *names).unionByName(used).groupBy("tid", "bucket").agg(*[F.sum(n).alias(n) for n in names]), "bucket-counts")
    before = running_before(fine, names)
    out = ends.select("region", "side", "tid", "bucket").join(before, ["tid", "bucket"]).join(inside.select("region", "side", *[c(n).alias(f"in_{n}") for n in names]), ["region", "side"], "left")
    return out.groupBy("region").agg(*[F.max(F.when(c("side") == s, c(n) + F.coalesce(f"in_{n}", F.lit(0)))).cast("long").alias(f"{s}_{n}") for n in names for s in ("lo", "hi")])


def between_counts(edge: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, key, reads): proper-pair reads after region a's last and up to region b's first anomalous read; keys without any are absent."""
    a = counts.select(c("region").alias("a"), *[c(f"hi_k{i}") for i in range(len(keys))])
    b = counts.select(c("region").alias("b"), *[c(f"lo_k{i}") for i in range(len(keys))])
    e = edge.where("a <> b").select("a", "b").join(a, "a").join(b, "b")
    per = F.array(*[F.struct(F.lit(k).alias("key"), (c(f"lo_k{i}") - c(f"hi_k{i}")).alias("reads")) for i, k in enumerate(keys)])
    return e.select("a", "b", F.inline(per)).where("reads > 0")
