"""Mixing sources to target weights with hash-threshold histograms.

A document's place in its source is a 60-bit hash of its id. Sizes are summed
by source and leading hash bits; the bucket in which a source's budget runs out
is refined by the next bits, and only it, until it is one document. A document
is then taken if its hash lies below its source's threshold: no sort, one scan,
the same choice on every run, and thresholds of smaller budgets are nested in
those of larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Hash bits, and bits read in each round (fixed: 60 = 5 x 12).
HASH_BITS, ROUND_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's digits ('null' for a null id), as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights by code point order, null last, shared up to ``cap`` times the size.

    The resharing ends where every uncapped source gets level * weight for one
    level, and the capped are those of the smallest cap / weight: one running
    sum over the sources (a row each) finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("no", F.row_number().over(by))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("no", "level"))
    s = s.withColumn("level", F.min(free).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, times of every row of ``docs``.

    size counts the words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources in
    code point order, null last, weigh ``weights``, repeating, and share the
    sum of all sizes; a source stops at ``cap`` times its size, its excess goes
    to the others by weight until none is above. A source takes every document
    floor(target / source_size) times and, for the rest, once more those whose
    hash lies below its threshold; the document at the boundary goes in if the
    sum comes nearer to the target by it. taken = size * times; times is one for a doc_id and source. Rows that
    repeat a doc_id within a source share its hash and are taken together; a
    null doc_id hashes as such. An empty table gives no rows, and sources
    without words have target 0; other columns take no part.
    """
    d = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), n_words(docs[text].cast("string")).alias("size"), place(docs[doc_id]).alias("h"))
    d = written(d, "sizes")
    s = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("times", whole).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    # n documents of summed size ``at`` share the leading bits ``prefix``; ``below`` is the size under it
    s = s.select("source", "source_size", "target", "times", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(HASH_BITS).alias("bits"), F.lit(0).cast("long").alias("below"), F.col("source_size").alias("at"), F.lit(2).cast("long").alias("n"))
    s = written(s, "budgets")
    shift = HASH_BITS
    while shift and (s.agg(F.max("n")).first()[0] or 0) > 1:
        keys = s.where("n > 1").select(F.col("source").alias("src"), F.col("prefix").alias("own"), "below", "budget")
        inside = d.join(keys, d["source"].eqNullSafe(F.col("src")) & (F.shiftright("h", shift) == F.col("own")))
        shift -= ROUND_BITS
        hist = inside.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("at"), F.count("*").alias("n"), F.first("below").alias("below"), F.first("budget").alias("budget"))
        hist = hist.withColumn("upto", F.col("below") + F.sum("at").over(Window.partitionBy("src").orderBy("bucket")))
        cross = hist.where("upto > budget").groupBy("src").agg(F.min(F.struct("bucket", "at", "n", "upto")).alias("x"))
        refined = F.struct(F.col("x.bucket").alias("prefix"), F.lit(shift).alias("bits"), (F.col("x.upto") - F.col("x.at")).alias("below"), F.col("x.at").alias("at"), F.col("x.n").alias("n"))
        # where nothing crosses, all of the bucket is below the threshold
        passed = F.struct((F.col("prefix") + 1).alias("prefix"), F.col("bits").alias("bits"), (F.col("below") + F.col("at")).alias("below"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
        same = F.struct("prefix", "bits", "below", "at", "n")
        j = s.join(cross, s["source"].eqNullSafe(F.col("src")), "left")
        state = F.when(F.col("n") <= 1, same).when(F.col("x").isNull(), passed).otherwise(refined)
        s = written(j.select("source", "source_size", "target", "times", "budget", state.alias("s")).select("source", "source_size", "target", "times", "budget", "s.*"), "budgets")
    nearer = (F.col("at") > 0) & (2 * (F.col("budget") - F.col("below")) >= F.col("at"))
    s = s.withColumn("edge", F.col("prefix") + F.when(nearer, 1).otherwise(0))
    s = s.select(F.col("source").alias("src"), "source_size", "target", "times", F.expr("shiftleft(edge, bits)").alias("threshold"))
    out = d.join(s, d["source"].eqNullSafe(F.col("src")))
    out = out.withColumn("times", F.col("times") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source", "times")
