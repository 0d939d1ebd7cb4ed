"""Alignments projected from the ``orders`` table, by whole-number rules: two alignments for each order.

Places follow the customer keys, which are 64-bit, and so are 64-bit too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

READS = "bam_file string, qname string, flag int, tid int, pos int, mapq int, am int, rg string, mtid int, mpos int, isize int, qlen int, mate int"

_FRAGMENTS = """
WITH o AS (SELECT o_custkey AS cust, o_orderkey AS fid, (o_orderkey * 7919) % 1000 AS r, o_orderpriority AS prio FROM {orders}),
k AS (SELECT *, CAST(cust % 5 AS INT) AS tid, cust DIV 5 * 3000 AS base,
  CASE WHEN r % 10 < 5 THEN 'N' WHEN r % 20 = 19 THEN 'INS2' WHEN r % 20 = 9 THEN 'INS' WHEN r % 10 = 8 THEN 'CTX'
       ELSE element_at(array('DEL', 'INS', 'FF', 'RF', 'CTX', 'RR'), CAST(cust % 6 AS INT) + 1) END AS kind FROM o),
f AS (SELECT *, CASE WHEN kind = 'N' THEN 300 + r % 100 WHEN kind = 'INS' THEN 60 WHEN kind = 'INS2' THEN 50 WHEN kind = 'CTX' THEN 0 ELSE 800 + r % 40 END AS isize,
  base + r % 150 + CASE WHEN kind = 'INS2' THEN 800 ELSE 0 END AS pos1,
  CASE WHEN kind IN ('RR', 'RF') THEN 1 ELSE 0 END AS rev1, CASE WHEN kind IN ('FF', 'RF') THEN 0 ELSE 1 END AS rev2 FROM k)
SELECT fid, CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS lib, kind, 20 + r % 41 AS mapq, isize, 50 + fid % 3 AS qlen,
  tid AS tid1, pos1, rev1, CASE WHEN kind = 'CTX' THEN (tid + 1) % 5 ELSE tid END AS tid2,
  CASE WHEN kind = 'CTX' THEN base + 1500 + r % 100 ELSE pos1 + isize END AS pos2, rev2 FROM f"""


def reads_from_orders(spark: SparkSession, sf_dir: str, odd: bool = False) -> DataFrame:
    """The READS columns, pos and mpos as long. ``odd`` adds records of every rare kind: secondary, duplicate, unmapped, unplaced, AM tags, unknown read groups."""
    path = f"{sf_dir}/orders.parquet"
    f = spark.sql(_FRAGMENTS.replace("{orders}", f"parquet.`{path}`"))
    c = F.col

    def mate(n: int) -> F.Column:
        o = 3 - n
        flag = F.lit(1) + F.when(c("kind") == "N", 2).otherwise(0) + 16 * c(f"rev{n}") + 32 * c(f"rev{o}") + (64 if n == 1 else 128)
        tid, am, rg = c(f"tid{n}"), F.lit(None).cast("int"), F.concat(F.lit("rg"), c("lib"))
        if odd:
            for step, bit in ((97, 0x100), (89, 0x800), (83, 0x400), (79, 0x4), (73, 0x8)):
                flag = flag + F.when(c("fid") % step == n, bit).otherwise(0)
            tid = F.when(c("fid") % 71 == n, -1).otherwise(tid)
            am = F.when(c("fid") % 7 == 0, (c("fid") * 31 % 60).cast("int"))
            rg = F.when(c("fid") % 53 == 0, F.lit(None).cast("string")).when(c("fid") % 59 == 0, F.lit("rgX")).otherwise(rg)
        return F.struct(
            F.concat(F.lower("lib"), F.lit(".bam")).alias("bam_file"), F.concat(F.lit("q"), c("fid").cast("string")).alias("qname"), flag.cast("int").alias("flag"), tid.cast("int").alias("tid"),
            c(f"pos{n}").cast("long").alias("pos"), c("mapq").cast("int").alias("mapq"), am.alias("am"), rg.alias("rg"), c(f"tid{o}").cast("int").alias("mtid"), c(f"pos{o}").cast("long").alias("mpos"),
            c("isize").cast("int").alias("isize"), c("qlen").cast("int").alias("qlen"), F.lit(n).alias("mate"),
        )

    return f.select(F.inline(F.array(mate(1), mate(2))))
