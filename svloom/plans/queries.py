"""The queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import flags as fl
from ..functions.score import fisher, log_poisson_sf, phred
from ..operators import calls, estimate, filters, links, regions, stats
from ..operators.filters import Library
from ..options import Options
from ..ship import shared_dir
from ..sinks import bed_lines, call_lines, fastq_records, header_lines, support_text, supporting
from ..sources import alignments, config
from ..sources.reads import reads_from_orders
from ..streaming.sessions import region_sessions
from . import sql
from .pipeline import Analysis

c = F.col
LIBS = [Library("libA", "a.bam", 350.0, 33.0, 450.0, 200.0, 51.0), Library("libB", "b.bam", 340.0, 32.0, 440.0, 210.0, 51.0, 30)]
RG_LIB = {"rgA": "libA", "rgB": "libB"}
#: Read length of coordinates where the query is to be independent of batches.
PAD = 51
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def analysis(spark: SparkSession, sf_dir: str, odd: bool = False, **more) -> Analysis:
    return Analysis(reads_from_orders(spark, sf_dir, odd), LIBS, RG_LIB, window=more.pop("window", 250), **more)


def with_(*parts: str) -> str:
    return "WITH" + sql.reads(True) + "," + sql.ENRICHED + "".join(parts)


def plain(*parts: str) -> str:
    return "WITH RECURSIVE" + sql.reads() + "," + sql.ENRICHED + "".join(parts)


def as_int(df: DataFrame, *names: str) -> DataFrame:
    """Places in the type of the SQL; one beyond it is an error in both."""
    return df.withColumns({n: c(n).cast("int") for n in names})


ALL = "bam_file, qname, flag, tid, pos, mapq, am, rg, mtid, mpos, isize, qlen, mate"


@query("WITH" + sql.reads(True) + f" SELECT {ALL} FROM reads")
def s4_pooled_reads(spark, sf_dir):
    return as_int(reads_from_orders(spark, sf_dir, odd=True), "pos", "mpos")


@query("WITH" + sql.reads(True) + ", r AS (SELECT *, row_number() OVER (ORDER BY tid, pos, flag & 16, qname, mate) - 1 AS place FROM reads WHERE flag & 2304 = 0 AND tid >= 0) SELECT qname, mate, place FROM r")
def s4_merge_order(spark, sf_dir):
    d = filters.scanned(reads_from_orders(spark, sf_dir, True)).withColumn("rev", fl.reverse())
    return regions.running(d, {"place": F.lit(1)}).select("qname", "mate", (c("place") - 1).alias("place"))


@query("WITH" + sql.reads(True) + " SELECT qname, mate, pos FROM reads WHERE flag & 2304 = 0 AND tid = 2 AND pos + qlen > 3000 AND pos < 90000")
def s2_region_scan(spark, sf_dir):
    return filters.scanned(reads_from_orders(spark, sf_dir, True), 2, 3000, 90000).select("qname", "mate", c("pos").cast("int").alias("pos"))


@query("WITH" + sql.reads(True) + " SELECT qname, mate, flag & 2304 = 0 AS is_primary, tid >= 0 AS aligned, flag & 1039 = 3 AS proper, flag & 12 <> 0 AS unmapped, tid <> mtid AS inter, pos < mpos AS leftmost FROM reads")
def f1_f7_predicates(spark, sf_dir):
    return reads_from_orders(spark, sf_dir, True).select("qname", "mate", fl.primary().alias("is_primary"), fl.aligned().alias("aligned"), fl.proper_pair().alias("proper"), fl.either_unmapped().alias("unmapped"), fl.interchromosomal().alias("inter"), fl.leftmost().alias("leftmost"))


@query(with_(" SELECT qname, mate, cls FROM adm".join([sql.ADMITTED, ""])))
def f8_admission(spark, sf_dir):
    return analysis(spark, sf_dir, True).admitted.select("qname", "mate", "cls")


@query(with_(" SELECT qname, mate, cls FROM enriched WHERE cls = 8 AND flag & 12 = 0 AND bdqual > need"))
def f8_only_inter_contig(spark, sf_dir):
    return analysis(spark, sf_dir, True, opts=Options(only_ctx=True)).admitted.select("qname", "mate", "cls")


@query(with_(sql.PASS1, " SELECT qname, mate, bdqual, need FROM pass1"))
def f9_f10_counting_pass(spark, sf_dir):
    return filters.counted_pairs(analysis(spark, sf_dir, True).reads).select("qname", "mate", "bdqual", "need")


@query(with_(sql.ADMITTED, " SELECT qname, mate, cls FROM ano"))
def f11_anomalous(spark, sf_dir):
    return filters.anomalous(analysis(spark, sf_dir, True).admitted).select("qname", "mate", "cls")


@query("WITH" + sql.reads(True) + " SELECT qname, mate, CASE WHEN rg = 'rgB' THEN 'libB' ELSE 'libA' END AS lib FROM reads")
def j1_library_of_read_group(spark, sf_dir):
    return filters.attach_library(reads_from_orders(spark, sf_dir, True), RG_LIB, LIBS).select("qname", "mate", "lib")


@query(with_(" SELECT qname, mate, lib, bdqual, rev, cls, CAST(upper_cut AS DOUBLE) AS upper, CAST(lower_cut AS DOUBLE) AS lower FROM enriched"))
def j2_j3_enriched(spark, sf_dir):
    return analysis(spark, sf_dir, True).reads.select("qname", "mate", "lib", "bdqual", "rev", "cls", "upper", "lower")


@query("WITH" + sql.reads() + " SELECT qname, mate, 'chr' || (tid + 1) AS contig FROM reads")
def j9_contig_name(spark, sf_dir):
    from ..sinks import named

    contigs = spark.range(5).select(c("id").cast("int").alias("tid"), F.concat(F.lit("chr"), (c("id") + 1).cast("string")).alias("contig"))
    return named(reads_from_orders(spark, sf_dir), contigs, name="contig").select("qname", "mate", "contig")


@query(with_(" SELECT cls, count(*) AS n FROM enriched GROUP BY cls"))
def c1_c2_classes(spark, sf_dir):
    return analysis(spark, sf_dir, True).reads.groupBy("cls").agg(F.count("*").alias("n"))


@query(with_(", x AS (SELECT *, CASE WHEN cls = 4 AND abs(isize) < upper_cut THEN 7 ELSE cls END AS c2 FROM enriched) SELECT qname, mate, CASE WHEN c2 = 7 AND abs(isize) < lower_cut THEN 3 ELSE c2 END AS cls FROM x"))
def c3_mate_pair_classes(spark, sf_dir):
    return analysis(spark, sf_dir, True, opts=Options(long_insert=True)).reads.select("qname", "mate", "cls")


@query(with_(" SELECT qname, mate, CASE cls WHEN 1 THEN 'INV' WHEN 5 THEN 'INV' WHEN 2 THEN 'DEL' WHEN 3 THEN 'INS' WHEN 4 THEN 'ITX' WHEN 8 THEN 'CTX' END AS type, CASE cls WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 8 WHEN 6 THEN 18 WHEN 8 THEN 32 WHEN 9 THEN 64 WHEN 10 THEN 192 ELSE 0 END AS code FROM enriched"))
def c5_types_and_codes(spark, sf_dir):
    return analysis(spark, sf_dir, True).reads.select("qname", "mate", fl.call_type(c("cls")).alias("type"), fl.external_code(c("cls")).alias("code"))


LEGACY = with_(
    """, leg AS (SELECT *, CASE WHEN flag & 1024 <> 0 OR flag & 1 = 0 THEN 0 WHEN flag & 4 <> 0 THEN 192 WHEN flag & 8 <> 0 THEN 64 WHEN tid <> mtid THEN 32
    WHEN flag & 2 <> 0 THEN CASE WHEN pos < mpos THEN CASE rev WHEN 0 THEN 18 ELSE 20 END ELSE CASE rev WHEN 0 THEN 20 ELSE 18 END END
    WHEN flag & 48 = 0 THEN 1 WHEN flag & 48 = 48 THEN 8 WHEN (mpos > pos AND rev = 1) OR (pos > mpos AND rev = 0) THEN 4 ELSE 2 END AS code,
    CASE WHEN tid <> mtid THEN 0 WHEN mate = 1 THEN isize ELSE -isize END AS dist FROM enriched)"""
)


def legacy(spark, sf_dir) -> DataFrame:
    d = analysis(spark, sf_dir, True).reads
    d = d.withColumns({"flag_text": c("flag").cast("string"), "mchr": F.when(c("tid") == c("mtid"), "=").otherwise(c("mtid").cast("string")), "platform": F.lit("illumina"), "mf": F.lit(None).cast("int")})
    dist = F.when(c("tid") != c("mtid"), 0).when(c("mate") == 1, c("isize")).otherwise(-c("isize"))
    return d.withColumn("code", fl.legacy_code()).withColumn("dist", dist)


@query(LEGACY + " SELECT qname, mate, code FROM leg")
def c7_legacy_codes(spark, sf_dir):
    return legacy(spark, sf_dir).select("qname", "mate", "code")


@query(with_(sql.HIST, " SELECT * FROM hist"))
def a1_a3_flag_histogram(spark, sf_dir):
    return analysis(spark, sf_dir, True).hist


@query(with_(sql.PASS1, " SELECT bam_file, count(*) FILTER (flag & 1039 = 3) AS reads FROM pass1 GROUP BY bam_file"))
def a2_file_counts(spark, sf_dir):
    return analysis(spark, sf_dir, True).files


@query(with_(sql.COVERED, " SELECT CAST(covered AS BIGINT) AS covered FROM cov"))
def a4_covered_length(spark, sf_dir):
    return analysis(spark, sf_dir, True).covered


@query(with_(sql.HIST, sql.COVERED, " SELECT lib, reads, CAST(covered AS BIGINT) AS covered, round(reads * 51.0::DOUBLE / covered, 9) AS sequence_coverage, round(reads * CASE lib WHEN 'libA' THEN 350.0::DOUBLE ELSE 340.0::DOUBLE END / (covered * 2), 9) AS physical_coverage FROM hist, cov"))
def a5_a6_coverage(spark, sf_dir):
    a = analysis(spark, sf_dir, True)
    x = stats.coverage(a.hist, a.library_rows, a.covered)
    return x.withColumns({n: F.round(n, 9) for n in ("sequence_coverage", "physical_coverage")})


@query(with_(sql.HIST, sql.COVERED, " SELECT lib AS key, round(CAST(reads AS DOUBLE) / covered, 9) AS density FROM hist, cov UNION ALL SELECT bam_file, round(count(*) FILTER (flag & 1039 = 3) / max(covered)::DOUBLE, 9) FROM pass1, cov GROUP BY bam_file"))
def a7_density(spark, sf_dir):
    a = analysis(spark, sf_dir, True)
    both = stats.density(a.hist, a.files, a.covered, True).unionByName(stats.density(a.hist, a.files, a.covered))
    return both.select("key", F.round("density", 9).alias("density"))


@query(with_(sql.HIST, sql.COVERED, " SELECT CAST(least(min(CASE WHEN n2 + n3 > 0 THEN floor(covered / (n2 + n3)) ELSE 50 END), 238) AS BIGINT) AS \"window\" FROM hist, cov"))
def a8_window(spark, sf_dir):
    a = analysis(spark, sf_dir, True, window=None)
    return a.window_row


@query(plain(sql.ISLANDS, " SELECT qname, mate, CAST(island AS BIGINT) AS island FROM isl"))
def w1_islands(spark, sf_dir):
    return analysis(spark, sf_dir).anomalous.select("qname", "mate", "island")


@query(plain(sql.ISLANDS, " SELECT CAST(island AS BIGINT) AS island, tid, s AS start, e AS \"end\", n, CAST(nucleotides AS BIGINT) AS nucleotides, max_len, fwd, bwd AS rev FROM it"))
def w2_a13_island_table(spark, sf_dir):
    return as_int(analysis(spark, sf_dir).table, "start", "end").select("island", "tid", "start", "end", "n", "nucleotides", "max_len", "fwd", "rev")


@query(plain(sql.ISLANDS, " SELECT region, CAST(island AS BIGINT) AS island, tid, s AS start, e AS \"end\", round(coverage, 6) AS coverage, CAST(e - s + 1 AS BIGINT) AS size FROM reg"))
def w3_w4_f15_regions(spark, sf_dir):
    return as_int(analysis(spark, sf_dir).regions.select("region", "island", "tid", "start", "end", F.round("coverage", 6).alias("coverage"), (c("end") - c("start") + 1).alias("size")), "start", "end")


@query(plain(sql.PAIRS, " SELECT qname, a, b, cls, lib, size FROM pairs"))
def g1_g3_mate_pairs(spark, sf_dir):
    return analysis(spark, sf_dir).pairs.select("qname", "a", "b", "cls", "lib", "size")


@query(plain(sql.PAIRS, " SELECT qname, a, b, cls, lib, size FROM pairs").replace("'q' || fid AS qname", "'n' || fid % 997 AS qname"))
def g1_names_of_many_reads(spark, sf_dir):
    """Fragments of several files share names: the first two reads of a name are a pair."""
    reads = reads_from_orders(spark, sf_dir).withColumn("qname", F.concat(F.lit("n"), (F.substring("qname", 2, 20).cast("long") % 997).cast("string")))
    return Analysis(reads, LIBS, RG_LIB, window=250).pairs.select("qname", "a", "b", "cls", "lib", "size")


@query(plain(sql.PAIRS, " SELECT a, b, weight FROM edg WHERE weight >= 2"))
def g4_f17_edges(spark, sf_dir):
    return analysis(spark, sf_dir).edges.where("weight >= 2")


@query(plain(sql.PAIRS, """, run AS (SELECT qname, mate, """ + ", ".join(f"sum(CASE WHEN flag & 1039 = 3 AND bam_file = '{k}.bam' THEN 1 ELSE 0 END) OVER (ORDER BY tid, pos, rev, qname, mate ROWS UNBOUNDED PRECEDING) AS {k}" for k in "ab") + """ FROM adm),
rc AS (SELECT region, min(run.a) AS la, max(run.a) AS ha, min(run.b) AS lb, max(run.b) AS hb FROM run JOIN isl USING (qname, mate) JOIN reg USING (island) GROUP BY region),
bt AS (SELECT edg.a, edg.b, y.la - x.ha AS na, y.lb - x.hb AS nb FROM edg JOIN rc x ON x.region = edg.a JOIN rc y ON y.region = edg.b WHERE edg.a <> edg.b AND weight >= 2)
SELECT a, b, 'a.bam' AS key, CAST(na AS BIGINT) AS reads FROM bt WHERE na > 0 UNION ALL SELECT a, b, 'b.bam', CAST(nb AS BIGINT) FROM bt WHERE nb > 0"""))
def w5_between_counts(spark, sf_dir):
    return analysis(spark, sf_dir).between


@query(plain(sql.VOTES, " SELECT ea, eb, flag, flag_pairs, pairs FROM win"))
def w7_f18_majority(spark, sf_dir):
    v = calls.flag_votes(analysis(spark, sf_dir).owned)
    return v.where("flag_pairs >= 2").select("ea", "eb", "flag", "flag_pairs", "pairs")


@query(plain(sql.VOTES, " SELECT ea, eb, lib, bam_file, n, CAST(span AS BIGINT) AS span FROM sup"))
def a11_evidence(spark, sf_dir):
    return evidence(analysis(spark, sf_dir))


def evidence(a: Analysis) -> DataFrame:
    o = a.owned
    return calls.evidence(o, calls.flag_votes(o).where("flag_pairs >= 2"))


@query(plain(sql.VOTES, " SELECT ea, eb, bam_file AS key, CAST(sum(n) AS BIGINT) AS reads FROM sup GROUP BY ALL"))
def a12_evidence_by_file(spark, sf_dir):
    return a11_evidence(spark, sf_dir).groupBy("ea", "eb", c("bam_file").alias("key")).agg(F.sum("n").alias("reads"))


def placed(a: Analysis) -> DataFrame:
    v = calls.flag_votes(a.owned).where("flag_pairs >= 2")
    end = lambda n, k: a.regions.select(c("region").alias(k), c("start").alias(f"start{n}"), c("end").alias(f"end{n}"))
    x = v.join(end(1, "ea"), "ea").join(end(2, "eb"), "eb")
    x = x.withColumn("span_size", c("end1") - c("start1") + 1 + F.when(c("ea") == c("eb"), 0).otherwise(c("end2") - c("start2") + 1))
    return calls.breakpoints(x.withColumn("start2", F.when(c("ea") != c("eb"), c("start2"))).withColumn("pad", F.lit(PAD)))


@query(plain(sql.PLACES, " SELECT ea, eb, CAST(CASE WHEN flag NOT IN (4, 5) AND p1 + 46 < p2 THEN p1 + 46 ELSE p1 END + 1 AS BIGINT) AS pos1, CAST(p2 + 1 AS BIGINT) AS pos2, CAST(span_size AS BIGINT) AS span_size FROM bp"))
def p4_p5_g10_breakpoints(spark, sf_dir):
    x = placed(analysis(spark, sf_dir))
    return x.select("ea", "eb", (calls.padded(c("pos1"), c("pos2")) + 1).alias("pos1"), (c("pos2") + 1).alias("pos2"), c("span_size").cast("long").alias("span_size"))


@query(plain(sql.VOTES, " SELECT ea, eb, CAST(trunc(sum(span - n * CASE lib WHEN 'libA' THEN 350.0::DOUBLE ELSE 340.0::DOUBLE END) / sum(n) + 0.5::DOUBLE) AS BIGINT) AS size FROM sup GROUP BY ea, eb"))
def p7_sizes(spark, sf_dir):
    return calls.call_size(a11_evidence(spark, sf_dir), filters.library_table(spark.range(1), LIBS))


@query(plain(sql.HIST, sql.COVERED, sql.PLACES, ", tests AS (SELECT sup.ea, sup.eb, sup.n AS k, greatest(1e-10::DOUBLE, span_size::DOUBLE * [n0,n1,n2,n3,n4,n5,n6,n7,n8,n9,n10][sup.flag + 1] / covered) AS lam FROM sup JOIN bp USING (ea, eb) JOIN hist USING (lib), cov) SELECT ea, eb, round(sum(" + sql.TAIL + "), 6) AS log_p, CAST(least(99, trunc(-10 * sum(" + sql.TAIL + ") / ln(10) + 0.5::DOUBLE)) AS INTEGER) AS score FROM tests GROUP BY ea, eb"))
def p1_p3_scores(spark, sf_dir):
    a = analysis(spark, sf_dir)
    s = calls.log_score(placed(a), evidence(a), a.hist, a.covered)
    return s.select("ea", "eb", F.round("log_p", 6).alias("log_p"), phred(c("log_p")).alias("score"))


@query("WITH t AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS k, round(l_extendedprice / 1000) + 0.5::DOUBLE AS lam FROM lineitem), u AS (SELECT k, lam, " + sql.TAIL + " AS log_p FROM t) SELECT k, lam, round(log_p, 6) + 0 AS log_p FROM u WHERE log_p > -25")
def p1_poisson_tail(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_quantity").cast("int").alias("k"), (F.round(c("l_extendedprice") / 1000) + 0.5).alias("lam")).distinct()
    return t.withColumn("log_p", log_poisson_sf(c("k"), c("lam"))).where("log_p > -25").withColumn("log_p", F.round("log_p", 6) + F.lit(0.0))


@query("WITH t AS (SELECT DISTINCT l_linenumber AS n, -round(l_extendedprice / 1000) AS s FROM lineitem) SELECT n, s, round(greatest(-99, s + ln(list_sum(list_transform(range(0, n), lambda i: exp(i * ln(-s) - lgamma(i + 1)))))), 6) AS log_q FROM t WHERE s < 0")
def p2_fisher(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_linenumber").alias("n"), (-F.round(c("l_extendedprice") / 1000)).alias("s")).distinct().where("s < 0")
    return t.select("n", "s", F.round(fisher(c("s"), c("n")), 6).alias("log_q"))


CN_SQL = plain(sql.COVERED, sql.PASS1, sql.PLACES, SQL["w5_between_counts"].split(sql.PAIRS, 1)[1].split("\nSELECT a, b, 'a.bam'")[0], """, bk AS (SELECT a, b, 'a.bam' AS key, na AS reads FROM bt WHERE na > 0 UNION ALL SELECT a, b, 'b.bam', nb FROM bt WHERE nb > 0),
den AS (SELECT bam_file AS key, count(*) FILTER (flag & 1039 = 3) / max(covered)::DOUBLE AS density FROM pass1, cov GROUP BY bam_file),
cn AS (SELECT ea, eb, key, CAST(reads AS BIGINT) AS reads, CASE WHEN p2 <> p1 THEN reads / (density * (p2 - p1)) * 2 END AS copies FROM bk JOIN bp ON ea = bk.a AND eb = bk.b JOIN den USING (key))""")


@query(CN_SQL + " SELECT ea, eb, key, reads, round(copies, 6) AS copies FROM cn")
def p8_copy_number(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return calls.copy_numbers(a.between, a.density, placed(a)).withColumn("copies", F.round("copies", 6))


@query(CN_SQL + " SELECT ea, eb, round(1 - sum(copies) / (2.0::DOUBLE * count(*)), 6) AS allele_frequency FROM cn GROUP BY ea, eb")
def p9_allele_frequency(spark, sf_dir):
    a = analysis(spark, sf_dir)
    cn = calls.copy_numbers(a.between, a.density, placed(a))
    return cn.groupBy("ea", "eb").agg(F.round(1 - F.sum("copies") / (2.0 * F.count("*")), 6).alias("allele_frequency"))


@query(plain(sql.WALK, " SELECT CAST(flush AS BIGINT) AS flush, a, b, weight, rank FROM wlk"))
def g5_g6_visit_order(spark, sf_dir):
    return analysis(spark, sf_dir).order


@query(plain(sql.OWNED, " SELECT qname, a, b, CAST(flush AS BIGINT) AS flush, rank, ea, eb FROM owned"))
def g7_owned_pairs(spark, sf_dir):
    return analysis(spark, sf_dir).owned.select("qname", "a", "b", "flush", "rank", "ea", "eb")


#: Pads of batches, places with them, copies, scores, sizes and support of every call, printed as the call table's rows.
CALLS_SQL = plain(sql.COVERED, sql.HIST, sql.PLACES, """, lst AS (SELECT max_len FROM it ORDER BY island DESC LIMIT 1),
shu AS (SELECT region // 101 AS flush, max(CASE WHEN region % 101 = 100 THEN max_len END) AS closing FROM reg GROUP BY 1),
bq AS (SELECT pl.*, wlk.flush, wlk.rank, coalesce(closing, (SELECT max_len FROM lst)) - 5 AS gap, x.tid AS t1, y.tid AS t2, x.fwd AS f1, x.bwd AS r1, y.fwd AS f2, y.bwd AS r2,
    CASE WHEN ea = eb OR flag IN (4, 5) THEN s1 ELSE e1 END AS p1, CASE WHEN ea = eb THEN e1 WHEN flag IN (1, 4) THEN e2 + coalesce(closing, (SELECT max_len FROM lst)) - 5 ELSE s2 END AS p2
  FROM pl JOIN wlk ON wlk.a = ea AND wlk.b = eb JOIN shu ON shu.flush = wlk.flush JOIN reg x ON x.region = ea JOIN reg y ON y.region = eb)""", CN_SQL.split(sql.PLACES, 1)[1].replace("JOIN bp ON", "JOIN bq ON"), """,
tst AS (SELECT sup.ea, sup.eb, sup.n AS k, greatest(1e-10::DOUBLE, span_size::DOUBLE * [n0,n1,n2,n3,n4,n5,n6,n7,n8,n9,n10][sup.flag + 1] / covered) AS lam FROM sup JOIN pl USING (ea, eb) JOIN hist USING (lib), cov),
sco AS (SELECT ea, eb, CAST(least(99, trunc(-10 * sum(""" + sql.TAIL + """) / ln(10) + 0.5::DOUBLE)) AS INTEGER) AS score FROM tst GROUP BY ea, eb),
siz AS (SELECT ea, eb, CAST(trunc(sum(span - n * CASE lib WHEN 'libA' THEN 350.0::DOUBLE ELSE 340.0::DOUBLE END) / sum(n) + 0.5::DOUBLE) AS BIGINT) AS size FROM sup GROUP BY ea, eb),
byf AS (SELECT ea, eb, bam_file, CAST(sum(n) AS BIGINT) AS n FROM sup GROUP BY ALL), txt AS (SELECT ea, eb, string_agg(bam_file || '|' || n, ':' ORDER BY bam_file) AS support FROM byf GROUP BY ea, eb),
cpy AS (SELECT ea, eb, max(CASE WHEN key = 'a.bam' THEN printf('%.2f', copies) END) AS ca, max(CASE WHEN key = 'b.bam' THEN printf('%.2f', copies) END) AS cb FROM cn GROUP BY ea, eb),
typ AS (SELECT bq.*, score, size, support, ca, cb, CASE flag WHEN 1 THEN 'INV' WHEN 2 THEN 'DEL' WHEN 3 THEN 'INS' WHEN 4 THEN 'ITX' WHEN 5 THEN 'INV' WHEN 8 THEN 'CTX' END AS type,
    CASE WHEN flag NOT IN (4, 5) AND p1 + gap < p2 THEN p1 + gap ELSE p1 END + 1 AS q1 FROM bq JOIN sco USING (ea, eb) JOIN siz USING (ea, eb) JOIN txt USING (ea, eb) LEFT JOIN cpy USING (ea, eb) WHERE score > 30)""")


@query()
def sv_calls(spark, sf_dir):
    return analysis(spark, sf_dir).calls


@query()
def sv_calls_per_library(spark, sf_dir):
    return analysis(spark, sf_dir, True, window=None, opts=Options(per_library=True, fisher=True, score_threshold=0)).calls


def contig_names(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(c("id").cast("int").alias("tid"), F.concat(F.lit("chr"), (c("id") + 1).cast("string")).alias("contig"))


@query(CALLS_SQL + """ SELECT CAST(flush AS BIGINT) AS flush, rank, concat_ws(chr(9), 'chr' || (t1 + 1), q1, f1 || '+' || r1 || '-', 'chr' || (t2 + 1), p2 + 1, f2 || '+' || r2 || '-', type, size, score, flag_pairs, support,
  CASE WHEN type <> 'CTX' THEN coalesce(ca, 'NA') || chr(9) || coalesce(cb, 'NA') END) AS value FROM typ""")
def s9_p10_p12_call_text(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return call_lines(a.calls, contig_names(spark), a.keys).select("flush", "rank", "value")


@query()
def s9_header_text(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return header_lines(stats.coverage(a.hist, a.library_rows, a.covered), a.hist, a.library_rows, "svloom", a.keys)


@query(CALLS_SQL + """, rds AS (SELECT typ.ea, typ.eb, typ.flag, typ.t1, two.* EXCLUDE (k), CASE WHEN k = 2 THEN 1 ELSE 0 END AS later FROM typ JOIN owned p ON p.ea = typ.ea AND p.eb = typ.eb JOIN two ON two.qname = p.qname AND k <= 2 WHERE two.cls = typ.flag)
SELECT ea, eb, '1' || qname || later AS no, concat_ws(chr(9), 'chr' || (tid + 1), pos, pos + qlen, qname || '|' || lib, bdqual * 10, rev, pos, pos + qlen, CASE rev WHEN 0 THEN '0,0,255' ELSE '255,0,0' END) AS value FROM rds
UNION ALL SELECT ea, eb, '0', 'track name=chr' || (t1 + 1) || '_' || q1 || '_' || type || '_' || size || ' description="svloom chr' || (t1 + 1) || ' ' || q1 || ' ' || type || ' ' || size || '" useScore=0' FROM typ""")
def s10_bed_text(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return bed_lines(supporting(a.owned, a.calls), contig_names(spark))


@query(LEGACY + " SELECT lib, round(avg(qlen), 6) AS readlen FROM leg GROUP BY lib")
def a14_read_length(spark, sf_dir):
    return estimate.read_lengths(legacy(spark, sf_dir)).select("lib", F.round("readlen", 6).alias("readlen"))


OBS = LEGACY + ", obs AS (SELECT lib, dist FROM leg WHERE bdqual > 35 AND code IN (18, 20) AND dist >= 0), fst AS (SELECT lib, avg(dist) AS m, stddev_samp(dist) AS s FROM obs GROUP BY lib), kept AS (SELECT obs.* FROM obs JOIN fst USING (lib) WHERE dist <= m + 5 * s), st AS (SELECT lib, count(*) AS n, avg(dist) AS mean, stddev_samp(dist) AS std FROM kept GROUP BY lib)"


@query(OBS + " SELECT lib, n, round(mean, 6) AS mean, round(std, 6) AS std FROM st WHERE mean >= 50 AND std / mean < 1 AND n >= 100")
def a15_a18_f12_f13_insert_stats(spark, sf_dir):
    s = estimate.good_libraries(estimate.insert_stats(estimate.usable(legacy(spark, sf_dir))))
    return s.select("lib", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SIDES = OBS + ", sd AS (SELECT lib, max(mean) AS mean, sqrt(sum(CASE WHEN dist <= mean THEN (dist - mean) ** 2 END) / (count(*) FILTER (dist <= mean) - 1)) AS sd_below, sqrt(sum(CASE WHEN dist > mean THEN (dist - mean) ** 2 END) / (count(*) FILTER (dist > mean) - 1)) AS sd_above FROM kept JOIN st USING (lib) GROUP BY lib)"


def sides(spark, sf_dir) -> DataFrame:
    obs = estimate.usable(legacy(spark, sf_dir))
    return estimate.one_sided(obs, estimate.insert_stats(obs).drop("n"))


@query(SIDES + " SELECT lib, round(sd_below, 6) AS sd_below, round(sd_above, 6) AS sd_above FROM sd")
def a16_one_sided_deviation(spark, sf_dir):
    return sides(spark, sf_dir).select("lib", F.round("sd_below", 6).alias("sd_below"), F.round("sd_above", 6).alias("sd_above"))


@query(SIDES + " SELECT lib, round(mean + 4 * sd_above, 6) AS upper, round(greatest(0, mean - 4 * sd_below), 6) AS lower FROM sd")
def a17_cutoffs(spark, sf_dir):
    return estimate.cutoffs(sides(spark, sf_dir)).select("lib", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


@query(LEGACY + " SELECT coalesce(rg, 'NA') AS rg, code, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY coalesce(rg, 'NA')), 6) AS percent, CAST(sum(count(*)) OVER (PARTITION BY coalesce(rg, 'NA')) AS BIGINT) AS total FROM leg GROUP BY 1, 2")
def a19_code_histogram(spark, sf_dir):
    return estimate.code_histogram(legacy(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(OBS + ", o2 AS (SELECT lib, qname, mate, row_number() OVER (PARTITION BY lib ORDER BY tid, pos, qname, mate) AS k FROM leg WHERE bdqual > 35 AND code IN (18, 20) AND dist >= 0) SELECT lib, qname, mate FROM o2 WHERE k <= 101")
def a20_sample(spark, sf_dir):
    return estimate.sampled(estimate.usable(legacy(spark, sf_dir)), 100).select("lib", "qname", "mate")


@query(OBS + " SELECT lib, CAST(dist // 10 * 10 AS BIGINT) AS bin, count(*) AS n FROM obs GROUP BY ALL")
def s19_size_histogram(spark, sf_dir):
    return estimate.size_histogram(estimate.usable(legacy(spark, sf_dir)))


@query()
def p14_p15_normality(spark, sf_dir):
    return estimate.normality(estimate.sampled(estimate.usable(legacy(spark, sf_dir))))


#: Of the estimator: each file names one library. Rows of a file up to its stop, for 100 observations.
FILE_LIBS = {"a.bam": 1, "b.bam": 1}


@query(LEGACY + """, good AS (SELECT *, code IN (18, 20) AND dist >= 0 AS obs FROM leg WHERE bdqual > 35 AND lib IS NOT NULL),
  gk AS (SELECT *, row_number() OVER w AS k, coalesce(count(*) FILTER (obs) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM good WINDOW w AS (PARTITION BY bam_file, lib ORDER BY tid, pos, qname, mate)),
  hk AS (SELECT *, coalesce(max(CASE WHEN greatest(seen, 1) / k < 0.0001 THEN 1 ELSE 0 END) OVER (PARTITION BY bam_file, lib ORDER BY tid, pos, qname, mate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM gk),
  ok AS (SELECT *, row_number() OVER (PARTITION BY bam_file ORDER BY tid, pos, qname, mate) AS no FROM hk WHERE seen <= 100 AND gone = 0)
SELECT lib, qname, mate FROM ok WHERE no <= 301 AND obs""")
def a20_overall_stop(spark, sf_dir):
    d = legacy(spark, sf_dir)
    return estimate.usable(estimate.until_stop(d, estimate.stops(d, FILE_LIBS, 100))).select("lib", "qname", "mate")


@query()
def s18_p14_estimator(spark, sf_dir):
    x = estimate.estimated(legacy(spark, sf_dir), FILE_LIBS)
    return estimate.config_lines(x.withColumns({"rg": c("lib"), "bam_file": F.concat("lib", F.lit(".bam"))}))


@query("WITH" + sql.reads() + ", n AS (SELECT *, CAST(substr(qname, 2) AS BIGINT) * 2 + mate AS no FROM reads), l AS (SELECT *, lag(tid) OVER w AS t, lag(pos) OVER w AS p FROM n WINDOW w AS (PARTITION BY bam_file ORDER BY no)) SELECT qname, mate FROM l WHERE t = tid AND pos < p")
def f14_out_of_order(spark, sf_dir):
    reads = reads_from_orders(spark, sf_dir).withColumn("no", F.expr("CAST(substr(qname, 2) AS BIGINT) * 2 + mate"))
    return estimate.out_of_order(reads, bits=10).select("qname", "mate")


def whole_records(spark, sf_dir) -> DataFrame:
    """The reads with names of contigs, cigar and bases."""
    contig = lambda t: F.when(c(t) >= 0, F.concat(F.lit("chr"), (c(t) + 1).cast("string"))).otherwise("*")
    more = {"contig": contig("tid"), "mcontig": contig("mtid"), "cigar": F.concat(c("qlen").cast("string"), F.lit("M")), "seq": F.repeat(F.lit("A"), c("qlen")), "qual": F.lit(None).cast("binary")}
    return reads_from_orders(spark, sf_dir, True).withColumns(more)


def as_bam(spark, sf_dir) -> str:
    """The reads as sorted BAM files with indices, in the shared folder."""
    path = f"{shared_dir(spark)}/svloom/bam-{uuid.uuid4().hex}"
    alignments.write_bam(whole_records(spark, sf_dir), path, [(f"chr{i + 1}", (1 << 29) - 1) for i in range(5)])
    return path


@query("WITH" + sql.reads(True) + """ SELECT qname || chr(9) || flag || chr(9) || CASE WHEN tid < 0 THEN '*' ELSE 'chr' || (tid + 1) END || chr(9) || (pos + 1) || chr(9) || mapq || chr(9) || qlen || 'M' || chr(9)
  || CASE WHEN tid = mtid AND tid >= 0 THEN '=' WHEN mtid < 0 THEN '*' ELSE 'chr' || (mtid + 1) END || chr(9) || (mpos + 1) || chr(9) || isize || chr(9) || repeat('A', qlen) || chr(9) || '*'
  || coalesce(chr(9) || 'RG:Z:' || rg, '') || coalesce(chr(9) || 'AM:i:' || am, '') AS value FROM reads""")
def s5_sam_text(spark, sf_dir):
    return alignments.sam_lines(whole_records(spark, sf_dir))


@query("WITH" + sql.reads(True) + " SELECT qname, flag, tid, pos, mapq, am, rg, mtid, mpos, isize, qlen, mate, qlen || 'M' AS cigar, repeat('A', qlen) AS seq FROM reads")
def s1_s5_bam_round_trip(spark, sf_dir):
    back = alignments.read_bam(spark, as_bam(spark, sf_dir), split=1 << 20)
    return back.select("qname", "flag", "tid", "pos", "mapq", "am", "rg", "mtid", "mpos", "isize", "qlen", "mate", "cigar", "seq")


@query("WITH" + sql.reads(True) + " SELECT qname, mate, pos FROM reads WHERE tid = 2 AND pos + qlen > 3000 AND pos < 90000")
def s2_region_by_index(spark, sf_dir):
    return alignments.read_bam(spark, as_bam(spark, sf_dir), with_seq=False, region="chr3:3001-90000").select("qname", "mate", "pos")


@query("WITH" + sql.reads(True) + " SELECT qname, mate, mapq FROM reads WHERE flag & 2304 = 0 AND tid IN (0, 3) AND mapq > 35 AND isize < 800")
def f1_f8_conditions_of_bam(spark, sf_dir):
    asked = [("tid", "in", [0, 3]), ("mapq", ">", 35), ("isize", "<", 800)]
    return alignments.read_bam(spark, as_bam(spark, sf_dir), with_seq=False, conditions=asked, flags_none=2304).select("qname", "mate", "mapq")



@query(plain(sql.VOTES, """, ends AS (SELECT two.qname, mate, two.lib, two.cls, k, qlen, x.flag FROM two JOIN owned p ON p.qname = two.qname AND two.k <= 2 JOIN win x ON x.ea = p.ea AND x.eb = p.eb)
SELECT lib, CAST(k AS INTEGER) AS file, '@' || qname || chr(10) || repeat('ACGT', qlen // 4) || chr(10) || '+' || chr(10) || CASE WHEN mate = 1 THEN repeat('I', qlen // 4 * 4) ELSE '' END AS value FROM ends WHERE cls = flag"""))
def s11_s13_fastq_text(spark, sf_dir):
    o = analysis(spark, sf_dir).owned
    found = calls.flag_votes(o).where("flag_pairs >= 2").select("ea", "eb", "flag", "flush", "rank", *[F.lit(0).alias(n) for n in ("type", "size", "pos1", "pos2", "tid1")])
    size = F.expr("qlen div 4").cast("int")
    qual = F.when(c("mate") == 1, F.encode(F.repeat(F.lit("I"), size * 4), "utf-8"))
    bases = reads_from_orders(spark, sf_dir).select("qname", "mate", F.repeat(F.lit("ACGT"), size).alias("seq"), qual.alias("qual"))
    return fastq_records(supporting(o, found), bases)


@query(plain(sql.PAIRS, " SELECT qname, mate, region FROM rr JOIN big USING (region)"))
def g2_g3_region_reads(spark, sf_dir):
    return analysis(spark, sf_dir).region_reads.select("qname", "mate", "region")


@query(plain(sql.ISLANDS, " SELECT region, tid, s AS start, e AS \"end\", n AS reads, fwd, bwd AS rev, max_len FROM reg"))
def s15_region_summary(spark, sf_dir):
    return as_int(analysis(spark, sf_dir).regions, "start", "end").select("region", "tid", "start", "end", c("n").alias("reads"), "fwd", "rev", "max_len")


@query(plain(sql.ISLANDS, ", last AS (SELECT max_len FROM it ORDER BY island DESC LIMIT 1), shut AS (SELECT region // 101 AS flush, max(CASE WHEN region % 101 = 100 THEN max_len END) AS own FROM reg GROUP BY 1) SELECT CAST(flush AS BIGINT) AS flush, CAST(coalesce(own, (SELECT max_len FROM last)) AS INTEGER) AS pad FROM shut"))
def p6_pad_lengths(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return calls.pad_lengths(a.table, a.regions, a.opts)


@query(plain(sql.VOTES, ", byfile AS (SELECT ea, eb, bam_file, CAST(sum(n) AS BIGINT) AS n FROM sup GROUP BY ALL) SELECT ea, eb, string_agg(bam_file || '|' || n, ':' ORDER BY bam_file) AS support FROM byfile GROUP BY ea, eb"))
def p11_support_text(spark, sf_dir):
    lists = a12_evidence_by_file(spark, sf_dir).groupBy("ea", "eb").agg(F.array_sort(F.collect_list(F.struct("key", "reads"))).alias("support"))
    return lists.select("ea", "eb", support_text().alias("support"))


@query(SQL["p1_p3_scores"].replace("SELECT ea, eb, round(sum(", "SELECT * FROM (SELECT ea, eb, round(sum(") + ") WHERE score > 30")
def f16_score_filter(spark, sf_dir):
    return p1_p3_scores(spark, sf_dir).where(c("score") > Options().score_threshold)


@query(SIDES + """, len AS (SELECT lib, avg(qlen) AS readlen FROM leg GROUP BY lib) SELECT concat_ws(chr(9), 'readgroup:' || lib, 'platform:illumina', 'map:' || lib || '.bam', printf('readlen:%.2f', readlen), 'lib:' || lib, 'num:' || n,
  printf('lower:%.2f', greatest(0, st.mean - 4 * sd_below)), printf('upper:%.2f', st.mean + 4 * sd_above), printf('mean:%.2f', st.mean), printf('std:%.2f', st.std), 'exe:samtools view') AS value FROM sd JOIN st USING (lib) JOIN len USING (lib)""")
def s18_estimated_config_text(spark, sf_dir):
    d = legacy(spark, sf_dir)
    obs = estimate.usable(d)
    first = estimate.insert_stats(obs)
    x = estimate.cutoffs(estimate.one_sided(obs, first.drop("n"))).select("lib", "lower", "upper").join(first.select("lib", "n", "mean", "std"), "lib").join(estimate.read_lengths(d), "lib")
    return estimate.config_lines(x.withColumns({"rg": c("lib"), "bam_file": F.concat("lib", F.lit(".bam"))}))


#: Configuration lines made from ``supplier``: odd ones lack cutoffs, name a sample only, or bring a quality.
CONFIG_SQL = """line AS (SELECT s_suppkey - 1 AS line_no, s_suppkey AS k,
  'readgroup:rg' || s_suppkey || chr(9) || 'platform:illumina' || chr(9) || 'map:f' || (s_suppkey % 7) || '.bam' || chr(9) || 'readlen:' || (50 + s_suppkey % 3) || chr(9)
  || CASE WHEN s_suppkey % 4 = 0 THEN 'sample' ELSE 'lib' END || ':lib' || (s_suppkey % 11) || chr(9) || 'num:1' || chr(9)
  || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'lower:' || (100 + s_suppkey % 13) || chr(9) END || 'Upper:' || (500 + s_suppkey % 17) || chr(9) || 'mean:' || (300 + s_suppkey % 19) || chr(9) || 'std:' || (20 + s_suppkey % 5)
  || CASE WHEN s_suppkey % 5 = 0 THEN chr(9) || 'mapqual:' || (s_suppkey % 40) ELSE '' END AS value FROM supplier)"""
PARSED_SQL = "WITH " + CONFIG_SQL + """, p AS (SELECT line_no, 'f' || (k % 7) || '.bam' AS bam_file, 'lib' || (k % 11) AS lib, 'rg' || k AS rg, CAST(300 + k % 19 AS DOUBLE) AS mean, CAST(20 + k % 5 AS DOUBLE) AS std,
  CASE WHEN k % 3 = 0 THEN 300 + k % 19 + 3.0::DOUBLE * (20 + k % 5) ELSE CAST(500 + k % 17 AS DOUBLE) END AS upper, CASE WHEN k % 3 = 0 THEN greatest(0, 300 + k % 19 - 3.0::DOUBLE * (20 + k % 5)) ELSE CAST(100 + k % 13 AS DOUBLE) END AS lower,
  CAST(50 + k % 3 AS DOUBLE) AS readlen, CAST(CASE WHEN k % 5 = 0 THEN k % 40 ELSE -1 END AS INTEGER) AS min_mapq FROM line)"""


def config_rows(spark, sf_dir) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("_suppliers")
    return config.parse(spark.sql("WITH " + CONFIG_SQL.replace("FROM supplier", "FROM _suppliers") + " SELECT line_no, value FROM line"))


@query(PARSED_SQL + " SELECT line_no, bam_file, lib, rg, mean, std, upper, lower, readlen, min_mapq FROM p")
def s6_s8_j4_j7_config(spark, sf_dir):
    return config_rows(spark, sf_dir)


@query(PARSED_SQL + ", l AS (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY line_no DESC) AS r FROM p) SELECT lib, bam_file, mean, std, upper, lower, readlen, min_mapq, CAST(row_number() OVER (ORDER BY lib) - 1 AS INTEGER) AS lib_index FROM l WHERE r = 1")
def j5_libraries(spark, sf_dir):
    return config.libraries(config_rows(spark, sf_dir))


@query(PARSED_SQL + ", l AS (SELECT *, row_number() OVER (PARTITION BY bam_file ORDER BY line_no DESC) AS r FROM p) SELECT bam_file, lib, CAST(row_number() OVER (ORDER BY bam_file) - 1 AS INTEGER) AS bam_index FROM l WHERE r = 1")
def j6_files(spark, sf_dir):
    return config.files(config_rows(spark, sf_dir))


@query(PARSED_SQL + " SELECT CAST(greatest(50, least(100000000, min(trunc(mean - 2 * readlen)))) AS BIGINT) AS \"window\" FROM p")
def j8_first_window(spark, sf_dir):
    return config.first_window(config_rows(spark, sf_dir))


@query(plain(sql.ISLANDS, " SELECT tid, s AS start, e AS \"end\", n, CAST((SELECT sum(qlen) FROM isl WHERE isl.island = it.island) AS BIGINT) AS bases FROM it"))
def w1_session_windows(spark, sf_dir):
    return as_int(region_sessions(filters.anomalous(analysis(spark, sf_dir).admitted), 250), "start", "end")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region pairs, their majority class and its pairs."""
    return w7_f18_majority(spark, sf_dir)
