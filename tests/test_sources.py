"""Sources, sinks, configuration, estimator, streaming."""

import gzip
import math
import struct
import zlib

import numpy as np
import plain_bam
import pytest
from pyspark.sql import functions as F

from svloom import sinks
from svloom.functions import flags as fl
from svloom.functions.score import fisher, log_poisson_sf, phred
from svloom.operators import estimate, filters
from svloom.options import Options
from svloom.plans import queries as q
from svloom.sources import alignments as al
from svloom.sources import config
from svloom.streaming.sessions import region_sessions
from tests_blocks import blocked

SF = "/root/testdata/sf0.001"
SAM = "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:900\n@SQ\tSN:c2\tLN:500\n" + "\n".join(
    ["r1\t99\tc1\t11\t60\t4M\t=\t101\t94\tACGT\tIIII\tRG:Z:g1\tAM:i:37", "r1\t147\tc1\t101\t60\t4M\t=\t11\t-94\tTTTT\t####\tRG:Z:g1\tAq:i:21", "r2\t97\tc1\t20\t40\t4M\tc2\t7\t0\tGGGG\t*", "r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
) + "\n"


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    d = al.read_sam(spark, str(tmp_path / "x.sam"))
    rows = {(r["qname"], r["mate"]): r for r in d.collect()}
    a, b, c = rows["r1", 1], rows["r1", 2], rows["r2", 1]
    assert (a["tid"], a["pos"], a["mpos"], a["am"], a["rg"], a["qlen"]) == (0, 10, 100, 37, "g1", 4)
    assert {tuple(r) for r in d.where("qname = 'r1'").select("mate", fl.legacy_quality(), fl.legacy_quality(mapped=True)).collect()} == {(1, 37, 60), (2, 21, 60)}
    assert b["isize"] == -94 and c["mtid"] == 1 and c["qual"] is None and c["rg"] is None
    assert rows["r3", 1]["tid"] == -1 and rows["r3", 1]["seq"] is None
    assert sorted(r["value"] for r in al.sam_lines(d).collect()) == sorted(SAM.split("\n")[3:-1])


def bam_bytes(names, records) -> bytes:
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n in names:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    body = b""
    for tid, pos, name, flag, mtid, mpos, isize, seq, qual, tags in records:
        codes = [plain_bam.BASES.index(x) for x in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        rec = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 50, 0, 1, flag, len(seq), mtid, mpos, isize) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + qual + tags
        body += struct.pack("<i", len(rec)) + rec

    def block(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    return block(head + body[:40]) + block(body[40:]) + block(b"")


def test_bam(spark, tmp_path):
    recs = [(0, 29185299, "junk", 163, 0, 29184911, -388, "CT", b"HB", b"RGZrg3\0AMc" + bytes([37])), (1, 5, "j2", 97, 0, 7, 0, "ACG", b"\xff\xff\xff", b"XBBc" + struct.pack("<i", 2) + b"\1\2" + b"AMS" + struct.pack("<H", 300) + b"Aqi" + struct.pack("<i", 9))]
    (tmp_path / "t.bam").write_bytes(bam_bytes(["c1", "c2"], recs))
    for d in (al.read_bam(spark, str(tmp_path / "t.bam")),):
        a, b = d.orderBy("tid").collect()
        assert (a["qname"], a["flag"], a["pos"], a["mpos"], a["isize"], a["rg"], a["am"], a["seq"], a["contig"], a["mate"]) == ("junk", 163, 29185299, 29184911, -388, "rg3", 37, "CT", "c1", 2)
        assert bytes(a["qual"]) == bytes(x + 33 for x in b"HB") and b["qual"] is None and b["am"] == 300 and (a["aq"], b["aq"]) == (None, 9) and b["cigar"] == "3M"
    al.register_bam(spark)
    one = spark.read.format("bam").load(str(tmp_path / "t.bam")).where("tid = 1")
    assert [r["qname"] for r in one.collect()] == ["j2"]
    assert list(plain_bam.decode_bam((tmp_path / "t.bam").read_bytes(), "t", with_seq=False))[0][13] is None
    with pytest.raises(ValueError):
        list(al.whole(gzip.compress(b"nope"), "t"))


def test_bam_in_splits(spark, tmp_path):
    from svloom.sources import bam

    rng = np.random.default_rng(1)
    recs = []
    for i in range(900):
        n = 40_000 if i in (5, 400) else int(rng.integers(1, 120))
        seq = "".join(rng.choice(list("ACGT"), n))
        recs.append((min(i // 180, 3) if i < 880 else -1, 10 * i if i < 880 else -1, f"r{i}", 99, 0, 5, 7, seq, bytes(rng.integers(0, 41, n).tolist()), b"RGZg\0" if i % 3 else b""))
    plain = al.inflated(bam_bytes(["c1", "c2", "c3", "c4"], recs))
    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    plain = plain[:4] + struct.pack("<i", len(text)) + text + plain[8:]
    for sizes in ((300, 70, 4000), (60_000,), (17,)):
        whole = blocked(plain, sizes)
        (tmp_path / "b.bam").write_bytes(whole)
        want = sorted(map(repr, plain_bam.decode_bam(whole, "b.bam")))
        for split in (700, 5000, 1 << 20):
            if len(whole) / split > 600:
                continue
            with bam.opened(str(tmp_path / "b.bam")) as f:
                head = bam.header(f, "b.bam")
                cuts = bam.splits(f, len(whole), head, None, split)
                got = [repr(plain_bam.row(d, i, e, "b.bam", head.contigs, True)) for b, n in cuts for d, i, e in bam.records(f, len(whole), b, n, head)]
                assert sorted(got) == want and head.is_sorted
                few = bam.splits(f, len(whole), head, 2, split)
                own = [d[i + 4 : i + 8] for b, n in few for d, i, _ in bam.records(f, len(whole), b, n, head)]
                assert own.count(struct.pack("<i", 2)) == 180 and (len(cuts) < 8 or len(few) < 0.6 * len(cuts))
    (tmp_path / "b.bam").write_bytes(blocked(plain, (300, 70, 4000)))
    d = al.read_bam(spark, str(tmp_path / "b.bam"), split=5000)
    assert d.rdd.getNumPartitions() > 5 and d.count() == 900 and d.where("tid = 2").count() == 180
    one = al.read_bam(spark, str(tmp_path / "b.bam"), split=5000, conditions=[("tid", "=", 1)])
    assert one.rdd.getNumPartitions() < d.rdd.getNumPartitions() and one.count() == 180
    assert al.read_bam(spark, str(tmp_path)).count() == 900


def test_pooled_files_number_contigs_by_name(spark):
    row = "qname string, contig string, tid int, mcontig string, mtid int"
    a = spark.createDataFrame([("r1", "x", 0, "y", 1), ("r2", "*", -1, "*", -1)], row)
    b = spark.createDataFrame([("r3", "y", 0, "z", 1), ("r4", "x", 2, "z", 1)], row).withColumn("rg", F.lit("g"))
    got = {r["qname"]: (r["tid"], r["mtid"]) for r in al.pooled([a, b]).collect()}
    assert got == {"r1": (0, 1), "r2": (-1, -1), "r3": (1, 2), "r4": (0, 2)}
    assert {r["qname"]: r["tid"] for r in al.pooled([a, b], ["z", "y", "x"]).collect()} == {"r1": 2, "r2": -1, "r3": 1, "r4": 2}


def test_regions_in_words():
    assert al.region("c1") == ("c1", None, None) and al.region("c1:11") == ("c1", 10, None) and al.region("c1:11-20") == ("c1", 10, 20)
    for bad in ("", ":4", "c1:x-2", "c1:3-y"):
        with pytest.raises(ValueError):
            al.region(bad)


def test_config_file(spark, tmp_path):
    p = tmp_path / "cfg"
    p.write_text("readgroup:g1\tplatform:x\tmap:b.bam\tReadLength:90.00\tlib:L1\tnum:1\tlowercutoff:10\tupper:20\tmean:475.76\tstd:28.67\texe:samtools view: x\nmap:a.bam\tsamp:S\tmean_insert:100\tSTD:10\tmapqual:10\treadlen:30\n\nmap:late.bam\tlib:Z\n")
    d = config.parse(config.read_lines(spark, str(p)))
    a, b = d.orderBy("line_no").collect()
    assert (a["bam_file"], a["lib"], a["rg"], a["lower"], a["upper"], a["readlen"], a["min_mapq"]) == ("b.bam", "L1", "g1", 10, 20, 90, -1)
    assert (b["lib"], b["rg"], b["lower"], b["upper"], b["min_mapq"]) == ("S", "S", 70, 130, 10)
    libs, groups = config.load(spark, str(p))
    assert [x.name for x in libs] == ["L1", "S"] and groups == {"g1": "L1", "S": "S"}
    assert config.first_window(d).first()[0] == 50
    p.write_text("lib:x\tmean:3\n")
    with pytest.raises(Exception, match="no map key"):
        config.parse(config.read_lines(spark, str(p))).collect()


@pytest.mark.parametrize(("key", "field"), [("map", "map"), ("MAP", "map"), ("mapqual", "min_mapq"), ("MapQuality", "min_mapq"), ("lib", "lib"), ("library", "lib"), ("readgroup", "readgroup"), ("group", "readgroup"), ("mean", "mean"), ("mean_insert", "mean"), ("std", "std"), ("readlen", "readlen"), ("lower", "lower"), ("low_cutoff", "lower"), ("upper", "upper"), ("sample", "sample"), ("exe", None), ("num", None), ("platform", None)])
def test_config_keys(spark, key, field):
    assert spark.createDataFrame([(key,)], "k string").select(config.field_of(F.col("k"))).first()[0] == field


def test_rg_map_and_mapview(spark, tmp_path):
    (tmp_path / "rg").write_text("g1  L1\n\ng2\tL2\n")
    assert sorted(map(tuple, config.read_rg_map(spark, str(tmp_path / "rg")).collect())) == [("g1", "L1"), ("g2", "L2")]
    (tmp_path / "mv").write_text("r1 c1 5 + 300 18 60 0 0 0 0 0 0 4 ACGT IIII\nshort row\n")
    r = al.read_mapview(spark, str(tmp_path / "mv")).collect()
    assert len(r) == 1 and (r[0]["qname"], r[0]["dist"], r[0]["code"], r[0]["qlen"]) == ("r1", 300, 18, 4)


def test_scan_overlaps(spark):
    d = spark.createDataFrame([(0, 0, 10, 5), (0, 0, 4, 5), (0, 0, 20, 5), (0, 1, 10, 5)], "flag int, tid int, pos int, qlen int")
    assert sorted(r["pos"] for r in filters.scanned(d, 0, 8, 20).collect()) == [4, 10]


def test_tails(spark):
    t = spark.createDataFrame([(0, 1e-12), (5, 2.0), (100, 5.0), (3, 40.0), (50, 50.0)], "k int, lam double")
    got = [r[0] for r in t.select(log_poisson_sf(F.col("k"), F.col("lam"))).collect()]
    assert abs(got[0] - math.log(1e-10)) < 1e-6 and abs(got[2] + 210.75) < 0.01
    for (k, lam), g in list(zip([(5, 2.0), (3, 40.0), (50, 50.0)], [got[1], got[3], got[4]], strict=True)):
        head = sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k + 1))
        assert abs(g - math.log1p(-head)) < 1e-9
    p = spark.createDataFrame([(-20.0, 2), (-300.0, 1), (0.0, 2)], "s double, n int").select(fisher(F.col("s"), F.col("n")), phred(F.col("s"))).collect()
    assert abs(p[0][0] - (-20 + math.log(21))) < 1e-9 and p[1][0] == -99 and p[2][0] == 0
    assert [r[1] for r in p] == [87, 99, 0]


def test_normality(spark):
    # a textbook sample (weights of 11 men): W = 0.79, p = 0.007
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert abs(estimate.shapiro_wilk(np.array(x)) - 0.0067) < 0.0005
    rng = np.random.default_rng(1)
    assert estimate.shapiro_wilk(np.sort(rng.normal(size=3000))) > 1e-2 and estimate.shapiro_wilk(np.sort(rng.exponential(size=300))) < 1e-5
    assert estimate.shapiro_wilk(np.array([1.0, 2.0, 3.0])) > 0.97
    codes = [estimate.shapiro_wilk(np.array(v)) for v in ([], [1.0, 2.0], [1.0] * 9, [1.0, 3.0, 2.0, 4.0])]
    assert codes == [-1, -1, -2.2, -2.3]
    assert [estimate.normality_field(p) for p in (-1.0, -2.1, -2.2, -2.3, 0.0, 0.01)] == ["data not qualified -1", "data not qualified -2.1", "data not qualified -2.2", "data not qualified -2.3", "minus infinity", "-2.00"]
    d = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 5.0)] * 4, "lib string, dist double")
    got = {r["lib"]: r for r in estimate.normality(d).collect()}
    assert abs(got["a"]["log10_p"] - math.log10(0.0067)) < 0.05 and (got["b"]["p"], got["b"]["log10_p"], got["b"]["field"]) == (-2.2, None, "data not qualified -2.2")


def walked(records, libraries, n, share):
    """Observations by library of one file, a record after the other."""
    alive, found, good, total = set(libraries), {}, {}, 0
    for lib, qual, obs in records:
        if not alive or total > 3 * len(libraries) * n:
            break
        if lib not in alive or qual <= 35:
            continue
        total += 1
        good[lib] = good.get(lib, 0) + 1
        if max(1, len(found.get(lib, ()))) / good[lib] < share:
            alive.discard(lib)
            found[lib] = None
        elif obs:
            found.setdefault(lib, []).append(total)
            if len(found[lib]) > n:
                alive.discard(lib)
    return {k: len(v) for k, v in found.items() if v}


@pytest.mark.parametrize(("n", "share", "odds"), [(5, 1e-4, (0.9, 0.9, 0.9)), (40, 1e-4, (0.9, 0.1, 0.2)), (20, 0.05, (0.8, 0.01, 0.5)), (500, 1e-4, (0.5, 0.5, 0.5))])
def test_estimator_stops(spark, n, share, odds):
    rng = np.random.default_rng(n)
    rows = [("f", f"L{k}", 0, pos, f"q{pos:05d}", 1, int(rng.choice([20, 60], p=[0.2, 0.8])), 18 if rng.random() < odds[k] else 64, 300) for pos, k in enumerate(rng.integers(0, 3, 900).tolist())]
    d = spark.createDataFrame(rows, "bam_file string, lib string, tid int, pos int, qname string, mate int, bdqual int, code int, dist int")
    got = estimate.usable(estimate.until_stop(d, estimate.stops(d, {"f": 3}, n, min_share=share))).groupBy("lib").count().collect()
    assert {r["lib"]: r["count"] for r in got} == walked([(r[1], r[6], r[7] == 18) for r in rows], ["L0", "L1", "L2"], n, share)
    assert estimate.stops(d.limit(0), {"f": 3}, n).count() == 0 and estimate.stops(d, {}, n).count() == 0


def test_order_of_records(spark):
    rows = [("f", 0, 5), ("f", 0, 9), ("f", 0, 9), ("f", 1, 2), ("f", 0, 1), ("f", 0, 0), ("g", 0, 3), ("g", 0, 2)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "bam_file string, tid int, pos int, no long")
    for bits in (0, 1, 33):  # every record a split of its own; two records; all in one
        assert sorted(r["no"] for r in estimate.out_of_order(d, bits=bits).collect()) == [5, 7]
    estimate.assert_sorted(d.where("no < 5"))
    with pytest.raises(ValueError, match="not sorted by position: f"):
        estimate.assert_sorted(d.where("bam_file = 'f'"))


def test_legacy_codes(spark):
    rows = [("1p", "+", 5, 9, "=", 18), ("99", None, 5, 9, "=", 18), ("83", None, 5, 9, "=", 20), ("1089", None, 5, 9, "=", 0), ("0", None, 5, 9, "=", 0), ("5", None, 5, 9, "=", 192), ("9", None, 5, 9, "=", 64), ("65", None, 5, 9, "c", 32), ("65", None, 5, 9, "=", 1), ("113", None, 5, 9, "=", 8), ("81", None, 5, 9, "=", 4), ("97", None, 5, 9, "=", 2), ("pPR", None, 5, 9, "=", 18), ("pu", None, 5, 9, "=", 192)]
    d = spark.createDataFrame([(f, p, m, c, None, "illumina") for f, _, p, m, c, _ in rows[1:]], "flag_text string, pos int, mpos int, mchr string, mf string, platform string")
    assert [r[0] for r in d.select(fl.legacy_code()).collect()] == [r[-1] for r in rows[1:]]
    s = spark.createDataFrame([("1", 5, 9, "=", "130", "illumina"), ("99", 5, 9, "=", None, "SOLiD"), ("65", 5, 9, "=", None, "solid"), ("129", 5, 9, "=", None, "solid"), ("97", 5, 9, "=", None, "solid")], d.schema)
    assert [r[0] for r in s.select(fl.legacy_code()).collect()] == [130, 18, 2, 4, 8]


def test_text_sinks(spark, tmp_path):
    a = q.analysis(spark, SF)
    contigs, calls = q.contig_names(spark), a.calls
    sup = sinks.supporting(a.owned, calls)
    bed = [r["value"] for r in sinks.bed_lines(sup, contigs).orderBy("ea", "eb", "no").collect()]
    tracks = [x for x in bed if x.startswith("track")]
    rows = [x.split("\t") for x in bed if not x.startswith("track")]
    assert len(tracks) == calls.count() and len(rows) == 2 * calls.agg(F.sum("num_reads")).first()[0]
    assert all(len(r) == 9 and int(r[2]) > int(r[1]) and r[5] in "01" and r[8] == ("0,0,255" if r[5] == "0" else "255,0,0") for r in rows)
    seq = a.reads.select("qname", "mate", F.repeat(F.lit("A"), F.col("qlen")).alias("seq"), F.when(F.col("mate") == 1, F.encode(F.lit("I"), "utf-8")).alias("qual"))
    rec = sinks.fastq_records(sup, seq)
    n = {r["file"]: r["n"] for r in rec.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert n[1] == n[2] == calls.agg(F.sum("num_reads")).first()[0]
    sinks.save_fastq(rec, str(tmp_path / "fq"), ["libA", "libB", "none"])
    assert (tmp_path / "fq/lib=none/file=1").is_dir()
    lines = sinks.call_lines(calls, contigs, a.keys, Options(allele_frequency=True))
    assert {len(r["value"].split("\t")) for r in lines.collect()} == {12, 14}
    sinks.save_lines(lines, str(tmp_path / "calls"), "flush", "rank")
    assert len(spark.read.text(str(tmp_path / "calls")).collect()) == calls.count()
    per = sinks.call_lines(q.analysis(spark, SF, opts=Options(per_library=True)).calls, contigs, a.keys, Options(per_library=True)).first()["value"]
    assert "lib" in per.split("\t")[10] and "," in per.split("\t")[10]
    sinks.save_summary(str(tmp_path / "s"), Options(buffer=7), hist=a.hist, covered=a.covered)
    opts, t = sinks.load_summary(spark, str(tmp_path / "s"), "hist", "covered")
    assert opts.buffer == 7 and sorted(t["hist"].collect()) == sorted(a.hist.collect())


def test_stream_equals_batch(spark, tmp_path):
    d = filters.anomalous(q.analysis(spark, SF).admitted).select("tid", "pos", "qlen").toPandas().sort_values(["tid", "pos"])
    files = [*range(0, len(d), len(d) // 7), len(d)]
    for k, (s, e) in enumerate(zip(files, files[1:], strict=False)):  # cuts inside contigs and across them
        d.iloc[s:e].to_parquet(tmp_path / f"{k}.parquet")
        if k == 0:
            schema = spark.read.parquet(str(tmp_path / "0.parquet")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    run = region_sessions(source, 250).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = {tuple(r) for r in spark.table("sessions").collect()}
    want = sorted(tuple(r) for r in region_sessions(spark.createDataFrame(d), 250).collect())
    assert len({r[0] for r in want}) > 2 and got == set(want[:-1])  # the last region is not passed by the watermark


def test_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "svloom", tmp_path / "svloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(q.QUERIES) and int(out[1]) == len(q.SQL)
