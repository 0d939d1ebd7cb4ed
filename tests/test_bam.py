"""BAM: columnar decoding against plain decoding, conditions before decoding, regions by index."""

import json
import random
import struct
import time

import numpy as np
import plain_bam
import pytest
from pyspark.sql import functions as F

from svloom.sources import alignments as al
from svloom.sources import bam, bam_columns, bam_index


def record(tid, pos, name, flag, mapq, mtid, mpos, isize, ops, seq, qual, tags=b""):
    codes = [bam_columns.BASES.index(x) for x in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mtid, mpos, isize) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | bam_columns.CIGAR.index(k)) for n, k in ops) + packed + (bytes(qual) if qual is not None else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def plain_file(contigs, records, text=b"@HD\tVN:1.6\tSO:coordinate\n"):
    names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + names + b"".join(records)


CONTIGS = [("c1", 400_000), ("c:2", 100_000), ("c3", 50_000), ("c4", 60_000_000)]
TAGS = [
    b"", b"RGZg1\0", b"XXZ\0RGZg2\0AMC\x25", b"AMs\x2c\x01Aqi\x09\0\0\0", b"XBBc\x03\0\0\0\1\2\3AMI\xff\xff\0\0RGZ\0", b"XFf\0\0\x80\x3fAMf\0\0\x10\x41", b"AMA7", b"AMZ41\0Aqc\xfe", b"XHH1AFF\0XBBi\1\0\0\0\1\2\3\4RGZlonger name\0",
]


def records(rnd, n=1500):
    out = []
    for i in range(n):
        tid = rnd.choice([0, 0, 0, 1, 3])
        pos = rnd.choice([rnd.randrange(0, 300_000) if tid == 0 else rnd.randrange(0, 90_000), rnd.randrange(40_000_000, 59_000_000) if tid == 3 else rnd.randrange(1000, 1100)])
        m = rnd.choice([0, 1, 2, 35, 36, 101])
        ops = rnd.choice([[(m, "M")], [], [(5, "S"), (m, "M"), (2, "D"), (3, "I")], [(10, "M"), (rnd.choice([200, 70_000]), "N"), (m, "=")], [(3, "H"), (4, "P")]])
        qual = None if m and rnd.random() < 0.2 else [rnd.randrange(0, 42) for _ in range(m)]
        out.append((tid, pos, f"r{i}" * rnd.choice([1, 1, 9]), rnd.choice([99, 147, 4, 1024 + 83, 0, 133]), rnd.randrange(0, 61), rnd.choice([-1, tid]), rnd.randrange(-1, 999), rnd.randrange(-500, 500), ops, "".join(rnd.choice(bam_columns.BASES) for _ in range(m)), qual, rnd.choice(TAGS)))
    out.sort(key=lambda r: r[:2])
    out += [(-1, -1, f"u{i}", 4, 0, -1, -1, 0, [], "ACGTN", None, b"") for i in range(30)]
    return out


@pytest.fixture(scope="module")
def sorted_bam(tmp_path_factory):
    from tests_blocks import blocked

    folder = tmp_path_factory.mktemp("bam")
    plain = plain_file(CONTIGS, [record(*r) for r in records(random.Random(3))])
    (folder / "a.bam").write_bytes(blocked(plain, (900, 70, 4000)))
    with bam.opened(str(folder / "a.bam")) as f:
        (folder / "a.bam.bai").write_bytes(bam_index.built(f, "a.bam"))
    return folder / "a.bam"


def plain_rows(path):
    return list(plain_bam.decode_bam(path.read_bytes(), path.name))


def overlapping(rows, tid, begin, end):
    def reach(cigar):
        import re

        return max(1, sum(int(n) for n, k in re.findall(r"(\d+)(\D)", cigar) if k in "MDN=X"))

    return sorted(repr(r) for r in rows if r[4] == tid and r[5] < end and r[5] + reach(r[7]) > begin)


def test_columns_equal_plain_decoding(spark, sorted_bam):
    got = [repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in al.read_bam(spark, str(sorted_bam), split=3000).collect()]
    want = plain_rows(sorted_bam)
    assert sorted(got) == sorted(map(repr, want)) and len({r[15] for r in want}) > 3 and len({r[16] for r in want}) > 5
    slim = al.read_bam(spark, str(sorted_bam), with_seq=False)
    assert slim.where("seq is not null or qual is not null").count() == 0 and slim.count() == len(want)
    with pytest.raises(ValueError, match="unknown type"):
        list(al.whole(__import__("gzip").compress(plain_file(CONTIGS, [record(0, 1, "r", 0, 0, 0, 0, 0, [], "", [], b"XX?1")])), "x"))


def test_columns_are_several_times_faster():
    rnd = random.Random(1)
    recs = [record(0, i, f"read{i}", 99, 60, 0, i + 300, 400, [(100, "M")], "".join(rnd.choices("ACGT", k=100)), [30] * 100, b"RGZg1\0NMC\1") for i in range(20_000)]
    data, at = b"".join(recs), np.cumsum([0] + [len(r) for r in recs])
    names = [n for n, _ in CONTIGS]
    took = []
    for _ in range(3):
        began = time.process_time()
        got = bam_columns.decoded(data, at[:-1], "x", names)
        middle = time.process_time()
        rows = [plain_bam.row(data, i, j, "x", names, True) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        took.append((time.process_time() - middle) / (middle - began))
        assert got.num_rows == len(rows)
    # 10 to 12 times, once warm
    assert max(took) > 4, took


def test_conditions_before_decoding(spark, sorted_bam):
    rows = plain_rows(sorted_bam)
    asked = [("tid", "in", [0, 3]), ("pos", ">", 1050), ("mapq", "<=", 30)]
    reader = al.BamDataSource({"path": str(sorted_bam), "conditions": json.dumps(asked), "flags_none": "1024"}).reader(None)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("qname").to_pylist()]
    want = [r for r in rows if r[4] in (0, 3) and r[5] > 1050 and r[6] <= 30 and not r[2] & 1024]
    assert sorted(got) == sorted(r[1] for r in want)
    assert reader.tests.seen == len(rows) and reader.tests.decoded == len(want) < len(rows) / 2
    d = al.read_bam(spark, str(sorted_bam), conditions=[("mapq", ">=", 20), ("tid", "in", [0, 1]), ("isize", "<", 100)], flags_all=1, flags_none=1024)
    assert sorted(r["qname"] for r in d.collect()) == sorted(r[1] for r in rows if r[2] & 1 and not r[2] & 1024 and r[6] >= 20 and r[4] in (0, 1) and r[11] < 100)
    for bad in ([("qname", "=", 1)], [("pos", "!=", 1)], [("pos", "=", "x")], [("tid", "in", ["a"])]):
        with pytest.raises(Exception, match="not a condition"):
            al.read_bam(spark, str(sorted_bam), conditions=bad).collect()


def test_filters_of_one_scan_do_not_reach_another(spark, sorted_bam):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d, rows = al.read_bam(spark, str(sorted_bam)), plain_rows(sorted_bam)
        high, third = sum(r[6] > 50 for r in rows), sum(r[4] == 3 for r in rows)
        assert (d.where("mapq > 50").count(), d.count(), d.where("tid = 3").count(), d.count()) == (high, len(rows), third, len(rows))
        assert d.where("mapq > 50").unionByName(d).unionByName(d.where("tid = 3")).count() == high + len(rows) + third
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("text", "tid", "begin", "end"), [("c1", 0, 0, 1 << 29), ("c1:1,001-1,100", 0, 1000, 1100), ("c1:90000", 0, 89_999, 1 << 29), ("c1:16385-16385", 0, 16384, 16385), ("c:2", 1, 0, 1 << 29), ("c:2:1000-1010", 1, 999, 1010), ("c3", 2, 0, 1 << 29), ("c4:45000001-46000000", 3, 45_000_000, 46_000_000), ("c1:399999-400000", 0, 399_998, 400_000)])
def test_region_by_index(spark, sorted_bam, text, tid, begin, end):
    got = al.read_bam(spark, str(sorted_bam), region=text, split=4000).collect()
    assert sorted(repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in got) == overlapping(plain_rows(sorted_bam), tid, begin, end)


def test_region_reads_only_chunks(sorted_bam):
    size = sorted_bam.stat().st_size
    reader = al.BamDataSource({"path": str(sorted_bam), "region": "c4:45000001-46000000"}).reader(None)
    parts = reader.partitions()
    assert sum(p.end - p.begin for p in parts) < size / 4
    # a condition on a contig uses the index as well, without the overlap
    reader = al.BamDataSource({"path": str(sorted_bam), "conditions": '[["tid", "=", 3], ["pos", ">", 58000000]]'}).reader(None)
    assert sum(p.end - p.begin for p in reader.partitions()) < size / 4
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("pos").to_pylist()]
    assert sorted(got) == sorted(r[5] for r in plain_rows(sorted_bam) if r[4] == 3 and r[5] > 58_000_000)


def test_region_errors(spark, sorted_bam, tmp_path):
    for bad in ("c9", "c1:x-3", "c1:20-10", "c1:1-2-3", ":4"):
        with pytest.raises(Exception, match="failed to parse the region"):
            al.read_bam(spark, str(sorted_bam), region=bad).collect()
    (tmp_path / "b.bam").write_bytes(sorted_bam.read_bytes())
    with pytest.raises(Exception, match="failed to load the index"):
        al.read_bam(spark, str(tmp_path / "b.bam"), region="c1").collect()
    (tmp_path / "b.bai").write_bytes(b"BAI\1\5\0\0\0")
    with pytest.raises(Exception, match="not an index"):
        al.read_bam(spark, str(tmp_path / "b.bam"), region="c1").collect()
    (tmp_path / "b.bai").write_bytes((sorted_bam.parent / "a.bam.bai").read_bytes())
    assert al.read_bam(spark, str(tmp_path / "b.bam"), region="c1:1-2000").count() > 0


def test_index_bins_and_packing():
    rnd = random.Random(2)
    r = bam_index.Builder(2)
    spans = sorted((p, p + rnd.choice([1, 100, 20_000, 3_000_000])) for p in (rnd.randrange(0, 1 << 24) for _ in range(400)))
    for i, (b, e) in enumerate(spans):
        r.add(1, b, e, i << 16, (i + 1) << 16)
    both = bam_index.unpacked(r.packed(), "x")
    assert both[0].chunks(0, 1 << 29) == [] and both[1].bins == r.references[1].bins and both[1].linear == r.references[1].linear
    for _ in range(200):
        begin = rnd.randrange(0, 1 << 24)
        end = begin + rnd.choice([1, 5000, 1 << 20])
        chunks = both[1].chunks(begin, end)
        assert all(any(x <= i << 16 < y for x, y in chunks) for i, (b, e) in enumerate(spans) if b < end and e > begin)
        assert all(y < x for (_, y), (x, _) in zip(chunks, chunks[1:], strict=False))
    assert [bam_index.smallest_bin(*x) for x in ((0, 1), (16383, 16385), (0, 1 << 29), (1 << 14, 1 << 15))] == [4681, 585, 0, 4682]
    with pytest.raises(ValueError, match="order"):
        r.add(1, 5, 6, 0, 1)
    with pytest.raises(ValueError):
        bam_index.unpacked(b"nope", "x")
    assert np.array_equal(bam_columns.spread(np.array([5, 9]), np.array([2, 3])), [5, 6, 9, 10, 11])


def test_file_names_with_commas(spark, tmp_path, sorted_bam):
    (tmp_path / "x,y.bam").write_bytes(sorted_bam.read_bytes())
    assert al.read_bam(spark, str(tmp_path / "x,y.bam")).where(F.col("bam_file") == "x,y.bam").count() == len(plain_rows(sorted_bam))


def test_estimator_reads_files_up_to_their_stops(spark, tmp_path):
    from tests_blocks import blocked

    from svloom.operators import estimate

    rnd = random.Random(6)
    paths = {}
    for name, libs, n in (("a", 2, 12_000), ("b", 1, 500), ("c", 3, 900)):
        recs = []
        for i in range(n):
            lib = rnd.randrange(libs if name != "c" else 2)  # one library of c never appears, so c is read to its end
            recs.append(record(0 if i < n // 2 else 1, i // 3 * 7, f"r{i}", 99, rnd.choice([20, 40, 60]), 0, 0, rnd.randrange(100, 400), [(20, "M")], "A" * 20, [9] * 20, b"RGZ" + f"{name}{lib}".encode() + b"\0"))
        (tmp_path / f"{name}.bam").write_bytes(blocked(plain_file(CONTIGS, recs), (2000,)))
        paths[str(tmp_path / f"{name}.bam")] = libs
    prepare = lambda d: d.select("*", F.col("rg").alias("lib"), F.col("mapq").alias("bdqual"), F.when(F.col("isize") % 3 == 0, 2).otherwise(18).alias("code"), F.col("isize").alias("dist"))
    whole = prepare(al.read_bam(spark, str(tmp_path), with_seq=False))
    for n in (20, 10_000):
        stop = estimate.stops(whole, {p.rsplit("/", 1)[-1]: k for p, k in paths.items()}, n)
        want = estimate.until_stop(whole, stop)
        got, ends, read = estimate.sampled_files(spark, paths, prepare, n, first=4000, split=2000)
        assert sorted(map(repr, ends.collect())) == sorted(map(repr, stop.collect()))
        key = ["bam_file", "lib", "qname"]
        assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
        size = (tmp_path / "a.bam").stat().st_size + (tmp_path / "b.bam").stat().st_size + (tmp_path / "c.bam").stat().st_size
        assert read < size / 2 if n == 20 else read < 5 * size
