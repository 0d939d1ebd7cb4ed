"""BAM output: round trips, order over files, commit and abort, headers of pooled files."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_bam import CONTIGS, plain_file, record, records
from tests_blocks import blocked

from svloom.sources import alignments as al
from svloom.sources import bam, bam_index

COLUMNS = ["qname", "flag", "contig", "tid", "pos", "mapq", "cigar", "mcontig", "mtid", "mpos", "isize", "qlen", "seq", "qual", "rg", "am", "aq"]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    rows = records(random.Random(8), 700)
    random.Random(1).shuffle(rows)
    (folder / "a.bam").write_bytes(blocked(plain_file(CONTIGS, [record(*r) for r in rows[:400]], b""), (9000,)))
    (folder / "b.bam").write_bytes(blocked(plain_file(CONTIGS, [record(*r) for r in rows[400:]], b""), (9000,)))
    return folder


def rows(df):
    return sorted(repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in df.select(*COLUMNS).collect())


def test_sorted_files_are_one_order_and_have_indices(spark, source, tmp_path):
    d = al.read_pooled(spark, [str(source / "a.bam"), str(source / "b.bam")])
    al.write_bam(d, str(tmp_path / "out"), CONTIGS, files=5)
    back = al.read_bam(spark, str(tmp_path / "out"))
    assert rows(back) == rows(d)
    files = sorted((tmp_path / "out").glob("*.bam"))
    assert len(files) > 2 and not list((tmp_path / "out").glob("_temp*"))
    seen = []
    for f in files:
        batch = list(al.BamDataSource({"path": str(f)}).reader(None).partitions())
        reader = al.BamDataSource({"path": str(f)}).reader(None)
        for p in batch:
            for b in reader.read(p):
                seen += zip([x if x >= 0 else 99 for x in b.column("tid").to_pylist()], b.column("pos").to_pylist(), [x & 16 for x in b.column("flag").to_pylist()], strict=True)
        with bam.opened(str(f)) as g:
            head = bam.header(g, f.name)
            assert head.is_sorted and list(zip(head.contigs, head.lengths, strict=True)) == CONTIGS
            made = bam_index.unpacked(bam_index.built(g, f.name), f.name)
        kept = bam_index.load(str(f))
        for begin, end in ((0, 1 << 29), (1000, 1001), (50_000, 120_000)):
            for t in range(4):
                assert [x[0] for x in made[t].chunks(begin, end)] == [x[0] for x in kept[t].chunks(begin, end)]
    assert seen == sorted(seen) and len(seen) == 730
    for region, where in (("c1:1001-1100", "tid = 0 and pos < 1100"), ("c4", "tid = 3")):
        got = al.read_bam(spark, str(tmp_path / "out"), region=region)
        assert got.count() and got.where(where).count() == got.count()
    # a file's last empty block is the usual one
    assert all(f.read_bytes()[-28:-18] == bytes.fromhex("1f8b08040000000000ff") for f in files)


def test_unsorted_and_replaced(spark, source, tmp_path):
    d = al.read_bam(spark, str(source))
    for part in (d, d.where("tid = 1").drop("seq", "qual", "rg", "am", "aq")):
        al.write_bam(part, str(tmp_path / "u"), CONTIGS, in_order=False)
        assert al.read_bam(spark, str(tmp_path / "u")).count() == part.count()
    assert not list((tmp_path / "u").glob("*.bai")) and al.read_bam(spark, str(tmp_path / "u")).where("seq is not null or rg is not null or am is not null").count() == 0
    al.write_bam(d.where("false"), str(tmp_path / "u"), CONTIGS)
    assert al.read_bam(spark, str(tmp_path / "u")).count() == 0 and len(list((tmp_path / "u").glob("*.bam"))) == 1


def test_a_failed_task_leaves_nothing(spark, source, tmp_path):
    d = al.read_bam(spark, str(source))
    al.write_bam(d.where("tid = 1"), str(tmp_path / "f"), CONTIGS)
    before = sorted(x.name for x in (tmp_path / "f").iterdir())
    for bad, message in ((d.withColumn("contig", F.when(F.col("qname").startswith("r7"), "none").otherwise(F.col("contig"))), "no contig"), (d.withColumn("cigar", F.lit("4Q")), "substring|cigar"), (d.withColumn("qual", F.lit(b"I")), "qualities"), (d.drop("mapq"), "missing")):
        with pytest.raises(Exception, match=message):
            al.write_bam(bad, str(tmp_path / "f"), CONTIGS, in_order=False)
        assert sorted(x.name for x in (tmp_path / "f").iterdir()) == before


def test_pooled_numbers_are_the_headers(spark, tmp_path):
    one = record(2, 5, "r1", 99, 9, 2, 50, 45, [(2, "M")], "AC", [9, 9])
    two = record(0, 7, "r2", 99, 9, 1, 8, 0, [(2, "M")], "AC", None)
    (tmp_path / "a.bam").write_bytes(blocked(plain_file([("x", 100), ("y", 200), ("z", 300)], [one]), (400,)))
    (tmp_path / "b.bam").write_bytes(blocked(plain_file([("z", 300), ("w", 50)], [two]), (400,)))
    paths = [str(tmp_path / "a.bam"), str(tmp_path / "b.bam")]
    assert al.bam_contigs(paths) == [("x", 100), ("y", 200), ("z", 300), ("w", 50)]
    got = {r["qname"]: (r["tid"], r["mtid"]) for r in al.read_pooled(spark, paths).collect()}
    assert got == {"r1": (2, 2), "r2": (2, 3)}
    (tmp_path / "c.bam").write_bytes(blocked(plain_file([("z", 301)], []), (400,)))
    with pytest.raises(ValueError, match="contig z has 301 bases"):
        al.bam_contigs([*paths, str(tmp_path / "c.bam")])
    assert list(itertools.chain(*[r for r in al.read_pooled(spark, paths).select("tid").orderBy("tid").collect()])) == [2, 2]
