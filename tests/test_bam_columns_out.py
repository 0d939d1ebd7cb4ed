"""BAM output by columns against records packed one by one: the same bytes, blocks and index, in a fraction of the time."""

import io
import random
import re
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from svloom.plans import queries as q
from svloom.sources import bam_columns, bam_index, bam_write
from svloom.sources import alignments as al

c = F.col
CONTIGS = [("c1", (1 << 29) - 1), ("c2", 1 << 20), ("c3", 5000)]
NUMBER = {"c1": 0, "c2": 1, "c3": 2, "*": -1, None: -1}
SCHEMA = pa.schema([(n, pa.string()) for n in ("qname", "contig", "mcontig", "cigar", "seq", "rg")] + [(n, pa.int32()) for n in ("flag", "pos", "mapq", "mpos", "isize", "am", "aq")] + [("qual", pa.binary())])


def plain_record(r):
    """(record, tid, pos, end) of a row."""
    ops = [(int(n), k) for n, k in re.findall(r"(\d+)(.)", r["cigar"] or "")]
    seq, qual = (r["seq"] or "").upper(), r["qual"]
    end = r["pos"] + max(1, sum(n for n, k in ops if k in "MDN=X"))
    name, codes = r["qname"].encode(), [bam_columns.BASES.index(x) for x in seq] + [0]
    kind = bam_index.smallest_bin(r["pos"], end) if r["pos"] >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", NUMBER[r["contig"]], r["pos"], len(name) + 1, r["mapq"], kind, len(ops), r["flag"], len(seq), NUMBER[r["mcontig"]], r["mpos"], r["isize"]) + name + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for n, k in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body += bytes(max(0, x - 33) for x in qual) if qual is not None else b"\xff" * len(seq)
    body += b"RGZ" + r["rg"].encode() + b"\0" if r["rg"] is not None else b""
    body += b"".join(k + b"i" + struct.pack("<i", r[n]) for k, n in ((b"AM", "am"), (b"Aq", "aq")) if r[n] is not None)
    return struct.pack("<i", len(body)) + body, NUMBER[r["contig"]], r["pos"], end


def plain_file(rows):
    """Blocks and index, record by record."""
    out, held, index = b"", b"", bam_index.Builder(3)
    for r in rows:
        record, tid, pos, end = plain_record(r)
        if held and len(held) + len(record) > bam_write.BLOCK:
            out, held = out + bam_write.block(held), b""
        begins = len(out) << 16 | len(held)
        held += record
        while len(held) >= bam_write.BLOCK:
            out, held = out + bam_write.block(held[: bam_write.BLOCK]), held[bam_write.BLOCK :]
        index.add(tid, pos, end, begins, len(out) << 16 | len(held))
    return out + (bam_write.block(held) if held else b"") + bam_write.block(b""), index.packed()


def column_file(rows, size):
    f, index = io.BytesIO(), bam_index.Builder(3)
    out = bam_write.BlockFile(f)
    t = pa.Table.from_pylist(rows, SCHEMA)
    for x in bam_write.encoded(iter(t.to_batches(max_chunksize=size)), CONTIGS):
        index.add_all(x.tid, x.pos, x.stop, *out.write_records(x.data, x.ends))
    out.close()
    return f.getvalue(), index.packed()


def rows(rnd, n, most=120):
    out = []
    for i in range(n):
        k = rnd.choice([0, 1, 2, 35, 36, most])
        seq = rnd.choice([None, "".join(rnd.choice(bam_columns.BASES + "acgt") for _ in range(k))])
        qual = bytes(rnd.randrange(0, 256) for _ in seq) if seq is not None and rnd.random() < 0.5 else None
        contig = rnd.choice(["c1", "c1", "c2", "c3", None, "*"])
        out.append(dict(qname=rnd.choice(["r", "ä", "x" * 90]) + str(i), contig=contig, mcontig=rnd.choice(["c1", None]), cigar=rnd.choice([None, "*", "36M", "5S20M2D3I", "9M70000N1=", "3H4P"]), seq=seq, qual=qual,
            rg=rnd.choice([None, "", "g1", "größer"]), flag=rnd.choice([0, 99, 65_535]), pos=rnd.choice([-1, rnd.randrange(4000), rnd.randrange(1 << 28) if contig == "c1" else 7]), mapq=rnd.choice([0, 255]), mpos=rnd.choice([-1, 5]), isize=rnd.choice([-(1 << 31), (1 << 31) - 1]), am=rnd.choice([None, -5]), aq=rnd.choice([None, 1 << 30])))
    out.sort(key=lambda r: (NUMBER[r["contig"]] if NUMBER[r["contig"]] >= 0 else 9, r["pos"]))
    return out


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_same_bytes_and_index(size):
    rnd = random.Random(size)
    for some in (rows(rnd, 1200), rows(rnd, 60, 70_000), rows(rnd, 9, 200_000)):
        assert column_file(some, size) == plain_file(some)
    # records that fill blocks to the last byte
    full = [dict(qname="abc", contig="c1", mcontig=None, cigar=None, seq="A" * 41, qual=None, rg=None, flag=0, pos=i, mapq=0, mpos=0, isize=0, am=None, aq=None) for i in range(1500)]
    assert len(plain_record(full[0])[0]) * 640 == bam_write.BLOCK
    assert column_file(full, size) == plain_file(full)


def test_slices_and_missing_columns():
    some = rows(random.Random(4), 300)
    t = pa.Table.from_pylist(some, SCHEMA).combine_chunks().to_batches()[0]
    got = b"".join(x.data for x in bam_write.encoded(iter([t.slice(0, 0), t.slice(50, 101)]), CONTIGS))
    assert got == b"".join(plain_record(r)[0] for r in some[50:151])
    bare = [dict(r, seq=None, qual=None, rg=None, am=None, aq=None) for r in some]
    assert b"".join(x.data for x in bam_write.encoded(iter([t.drop_columns(["seq", "qual", "rg", "am", "aq"])]), CONTIGS)) == b"".join(plain_record(r)[0] for r in bare)


def test_rows_that_do_not_fit_are_errors():
    row = dict(rows(random.Random(1), 1)[0], seq="ACG", qual=None)
    for bad, message in (({"qname": ""}, "name"), ({"qname": "x" * 255}, "name"), ({"qname": None}, "name"), ({"flag": 65_536}, "flag"), ({"pos": None}, "pos"), ({"mapq": 256}, "mapq"), ({"seq": "AC5"}, "base"), ({"contig": "none"}, "no contig"), ({"qual": b"I"}, "qualities")):
        with pytest.raises(ValueError, match=message):
            list(bam_write.encoded(iter([pa.RecordBatch.from_pylist([row, row | bad], SCHEMA)]), CONTIGS))
    unsorted = bam_index.Builder(3)
    with pytest.raises(ValueError, match="order"):
        x = next(bam_write.encoded(iter([pa.RecordBatch.from_pylist([dict(row, contig="c1", pos=5), dict(row, contig="c1", pos=4)], SCHEMA)]), CONTIGS))
        unsorted.add_all(x.tid, x.pos, x.stop, x.ends, x.ends)


def test_packing_takes_a_fraction_of_record_by_record():
    some = [dict(r, cigar="50M", seq="A" * 50, qual=None) for r in rows(random.Random(2), 20_000)]
    batch = pa.RecordBatch.from_pylist(some, SCHEMA)
    spent = []
    for pack in (lambda: list(map(plain_record, batch.to_pylist())), lambda: list(bam_write.encoded(iter([batch]), CONTIGS))):
        begun = time.process_time()
        pack()
        spent.append(time.process_time() - begun)
    assert spent[1] < spent[0] / 5


def test_sorting_compares_columns_not_expressions(spark):
    """A sort computes expressions anew at each comparison."""
    contigs = [(f"chr{i + 1}", (1 << 29) - 1) for i in range(5)]
    d = q.whole_records(spark, "/root/testdata/sf0.001").withColumn("pos", F.when(c("pos") % 7 == 0, -1).otherwise(c("pos") % 50).cast("int"))
    got = al.ordered(d, contigs, 4)
    assert got.columns == d.columns
    assert "Sort [place_" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "element_at" not in "".join(x for x in plan.split("\n") if "Sort [" in x or "Repartition" in x)
    key = lambda r: (r["tid"] if r["tid"] >= 0 else 9, r["pos"], r["flag"] & 16, r["qname"], r["flag"])
    assert list(map(key, got.collect())) == sorted(map(key, d.collect()))
