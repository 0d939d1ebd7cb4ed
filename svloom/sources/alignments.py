"""Alignment sources: SAM text, BAM files, mapview text; and a SAM sink."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bam, bam_columns, bam_index, bam_write

c = F.col
SCHEMA = "bam_file string, qname string, flag int, contig string, tid int, pos int, mapq int, cigar string, mcontig string, mtid int, mpos int, isize int, qlen int, seq string, qual binary, rg string, am int, mate int, aq int"
#: Schemes of files that executors open by themselves.
OPENED = {"file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"}


def read_sam(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """Rows of SAM text files. ``contigs`` fixes the numbering; else it follows the header of the first file by name (a header is small)."""
    lines = spark.read.text(path).withColumn("bam_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    if contigs is None:
        head = lines.where(F.startswith("value", F.lit("@SQ"))).select("bam_file", F.monotonically_increasing_id().alias("no"), F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig")).collect()
        first = min((r["bam_file"] for r in head), default=None)
        contigs = [r["contig"] for r in sorted(head, key=lambda r: r["no"]) if r["bam_file"] == first]
    number = F.create_map(*[F.lit(x) for i, k in enumerate(contigs) for x in (k, i)]) if contigs else F.lit(None).cast("map<string,int>")
    s = F.split("value", "\t")
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:[A-Za-z]:([^\t]+)", 1), F.lit(""))
    rows = lines.where(~F.startswith("value", F.lit("@")) & (F.size(s) >= 11))
    mate_contig = F.when(s[6] == "=", s[2]).otherwise(s[6])
    tid = lambda x: F.coalesce(F.element_at(number, x), F.lit(-1))
    seq = F.when(s[9] != "*", s[9])
    return rows.select(
        "bam_file", s[0].alias("qname"), s[1].cast("int").alias("flag"), s[2].alias("contig"), tid(s[2]).alias("tid"), (s[3].cast("int") - 1).alias("pos"), s[4].cast("int").alias("mapq"), s[5].alias("cigar"),
        mate_contig.alias("mcontig"), tid(mate_contig).alias("mtid"), (s[7].cast("int") - 1).alias("mpos"), s[8].cast("int").alias("isize"), F.coalesce(F.length(seq), F.lit(0)).alias("qlen"), seq.alias("seq"),
        F.when(s[10] != "*", F.encode(s[10], "utf-8")).alias("qual_text"), tag("RG").alias("rg"), tag("AM").cast("int").alias("am"), F.when(s[1].cast("int").bitwiseAND(128) != 0, 2).otherwise(1).alias("mate"), tag("Aq").cast("int").alias("aq"),
    ).withColumnRenamed("qual_text", "qual")


def sam_lines(df: DataFrame) -> DataFrame:
    """SAM text of alignments (qual holds printable bytes): one column, ``value``."""
    tags = [F.concat(F.lit("RG:Z:"), c("rg")), F.concat(F.lit("AM:i:"), c("am").cast("string"))]
    tags = F.concat_ws("\t", *tags, *[F.concat(F.lit("Aq:i:"), c("aq").cast("string"))] * ("aq" in df.columns))
    star = lambda x: F.coalesce(x, F.lit("*"))
    mate = F.when((c("mcontig") == c("contig")) & (c("contig") != "*"), "=").otherwise(star(c("mcontig")))
    base = F.concat_ws("\t", "qname", c("flag").cast("string"), star(c("contig")), (c("pos") + 1).cast("string"), c("mapq").cast("string"), star(c("cigar")), mate, (c("mpos") + 1).cast("string"), c("isize").cast("string"), star(c("seq")), star(F.decode("qual", "utf-8")))
    return df.select(F.when(tags != "", F.concat_ws("\t", base, tags)).otherwise(base).alias("value"))


def read_mapview(spark: SparkSession, path: str) -> DataFrame:
    """Rows of mapview text with 15 fields at least."""
    s = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(s) >= 15)
    return rows.select(s[0].alias("qname"), s[1].alias("contig"), s[2].cast("int").alias("pos"), s[3].alias("ori"), s[4].cast("int").alias("dist"), s[5].cast("int").alias("code"), s[6].cast("int").alias("mapq"), s[13].cast("int").alias("qlen"), s[14].alias("seq"))


def inflated(data: bytes) -> bytes:
    """The blocks of a blocked gzip file, one after another."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def whole(data: bytes, name: str, tests: bam_columns.Tests | None = None, with_seq: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from the bytes of one BAM file."""
    d = inflated(data)
    if d[:4] != b"BAM\1":
        raise ValueError(f"{name} is not a BAM file")
    i = 8 + struct.unpack_from("<i", d, 4)[0]
    n = struct.unpack_from("<i", d, i)[0]
    i += 4
    contigs = []
    for _ in range(n):
        k = struct.unpack_from("<i", d, i)[0]
        contigs.append(d[i + 4 : i + 3 + k].decode())
        i += 8 + k
    while i < len(d):
        at, first = [], i
        while i < len(d) and i - first < bam.RUN:
            at.append(i - first)
            i += 4 + struct.unpack_from("<i", d, i)[0]
        yield bam_columns.decoded(d[first:i], np.array(at, np.int64), name, contigs, with_seq, tests)


def tests_of(options: dict) -> bam_columns.Tests:
    """The tests that the options ``conditions`` (JSON), ``flags_all`` and ``flags_none`` ask for."""
    fields = [(n, op, v) for n, op, v in json.loads(options.get("conditions", "[]"))]
    for n, op, v in fields:
        if n not in bam_columns.TESTED or op not in ("in", *bam_columns.OPS) or not all(isinstance(x, int) for x in (v if op == "in" else [v])):
            raise ValueError(f"not a condition on a record's fixed fields: {n} {op} {v}")
    return bam_columns.Tests(fields, int(options.get("flags_all", 0)), int(options.get("flags_none", 0)))


class _BamPartition(InputPartition):
    """A split of a file, from and up to virtual offsets if they are known; without a header the whole file, whose blocks do not tell their sizes."""

    def __init__(self, path: str, size: int, begin: int, end: int, head: bam.Header | None, exact: int | None = None, limit: int | None = None, region: tuple | None = None):
        self.path, self.size, self.begin, self.end, self.head, self.exact, self.limit, self.region = path, size, begin, end, head, exact, limit, region


class _BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.with_seq, self.region = options.get("with_seq", "true") == "true", options.get("region")
        self.split = int(options.get("split", bam.SPLIT))
        self.upto = int(options.get("upto", 1 << 62))
        self.tests = tests_of(options)

    def _wanted(self) -> tuple[int, int, int] | None:
        """The stretch of one contig that the tests leave."""
        tids = [v for n, op, v in self.tests.fields if (n, op) == ("tid", "=")]
        if not tids or tids[0] < 0:
            return None
        low = max([0] + [v + (op == ">") for n, op, v in self.tests.fields if n == "pos" and op in (">", ">=", "=")])
        high = min([1 << 29] + [v + (op != "<") for n, op, v in self.tests.fields if n == "pos" and op in ("<", "<=", "=")])
        return tids[0], low, high

    def _parts(self, path: str) -> list[_BamPartition]:
        with bam.opened(path) as f:
            size = f.seek(0, 2)
            head = bam.header(f, path)
            if self.region is not None:
                index = bam_index.load(path)
                stretch = bam_index.place(self.region, head.contigs if head else [], path)
                return self._chunks(path, size, head, index, stretch, stretch)
            if head is None:
                return [_BamPartition(path, size, 0, size, None)]
            wanted = self._wanted()
            if wanted is not None and head.is_sorted:
                try:
                    index = bam_index.load(path)
                except FileNotFoundError:
                    index = None
                if index is not None:
                    return self._chunks(path, size, head, index, wanted, None)
            return [_BamPartition(path, size, b, e, head) for b, e in bam.splits(f, size, head, wanted and wanted[0], self.split) if b < self.upto]

    def _chunks(self, path: str, size: int, head: bam.Header, index: list, stretch: tuple[int, int, int], region: tuple | None) -> list[_BamPartition]:
        """Splits of the index' chunks; all but a chunk's first one find their first record by themselves."""
        tid, begin, end = stretch
        out = []
        for b, e in index[tid].chunks(begin, end) if tid < len(index) else []:
            first, last = b >> 16, min(size, (e >> 16) + 1)
            cuts = [*range(first, last, self.split), last]
            out += [_BamPartition(path, size, i, j, head, b if i == first else None, e, region) for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def partitions(self):
        # headers and indices are small; many files are opened side by side
        with ThreadPoolExecutor(16) as pool:
            found = [x for parts in pool.map(self._parts, self.paths) for x in parts]
        return found or [_BamPartition("", 0, 0, 0, None)]

    def read(self, partition):
        if not partition.path:
            return
        name, p = partition.path.rsplit("/", 1)[-1], partition
        self.tests.region = p.region
        with bam.opened(p.path) as f:
            if p.head is None:
                yield from whole(f.read(), name, self.tests, self.with_seq)
                return
            for run in bam.runs(f, p.size, p.begin, p.end, p.head, p.exact, p.limit):
                yield bam_columns.decoded(run.data, run.at, name, p.head.contigs, self.with_seq, self.tests)


class BamDataSource(DataSource):
    """``spark.read.format("bam")`` and ``df.write.format("bam")`` over files that every executor can open (a path, or a URI of a store that pyarrow knows).

    Read: ``load(path)``, or the option ``paths``, a JSON list. Partitions are
    splits of the files, of as many bytes as the option ``split`` says; with
    ``upto`` those alone that begin before this byte. ``conditions``, a JSON list
    of [field, operator, value] on tid, pos, mapq, flag, mtid, mpos, isize and
    qlen (=, <, <=, >, >=, in), ``flags_all`` and ``flags_none`` (bits) are
    tested on a record's fixed fields before anything else of it is decoded.
    They are options because Spark's own handing down of filters to such
    sources is not safe: what one scan of a DataFrame hands down stays for its
    other scans (seen in 4.1), which then lack rows. With ``region``
    (``contig:begin-end``, from 1) only the index' chunks are read, and records
    that overlap it returned; an error tells of a missing index or a bad region.
    Conditions on one contig use the index where there is one.

    Write: the options ``contigs``, ``sorted``, ``header`` and ``level`` (see
    ``bam_write.BamWriter``); ``write_bam`` sets them.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return bam_write.BamWriter(dict(self.options), overwrite)


def register_bam(spark: SparkSession) -> None:
    """Makes the format ``bam`` known to the session."""
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(BamDataSource)


def read_files(spark: SparkSession, files: list[str], **options) -> DataFrame:
    """Rows of BAM files that executors open by themselves; options: see ``BamDataSource``."""
    register_bam(spark)
    given = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None}
    return spark.read.format("bam").options(paths=json.dumps(files), **given).load()


def read_bam(spark: SparkSession, path: str, with_seq: bool = True, split: int = bam.SPLIT, region: str | None = None, conditions: list[tuple] = (), flags_all: int = 0, flags_none: int = 0) -> DataFrame:
    """Rows of the BAM files below ``path`` (a file, folder or pattern) in any store Spark reads; of a ``region`` by their indices, and only those that meet ``conditions`` and flags (see ``BamDataSource``).

    Files in stores that executors open by themselves are read in splits of
    ``split`` bytes. Of others each is read whole, so they may have 2 GB at most.
    """
    register_bam(spark)
    files, tested = bam_files(spark, path), {"conditions": json.dumps(list(conditions)), "flags_all": flags_all, "flags_none": flags_none}
    if files and all(f.split(":", 1)[0] in OPENED for f in files):
        return read_files(spark, files, with_seq=with_seq, split=split, region=region, **tested)
    if region:
        raise ValueError("a region needs files that executors can open by themselves")

    def run(batches):
        for b in batches:
            for path, content in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield from whole(content, path.rsplit("/", 1)[-1], tests_of(tested), with_seq)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def pooled(parts: list[DataFrame], contigs: list[str] | None = None) -> DataFrame:
    """Alignments of several files as one set, with contigs numbered by name over all of them.

    contigs: the names in their order; else those of the first part in its
    order, then what each further part adds (only names and numbers are
    collected, a row for each contig). Records without a contig keep -1.
    """
    if contigs is None:
        contigs = []
        for p in parts:
            ends = p.select("contig", "tid").unionByName(p.select(c("mcontig").alias("contig"), c("mtid").alias("tid"))).where("tid >= 0")
            own = sorted((r["tid"], r["contig"]) for r in ends.groupBy("contig").agg(F.min("tid").alias("tid")).collect())
            contigs += [n for _, n in own if n not in contigs]
    number = F.create_map(*[F.lit(x) for i, k in enumerate(contigs) for x in (k, i)]) if contigs else F.lit(None).cast("map<string,int>")
    out = None
    for p in parts:
        p = p.withColumns({t: F.when(c(t) >= 0, F.element_at(number, c(n))).otherwise(-1).cast("int") for t, n in (("tid", "contig"), ("mtid", "mcontig"))})
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def bam_files(spark: SparkSession, path: str) -> list[str]:
    """The BAM files of a file, folder or pattern, in order."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    found = [s for g in store.globStatus(at) or [] for s in (store.listStatus(g.getPath()) if g.isDirectory() else [g])]
    return sorted(s.getPath().toString() for s in found if s.isFile() and not s.getPath().getName().startswith((".", "_")) and not s.getPath().getName().endswith(".bai"))


def bam_contigs(paths: list[str]) -> list[tuple[str, int]]:
    """(name, length) of the contigs in the headers of several files: the first file's in their order, then what each further one adds. Lengths that differ are an error."""

    def own(path: str) -> list[tuple[str, int]]:
        with bam.opened(path) as f:
            head = bam.header(f, path)
        if head is None:
            raise ValueError(f"{path} has no blocks")
        return list(zip(head.contigs, head.lengths, strict=True))

    out: dict[str, int] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, found in zip(paths, pool.map(own, paths), strict=True):
            for n, size in found:
                if out.setdefault(n, size) != size:
                    raise ValueError(f"contig {n} has {size} bases in {path}, {out[n]} in a file before")
    return list(out.items())


def read_pooled(spark: SparkSession, paths: list[str], **more) -> DataFrame:
    """Alignments of several BAM files, folders or patterns as one set; contigs keep the numbers of the headers (see ``bam_contigs``), read or not."""
    names = [n for n, _ in bam_contigs([f for p in paths for f in bam_files(spark, p)])]
    return pooled([read_bam(spark, p, **more) for p in paths], names)


def ordered(df: DataFrame, contigs: list[tuple[str, int]], files: int | None = None) -> DataFrame:
    """The rows in order of contig (none is last), position and strand, in ranges of about equal size."""
    number = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(contigs) for x in (n, i)]) if contigs else F.lit(None).cast("map<string,int>")
    at = F.coalesce(F.element_at(number, c("contig")), F.lit(len(contigs))).cast("long")
    # contig, position and strand as one number, made once a row: a sort computes expressions anew at each comparison
    place = f"place_{uuid.uuid4().hex}"
    keyed = df.withColumn(place, at * (1 << 33) + (c("pos").cast("long") + (1 << 31)) * 2 + F.shiftright(c("flag"), 4).bitwiseAND(1))
    key = [c(place), c("qname"), c("flag")]
    return keyed.repartitionByRange(*([files] if files else []), *key).sortWithinPartitions(*key).drop(place)


def write_bam(df: DataFrame, path: str, contigs: list[tuple[str, int]], in_order: bool = True, header: str = "", files: int | None = None) -> None:
    """Writes alignments as BAM files below ``path``, which replace those there.

    in_order: the files, one after another, are in order of contig (the
    header's; none is last), position and strand, and each has an index; ranges
    of about equal size are found by sampling, so no task holds a whole contig.
    """
    register_bam(df.sparkSession)
    if in_order:
        df = ordered(df, contigs, files)
    df.write.format("bam").mode("overwrite").options(contigs=json.dumps(contigs), sorted=str(in_order).lower(), header=header).save(path)


def region(text: str) -> tuple[str, int | None, int | None]:
    """contig, 0-based begin and end of ``contig[:begin[-end]]``."""
    name, _, span = text.partition(":")
    if not name:
        raise ValueError(f"no contig in {text!r}")
    if not span:
        return name, None, None
    begin, _, end = span.replace(",", "").partition("-")
    if not begin.isdigit() or (end and not end.isdigit()):
        raise ValueError(f"not a region: {text!r}")
    return name, int(begin) - 1, int(end) if end else None
