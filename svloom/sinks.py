"""Text and Parquet sinks: each makes a column ``value`` of lines; ``save_lines`` writes one file of them."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import flags as fl
from .options import Options

c = F.col


def named(df: DataFrame, contigs: DataFrame, tid: str = "tid", name: str = "chrom") -> DataFrame:
    """Adds the contig's name; (tid, contig) is the header's size."""
    return df.join(F.broadcast(contigs.select(c("tid").alias("_t"), c("contig").alias(name))), c(tid) == c("_t"), "left").drop("_t")


def two_decimals(x: Column) -> Column:
    return F.when(x.isNull(), "NA").otherwise(F.format_string("%.2f", x))


def general(x: Column) -> Column:
    """Six significant digits without zeros at the end, and a power of ten where the number is very large or small."""
    text = F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")


def support_text(per_library: bool = False) -> Column:
    """key|reads joined by ':'; by library with copies, NA where unknown or between contigs."""
    copies = lambda s: F.when(c("type") == "CTX", F.lit("NA")).otherwise(two_decimals(F.element_at("copy_number", s["key"])))
    one = (lambda s: F.concat(s["key"], F.lit("|"), s["reads"].cast("string"), F.lit(","), copies(s))) if per_library else (lambda s: F.concat(s["key"], F.lit("|"), s["reads"].cast("string")))
    return F.when(F.size("support") == 0, "NA").otherwise(F.array_join(F.transform("support", one), ":"))


def orientation(n: int) -> Column:
    return F.concat(c(f"fwd{n}").cast("string"), F.lit("+"), c(f"rev{n}").cast("string"), F.lit("-"))


def call_lines(calls: DataFrame, contigs: DataFrame, keys: list[str], opts: Options = Options()) -> DataFrame:
    """flush, rank, value: rows of the call table; copy-number columns by file are left out between contigs, as with per-library counts.

    An allele frequency has six significant digits up to the row, in visiting
    order, that prints the first copy number by file, and two decimals from the
    next row on.
    """
    x = named(named(calls, contigs, "tid1", "chr1"), contigs, "tid2", "chr2")
    text = [c("chr1"), c("pos1"), orientation(1), c("chr2"), c("pos2"), orientation(2), c("type"), c("size"), c("score"), c("num_reads"), support_text(opts.per_library)]
    if opts.allele_frequency:
        x = x.withColumn("_at", F.struct("flush", "rank"))
        prints = F.lit(not opts.per_library) & (c("type") != "CTX") & F.exists(F.array(*map(F.lit, keys)), lambda k: F.element_at("copy_number", k).isNotNull())
        first = x.where(prints).agg(F.min("_at").alias("_first"))  # one row
        x = x.crossJoin(F.broadcast(first))
        fixed = F.coalesce(c("_at") > c("_first"), F.lit(False))
        text.append(F.when(c("allele_frequency").isNull(), "NA").when(fixed, F.format_string("%.2f", "allele_frequency")).otherwise(general(c("allele_frequency"))))
    if not opts.per_library:
        per = F.transform(F.array(*map(F.lit, keys)), lambda k: two_decimals(F.element_at("copy_number", k)))
        text.append(F.when(c("type") != "CTX", F.array_join(per, "\t")))
    return x.select("flush", "rank", F.concat_ws("\t", *[t.cast("string") for t in text]).alias("value"))


def header_lines(coverage: DataFrame, hist: DataFrame, libs: DataFrame, command: str, keys: list[str], opts: Options = Options()) -> DataFrame:
    """no, value: software, command, a line per library, the column names."""
    codes = F.concat_ws("\t", *[F.when(F.coalesce(c(f"n{k}"), F.lit(0)) > 0, F.concat(F.lit(f"{fl.EXTERNAL[k]}:"), c(f"n{k}").cast("string"))) for k in range(11)])
    x = coverage.join(libs.select("lib", "lib_bam", "mean", "std", "upper", "lower", "readlen"), "lib").join(hist.drop("reads"), "lib", "left")
    value = F.concat_ws("\t", "lib_bam", *[F.concat(F.lit(f"{n}:"), general(c(v))) for n, v in (("mean", "mean"), ("std", "std"), ("uppercutoff", "upper"), ("lowercutoff", "lower"), ("readlen", "readlen"))], F.concat(F.lit("library:"), c("lib")), F.concat(F.lit("reflen:"), c("covered").cast("string")), F.concat(F.lit("seqcov:"), general(c("sequence_coverage"))), F.concat(F.lit("phycov:"), general(c("physical_coverage"))), codes)
    spark = coverage.sparkSession
    names = ["#Chr1", "Pos1", "Orientation1", "Chr2", "Pos2", "Orientation2", "Type", "Size", "Score", "num_Reads", "num_Reads_lib"] + ["Allele_frequency"] * opts.allele_frequency + ([] if opts.per_library else keys)
    fixed = spark.createDataFrame([(0, "#Software: svloom"), (1, f"#Command: {command}"), (2, "#Library Statistics:"), (1 << 40, "\t".join(names))], "no long, value string")
    rows = x.select((F.row_number().over(Window.orderBy("lib")) + 2).cast("long").alias("no"), F.concat(F.lit("#"), value).alias("value"))
    return fixed.unionByName(rows)


def supporting(owned: DataFrame, calls: DataFrame) -> DataFrame:
    """Both reads of the pairs that consumed for a call, with its columns; ``later`` marks the second in order."""
    x = owned.drop("size").join(calls.drop("flush", "rank"), ["ea", "eb"])
    ends = F.inline(F.array(F.struct(F.lit(1).alias("later"), c("later").alias("r")), F.struct(F.lit(0).alias("later"), c("earlier").alias("r"))))
    return x.select("ea", "eb", "qname", "flag", "type", "size", "pos1", "pos2", "tid1", ends).select("*", "r.tid", "r.pos", "r.rev", "r.mate", "r.cls", "r.lib", "r.qlen", "r.bdqual").drop("r")


def bed_lines(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """ea, eb, no, value: a track line per call, then a row per supporting read of the call's own class. Strand is 0 or 1."""
    x = named(named(reads, contigs, "tid1", "chr1"), contigs)
    chr_ = lambda n: F.when(F.startswith("chr1", F.lit("chr")), c(n)).otherwise(F.concat(F.lit("chr"), c(n)))
    end, colour = c("pos") + c("qlen"), F.when(c("rev") == 0, "0,0,255").otherwise("255,0,0")
    row = F.concat_ws("\t", chr_("chrom"), c("pos").cast("string"), end.cast("string"), F.concat("qname", F.lit("|"), "lib"), (c("bdqual") * 10).cast("string"), c("rev").cast("string"), c("pos").cast("string"), end.cast("string"), colour)
    rows = x.where(c("cls") == c("flag")).select("ea", "eb", F.concat(F.lit("1"), "qname", c("later").cast("string")).alias("no"), row.alias("value"))
    title = F.format_string('track name=%s_%d_%s_%d description="svloom %s %d %s %d" useScore=0', c("chr1"), c("pos1"), c("type"), c("size"), c("chr1"), c("pos1"), c("type"), c("size"))
    tracks = x.select("ea", "eb", F.lit("0").alias("no"), title.alias("value")).distinct()
    return tracks.unionByName(rows)


def fastq_records(reads: DataFrame, sequences: DataFrame) -> DataFrame:
    """lib, file (the later read of a pair: 2, the earlier: 1), value: the four lines of a record.

    ``sequences``: qname, mate, seq, qual (printable bytes; null gives an empty line). Only reads of the call's class with a sequence.
    """
    x = reads.where(c("cls") == c("flag")).join(sequences.select("qname", "mate", "seq", "qual"), ["qname", "mate"]).where("seq is not null")
    value = F.concat_ws("\n", F.concat(F.lit("@"), "qname"), "seq", F.lit("+"), F.coalesce(F.decode("qual", "utf-8"), F.lit("")))
    return x.select("lib", (c("later") + 1).alias("file"), value.alias("value"))


def save_lines(df: DataFrame, path: str, *order: str) -> None:
    """One text file of ``value`` in the given order; what is printed is small beside the input."""
    df.repartition(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def save_fastq(records: DataFrame, prefix: str, libs: list[str]) -> None:
    """A folder lib=L/file=1|2 for each library; libraries without records get their (empty) folders too."""
    records.write.mode("append").partitionBy("lib", "file").text(prefix)
    for lib in libs:
        for n in (1, 2):
            records.limit(0).select("value").write.mode("append").text(f"{prefix}/lib={lib}/file={n}")


def save_summary(folder: str, opts: Options, **tables: DataFrame) -> None:
    """Options as JSON and statistics as Parquet; where they were saved is no part of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(asdict(opts)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/options")


def load_summary(spark: SparkSession, folder: str, *names: str) -> tuple[Options, dict[str, DataFrame]]:
    text = spark.read.text(f"{folder}/options").first()[0]
    return Options(**json.loads(text)), {n: spark.read.parquet(f"{folder}/{n}") for n in names}


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Path", "annotations")]
