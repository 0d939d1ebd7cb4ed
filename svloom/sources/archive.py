"""Restores a run from the XML archive of options, configuration and counting pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import Library
from ..options import Options

c = F.col
# Fixed names of the archive's elements: options with our names and types, fields of a library.
OPTIONS = {
    "min_len": ("min_len", int), "cut_sd": ("cutoff_sd", int), "max_sd": ("max_sd", int), "min_map_qual": ("min_mapq", int), "min_read_pair": ("min_read_pair", int), "seq_coverage_lim": ("coverage_limit", int), "buffer_size": ("buffer", int),
    "transchr_rearrange": ("only_ctx", bool), "fisher": ("fisher", bool), "Illumina_long_insert": ("long_insert", bool), "CN_lib": ("per_library", bool), "print_AF": ("allele_frequency", bool), "score_threshold": ("score_threshold", int), "chr": ("contig", str), "prefix_fastq": ("fastq_prefix", str), "dump_BED": ("bed_file", str),
}
LIBRARY = "index INT, name STRING, bam_file_index INT, bam_file STRING, mean_insertsize DOUBLE, std_insertsize DOUBLE, uppercutoff DOUBLE, lowercutoff DOUBLE, readlens DOUBLE, min_mapping_quality INT"
SCHEMA = (
    "options STRUCT<" + ", ".join(f"{n}: STRING" for n in OPTIONS) + ">, "
    f"bamConfig STRUCT<libraryConfig: STRUCT<item: ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in LIBRARY.split(', '))}>>>, readgroupToLibrary: STRUCT<item: ARRAY<STRUCT<first: STRING, second: STRING>>>>, "
    "bamSummaries STRUCT<coveredReferenceLength: BIGINT, readCountPerBam: STRUCT<item: ARRAY<STRUCT<first: STRING, second: BIGINT>>>, libraryFlagDistributions: STRUCT<item: ARRAY<STRUCT<readCount: BIGINT, readCountsByFlag: STRUCT<item: ARRAY<BIGINT>>>>>>"
)


@dataclass
class Archive:
    """Options, libraries and read groups, and the counting pass' tables as ``operators.stats`` makes them."""

    opts: Options
    libs: list[Library]
    rg_lib: dict[str, str]
    hist: DataFrame
    files: DataFrame
    covered: DataFrame


def load(spark: SparkSession, path: str) -> Archive:
    """The archive at ``path``: one file, whose size is that of a configuration.

    An element that is missing is an error, as are counts that do not fit the
    libraries. Empty texts of options mean none; where the archive was made is
    no part of it.
    """
    rows = spark.read.format("xml").schema(SCHEMA).option("rowTag", "boost_serialization").option("mode", "FAILFAST").load(path)
    found = rows.limit(2).collect()
    if len(found) != 1 or any(found[0][n] is None for n in ("options", "bamConfig", "bamSummaries")):
        raise ValueError(f"{path} is not an archive of a run")
    opts, config, summary = found[0]

    def items(x, what: str) -> list:
        if x is None:
            raise ValueError(f"{path} has no {what}")
        return x["item"] or []

    given = {}
    for n, (own, kind) in OPTIONS.items():
        if opts[n] is None and kind is not str:
            raise ValueError(f"{path} has no option {n}")
        given[own] = (opts[n] or None) if kind is str else bool(int(opts[n])) if kind is bool else int(opts[n])
    if given["contig"] == "0":
        given["contig"] = None
    libraries = sorted(items(config["libraryConfig"], "libraries"), key=lambda r: r["index"])
    libs = [Library(r["name"], r["bam_file"], r["mean_insertsize"], r["std_insertsize"], r["uppercutoff"], r["lowercutoff"], r["readlens"], r["min_mapping_quality"]) for r in libraries]
    counts = items(summary["libraryFlagDistributions"], "counts of libraries")
    flags = [items(r["readCountsByFlag"], "counts by class") for r in counts]
    if len(counts) != len(libs) or any(len(x) != 11 for x in flags) or summary["coveredReferenceLength"] is None:
        raise ValueError(f"{path} has counts that do not fit its libraries")
    hist = spark.createDataFrame([(lib.name, r["readCount"], *x) for lib, r, x in zip(libs, counts, flags, strict=True)], "lib string, reads long, " + ", ".join(f"n{k} long" for k in range(11)))
    files = spark.createDataFrame([tuple(r) for r in items(summary["readCountPerBam"], "counts of files")], "bam_file string, reads long")
    covered = spark.createDataFrame([(summary["coveredReferenceLength"],)], "covered long")
    groups = {r["first"]: r["second"] for r in items(config["readgroupToLibrary"], "read groups")}
    return Archive(Options(**given), libs, groups, hist, files, covered)
