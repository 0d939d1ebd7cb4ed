"""Enrichment and admission of alignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flags as fl
from ..options import Options

c = F.col


@dataclass(frozen=True)
class Library:
    """One library of the configuration; min_mapq -1: the option's value holds."""

    name: str
    bam_file: str
    mean: float
    std: float
    upper: float
    lower: float
    readlen: float
    min_mapq: int = -1


def library_table(df: DataFrame, libs: list[Library]) -> DataFrame:
    """A row per library, numbered by name: configuration, so small by nature."""
    rows = [(i, x.name, x.bam_file, float(x.mean), float(x.std), float(x.upper), float(x.lower), float(x.readlen), x.min_mapq) for i, x in enumerate(sorted(libs, key=lambda x: x.name))]
    return df.sparkSession.createDataFrame(rows, "lib_index int, lib string, lib_bam string, mean double, std double, upper double, lower double, readlen double, lib_mapq int")


def attach_library(df: DataFrame, rg_lib: dict[str, str], libs: list[Library], how: str = "inner") -> DataFrame:
    """Library and its configuration for each read group; an unknown or missing group gets the library of the first file by name. ``how`` left keeps reads whose library is not configured."""
    first = min(libs, key=lambda x: x.bam_file).name
    known = F.create_map(*[F.lit(x) for kv in rg_lib.items() for x in kv]) if rg_lib else F.lit(None).cast("map<string,string>")
    lib = F.coalesce(F.element_at(known, F.coalesce(c("rg"), F.lit(""))), F.lit(first))
    return df.withColumn("lib", lib).join(F.broadcast(library_table(df, libs)), "lib", how)


def scanned(df: DataFrame, contig: int | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Primary and placed records, of one contig or an overlapping stretch of it if given."""
    df = df.where(fl.primary() & fl.aligned())
    if contig is not None:
        df = df.where(c("tid") == contig)
    if begin is not None:
        df = df.where(c("pos") + c("qlen") > begin)
    if end is not None:
        df = df.where(c("pos") < end)
    return df


def enriched(df: DataFrame, rg_lib: dict[str, str], libs: list[Library], opts: Options = Options(), classifier: Column | None = None, how: str = "inner") -> DataFrame:
    """Adds lib and its columns, bdqual, rev, cls (before the inversion merge) and the quality to exceed, ``need``."""
    df = attach_library(df, rg_lib, libs, how).withColumn("bdqual", fl.quality()).withColumn("rev", fl.reverse())
    df = df.withColumn("need", F.when(c("lib_mapq") < 0, opts.min_mapq).otherwise(c("lib_mapq")))
    return fl.classified(df, classifier, opts.long_insert)


def admitted(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Records the calling pass uses, inversions merged: good enough, mapped pairs, of a size below the largest."""
    df = df.where((c("cls") != fl.NA) & ~fl.either_unmapped() & (c("bdqual") > c("need")))
    if opts.only_ctx:
        df = df.where(fl.interchromosomal())
    df = df.where((c("cls") == fl.CTX) | (F.abs("isize") <= opts.max_sd))
    return df.withColumn("cls", fl.merged_inversions(c("cls")))


def counted() -> Column:
    """Records of the counting pass: quality alone."""
    return c("bdqual") > c("need")


def counted_pairs(df: DataFrame) -> DataFrame:
    return df.where(counted())


def anomalous(df: DataFrame) -> DataFrame:
    return df.where(~c("cls").isin(fl.NORMAL_FR, fl.NORMAL_RF))
