"""Library configuration: tab-separated key:value lines, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.filters import Library

c = F.col
# Key patterns in the order they are tried, and the field each names.
FIELDS = (
    (r"group$", "readgroup"),
    (r"lib\w*$", "lib"),
    (r"low\w*$", "lower"),
    (r"map$", "map"),
    (r"map\w*qual\w*$", "min_mapq"),
    (r"mean\w*$", "mean"),
    (r"readlen\w*$", "readlen"),
    (r"samp\w*$", "sample"),
    (r"std\w*$", "std"),
    (r"upp\w*$", "upper"),
)


def field_of(key: Column) -> Column:
    """The field a key names; null for keys that are to be ignored."""
    out = F.lit(None).cast("string")
    for pattern, field in reversed(FIELDS):
        out = F.when(key.rlike(f"(?i){pattern}"), field).otherwise(out)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); a configuration file is small and read in one partition, in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def parse(lines: DataFrame, cutoff_sd: float = 3) -> DataFrame:
    """A typed row per line up to the first empty one; a line without a map key raises an error."""
    stop = lines.where(F.trim(F.coalesce("value", F.lit(""))) == "").agg(F.min("line_no").alias("stop"))
    used = lines.crossJoin(F.broadcast(stop)).where(c("stop").isNull() | (c("line_no") < c("stop")))
    tok = used.select("line_no", F.posexplode(F.split("value", "\t")).alias("k", "token")).where(F.instr("token", ":") > 0)
    tok = tok.select("line_no", "k", field_of(F.substring_index("token", ":", 1)).alias("field"), F.expr("substring(token, instr(token, ':') + 1)").alias("v")).where("field is not null")
    value = lambda f: F.max_by(F.when(c("field") == f, c("v")), F.when(c("field") == f, c("k")))
    w = used.select("line_no").join(tok, "line_no", "left").groupBy("line_no").agg(*[value(f).alias(f) for _, f in FIELDS])
    num = lambda f: c(f).try_cast("double")
    need = F.when(c("map").isNull(), F.raise_error(F.concat(F.lit("no map key in line "), (c("line_no") + 1).cast("string")))).otherwise(c("map"))
    w = w.select("line_no", need.cast("string").alias("bam_file"), F.coalesce("lib", "sample").alias("lib"), c("readgroup").alias("rg"), *[num(f).alias(f) for f in ("mean", "std", "upper", "lower", "readlen")], F.coalesce(c("min_mapq").try_cast("int"), F.lit(-1)).alias("min_mapq"))
    again = c("mean").isNotNull() & c("std").isNotNull() & (c("upper").isNull() | c("lower").isNull())
    return w.withColumn("rg", F.coalesce("rg", "lib")).withColumns(
        {"upper": F.when(again, c("mean") + cutoff_sd * c("std")).otherwise(c("upper")), "lower": F.when(again, F.greatest(F.lit(0.0), c("mean") - cutoff_sd * c("std"))).otherwise(c("lower"))}
    )


def libraries(parsed: DataFrame) -> DataFrame:
    """A row per library by name, numbered; the last line wins."""
    names = ["bam_file", "mean", "std", "upper", "lower", "readlen", "min_mapq"]
    last = parsed.groupBy("lib").agg(F.max_by(F.struct(*names), "line_no").alias("s")).select("lib", "s.*")
    return last.withColumn("lib_index", F.row_number().over(Window.orderBy("lib")) - 1)


def readgroups(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("rg").agg(F.max_by("lib", "line_no").alias("lib"))


def files(parsed: DataFrame) -> DataFrame:
    """Distinct files by name, numbered, with the library of their last line."""
    f = parsed.groupBy("bam_file").agg(F.max_by("lib", "line_no").alias("lib"))
    return f.withColumn("bam_index", F.row_number().over(Window.orderBy("bam_file")) - 1)


def first_window(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.greatest(F.lit(50), F.least(F.lit(100_000_000), F.min((c("mean") - 2 * c("readlen")).cast("int")))).cast("long").alias("window"))


def load(spark: SparkSession, path: str, cutoff_sd: float = 3) -> tuple[list[Library], dict[str, str]]:
    """Libraries and the read groups' libraries of a configuration file: configuration, small by nature."""
    p = parse(read_lines(spark, path), cutoff_sd)
    libs = [Library(r["lib"], r["bam_file"], r["mean"] or 0, r["std"] or 0, r["upper"] or 0, r["lower"] or 0, r["readlen"] or 0, r["min_mapq"]) for r in libraries(p).collect()]
    return libs, {r["rg"]: r["lib"] for r in readgroups(p).collect()}


def read_rg_map(spark: SparkSession, path: str) -> DataFrame:
    """(rg, lib): a file of two columns parted by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("rg"), parts[1].alias("lib"))
