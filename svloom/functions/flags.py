"""Predicates and classes of an alignment, as Columns over flag, tid, pos, mtid, mpos, isize, upper, lower."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Pair classes by ordinal, their external codes, and the call types they name.
NA, FF, LARGE, SMALL, RF, RR, NORMAL_FR, NORMAL_RF, CTX, MATE_UNMAPPED, UNMAPPED = range(11)
EXTERNAL = {NA: 0, FF: 1, LARGE: 2, SMALL: 3, RF: 4, RR: 8, NORMAL_FR: 18, NORMAL_RF: 20, CTX: 32, MATE_UNMAPPED: 64, UNMAPPED: 192}
TYPES = {FF: "INV", RR: "INV", LARGE: "DEL", SMALL: "INS", RF: "ITX", CTX: "CTX"}
TYPES_LONG = {FF: "INV", RR: "INV", LARGE: "", SMALL: "INS", RF: "DEL", CTX: "CTX"}

c = F.col


def has(bit: int, flag: str = "flag") -> Column:
    return c(flag).bitwiseAND(bit) != 0


def primary() -> Column:
    """Neither secondary nor supplementary."""
    return c("flag").bitwiseAND(0x100 | 0x800) == 0


def aligned() -> Column:
    return c("tid") >= 0


def proper_pair() -> Column:
    """Paired and proper, both mapped, no duplicate."""
    return c("flag").bitwiseAND(0x1 | 0x2 | 0x4 | 0x8 | 0x400) == 0x3


def either_unmapped() -> Column:
    return has(0x4 | 0x8)


def interchromosomal() -> Column:
    return c("tid") != c("mtid")


def leftmost() -> Column:
    return c("pos") < c("mpos")


def reverse() -> Column:
    return F.when(has(0x10), 1).otherwise(0)


def quality() -> Column:
    """The pair's mapping quality where the record has one, else its own."""
    return F.coalesce(c("am"), c("mapq"))


def pair_class() -> Column:
    """Class of a pair: by flags first, then by strands, order and size."""
    rev, mate_rev = has(0x10), has(0x20)
    return (
        F.when(has(0x400) | ~has(0x1), NA)
        .when(has(0x4), UNMAPPED)
        .when(has(0x8), MATE_UNMAPPED)
        .when(interchromosomal(), CTX)
        .when(rev & mate_rev, RR)
        .when(~rev & ~mate_rev, FF)
        .when(leftmost() == rev, RF)
        .when(F.abs("isize") > c("upper"), LARGE)
        .when(F.abs("isize") < c("lower"), SMALL)
        .otherwise(NORMAL_FR)
    )


def mate_pair_class(cls: Column) -> Column:
    """Classes for long-insert libraries: three rules, one after the other."""
    size = F.abs("isize")
    a = F.when((cls == NORMAL_RF) & (size > c("upper")), RF).otherwise(cls)
    b = F.when((a == RF) & (size < c("upper")), NORMAL_RF).otherwise(a)
    return F.when((b == NORMAL_RF) & (size < c("lower")), SMALL).otherwise(b)


def merged_inversions(cls: Column) -> Column:
    """Looked up, so that the class is named once: with a second copy in each filter over it, the compiled scan grows too long for the JVM to optimise."""
    return F.get(F.array(*[F.lit(FF if k == RR else k) for k in range(11)]), cls)


def lookup(values: Mapping[int, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def call_type(cls: Column, long_insert: bool = False) -> Column:
    return lookup(TYPES_LONG if long_insert else TYPES, cls)


def external_code(cls: Column) -> Column:
    return lookup(EXTERNAL, cls)


def letter_or_bit(bit: int, letter: str) -> Column:
    """A flag given as a number, or as letters."""
    text = c("flag_text")
    return (F.coalesce(text.try_cast("int"), F.lit(0)).bitwiseAND(bit) != 0) | F.contains(text, F.lit(letter))


def legacy_quality(mapped: bool = False) -> Column:
    """Mapping quality as the estimator takes it: the tags aq, then am, before mapq; mapped: mapq itself."""
    return c("mapq") if mapped else F.coalesce(c("aq"), c("am"), c("mapq"))


def legacy_code() -> Column:
    """External code as the estimator derives it from flag_text, chr/pos/mchr/mpos, platform and mf (an override)."""
    rev, mate_rev = letter_or_bit(0x10, "r"), letter_or_bit(0x20, "R")
    left, solid = c("pos") < c("mpos"), F.lower(F.coalesce(c("platform"), F.lit("illumina"))).contains("solid")
    first = letter_or_bit(0x40, "\x00")
    ahead = F.when(rev, c("pos") > c("mpos")).otherwise(left)
    behind = F.when(rev, left).otherwise(c("pos") > c("mpos"))
    solid_code = F.when(rev != mate_rev, F.when(~mate_rev, 1).otherwise(8)).when(F.when(first, ahead).otherwise(behind), 2).otherwise(4)
    same = F.when(~mate_rev, 1).otherwise(8)
    outward = ((c("mpos") > c("pos")) & rev) | ((c("pos") > c("mpos")) & ~rev)
    return F.coalesce(
        c("mf").cast("int"),
        F.when(letter_or_bit(0x400, "d"), 0)
        .when(~letter_or_bit(0x1, "p"), 0)
        .when(letter_or_bit(0x4, "u"), 192)
        .when(letter_or_bit(0x8, "U"), 64)
        .when(c("mchr") != "=", 32)
        .when(letter_or_bit(0x2, "P"), F.when(solid, 18).when(left == ~rev, 18).otherwise(20))
        .when(solid, solid_code)
        .when(rev == mate_rev, same)
        .when(outward, 4)
        .otherwise(2),
    )


def classified(df: DataFrame, classifier: Column | None = None, long_insert: bool = False, merge: bool = False) -> DataFrame:
    """Adds ``cls``; ``classifier`` may replace the default pair class."""
    cls = pair_class() if classifier is None else classifier
    cls = mate_pair_class(cls) if long_insert else cls
    return df.withColumn("cls", merged_inversions(cls) if merge else cls)
