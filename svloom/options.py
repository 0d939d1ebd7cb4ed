"""Options of a run, with the defaults of the calling tool they describe."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    min_len: int = 7
    cutoff_sd: int = 3
    max_sd: int = 1_000_000_000
    min_mapq: int = 35
    min_read_pair: int = 2
    coverage_limit: int = 1000
    buffer: int = 100
    only_ctx: bool = False
    fisher: bool = False
    long_insert: bool = False
    per_library: bool = False
    allele_frequency: bool = False
    score_threshold: int = 30
    contig: str | None = None
    fastq_prefix: str | None = None
    bed_file: str | None = None
