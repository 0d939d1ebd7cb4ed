"""The whole analysis as one plan: statistics, regions, links, calls."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import calls, filters, links, regions, stats
from ..operators.filters import Library
from ..options import Options
from ..ship import written
from ..sources.archive import Archive


@dataclass
class Analysis:
    """Alignments, configuration and options; every step is a DataFrame.

    What several later steps need is written to the shared folder once: the
    anomalous reads (a small part of all), the regions, pairs and statistics.
    """

    alignments: DataFrame
    libs: list[Library]
    rg_lib: dict[str, str]
    opts: Options = Options()
    window: int | None = None
    pad_length: int | None = None
    classifier: Column | None = None
    contig: int | None = None

    @classmethod
    def restored(cls, alignments: DataFrame, saved: Archive, **more) -> Analysis:
        """A run with the options, configuration and counting pass of an archive: only the calling pass reads the alignments."""
        out = cls(alignments, saved.libs, saved.rg_lib, saved.opts, **more)
        out.hist, out.files, out.covered = saved.hist, saved.files, saved.covered
        return out

    @cached_property
    def library_rows(self) -> DataFrame:
        return filters.library_table(self.alignments, self.libs)

    @cached_property
    def scanned(self) -> DataFrame:
        return filters.scanned(self.alignments, self.contig)

    @cached_property
    def reads(self) -> DataFrame:
        return filters.enriched(self.scanned, self.rg_lib, self.libs, self.opts, self.classifier)

    @cached_property
    def counts(self) -> DataFrame:
        every = filters.enriched(self.scanned, self.rg_lib, self.libs, self.opts, self.classifier, "left")
        return written(stats.counting_pass(every, self.opts), "counts")

    @cached_property
    def hist(self) -> DataFrame:
        return written(stats.flag_histogram(self.counts), "histogram")

    @cached_property
    def files(self) -> DataFrame:
        return stats.file_counts(self.counts)

    @cached_property
    def covered(self) -> DataFrame:
        return written(stats.covered_length(self.counts), "covered")

    @cached_property
    def density(self) -> DataFrame:
        return stats.density(self.hist, self.files, self.covered, self.opts.per_library)

    @cached_property
    def window_row(self) -> DataFrame:
        if self.window is not None:
            return self.alignments.sparkSession.range(1).select(F.lit(self.window).cast("long").alias("window"))
        return stats.window_size(self.hist, self.library_rows, self.covered)

    @cached_property
    def admitted(self) -> DataFrame:
        return filters.admitted(self.reads, self.opts)

    @cached_property
    def anomalous(self) -> DataFrame:
        """Few of all reads, and needed by regions, links and sinks: ``islands`` writes them once."""
        return regions.islands(filters.anomalous(self.admitted), self.window_row)

    @cached_property
    def table(self) -> DataFrame:
        return written(regions.island_table(self.anomalous), "islands")

    @cached_property
    def regions(self) -> DataFrame:
        return written(regions.regions(self.table, self.opts), "regions")

    @cached_property
    def region_reads(self) -> DataFrame:
        return regions.region_reads(self.anomalous, self.regions, self.opts)

    @cached_property
    def pairs(self) -> DataFrame:
        return written(links.mate_pairs(self.region_reads), "pairs")

    @cached_property
    def edges(self) -> DataFrame:
        return written(links.edges(self.pairs), "edges")

    @cached_property
    def order(self) -> DataFrame:
        return written(links.visit_order(self.edges, self.opts), "order")

    @cached_property
    def owned(self) -> DataFrame:
        return written(links.owned_pairs(self.pairs, self.order), "owned")

    @property
    def keys(self) -> list[str]:
        return sorted({x.name if self.opts.per_library else x.bam_file for x in self.libs})

    @cached_property
    def region_counts(self) -> DataFrame:
        return links.normal_counts(self.admitted, self.anomalous, self.keys, "lib" if self.opts.per_library else "bam_file", self.regions)

    @cached_property
    def between(self) -> DataFrame:
        return links.between_counts(self.edges.where(F.col("weight") >= self.opts.min_read_pair), self.region_counts, self.keys)

    @cached_property
    def calls(self) -> DataFrame:
        return calls.assemble(self.owned, self.regions, self.table, self.between, self.density, self.hist, self.covered, self.library_rows, self.opts, self.pad_length)
