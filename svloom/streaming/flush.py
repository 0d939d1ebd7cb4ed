"""Calls over a stream: a batch of regions is called as soon as it is closed, and once.

Reads come in order of contig and position. A region is closed when an island
begins behind it; ``buffer`` + 1 closed regions are a batch, which is walked
and called with what earlier batches left: their regions, names still without a
mate, pairs inside a region that no edge has owned yet, and counts of normal
reads. So the calls of all batches are those of the batch analysis.

Everything that micro-batch n makes lies in folders ``batch=n`` that a replay
writes again, its state last. A replayed micro-batch starts from the state of
the one before and so gives the same files, no second call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import flags as fl
from ..operators import calls, filters, links, regions
from ..operators.regions import ORDER
from ..plans.pipeline import Analysis
from ..ship import ship, written

c = F.col
#: What a later batch needs of a read, and of a region.
READ = ["qname", "tid", "pos", "rev", "mate", "region", "cls", "lib", "bam_file", "lib_index", "isize", "qlen", "bdqual"]
REGION = ["region", "tid", "start", "end", "fwd", "rev", "max_len"]
PLACE = "struct<tid:int,pos:int,rev:int,qname:string,mate:int>"
CALLS = (
    "flush long, rank long, ea long, eb long, tid1 int, pos1 long, fwd1 long, rev1 long, tid2 int, pos2 long, fwd2 long, rev2 long, flag int, type string, size long, score int, num_reads long, "
    "support array<struct<key: string, reads: long>>, copy_number map<string, double>, allele_frequency double"
)
STATE = f"first long, flush long, regions long, last long, cut {PLACE}, place {PLACE}, totals array<long>"


def place() -> Column:
    return F.struct(*[c(n).cast("string" if n == "qname" else "int").alias(n) for n in ORDER])


class CallStream:
    """The sink of a stream of alignments that writes calls to ``folder``, which driver and executors share.

    analysis: makes the ``Analysis`` of a DataFrame of alignments with its
    statistics given (``hist``, ``files``, ``covered``, as ``Analysis.restored``
    does), for a stream has no counting pass. State between two batches: the
    open reads, and of closed regions a row each, the first two reads of each
    name, and unowned pairs. Names stay, as a mate may come on any later contig
    and a third read of a name is no new pair. Admitted reads of micro-batches
    before the state's ``first`` are not read any more and may be deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, analysis: Callable[[DataFrame], Analysis]):
        self.spark, self.folder, self.analysis = ship(spark), folder.rstrip("/"), analysis
        start = [(0, 0, 0, -1, None, None, None)]
        spark.createDataFrame(start, STATE).write.mode("ignore").json(f"{self.folder}/state/batch=-1")

    def start(self, alignments: DataFrame, **trigger) -> StreamingQuery:
        """Starts the stream, with the arguments of ``trigger``; its checkpoint lies beside the calls."""
        return alignments.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()

    def __call__(self, alignments: DataFrame, batch: int) -> None:
        state = self._state(batch - 1)
        a = self.analysis(alignments)
        self._write(a.admitted, "admitted", batch)
        got = self._parts("admitted", batch, batch).agg(F.min(place()).alias("lo"), F.max(place()).alias("hi")).first()
        if got["lo"] is not None:
            if state["place"] is not None and tuple(got["lo"]) < tuple(state["place"]):
                raise ValueError(f"micro-batch {batch} begins at {tuple(got['lo'])}, before the end of the last, {tuple(state['place'])}")
            state["place"] = got["hi"]
        self._commit(self._called(a, state, batch, final=False), batch)

    def finish(self) -> DataFrame:
        """All calls, those of the last batch of regions included, as if the stream had ended.

        If it goes on, its next micro-batch replaces what this call has added.
        """
        batch = self.spark.read.schema(STATE).json(f"{self.folder}/state").agg(F.max("batch")).first()[0]
        if batch >= 0:
            self._called(self.analysis(self._parts("admitted", batch, batch)), self._state(batch), batch + 1, final=True)
        return self.calls()

    def calls(self) -> DataFrame:
        """The calls so far, in no order: sort by flush, rank."""
        return self.spark.read.parquet(f"{self.folder}/calls").drop("batch")

    def _state(self, batch: int) -> dict:
        return self.spark.read.schema(STATE).json(f"{self.folder}/state/batch={batch}").first().asDict()

    def _commit(self, state: dict, batch: int) -> None:
        row = tuple(state[n] for n in ("first", "flush", "regions", "last", "cut", "place", "totals"))
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").json(f"{self.folder}/state/batch={batch}")

    def _write(self, df: DataFrame, what: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch={batch}")

    def _parts(self, what: str, first: int, last: int) -> DataFrame:
        """What micro-batches ``first`` to ``last`` wrote, with ``batch``."""
        paths = [f"{self.folder}/{what}/batch={n}" for n in range(first, last + 1)]
        return self.spark.read.option("basePath", f"{self.folder}/{what}").parquet(*paths)

    def _called(self, a: Analysis, state: dict, batch: int, final: bool) -> dict:
        """Calls the batches of regions that are closed after micro-batch ``batch``; the state after it."""
        opts, step = a.opts, a.opts.buffer + 1
        d = self._parts("admitted", state["first"], batch - 1 if final else batch)
        if state["cut"] is not None:
            d = d.where(place() > self._literal(state["cut"]))
        reads = written(regions.islands(filters.anomalous(d), a.window_row), "open-islands")
        table = written(regions.island_table(reads), "open-table")
        closed = table if final else table.where(c("island") < F.lit(table.agg(F.max("island")).first()[0]))
        accepted = regions.regions(closed, opts).withColumn("region", c("region") + state["regions"])
        known = state["regions"] + accepted.count()
        upto = known if final else known // step * step
        if upto == state["regions"]:
            self._write(self.spark.createDataFrame([], CALLS), "calls", batch)
            return state
        accepted = written(accepted.where(c("region") < upto), "open-regions")
        later = state["last"] >= 0  # an earlier micro-batch has called

        found = regions.region_reads(reads, accepted, opts).select(READ)
        if later:
            found = found.unionByName(self._parts("names", state["last"], state["last"]).select(READ))
        found = written(found, "open-names")
        pairs = links.mate_pairs(found).where(c("b") >= state["regions"])
        pairs = written(pairs, "open-pairs")
        order = written(links.visit_order(links.edges(pairs), opts), "open-order")
        waiting = self._parts("inner", state["last"], state["last"]).select(pairs.columns) if later else pairs.limit(0)
        pairs = pairs.unionByName(waiting)
        owned = written(links.owned_pairs(pairs, order), "open-owned")

        keys, key = a.keys, "lib" if opts.per_library else "bam_file"
        before = state["totals"] or [0] * len(keys)
        counts = links.normal_counts(d, reads, keys, key, accepted)
        counts = counts.select("region", *[(c(f"{side}_k{i}") + n).alias(f"{side}_k{i}") for i, n in enumerate(before) for side in ("lo", "hi")])
        new = accepted.select(REGION).join(counts, "region")
        every = new
        if later:
            # micro-batches that called nothing have no folder
            old = self.spark.read.parquet(f"{self.folder}/regions").where(c("batch") < batch)
            every = new.unionByName(old.select(new.columns))
        every = written(every, "regions-so-far")
        between = links.between_counts(order, every, keys)
        self._write(calls.assemble(owned, every, table, between, a.density, a.hist, a.covered, a.library_rows, opts, a.pad_length), "calls", batch)
        if final:
            return state

        visited = order.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        self._write(pairs.where("a = b").join(visited, c("a") == c("v"), "left_anti"), "inner", batch)
        self._write(first_two(found), "names", batch)
        self._write(every.where(c("region") >= state["regions"]), "regions", batch)
        island = accepted.agg(F.max("island")).first()[0]
        cut = reads.where(c("island") == island).agg(F.max(place())).first()[0]
        here = self._literal(cut)
        sums = d.where(fl.proper_pair() & (place() <= here)).agg(*[F.count_if(c(key) == k) for k in keys]).first()
        first = d.where(place() > here).agg(F.min("batch")).first()[0]
        return {**state, "first": batch + 1 if first is None else first, "flush": upto // step, "regions": upto, "last": batch, "cut": cut, "totals": [x + n for x, n in zip(before, sums, strict=True)]}

    def _literal(self, at) -> Column:
        return F.struct(*[F.lit(x).cast("string" if n == "qname" else "int").alias(n) for n, x in zip(ORDER, at, strict=True)])


def first_two(reads: DataFrame) -> DataFrame:
    """Of each name the first two reads; a name that many share sends two from each task."""
    w = Window.partitionBy("qname").orderBy("tid", "pos", "rev", "mate")
    return reads.withColumn("_k", F.row_number().over(w)).where("_k <= 2").drop("_k")
