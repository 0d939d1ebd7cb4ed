"""Stateful stream operators: islands of reads by contig, mates by name, each with timers in event time.

Event time is the place of a read (see ``sessions.position_time``), so a
watermark that trails by ``delay`` bases tells which places are complete. Both
operators need Spark's RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..ship import ship
from .sessions import CONTIG, position_time

c = F.col
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The total order of reads within a contig.
ORDER = ["pos", "rev", "qname", "mate"]


def use_state_store(spark: SparkSession) -> SparkSession:
    """Sets the store that stateful processors need, and sends the package to the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return ship(spark)


def _place(d: pd.DataFrame) -> pd.Series:
    """Event time in milliseconds."""
    return d["tid"].where(d["tid"] >= 0, CONTIG).astype("int64") * CONTIG + d["pos"]


class Islands(StatefulProcessor):
    """Reads of one contig: held until the watermark has passed them, then numbered in order.

    State: the reads that are held, and the last numbered read's position with
    its island. A timer stands at each held read's place of greatest time, so
    the last ones leave without further rows of their contig.
    """

    def __init__(self, window: int, columns: list[str], schema: StructType):
        self.window, self.columns, self.schema = window, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.last = handle.getValueState("last", "pos int, island long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of Spark's interface)
        new = pd.concat(list(rows), ignore_index=True)[self.columns]
        self.held.appendList([tuple(None if pd.isna(x) else x for x in r) for r in new.astype(object).itertuples(index=False)])
        self.handle.registerTimer(int(_place(new).max()))
        yield from self._passed(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._passed(timerValues.getCurrentWatermarkInMs())

    def _passed(self, watermark: int) -> Iterator[pd.DataFrame]:
        rows = list(self.held.get()) if self.held.exists() else []
        if not rows:
            return
        d = pd.DataFrame(rows, columns=self.columns)
        ready = _place(d) <= watermark
        if not ready.any():
            return
        if ready.all():
            self.held.clear()
        else:
            self.held.put([tuple(r) for r, out in zip(rows, ready, strict=True) if not out])
        out = d[ready].sort_values(ORDER, kind="stable")
        pos, island = self.last.get() if self.last.exists() else (None, 0)
        before = out["pos"].shift(1)
        if pos is not None:
            before.iloc[0] = pos
        numbers = (before.isna() | (out["pos"] - before > self.window)).cumsum() + island
        self.last.update((int(out["pos"].iloc[-1]), int(numbers.iloc[-1])))
        yield out.assign(island=numbers.astype("int64"))

    def close(self) -> None:
        pass


def stream_islands(reads: DataFrame, window: int, delay: int = 1) -> DataFrame:
    """Each read with ``island``, its number on its contig from 1: a new one where the gap exceeds ``window`` bases.

    reads: a stream in order of contig and position but for ``delay`` bases, with
    tid, pos, rev, qname and mate. A read leaves when the watermark has passed
    its place; what is behind the last place less ``delay`` stays until more rows
    come. Contigs are the keys, so one contig's open reads are one task's.
    """
    use_state_store(reads.sparkSession)
    columns, schema = reads.columns, reads.schema
    out = StructType(list(schema)).add("island", "long")
    d = reads.withColumn("_at", position_time(c("tid"), c("pos"))).withWatermark("_at", f"{delay} milliseconds")
    return d.groupBy("tid").transformWithStateInPandas(statefulProcessor=Islands(window, columns, schema), outputStructType=out, outputMode="Append", timeMode="EventTime")


class Mates(StatefulProcessor):
    """Reads of one name: the first waits for the second; later ones are no pair.

    State: the first read until it has its mate, and whether the name is done.
    Both go ``reach`` bases behind the first read.
    """

    def __init__(self, reach: int, columns: list[str], schema: StructType):
        self.reach, self.columns, self.schema = reach, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.schema)
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        new = pd.concat(list(rows), ignore_index=True)[self.columns]
        waiting = self.first.exists()
        if waiting:
            new = pd.concat([pd.DataFrame([self.first.get()], columns=self.columns), new], ignore_index=True)
        else:
            self.handle.registerTimer(int(_place(new).min()) + self.reach)
        new = new.sort_values(["tid", *ORDER], kind="stable").head(2)
        if len(new) < 2:
            self.first.update(tuple(None if pd.isna(x) else x for x in new.astype(object).iloc[0]))
            return
        if waiting:
            self.first.clear()
        self.done.update((True,))
        a, b = new.iloc[[0]].reset_index(drop=True), new.iloc[[1]].reset_index(drop=True)
        yield pd.concat([a[["qname"]], a.drop(columns="qname").add_prefix("first_"), b.drop(columns="qname").add_prefix("second_")], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        self.done.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_mates(reads: DataFrame, reach: int, delay: int = 1) -> DataFrame:
    """A row for each name's first two reads: qname, then their other columns as first_* and second_*.

    reads: a stream in order of contig and position, with tid, pos, rev, qname and
    mate. A name is forgotten when the watermark is ``reach`` bases behind its
    first read (contigs lie 2^31 bases apart), so state holds the names of that
    stretch alone; a mate that comes later starts anew.
    """
    use_state_store(reads.sparkSession)
    schema = reads.schema
    rest = [f for f in schema if f.name != "qname"]
    out = StructType([schema["qname"]])
    for prefix in ("first_", "second_"):
        for f in rest:
            out.add(prefix + f.name, f.dataType)
    d = reads.withColumn("_at", position_time(c("tid"), c("pos"))).withWatermark("_at", f"{delay} milliseconds")
    return d.groupBy("qname").transformWithStateInPandas(statefulProcessor=Mates(reach, reads.columns, schema), outputStructType=out, outputMode="Append", timeMode="EventTime")
