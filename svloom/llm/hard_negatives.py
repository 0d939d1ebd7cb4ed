"""Hard negatives by a vector-approximation file.

Every dimension is cut into cells of about equal population; a row is stored
as the cell numbers of its components (a byte each), in blocks, beside its exact
components. For an anchor, a table holds the least and the largest product of
its component with every cell of a dimension: summed over a row's cells, look-ups
give an upper and a lower bound of the row's score. Only rows whose bounds may
enter the anchor's first places (or a window's) are scored exactly.

Two passes over the file: the first finds every anchor's positives, the second
the best negatives of every window. Anchors come in blocks, dealt to the
candidate blocks by a salted key, so that neither side meets in one task. A task
carries the best scores it has seen from block to block, as thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .common import written

#: Cells of a dimension; rows of a block; anchors of a block; anchor blocks whose state a task holds.
CELLS, BLOCK_ROWS, ANCHOR_ROWS, HELD = 128, 2048, 128, 16
#: Sums of products beyond this raise an error.
MOST = 2**61


def usable(vectors: DataFrame, shift_every: int, labels: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, dim, q: the rows that take part, with shifted labels and components floor(256 * x)."""
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[embedding].cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**52))
    broken = F.exists("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) >= 2.0**52) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0))
    v = v.where(F.when(broken, F.raise_error(F.lit("a score may not fit a 64-bit integer")).cast("boolean")).otherwise(fine))
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    v = v.select("vec_id", moved.alias("label"), F.transform("e", lambda x: F.floor(x * 256.0).cast("long")).alias("q"))
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", F.size("r.q").alias("dim"), "r.q")


def cell_marks(v: DataFrame, cells: int = CELLS) -> DataFrame:
    """dim, low, high: for vectors of ``dim`` components, flat lists (component by component) of each cell's ends.

    Quantiles of all rows, a row of the result for each vector length.
    """
    each = v.select("dim", F.posexplode("q").alias("at", "x")).groupBy("dim", "at")
    shares = [i / cells for i in range(1, cells)]
    found = each.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", shares, 2000).alias("cuts"))
    # a cell holds the whole numbers from one cut to the one below the next
    low = F.concat(F.array("least"), F.col("cuts"))
    high = F.concat(F.transform("cuts", lambda x: x - 1), F.array("most"))
    rows = F.array_sort(F.collect_list(F.struct("at", low.alias("low"), high.alias("high"))))
    return found.groupBy("dim").agg(rows.alias("m")).select("dim", F.flatten("m.low").alias("low"), F.flatten("m.high").alias("high"))


def approximation_file(v: DataFrame, marks: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows of one length: ids, labels, cells (bytes, row by row), parts (exact components), norm, and the marks."""
    schema = pa.schema([("dim", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("parts", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, labels, q = zip(*held.pop(dim), strict=True)
            x = np.array(q, np.int64)
            norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict({"dim": [dim], "norm": [norm], "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "parts": [x.tobytes()]}, schema=schema)

        for b in batches:
            for i, y, dim, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = held.setdefault(dim, [])
                part.append((i, y, q))
                if len(part) >= rows:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["parts"], np.int64).reshape(-1, r["dim"])
                low = np.array(r["low"], np.int64).reshape(r["dim"], -1)
                cells = np.empty(x.shape, np.uint8)
                for d in range(r["dim"]):
                    cells[:, d] = np.searchsorted(low[d, 1:], x[:, d], "right")
                yield pa.RecordBatch.from_pydict({**{k: [r[k]] for k in ("dim", "norm", "ids", "labels", "parts", "low", "high")}, "cells": [cells.tobytes()]}, schema=pa.schema([*schema, ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("cells", pa.binary())]))

    blocks = v.mapInArrow(pack, "dim int, norm double, ids binary, labels binary, parts binary")
    return blocks.join(marks, "dim").mapInArrow(encode, "dim int, norm double, ids binary, labels binary, parts binary, low array<long>, high array<long>, cells binary")


class Block:
    """A candidate block, ready for look-ups."""

    def __init__(self, r: dict):
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.parts = np.frombuffer(r["parts"], np.int64).reshape(len(self.ids), -1)
        cells = np.frombuffer(r["cells"], np.uint8).reshape(self.parts.shape)
        self.low, self.high = (np.array(r[k], np.int64).reshape(self.parts.shape[1], -1) for k in ("low", "high"))
        # where a row's cells lie in an anchor's table
        self.at = cells.astype(np.intp) + np.arange(self.parts.shape[1]) * self.low.shape[1]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of the anchor's components with each cell, flat."""
        a, b = q[:, None] * self.low, q[:, None] * self.high
        lower, upper = np.minimum(a, b), np.maximum(a, b)
        top = max(-float(lower.min(axis=1).astype(float).sum()), float(upper.max(axis=1).astype(float).sum()))
        if top > MOST:
            raise OverflowError("a score may not fit a 64-bit integer")
        kind = np.int32 if top < 2**31 else np.int64
        return lower.ravel().astype(kind), upper.ravel().astype(kind)

    def bound(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return table.take(self.at[rows]).sum(axis=1, dtype=table.dtype)

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.parts[rows] @ q


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Places:
    """The first k rows seen by a task for one anchor (and window): what may still enter has a score of ``limit`` at least."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def limit(self, least: int) -> int:
        return max(least, int(self.scores[-1])) if len(self.scores) == self.k else least

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            self.ids, self.scores = best(np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores)), self.k)


def kth(x: np.ndarray, k: int) -> int:
    """The k-th largest, or far below all when there are fewer."""
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -MOST


def search(windowed: bool, k: int, counts: list[int] | None = None):
    """A pass over (candidate block, anchor block) rows: k places for each anchor, or for each window of an anchor.

    counts: if given, gets [pairs bounded, pairs scored exactly] added (for tests).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[dict[int, Places]]] = {}
        known: dict[bytes, list] = {}
        last: tuple[bytes, Block] | None = None

        def out() -> Iterator[pa.RecordBatch]:
            for ids, states in held.items():
                rows = [(a, p, x.ids, x.scores) for a, state in zip(np.frombuffer(ids, np.int64).tolist(), states, strict=True) for p, x in state.items() if len(x.ids)]
                if rows:
                    n = [len(x[2]) for x in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in rows], n)), pa.array(np.repeat([x[1] for x in rows], n)), pa.array(np.concatenate([x[2] for x in rows])), pa.array(np.concatenate([x[3] for x in rows]))], names=["anchor_id", "of", "vec_id", "score"])
            held.clear()
            known.clear()

        for b in batches:
            for r in b.to_pylist():
                if last is None or last[0] != r["ids"]:
                    last = (r["ids"], Block(r))
                block, name = last[1], r["a_ids"]
                if name not in held:
                    if len(held) >= HELD:
                        yield from out()
                    windows = np.frombuffer(r["windows"], np.int64).reshape(-1, 2) if windowed else None
                    ids = np.frombuffer(name, np.int64)
                    q = np.frombuffer(r["a_parts"], np.int64).reshape(len(ids), -1)
                    spans = [np.unique(windows[windows[:, 0] == i, 1]).tolist() for i in range(len(ids))] if windowed else [[0]] * len(ids)
                    held[name] = [{p: Places(k) for p in s} for s in spans]
                    known[name] = [ids.tolist(), np.frombuffer(r["a_labels"], np.int64), q, [block.tables(x) for x in q]]
                ids, labels, q, tables = known[name]
                for i, state in enumerate(held[name]):
                    rows = np.flatnonzero(block.labels != labels[i]) if windowed else np.flatnonzero((block.labels == labels[i]) & (block.ids != ids[i]))
                    if not len(rows) or not state:
                        continue
                    scored = _windows(block, rows, q[i], tables[i], state, k) if windowed else _first(block, rows, q[i], tables[i], state[0], k)
                    if counts is not None:
                        counts[0] += len(rows)
                        counts[1] += scored
        yield from out()

    return run


def _first(block: Block, rows: np.ndarray, q: np.ndarray, table: tuple, places: Places, k: int) -> int:
    upper = block.bound(table[1], rows)
    limit = places.limit(-MOST)
    if limit == -MOST:
        limit = kth(block.bound(table[0], rows), k)
    rows = rows[upper >= limit]
    places.add(*best(block.ids[rows], block.exact(rows, q), k))
    return len(rows)


def window(p: int) -> tuple[int, int]:
    """Scores n with 50 p <= 100 n <= 95 p."""
    return -(-p // 2), 95 * p // 100


def _windows(block: Block, rows: np.ndarray, q: np.ndarray, table: tuple, state: dict[int, Places], k: int) -> int:
    upper = block.bound(table[1], rows)
    spans = {p: window(p) for p in state}
    least = min(x.limit(spans[p][0]) for p, x in state.items())
    rows, upper = rows[upper >= least], upper[upper >= least]
    lower = block.bound(table[0], rows)
    enters = np.zeros(len(rows), bool)
    for p, x in state.items():
        low, high = spans[p]
        sure = lower[(lower >= low) & (upper <= high)]
        enters |= (upper >= max(x.limit(low), kth(sure, k))) & (lower <= high)
    rows = rows[enters]
    scores, ids = block.exact(rows, q), block.ids[rows]
    for p, x in state.items():
        inside = (scores >= spans[p][0]) & (scores <= spans[p][1])
        x.add(ids[inside], scores[inside])
    return len(rows)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, shift_every: int = 7, labels: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``, candidates all
    rows. The label of a row whose vec_id is divisible by ``shift_every`` becomes
    (label + 1) % labels first. The score is the integer product of
    floor(256 * x); higher scores are first, ties go to the smaller vec_id. An
    anchor's positives are its first ``positives`` other rows of the same label;
    for each of them come the first ``negatives`` rows of another label with 50
    positive_score <= 100 negative_score <= 95 positive_score, ranked from 1.

    Rows whose vec_id, label or vector is null, whose vector is empty or has a
    null or non-finite component take no part; rows of another vector length
    than the anchor's are no candidates of it. Rows that repeat a vec_id count as
    one (the least by label, then vector). Scores that may pass 2^61 raise an
    error. Anchors without positives, and positives without negatives, give no
    rows; an empty table gives none. Further columns take no part.
    """
    spark = ship(vectors.sparkSession)
    v = written(usable(vectors, shift_every, labels, vec_id, embedding, label), "vectors")
    marks = written(cell_marks(v), "marks")
    cells = written(approximation_file(v, marks), "cells")
    few = v.where(F.col("vec_id") % every == 0)
    few = few.coalesce(max(1, spark.sparkContext.defaultParallelism // 2))
    asked = written(approximation_file(few, marks, ANCHOR_ROWS).select("dim", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("parts").alias("a_parts"), F.xxhash64("ids").alias("block")), "anchors")
    # every anchor block meets every candidate block; salts spread the meeting over the tasks
    salts = max(4, spark.sparkContext.defaultParallelism * 2)
    left = cells.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).drop("norm")
    salted = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    found = "anchor_id long, of long, vec_id long, score long"

    def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        return df.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    first = left.join(asked.withColumn("salt", salted), ["salt", "dim"]).drop("salt", "dim", "block").mapInArrow(search(False, positives), found)
    mine = written(ranked(first, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # an anchor block's windows: (place in the block, positive score), at most ``positives`` an anchor
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["a_ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "at", "anchor_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [np.array(sorted((x["at"], x["positive_score"]) for x in s), np.int64).tobytes() for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.binary())], names=["block", "windows"])

    at = asked.select("block", "a_ids").mapInArrow(unpack, "block long, at long, anchor_id long")
    spans = at.join(mine, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("at", "positive_score")).alias("s")).mapInArrow(pack, "block long, windows binary")
    second = left.join(asked.join(spans, "block").withColumn("salt", salted), ["salt", "dim"]).drop("salt", "dim", "block").mapInArrow(search(True, negatives), found)
    hard = ranked(second, ["anchor_id", "of"], negatives).select("anchor_id", F.col("of").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mine.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
