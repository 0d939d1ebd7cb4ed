"""Exact top-k by distributed histogram selection.

Candidates and queries are packed into blocks; each block pair gives the
integer scores as one matrix product. Round by round, per-query histograms of
the scores, summed over all candidate blocks, narrow the interval that holds
the k-th score until it is one value; then each block emits what lies above
(and the ties of least id, at most k), and a rank over these few ends it.
Query blocks are dealt to the candidate blocks by a salted key, so neither side
meets in one task, and each side is read in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from .common import written

#: Rows of a query block and of a candidate block; bins of a histogram round; query blocks whose histograms a task holds.
QUERY_ROWS, BLOCK_ROWS, BINS, HELD = 1024, 2048, 256, 16


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(block rows) n, dim, top, ids, parts: up to ``rows`` vectors of one length as packed bytes; top = largest |part|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, xs = zip(*held.pop(dim), strict=True)
            x = _quantised(np.array(xs, float).reshape(len(ids), dim))
            ids = np.array(ids, np.int64)
            return pa.RecordBatch.from_pydict({"n": [len(ids)], "dim": [dim], "top": [float(np.abs(x).max(initial=0))], "norm": [float(np.sqrt((x * x).sum(axis=1)).max(initial=0))], "ids": [ids.tobytes()], "parts": [x.tobytes()]}, schema=pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("top", pa.float64()), ("norm", pa.float64()), ("ids", pa.binary()), ("parts", pa.binary())]))

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = held.setdefault(len(x), [])
                part.append((i, x))
                if len(part) >= rows:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "n long, dim long, top double, norm double, ids binary, parts binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while every sum stays below 2^53, 64-bit integers beyond."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if max(np.abs(q).max(), np.abs(c).max()) >= 2.0**63:
        raise OverflowError("a score does not fit a 64-bit integer")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _blocks(b: pa.RecordBatch):
    for r in b.to_pylist():
        ci = np.frombuffer(r["ids"], np.int64)
        qi = np.frombuffer(r["q_ids"], np.int64)
        c = np.frombuffer(r["parts"]).reshape(len(ci), -1)
        q = np.frombuffer(r["q_parts"]).reshape(len(qi), -1)
        yield r, ci, qi, scores(q, c)


def histogram_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (query, bin) inside each query's interval; a query itself is no candidate of its own.

    A task adds up what it reads; of HELD query blocks at a time, so that memory is bounded.
    """
    held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for qi, n in held.values():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(qi[k // BINS]), pa.array((k % BINS).astype(np.int64)), pa.array(n[k].astype(np.int64))], names=["query_id", "bin", "n"])
        held.clear()

    for b in batches:
        for r, ci, qi, s in _blocks(b):
            if r["q_ids"] not in held and len(held) >= HELD:
                yield from out()
            lo, width = np.frombuffer(r["lo"], np.int64)[:, None], np.frombuffer(r["width"], np.int64)[:, None]
            at = np.floor_divide(s - lo, width)
            inside = (at >= 0) & (at < BINS) & (qi[:, None] != ci[None, :])
            flat = (np.arange(len(qi))[:, None] * BINS + at)[inside]
            n = np.bincount(flat, minlength=len(qi) * BINS)
            if r["q_ids"] in held:
                held[r["q_ids"]][1][:] += n
            else:
                held[r["q_ids"]] = (qi, n)
    yield from out()


def above(k: int):
    """Rows (query, id, score) with a score of at least the query's limit, per block at most k: ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, ci, qi, s in _blocks(b):
                hit = (s >= np.frombuffer(r["lo"], np.int64)[:, None]) & (qi[:, None] != ci[None, :])
                i, j = np.nonzero(hit)
                order = np.lexsort((ci[j], -s[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ci[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, by integer product of floor(256 * x).

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but the query's own vec_id. Ties go to the smaller vec_id; a query
    with fewer candidates returns them all. Vectors that are null, empty or hold
    null or non-finite parts, or whose vec_id is null, take no part; vectors of
    another length than the query's are no candidates of it. Rows that repeat a
    vec_id count as one vector (the least). Scores beyond 64 bits raise an
    error (2^61). An empty table gives no rows; further columns take no part.
    """
    ship(vectors.sparkSession)
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & fine).groupBy("vec_id").agg(F.min("e").alias("e"))
    v = written(v, "vectors")
    spark = v.sparkSession
    blocks = written(packed(v, BLOCK_ROWS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    queries = written(packed(v.where(F.col("vec_id") % every == 0).coalesce(max(1, spark.sparkContext.defaultParallelism // 2)), QUERY_ROWS).select(F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"), F.col("norm").alias("q_norm"), "dim").withColumn("q_block", F.monotonically_increasing_id()), "queries")
    # every candidate block meets every query block; salts spread the meeting over the tasks
    salts = max(4, spark.sparkContext.defaultParallelism * 2)
    left = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    reach = blocks.groupBy("dim").agg(F.max("norm").alias("norm"))
    # the state of a query block: interval start, bin width and rank still wanted, as packed integers
    start = queries.join(reach, "dim").select("*", (F.floor(F.col("q_norm") * F.col("norm")) + 1).alias("reach"))

    def first_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                top, width = int(r["reach"]), 1
                if top > 2**61:
                    raise OverflowError("a score may not fit a 64-bit integer")
                while width * BINS < 2 * top + 1:
                    width *= BINS
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids), pa.array([-top] * len(ids), pa.int64()), pa.array([width] * len(ids), pa.int64()), pa.array([k] * len(ids), pa.int64())], names=["q_block", "at", "query_id", "lo", "width", "want"])

    state = written(start.select("q_block", "q_ids", "reach").mapInArrow(first_state, "q_block long, at long, query_id long, lo long, width long, want long"), "state")

    def meeting(state: DataFrame) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    rows = sorted(r["s"], key=lambda x: x["at"])
                    yield pa.RecordBatch.from_pydict({"q_block": [r["q_block"]], **{n: [np.array([x[n] for x in rows], np.int64).tobytes()] for n in ("lo", "width")}}, schema=pa.schema([("q_block", pa.int64()), ("lo", pa.binary()), ("width", pa.binary())]))

        # a query block holds at most QUERY_ROWS queries, so this list is bounded
        packs = state.groupBy("q_block").agg(F.collect_list(F.struct("at", "lo", "width")).alias("s")).mapInArrow(pack, "q_block long, lo binary, width binary")
        right = queries.select("q_block", "q_ids", "q_parts", "dim").join(packs, "q_block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return left.select("salt", "dim", "ids", "parts").join(right, ["salt", "dim"]).select("ids", "parts", "q_ids", "q_parts", "lo", "width")

    while state.where("want > 0").limit(1).count():
        h = meeting(state).mapInArrow(histogram_round, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # how many scores lie in this bin or above it; the wanted bin is the highest with enough
        h = h.withColumn("up", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))))
        h = h.join(state.select("query_id", "want"), "query_id").where("up >= want").groupBy("query_id").agg(F.max(F.struct("bin", "n", "up")).alias("x"))
        nxt = state.join(h, "query_id", "left")
        # without enough candidates in the interval the interval's lower end is the limit
        lo = F.when(F.col("x").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("x.bin") * F.col("width"))
        want = F.when(F.col("x").isNull() | (F.col("width") == 1), F.lit(0)).otherwise(F.col("want") - (F.col("x.up") - F.col("x.n")))
        width = F.when(F.col("x").isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.expr(f"width div {BINS}"))).cast("long")
        state = written(nxt.select("q_block", "at", "query_id", lo.alias("lo"), width.alias("width"), want.cast("long").alias("want")), "state")
    best = meeting(state).mapInArrow(above(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
