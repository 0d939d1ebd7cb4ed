"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector o is rotated by random orthogonal matrices; the signs are its
code, and <code, rotated o> its stored correction factor (RaBitQ, Gao and Long
2024). For a query q the scaled product of q with o's code is an unbiased
estimate of <o, q> with a known error bound, so only pairs whose upper
confidence bound reaches the threshold are computed exactly.

Equal vectors of a label are one class, which counts as often as it has members.

Candidates: a band is the signs along random directions of its own; classes of
one label that agree in a band meet in a bucket. The number of bits grows with the logarithm of the rows
and the number of bands with it, so that a pair at the threshold is missed by
all bands with a probability below MISS at any size. Large buckets are cut into
tiles and each pair of tiles is a task, so no bucket has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship
from .common import U64, mixed, pieces, signed, written
from .components import components

#: Code bits, a multiple of 64; probability to miss a pair at the threshold; standard errors of the confidence bound.
CODE_BITS, MISS, SIGMAS = 256, 1e-4, 4.0
#: Vectors in a tile; rows of a bucket that one task meets at once are two tiles at most.
TILE = 1024
#: Numbers of either side of pairs that are multiplied at once; classes of more than one in so many rows are joined by broadcast.
AT_ONCE, HOT = 1 << 22, 64


def rotations(dim: int) -> np.ndarray:
    """Stacked random rotations, CODE_BITS rows at least; each block of dim rows is orthonormal."""
    rng = np.random.default_rng(3)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-CODE_BITS // dim))])


def band_plan(rows: int, cosine: float) -> tuple[int, int]:
    """(bits, bands): as many buckets as rows, and a miss at the threshold of at most MISS."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(8, min(32, math.ceil(math.log2(max(rows, 1)))))
    bands = math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))
    return bits, bands


@lru_cache(4)
def directions(dim: int, bits: int, bands: int) -> np.ndarray:
    """Independent directions, ``bits`` for each band: none is shared, so bands miss a pair independently."""
    return np.random.default_rng(4).standard_normal((bits * bands, dim))


def band_keys(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """(n, bands) hashes; band j takes the signs of the vectors along its own directions."""
    turned = x @ directions(x.shape[1], bits, bands).T
    value = (turned >= 0).reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return mixed(value.astype(U64) ^ (np.arange(bands, dtype=U64) << U64(40))[None, :])


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, without null or non-finite parts, and not zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def codes_of(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, one byte for 8 signs; correction factor) of unit vectors."""
    turned = x @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / turn.shape[0]


def coded(vectors: DataFrame, dim: int, bits: int, bands: int) -> DataFrame:
    """vec_id, members, label, unit (packed doubles), code, factor, keys of the usable vectors of length ``dim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim)
        for b in pieces(batches, 2048):
            x = np.array(b.column(3).to_pylist(), float).reshape(b.num_rows, dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys = band_keys(x, bits, bands)
            code, factor = codes_of(x, turn)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor), pa.array(list(signed(keys)), pa.list_(pa.int64()))], names=["vec_id", "members", "label", "unit", "code", "factor", "keys"])

    return vectors.mapInArrow(run, "vec_id long, members long, label string, unit binary, code binary, factor double, keys array<long>")


class Codes:
    """Stored codes and correction factors of a tile, and estimates between two tiles."""

    def __init__(self, x: np.ndarray, code: np.ndarray, factor: np.ndarray, turn: np.ndarray):
        self.x, self.turned, self.factor = x, x @ turn.T, factor
        self.signs = np.unpackbits(code, axis=1, count=turn.shape[0]) * 2.0 - 1.0

    def upper(self, other: "Codes") -> np.ndarray:
        """Upper confidence bound of the products of own vectors with those of ``other``.

        With f = <code, turned o> / bits, <code, turned q> / bits / f is
        unbiased for <o, q>; its standard error is sqrt((scale / f^2 - 1) / bits)
        times the length of the part of q across o, where scale is the mean
        square of a part of the turned o.
        """
        bits = self.turned.shape[1]
        scale = 1 / self.x.shape[1]  # mean square of a turned part of a unit vector
        est = (self.signs @ other.turned.T) / (bits * self.factor)[:, None]
        spread = np.sqrt(np.maximum(0, scale / self.factor**2 - 1) / bits)
        return est + SIGMAS * spread[:, None] * np.sqrt(np.maximum(0.04, 1 - np.minimum(1, est) ** 2))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b (sorted by a) over 0..n-1."""
    root, out = np.arange(n), []
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
    for s, e in zip(starts, [*starts[1:], len(a)], strict=True) if len(a) else ():
        x, ys = int(a[s]), b[s:e]
        for y in ys[np.unique(root[ys], return_index=True)[1]]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((x, int(y)))
    return out


def tile_links(dim: int, cosine: float):
    """For rows (tile, band, own, same, vec_id, members, unit, code, factor, keys) sorted by tile: link counts per class, and a forest of the links.

    Rows out: (a, b, n). n > 0: class a has links to n vectors counted here; n = 0: edge a-b.
    A pair counts in the first band in which it meets (keys: those of the bands before), so no link counts twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim)
        step = max(1, AT_ONCE // dim)

        def links(own: np.ndarray, same: bool, ids: np.ndarray, members: np.ndarray, x: np.ndarray, code: np.ndarray, factor: np.ndarray, keys: np.ndarray):
            left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min()))
            if len(left) == 0 or len(right) == 0:
                return None
            c = Codes(x[left], code[left], factor[left], turn)
            d = c if same else Codes(x[right], code[right], factor[right], turn)
            i, j = np.nonzero(c.upper(d) >= cosine)
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                return None
            exact = np.concatenate([np.einsum("ij,ij->i", c.x[i[s : s + step]], d.x[j[s : s + step]]) >= cosine for s in range(0, len(i), step)])
            i, j = left[i[exact]], right[j[exact]]
            new = np.ones(len(i), bool)
            if keys.shape[1]:
                for s in range(0, len(i), step):
                    new[s : s + step] = ~(keys[i[s : s + step]] == keys[j[s : s + step]]).any(axis=1)
            n = np.bincount(i[new], members[j[new]], len(ids)) + np.bincount(j[new], members[i[new]], len(ids))
            edges = [(ids[a], ids[b]) for a, b in forest(len(ids), i, j)]
            at = np.flatnonzero(n)
            return np.concatenate((np.array([(a, b, 0) for a, b in edges], np.int64).reshape(-1, 3), np.stack((ids[at], ids[at], n[at].astype(np.int64)), axis=1).reshape(-1, 3)))

        last, parts = None, []

        def flush():
            if parts:
                columns = [np.concatenate(c) for c in zip(*(p[1:] for p in parts), strict=True)]
                out = links(columns[0], parts[0][0], *columns[1:]) if len(columns[0]) > 1 else None
                if out is not None and len(out):
                    return pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(3)], names=["a", "b", "n"])
            return None

        for b in batches:
            if not b.num_rows:
                continue
            tiles, own, ids, members, factor = (b.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "own", "vec_id", "members", "factor"))
            same = b.column("same").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b.column("unit").to_pylist())).reshape(-1, dim)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            keys = b.column("keys")
            cuts = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1])))
            for s, e in zip(cuts, [*cuts[1:], len(tiles)], strict=True):
                if tiles[s] != last:
                    if (out := flush()) is not None:
                        yield out
                    last, parts = tiles[s], []
                parts.append((bool(same[s]), own[s:e], ids[s:e], members[s:e], x[s:e], code[s:e], factor[s:e], keys.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)))
        if (out := flush()) is not None:
            yield out

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors of one non-null label link when their cosine, in double precision,
    is at least ``cosine``. n_links counts the other vectors linked directly,
    component_id is the smallest vec_id reachable, itself included, kept marks
    vec_id = component_id. A vector that is null, empty, zero or holds null or
    non-finite parts, or whose label or vec_id is null, links with nothing, and
    so do vectors of different lengths among each other (each length is searched
    by itself). vec_id names a vector; rows that repeat a vec_id count as one
    vector (the first by label and parts) and each gets the row. An empty table
    gives no rows; further columns take no part.
    """
    ship(vectors.sparkSession)
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[embedding].cast("array<double>").alias("e"))
    good = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("e")))
    own = good.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("s")).select("vec_id", "s.label", "s.e")
    # a class is named by 128 bits of its label and parts
    own = written(own.withColumns({"h": F.xxhash64(F.lit(3), "label", "e"), "g": F.xxhash64(F.lit(4), "label", "e")}), "vectors")
    classes = own.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.min(F.struct("label", "e")).alias("s")).select("h", "g", F.col("rep").alias("vec_id"), "members", "s.label", "s.e")
    classes = written(classes, "classes")
    dims = [(r["d"], r["n"], r["m"]) for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.sum("members").alias("m")).collect()]
    rows, found = sum(m for _, _, m in dims), None
    for dim, n, _ in sorted(dims):
        bits, bands = band_plan(n, cosine)
        codes = written(coded(classes.where(F.size("e") == dim).select("vec_id", "members", "label", "e"), dim, bits, bands), "codes")
        met = codes.select("vec_id", "label", F.posexplode("keys").alias("band", "key")).withColumn("key", F.xxhash64("label", "key", "band"))
        sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
        met = met.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("tile", F.xxhash64("key", "lo", "hi"))
        met = met.select("tile", "band", "own", (F.col("lo") == F.col("hi")).alias("same"), "vec_id").join(codes.drop("label"), "vec_id")
        rowsets = met.withColumn("keys", F.slice("keys", 1, F.col("band"))).repartition("tile").sortWithinPartitions("tile").drop("band")
        part = written(rowsets.mapInArrow(tile_links(dim, cosine), "a long, b long, n long"), "links")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    comp = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "vec_id")
    counts = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    # a class is named by its smallest member, so the smallest class of a component has its smallest vector
    known = classes.select("h", "g", "vec_id", "members").join(counts, "vec_id", "left").join(comp, "vec_id", "left")
    known = written(known.select("h", "g", "members", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n"), F.coalesce("component", "vec_id").alias("component")), "known")
    # at most HOT classes can be this large: they are broadcast, so that no task gets all members of one
    hot = F.broadcast(known.where(F.col("members") > rows / HOT))
    slim = own.select("vec_id", "h", "g")
    named = slim.join(hot, ["h", "g"]).unionByName(slim.join(hot, ["h", "g"], "left_anti").join(known, ["h", "g"])).select("vec_id", "n", "component")
    # a vec_id whose first row is no good still has its own row
    out = v.select("vec_id").join(named, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
