"""MinHash near-duplicates with odd sketches.

The shingle set of a text gives ``k`` MinHash samples. Samples are banded for
candidate search and folded into a parity bitmap (odd sketch): bit
``hash(i, sample_i) mod bits`` flips for each sample, so the population count of
the XOR of two bitmaps estimates their number of differing samples, and with
it a high Jaccard similarity, precisely (Mitzenmacher, Pagh, Pham 2014).

Plan: features per document -> classes of equal sets -> bands over classes ->
candidate forest per bucket, judged by odd sketches -> candidate components ->
exact check of shingle sets inside each component -> components of the links.

Equal sets are one class, so thousands of copies cost one entry. In a bucket,
members are compared with *leaders* only: Jaccard distance is a metric, so if x
and y link (distance <= d) and y follows leader L (distance <= r), then x is
within d + r of L; joining each member to every leader that may be within d + r
keeps the ends of every link in one candidate component, at a cost linear in the
copies. A member follows only if its sketch shows no pair farther than r, and
joins if it shows pairs within d + r, either but for tails of BUCKET_SIGMAS;
pairs that link meet in several buckets, whose leaders differ.

A hot bucket of n members is split by a salt into sqrt(n) / SPREAD parts, each
with leaders of its own. If x and y link across parts and follow L and M, then L
is within d + 2r of M: the leaders of all parts, few beside the members, meet
once more and join within d + 2r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship
from .common import MIX_B, U64, as_bytes, mixed, pieces, shingle_set, signed, written
from .components import components

#: MinHash samples and bits of the odd sketch.
SAMPLES, BITS = 128, 512
#: Distance within which members follow a leader, and standard deviations of its tests.
FOLLOW, BUCKET_SIGMAS = 0.25, 3.0
#: A link is missed by all bands with at most this probability.
MISS = 1e-4
#: Members of a bucket that is not split; a larger one of n members gets sqrt(n) / SPREAD parts.
WHOLE_BUCKET, SPREAD = 512, 8
#: Shingle hashes that one verification tile holds.
TILE_HASHES = 2_000_000


def bands_for(threshold: float, samples: int = SAMPLES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose miss probability at the threshold stays below ``miss``."""
    rows = max([r for r in range(1, 17) if (1 - threshold**r) ** (samples // r) <= miss], default=1)
    return samples // rows, rows


def xor_count(distance: float, samples: int = SAMPLES, bits: int = BITS) -> tuple[float, float]:
    """Mean and standard deviation of the XOR count of two sketches whose sets lie ``distance`` apart."""
    p = min(1.0, distance)
    differing, left = samples * p, (1 - 2 / bits) ** (2 * samples * p)
    # the number of differing samples varies, and how many of their bits cancel
    return bits / 2 * (1 - left), math.sqrt(4 * differing * (1 - p) * left**2 + bits / 4 * (1 - math.exp(-8 * differing / bits)))


def sketch_limit(threshold: float, distance: float | None = None, sigmas: float = 4.5) -> int:
    """Largest XOR count that a pair within ``distance`` (default: the threshold's) shows, but for tails of so many sigmas."""
    mean, deviation = xor_count(1 - threshold if distance is None else distance)
    return math.ceil(mean + sigmas * deviation)


def sure_limit(distance: float, sigmas: float) -> int:
    """Largest XOR count that no pair farther apart than ``distance`` shows, but for tails of so many sigmas."""
    mean, deviation = xor_count(distance)
    return max(0, math.floor(mean - sigmas * deviation))


def minhash(flat: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples, one row per set; ``flat`` holds the sets one after another (none empty)."""
    rng = np.random.default_rng(8)
    mult, add = (rng.integers(0, 2**63, samples, dtype=np.uint64) << U64(1) | U64(1) for _ in range(2))
    out = np.empty((len(starts), samples), U64)
    with np.errstate(over="ignore"):
        for i in range(samples):
            out[:, i] = np.minimum.reduceat((flat ^ add[i]) * mult[i], starts)
    return out


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps (n, bits/64) of uint64 of the (n, k) samples."""
    n, k = samples.shape
    with np.errstate(over="ignore"):
        at = mixed(samples + (np.arange(k, dtype=U64) * MIX_B)[None, :]) % U64(bits)
    flat = np.bincount((np.arange(n)[:, None] * bits + at.astype(np.int64)).ravel(), minlength=n * bits) & 1
    return np.packbits(flat.reshape(n, bits).astype(np.uint8), axis=1, bitorder="little").view(U64)


def class_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set of ``flat``: equal sets, equal hashes."""
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(mixed(flat), starts) ^ np.bitwise_xor.reduceat(flat * MIX_B, starts))


def features_of(sets: list[np.ndarray], bands: int, rows: int):
    """(class hash, sketch, band keys) of non-empty sets, by slices that stay in the processor's cache."""
    cls, sketches, keys = [], [], []
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 32_768):
            total += len(sets[j])
            j += 1
        part = sets[i:j]
        flat = np.concatenate(part)
        starts = np.cumsum([0, *map(len, part[:-1])])
        m = minhash(flat, starts, SAMPLES)
        sketches.append(odd_sketch(m))
        with np.errstate(over="ignore"):
            key = np.zeros((len(part), bands), U64) + np.arange(bands, dtype=U64)[None, :] * MIX_B
            for r in range(rows):
                key = mixed(key ^ m[:, r : r + bands * rows : rows][:, :bands])
        cls.append(class_of(flat, starts))
        keys.append(key)
        i = j
    return np.concatenate(cls), np.concatenate(sketches), np.concatenate(keys)


def features(docs: DataFrame, k: int, threshold: float, doc_id: str, text: str, mark: Column) -> DataFrame:
    """doc_id, mark, n_shingles, cls (null: no set), sketch, bands of each row."""
    bands, rows = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t, k) for t in as_bytes(b.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            cls, sketch, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                c, s, q = features_of([sets[i] for i in full], bands, rows)
                for at, i in enumerate(full):
                    cls[i], sketch[i], keys[i] = int(signed(c)[at]), s[at].tobytes(), signed(q[at])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_shingles", "cls", "sketch", "bands"],
            )

    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), mark.cast("long").alias("mark"))
    return slim.mapInArrow(run, "doc_id long, mark long, n_shingles long, cls long, sketch binary, bands array<long>")


def runs(batches: Iterator[pa.RecordBatch], key: str):
    """Consecutive rows of one key, as (key, record batch); a run that spans batches comes in parts, in order."""
    for b in batches:
        ks = b.column(key).to_numpy(zero_copy_only=False)
        if not len(ks):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
        for s, e in zip(cuts, [*cuts[1:], len(ks)], strict=True):
            yield ks[s], b, int(s), int(e)


def bucket_forest(near: int, far: int):
    """For rows (part, key, parts, cls, sketch) sorted by part: a forest that joins each member to the leaders within reach.

    Rows out: edges (a, b), and for a bucket of several parts its leaders (a,
    key, sketch) with a null b. A negative ``near`` makes every member a leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead_ids, count = None, [], 0
        leads, group = np.empty((0, BITS // 64), U64), np.empty(0, np.int64)  # of the leaders: sketches, and what hangs together
        last_batch, ids, sketches, keys, split = None, None, None, None, None
        edges: list[tuple[int, int]] = []
        above: list[tuple[int, int, bytes]] = []
        for part, b, s, e in runs(batches, "part"):
            if b is not last_batch:
                if edges or above:
                    yield _found(edges, above)
                    edges, above = [], []
                last_batch = b
                ids, keys = (b.column(n).to_numpy(zero_copy_only=False) for n in ("cls", "key"))
                split = b.column("parts").to_numpy(zero_copy_only=False) > 1
                sketches = np.frombuffer(b"".join(b.column("sketch").to_pylist()), U64).reshape(len(ids), -1)
            if part != last:
                last, lead_ids, count = part, [], 0
            for i in range(s, e):
                if count:
                    z = np.bitwise_count(leads[:count] ^ sketches[i]).sum(axis=1)
                    # within reach of leaders that already hang together, one edge is enough
                    reached = np.flatnonzero(z <= far)
                    reached = reached[np.unique(group[reached], return_index=True)[1]]
                    for j in reached:
                        edges.append((int(ids[i]), int(lead_ids[j])))
                    if len(reached) > 1:
                        group[:count][np.isin(group[:count], group[reached])] = group[reached[0]]
                    if (z <= near).any():
                        continue
                if count == len(leads):
                    leads = np.concatenate((leads, np.zeros((max(8, count), leads.shape[1]), U64)))
                    group = np.concatenate((group, np.zeros(max(8, count), np.int64)))
                leads[count] = sketches[i]
                group[count] = group[reached[0]] if count and len(reached) else count
                lead_ids.append(ids[i])
                count += 1
                if split[i]:
                    above.append((int(ids[i]), int(keys[i]), sketches[i].tobytes()))
        if edges or above:
            yield _found(edges, above)

    return run


#: Rows of ``bucket_forest``.
FOUND = "a long, b long, key long, sketch binary"


def _found(edges: list[tuple[int, int]], above: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    e = np.unique(np.array(edges, np.int64).reshape(-1, 2), axis=0)
    ids, keys, sketches = (list(x) for x in zip(*above, strict=True)) if above else ([], [], [])
    none = [None] * len(e)
    return pa.RecordBatch.from_arrays([pa.array([*e[:, 0].tolist(), *ids], pa.int64()), pa.array([*e[:, 1].tolist(), *[None] * len(ids)], pa.int64()), pa.array(none + keys, pa.int64()), pa.array(none + sketches, pa.binary())], names=["a", "b", "key", "sketch"])


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether |x & y| / |x | y| >= num / den, in whole numbers."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def tile_links(k: int, num: int, den: int, near: int):
    """For rows (tile, cls, sketch, text) sorted by tile: a spanning forest of the exact links in each tile."""

    def links(rows: dict[int, tuple]) -> list[tuple[int, int]]:
        ids = list(rows)
        sets, sketches = ([rows[i][j] for i in ids] for j in range(2))
        order = np.argsort([len(s) for s in sets], kind="stable")
        ids, sets = ([v[i] for i in order] for v in (ids, sets))
        sk = np.stack([sketches[i] for i in order])
        lens = np.array([len(s) for s in sets])
        root, out = np.arange(len(ids)), []
        for i in range(1, len(ids)):
            low = int(np.searchsorted(lens[:i], -(-num * lens[i] // den)))
            z = np.bitwise_count(sk[low:i] ^ sk[i]).sum(axis=1)
            close = np.flatnonzero(z <= near)
            close = low + close[np.argsort(z[close], kind="stable")]
            while len(close := close[root[close] != root[i]]):
                j, close = int(close[0]), close[1:]
                if linked(sets[i], sets[j], num, den):
                    root[root == root[j]] = root[i]
                    out.append((ids[i], ids[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, {}
        found: list[tuple[int, int]] = []
        for b in batches:
            for tile, cls, sketch, text in zip(b.column("tile").to_pylist(), b.column("cls").to_pylist(), b.column("sketch").to_pylist(), as_bytes(b.column("text")), strict=True):
                if tile != last:
                    found += links(rows) if len(rows) > 1 else []
                    last, rows = tile, {}
                if cls not in rows:
                    own = shingle_set(text, k)
                    # a repeated doc_id may bring another text: it is not this class
                    if len(own) and int(signed(class_of(own, np.array([0])))[0]) == cls:
                        rows[cls] = (own, np.frombuffer(sketch, U64))
            if found:
                yield _pairs(found)
                found = []
        found += links(rows) if len(rows) > 1 else []
        if found:
            yield _pairs(found)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group (and mark, if given) for every row of ``docs``.

    Rows link when their sets of distinct ``k``-word shingles (A-Z lowered; all
    the words as one shingle when there are fewer) have
    ``den * |intersection| >= num * |union|``. component_id is the smallest
    doc_id reachable by links, itself included; kept marks doc_id = component_id.
    A null, empty or blank text has no set: it links with nothing, is kept and
    is its own component. Rows that repeat a doc_id each get a row; a null
    doc_id joins by an equal set alone: component_id is that of its class if
    another row has one, else null, and kept is false. group names the linked
    texts whatever their doc_ids (null: no set), mark is a long Column of
    ``docs`` that is handed through. Other columns take no part. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    threshold = num / den
    reach = lambda times: sketch_limit(threshold, 1 - threshold + times * FOLLOW, BUCKET_SIGMAS)
    given, mark = mark is not None, F.lit(None) if mark is None else mark
    f = written(features(docs, k, threshold, doc_id, text, mark), "features")
    one = f.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    one = written(one, "classes")
    keys = one.select("cls", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    parts = F.when(F.col("many") > WHOLE_BUCKET, F.ceil(F.sqrt("many") / SPREAD)).otherwise(1).cast("int")
    keys = keys.join(sizes.select("key", parts.alias("parts")), "key")
    part = F.when(F.col("parts") > 1, F.xxhash64("key", F.pmod(F.xxhash64("cls"), F.col("parts")))).otherwise(F.col("key"))
    buckets = keys.withColumn("part", part).join(one.select("cls", "sketch", "n"), "cls").repartition("part").sortWithinPartitions("part", "n", "cls")
    columns = ["part", "key", "parts", "cls", "sketch"]
    found = written(buckets.select(columns).mapInArrow(bucket_forest(sure_limit(FOLLOW, BUCKET_SIGMAS), reach(1)), FOUND), "forest")
    heads = found.where("b is null").select(F.col("key").alias("part"), "key", F.lit(1).alias("parts"), F.col("a").alias("cls"), "sketch")
    across = heads.repartition("part").sortWithinPartitions("part", "cls").mapInArrow(bucket_forest(-1, reach(2)), FOUND)
    edges = found.where("b is not null").unionByName(across).select("a", "b").distinct()
    group = written(components(edges), "candidates").select(F.col("node").alias("cls"), F.col("component").alias("grp"))

    member = one.select("cls", "low", "sketch", "n").join(group, "cls")
    tiles = member.groupBy("grp").agg((F.floor(F.sum("n") / TILE_HASHES) + 1).cast("int").alias("tiles"))
    member = member.join(tiles, "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    # every pair of tiles meets once: tile (i, j) with i <= j holds the members of both
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.withColumn("tile", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")))
    slim = docs.select(docs[doc_id].cast("long").alias("low"), docs[text].cast("string").alias("text"))
    rows = member.select("low", "cls", "sketch", "tile").join(slim, "low").repartition("tile").sortWithinPartitions("tile", "cls")
    links = rows.select("tile", "cls", "sketch", "text").mapInArrow(tile_links(k, num, den, sketch_limit(threshold)), "a long, b long")
    comp = components(links).select(F.col("node").alias("cls"), "component")
    named = one.select("cls", "low").join(comp, "cls", "left").select("cls", "low", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("cls", "component_id", F.col("component").alias("group"))
    out = f.select("doc_id", "mark", "n_shingles", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "group"]
    return out.select(*columns, "mark") if given else out.select(*columns)
