"""Removes passages of many bytes that occur anywhere else, by suffix arrays of shards.

Equal strings of ``length`` bytes hold the same least fingerprint among the
fingerprints of their short substrings. So every place at which such a string
starts belongs to one fingerprint, its key, and equal strings meet at their key:
neighbouring places of one key make a segment (the places and the bytes their
strings cover). Segments are told apart by a hash of their bytes; a key with one
segment is unique, or all copies of it are repeats. Where one key has different
segments, the bytes of one copy of each go to the key's shard. A shard's suffix
array is built by induced sorting; permuted common prefixes tell which strings
start elsewhere too.

A key with very many different segments (a common passage in many contexts)
would burden one shard. Its segments are parted by the side on which their
strings have more of other bytes, and half of these bytes join the key: the parts
go to keys of their own, again and again until no key is crowded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..ship import shared_dir, ship
from .common import MIX_A, U64, as_bytes, mixed, pieces, written
from .suffixes import permuted_prefixes, suffix_array

#: Bytes of a fingerprinted substring; bytes of one suffix array, as far as keys allow; different segments of a key beyond which they are parted; bytes in a table part; bytes fingerprinted at a time.
GRAM, SHARD_BYTES, CROWD, PART_BYTES, SPAN = 32, 2 << 20, 512, 64 << 20, 1 << 23


def fingerprints(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit fingerprints of the k bytes from every place on (k: a power of two)."""
    with np.errstate(over="ignore"):
        h, j = mixed(np.arange(1, 257, dtype=U64))[b], 1
        while j < k:
            h = h[:-j] * MIX_A + h[j:]
            h ^= h >> U64(32)
            j *= 2
    return mixed(h)


def least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from every place on."""
    j = 1
    while 2 * j <= w:
        v = np.minimum(v[:-j], v[j:])
        j *= 2
    return np.minimum(v[: len(v) - (w - j)], v[w - j :]) if w > j else v


def segments(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, start, places) of a text's segments: from each of ``places`` starts on, ``length`` bytes belong to ``key``.

    Long texts are taken in spans; a border of spans may part a segment.
    """
    whole = np.frombuffer(text, np.uint8)
    w = length - GRAM + 1
    for at in range(0, len(whole) - length + 1, SPAN):
        b = whole[at : at + SPAN + length - 1]
        f = fingerprints(b, GRAM)
        # the least of the upper 40 bits, leftmost: places are below 2^24
        low = least((f & ~U64(0xFFFFFF)) | np.arange(len(f), dtype=U64), w) & U64(0xFFFFFF)
        start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        yield f[low[start].astype(np.int64)].view(np.int64), at + start, np.diff(np.append(start, len(low)))


def keyed(length: int):
    """Rows key, h, row, start, places of (row, text) rows; h is the hash of the segment's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for row, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if text is None or len(text) < length:
                    continue
                view = memoryview(text)
                for key, start, places in segments(text, length):
                    h = np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + n + length - 1]) for i, n in zip(start.tolist(), places.tolist(), strict=True)), U64, len(start)).view(np.int64)
                    out.append((key, h, np.full(len(key), row), start, places))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "h", "row", "start", "places"])

    return run


def shared_parts(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(row, first place, places): the rows' right and left parts (see ``parts``) as far as another row shares what all strings of the part have; both parts of a row are one."""
    b = np.frombuffer(b"".join(x[2] for x in rows) + b"\0" * GRAM, np.uint8)
    sizes = np.array([len(x[2]) for x in rows])
    first = np.cumsum(sizes) - sizes
    f = (fingerprints(b, GRAM)[: len(b) - GRAM] & ~U64(0xFFFFFF)) | (np.arange(len(b) - GRAM) - np.repeat(first, sizes)).astype(U64)
    for k in range(1, GRAM):  # substrings that end in the next row
        f[first + sizes - k] = ~U64(0)
    low = (np.minimum.reduceat(f, first) & U64(0xFFFFFF)).astype(np.int64).tolist()
    mine = [parts(len(text) - length + 1, at, at + GRAM, length) for (_, _, text), at in zip(rows, low, strict=True)]
    marks = np.array([xxhash.xxh3_64_intdigest(rows[r][2][i:j], seed=i == low[r]) for r, some in enumerate(mine) for _, _, i, j in some], U64)
    _, where, n = np.unique(marks, return_inverse=True, return_counts=True)
    often = iter((n[where] > 1).tolist())
    out = []
    for r, some in enumerate(mine):
        kept = sorted((at, n) for at, n, _, _ in some if next(often))
        if kept:
            out.append((r, kept[0][0], sum(n for _, n in kept)))
    return out


def sharded(length: int):
    """Rows key, h, bits of (key, h, bytes) rows in order of the key: which places start a string that starts in another segment or place of the key."""

    def found(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        kept = shared_parts(rows, length)
        bits = dict.fromkeys(range(len(rows)))
        if kept:
            sizes = np.array([n + length - 1 for _, _, n in kept])
            # no UTF-8 text has the byte 255: it ends a segment
            b = np.frombuffer(b"".join(rows[r][2][i : i + n + length - 1] + b"\xff" for r, i, n in kept), np.uint8)
            ends = np.cumsum(sizes + 1)
            room = np.repeat(ends, sizes + 1) - 1 - np.arange(len(b))
            sa = suffix_array(np.concatenate((b.astype(np.int32) + 1, [0])), 257)[1:]
            shared, before = permuted_prefixes(b, sa, room)
            again = shared >= length
            again[before[np.flatnonzero(again)]] = True
            for (r, i, n), e in zip(kept, ends.tolist(), strict=True):
                x = again[e - length - n : e - length]
                if x.any():
                    bits[r] = np.packbits(np.concatenate((np.zeros(i, bool), x, np.zeros(len(rows[r][2]) - length + 1 - i - n, bool)))).tobytes()
        some = [(k, h, bits[r]) for r, (k, h, _) in enumerate(rows) if bits[r]]
        k, h, x = zip(*some, strict=True) if some else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(x, pa.binary())], names=["key", "h", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SHARD_BYTES and held[-1][0] != row[0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield found(held)

    return run


def halved(length: int):
    """Two parts of each segment of a crowded key, with keys of their own: those places whose strings have most of the bytes that are not common on the right, and those that have them on the left.

    All strings of a segment share the bytes from ``low`` to ``high``; those of
    a part share half of the remaining bytes more, which make the part's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, h, text, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if low is None:
                    f = fingerprints(np.frombuffer(text, np.uint8), GRAM)
                    low = int(np.argmin((f & ~U64(0xFFFFFF)) | np.arange(len(f), dtype=U64)))
                    high = low + GRAM
                for at, n, i, j in parts(len(text) - length + 1, low, high, length):
                    mine = text[at : at + n + length - 1]
                    hashes = (xxhash.xxh3_64_intdigest(x, seed=(i == low) + 2 * (j - i)) for x in (text[i:j], mine))
                    out.append((*(x - (1 << 64) if x >> 63 else x for x in hashes), mine, i - at, j - at, k, h, at, n))
            if out:
                names = ["key", "h", "bytes", "low", "high", "of_key", "of_h", "at", "places"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "bytes" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return run


def parts(places: int, low: int, high: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first place, places, common bytes' begin and end) of the right and the left part of a segment whose strings share the bytes from ``low`` to ``high``."""
    half = -(-(length - (high - low)) // 2)
    m = max(0, min(places, high + half - length))
    right = [(m, places - m, low, high + half)] if m < places else []
    return right + ([(0, m, low - half, high)] if m else [])


def joined_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h, bits of (key, h, parts) rows."""
    for b in batches:
        out = []
        for some in b.column(2).to_pylist():
            x = np.zeros(max(r["at"] + r["places"] for r in some), bool)
            for r in some:
                # bits end behind the last one that is set
                mine = np.ones(r["places"], bool) if r["bits"] is None else np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["places"]]
                x[r["at"] : r["at"] + len(mine)] = mine
            out.append(np.packbits(x).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["key", "h", "bits"])


def known_keys(segments: DataFrame) -> DataFrame:
    """key, many: the keys that occur twice or more; many: in segments that differ."""
    n = segments.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))
    return written(n.where("n > 1").select("key", (F.col("least") != F.col("most")).alias("many")), "keys")


def told(classes: DataFrame, bits: DataFrame) -> DataFrame:
    """key, h, bits of the segments with repeated strings; a segment with copies repeats as a whole: no bits."""
    found = classes.select("key", "h", "copies").join(bits, ["key", "h"], "left").where("copies > 1 or bits is not null")
    return written(found.select("key", "h", F.when(F.col("copies") == 1, F.col("bits")).alias("bits")), "repeats")


def repeated_bits(texts: DataFrame, length: int) -> DataFrame:
    """key, h, bits of (key, h, bytes, low, high) rows: one of each segment of keys that have several.

    Keys with more than CROWD segments are parted, and the parts are treated in
    the same way; as the common bytes grow to the whole string, where equal keys
    are equal strings, this ends after a few rounds.
    """
    crowds = written(texts.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowds")
    few = texts.select("key", "h", "bytes").join(crowds, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    few = written(few.mapInArrow(sharded(length), "key long, h long, bits binary"), "bits")
    if not crowds.limit(1).count():
        return few
    halves = written(texts.join(crowds, "key").select("key", "h", "bytes", "low", "high").mapInArrow(halved(length), "key long, h long, bytes binary, low long, high long, of_key long, of_h long, at long, places long"), "halves")
    candidates = written(halves.join(known_keys(halves), "key"), "candidates")
    one = F.min(F.struct("bytes", "low", "high")).alias("r")
    classes = written(candidates.where("many").groupBy("key", "h").agg(F.count("*").alias("copies"), one).select("key", "h", "copies", "r.*"), "classes")
    marks = candidates.where("many").join(told(classes, repeated_bits(classes, length)), ["key", "h"])
    marks = marks.select("of_key", "of_h", "at", "places", "bits").unionByName(candidates.where("not many").select("of_key", "of_h", "at", "places", F.lit(None).cast("binary").alias("bits")))
    # two parts a segment at most
    both = marks.groupBy(F.col("of_key").alias("key"), F.col("of_h").alias("h")).agg(F.collect_list(F.struct("at", "places", "bits")).alias("parts"))
    return few.unionByName(written(both.mapInArrow(joined_bits, "key long, h long, bits binary"), "bits"))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h, bytes of (text, wanted) rows."""
    for b in pieces(batches):
        k, h, x = [], [], []
        for text, wanted in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            for r in wanted:
                k.append(r["key"])
                h.append(r["h"])
                x.append(text[r["start"] : r["end"]])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(x, pa.binary())], names=["key", "h", "bytes"])


def spans(size: int, repeats: list[tuple[int, int, bytes | None]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs that the repeated strings cover; repeats: (start, places, bits or null for all)."""
    edge = np.zeros(size + 1, np.int64)
    for start, places, bits in repeats:
        if bits is None:
            edge[start] += 1
            edge[start + places + length - 1] -= 1
        else:
            at = start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:places])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    inside = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def removed(length: int):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, begins, ends of (doc_id, text, repeats) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for text, found in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                text = text or b""
                begin, end = spans(len(text), [(r["start"], r["places"], r["bits"]) for r in found or []], length) if found else ((), ())
                begin, end = list(map(int, begin)), list(map(int, end))
                kept = hashlib.sha256()
                for i, j in zip([0, *end], [*begin, len(text)], strict=True):
                    kept.update(memoryview(text)[i:j])
                rows.append((len(text), sum(end) - sum(begin), len(begin), kept.hexdigest(), begin, end))
            n, m, k, sha, begin, end = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, m, k)), pa.array(sha, pa.string()), pa.array(begin, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, begins, ends of every row of ``docs``.

    Texts are bytes (UTF-8). A byte is removed if a string of ``length`` bytes
    (64 at least) that covers it also starts anywhere else: in another text or
    at another place of the same, overlaps included; strings are judged on the
    input. n_spans counts the maximal runs of removed bytes, begins and ends
    are their places, kept_sha256 is the hash of the bytes that stay, together.

    A null text counts as empty; texts shorter than ``length`` stay whole. Each
    row is a text of its own, so rows that repeat lose all their bytes if they
    are long enough; a null doc_id stays null; an empty table gives no rows;
    further columns take no part.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    spark = ship(docs.sparkSession)
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # numbered once, and dealt by the number once: later joins move lists of places to the texts, not texts
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    name = f"svloom_texts_{uuid.uuid4().hex}"
    numbered = slim.withColumn("row", F.monotonically_increasing_id()).repartition(parts, "row")
    numbered.write.format("parquet").option("path", f"{shared_dir(spark)}/svloom/{name}").bucketBy(parts, "row").saveAsTable(name)
    rows = spark.table(name)
    places = rows.select("row", "text").mapInArrow(keyed(length), "key long, h long, row long, start long, places int")
    candidates = written(places.join(known_keys(places), "key"), "candidates")
    one = F.min(F.struct("row", "start", "places")).alias("r")
    classes = written(candidates.where("many").groupBy("key", "h").agg(F.count("*").alias("copies"), one).select("key", "h", "copies", "r.*"), "classes")
    wanted = classes.groupBy("row").agg(F.collect_list(F.struct("key", "h", "start", (F.col("start") + F.col("places") + length - 1).alias("end"))).alias("wanted"))
    texts = written(rows.join(wanted.hint("shuffle_hash"), "row").select("text", "wanted").mapInArrow(cut, "key long, h long, bytes binary"), "segments")
    whole = F.lit(None).cast("long")
    bits = repeated_bits(texts.withColumns({"low": whole, "high": whole}), length)
    marks = candidates.where("many").join(told(classes, bits), ["key", "h"]).select("row", "start", "places", "bits")
    marks = marks.unionByName(candidates.where("not many").select("row", "start", "places", F.lit(None).cast("binary").alias("bits")))
    # a row's list is bounded by its own text
    found = marks.groupBy("row").agg(F.collect_list(F.struct("start", "places", "bits")).alias("repeats"))
    out = rows.join(written(found, "marks").hint("shuffle_hash"), "row", "left").select("doc_id", "text", "repeats")
    return out.mapInArrow(removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>")
