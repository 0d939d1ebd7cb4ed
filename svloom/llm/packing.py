"""Packing documents into windows by lexical retrieval.

Each document is cut into full windows and a tail. The tails are dealt into the
shards of a BM25 inverted index; in a shard, every seed's window is filled with
the unused tails that score highest for it, one after the other, and the last
one is cut. What is left of a shard becomes windows whose lengths are powers of
two, which need no padding. Document frequencies and mean length are those of
all tails.

Shards keep lexical neighbours together: a tail's terms, weighed by their
inverse document frequency and projected to a few dimensions, fall down a tree
of median splits that was fitted on a sample, to a leaf; a run of leaves is a
shard. A leaf of more than SHARD_TAILS tails is split by a hash, so equal tails,
however many, share a task no more than others. Search is exact within a shard
and its cost linear in the tails; neighbours in other shards are not seen.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .common import MIX_B, U64, mixed, pieces, written

#: Tokens of a window; BM25's saturation and length parameters.
WINDOW, K1, B = 1024, 1.2, 0.75
#: Tails of an index shard (at most, but for the hash's spread); dimensions of the projection; leaves of the tree at most; sampled tails for each leaf.
SHARD_TAILS, DIMENSIONS, LEAVES, LEAF_SAMPLE = 1024, 64, 65_536, 8
#: Leaves for each shard wanted; tails projected at once; hash buckets of the tokens' directions.
FINE, PROJECTED, BUCKETS = 8, 128, 2048


class Encoder:
    """Token ids of the ``tokenizers`` file, as little-endian unsigned 32-bit arrays.

    Texts of Latin-1 characters without special strings go to the same
    vocabulary's faster library (its ranks file lies beside the JSON file); all
    other texts to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except UnicodeEncodeError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut(docs: DataFrame, tokenizer: str | None, window: int) -> DataFrame:
    """A row for each full window (ids null) and for the tail (ids: packed 32-bit ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in pieces(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(t or ""), np.uint32(0))
                full = len(ids) // window * window
                rows += [(i, s, window, crc(ids[s : s + window]), len(ids), None) for s in range(0, full, window)]
                if full < len(ids):
                    rows.append((i, full, len(ids) - full, 0, len(ids), np.ascontiguousarray(ids[full:], "<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.mapInArrow(run, SCHEMA)


class Statistics:
    """Number and mean length of tails, and how many hold each token."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean = n, mean
        # a term of more than half the tails tells nothing: BM25's inverse frequency is not positive
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
        self.terms, self.idf = terms[idf > 0], idf[idf > 0]

    @classmethod
    def of(cls, tails: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.unique(t) for t in tails]), return_counts=True)
        return cls(len(tails), float(np.mean([len(t) for t in tails])), terms, df)

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms tell something, and their numbers."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        ok = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return ok, at[ok]


class Index:
    """BM25 inverted index over the distinct tokens of some tails; statistics: of all tails (default: of these)."""

    def __init__(self, tails: list[np.ndarray], statistics: Statistics | None = None):
        s = self.statistics = statistics or Statistics.of(tails)
        self.n = len(tails)
        terms, tf = zip(*(np.unique(t, return_counts=True) for t in tails), strict=True)
        size = np.array([len(t) for t in tails], float)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        flat, tf = np.concatenate(terms), np.concatenate(tf)
        keep, term = s.known(flat)
        doc, tf = doc[keep], tf[keep]
        weight = s.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / s.mean))
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(s.terms) + 1))

    def scores(self, i: int) -> np.ndarray:
        """Score of every tail for tail i's distinct terms."""
        return self.sums(self.terms[i])

    def sums(self, t: np.ndarray) -> np.ndarray:
        """Sums of the weights of terms ``t`` for every tail."""
        lo, n = self.first[t], self.first[t + 1] - self.first[t]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def fill(tails: list[np.ndarray], window: int, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, from, to); every window is full but those of powers of two at the end."""
    index = Index(tails, statistics)
    begun, size = np.zeros(len(tails), np.int64), np.array([len(t) for t in tails])
    unused = np.ones(len(tails), bool)
    seed, out = 0, []
    while True:
        while seed < len(tails) and not unused[seed]:
            seed += 1
        if seed == len(tails):
            break
        parts, room, score, j = [], window, None, seed
        while room and j is not None:
            take = min(room, int(size[j] - begun[j]))
            parts.append((j, int(begun[j]), int(begun[j]) + take))
            begun[j] += take
            room -= take
            if begun[j] == size[j]:
                unused[j] = False
                if score is not None:
                    score[j] = -1
            if room:
                if score is None:
                    score = np.where(unused, index.scores(seed), -1)
                j = int(np.argmax(score))
                j = j if unused[j] else None
        out.append(parts)
    last = out.pop() if out and sum(e - s for _, s, e in out[-1]) < window else []
    left = sum(e - s for _, s, e in last)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        parts = []
        while room:
            j, s, e = last[0]
            take = min(room, e - s)
            parts.append((j, s, s + take))
            last[0] = (j, s + take, e)
            if s + take == e:
                last.pop(0)
            room -= take
        out.append(parts)
    return out


#: Kinds of windows, for distinct numbers: 0 one piece of a document, 1 full, others by their length's bits.
KINDS = 64
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(window: int, statistics: Statistics):
    """For the rows (shard, key, doc_id, start, doc_tokens, ids) sorted by shard: the pieces with their windows."""

    def windows(rows: list[dict]) -> pa.RecordBatch:
        tails = [np.frombuffer(r["ids"], "<u4") for r in rows]
        found = []
        for parts in fill(tails, window, statistics):
            offset, n = 0, sum(e - s for _, s, e in parts)
            # named by the tail that opens it; one tail can open a full window and, of the last ones, one of each length
            sequence = rows[parts[0][0]]["key"] * KINDS + (1 if n == window else n.bit_length() + 1)
            for j, s, e in parts:
                found.append((rows[j]["doc_id"], rows[j]["start"] + s, e - s, crc(tails[j][s:e]), rows[j]["doc_tokens"], sequence, offset))
                offset += e - s
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if rows:
                        yield windows(rows)
                    shard, rows = r["shard"], []
                rows.append(r)
        if rows:
            yield windows(rows)

    return run


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (ids): (token, tails that hold it); token -1: number of tails, -2: their tokens."""
    df, n, size = np.zeros(0, np.int64), 0, 0
    for b in batches:
        tails = [np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()]
        if tails:
            c = np.bincount(np.concatenate([np.unique(t) for t in tails]))
            df = np.pad(df, (0, max(0, len(c) - len(df))))
            df[: len(c)] += c
            n, size = n + len(tails), size + sum(map(len, tails))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, size]))], names=["token", "n"])


def projected(statistics: Statistics):
    """Tails -> (n, DIMENSIONS) unit vectors: random directions of their tokens, weighed by inverse document frequency and summed.

    A token's direction is plus or minus that of one of BUCKETS hash buckets, so the sum is a count by bucket and one matrix product.
    """
    top = int(statistics.terms[-1]) + 1 if len(statistics.terms) else 1
    hashed = mixed(np.arange(top + 1, dtype=U64) ^ MIX_B)
    bucket, weight = (hashed % U64(BUCKETS)).astype(np.int64), np.zeros(top + 1)
    weight[statistics.terms] = statistics.idf
    weight[hashed >> U64(63) == 1] *= -1
    directions = np.random.default_rng(4).standard_normal((BUCKETS, DIMENSIONS), np.float32)

    def run(tails: list[np.ndarray]) -> np.ndarray:
        flat = np.minimum(np.concatenate(tails), top)
        row = np.repeat(np.arange(0, BUCKETS * len(tails), BUCKETS), [len(t) for t in tails])
        x = np.bincount(row + bucket[flat], weight[flat], BUCKETS * len(tails)).reshape(len(tails), BUCKETS).astype(np.float32) @ directions
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    return run


class Tree:
    """Median splits along the widest direction of each node's sample, down to 2 ** depth leaves."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth if len(sample) else 0
        self.along, self.limit = np.zeros((2**self.depth, DIMENSIONS), np.float32), np.zeros(2**self.depth, np.float32)
        nodes = [sample]
        for level in range(self.depth):
            below = []
            for i, x in enumerate(nodes):
                n = (1 << level) + i
                if len(x) > 1:
                    self.along[n] = np.linalg.eigh(np.cov(x.T.astype(float)))[1][:, -1]
                at = x @ self.along[n]
                self.limit[n] = np.median(at) if len(x) else 0
                below += [x[at <= self.limit[n]], x[at > self.limit[n]]]
            nodes = below

    def leaves(self, x: np.ndarray) -> np.ndarray:
        n = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            n = 2 * n + ((x * self.along[n]).sum(axis=1) > self.limit[n])
        return n - (1 << self.depth)


def runs(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of every leaf: runs of leaves of up to ``most`` tails are one shard, a larger leaf has shards of its own."""
    first, parts, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, c in enumerate(counts.tolist()):
        if held and held + c > most:
            shard, held = shard + 1, 0
        first[i], parts[i] = shard, max(1, -(-c // most))
        if parts[i] > 1:
            shard, held = shard + int(parts[i]), 0
        else:
            held += c
    return first, parts


def dealt(pool: DataFrame, statistics: Statistics, n: int) -> DataFrame:
    """``pool`` with ``shard``: runs of the tree's leaves; a leaf of more than SHARD_TAILS tails is split by a hash of the key."""
    if n <= SHARD_TAILS:
        return pool.withColumn("shard", F.lit(0).cast("long"))
    project = projected(statistics)
    leaves = min(LEAVES, 1 << math.ceil(math.log2(FINE * n / SHARD_TAILS)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PROJECTED):
            x = project([np.frombuffer(i, "<u4") for i in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["key", "x"])

    # the sample's size follows the leaves, whose number has a limit
    share = min(1.0, leaves * LEAF_SAMPLE / n)
    few = pool.select("key", "ids").where(F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = sorted((r["key"], bytes(r["x"])) for r in few.mapInArrow(vectors, "key long, x binary").toLocalIterator())
    tree = Tree(np.frombuffer(b"".join(x for _, x in rows), np.float32).reshape(-1, DIMENSIONS), leaves.bit_length() - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(leaves, np.int64)
        for b in pieces(batches, PROJECTED):
            c += np.bincount(tree.leaves(project([np.frombuffer(i, "<u4") for i in b.column(0).to_pylist()])), minlength=leaves)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], names=["leaf", "n"])

    # a row for each leaf, LEAVES at most
    counts = np.zeros(leaves, np.int64)
    for r in pool.select("ids").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    first, parts = runs(counts, SHARD_TAILS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PROJECTED):
            leaf = tree.leaves(project([np.frombuffer(i, "<u4") for i in b.column("ids").to_pylist()]))
            shard = first[leaf] + (mixed(b.column("key").to_numpy().astype(U64)) % parts[leaf].astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    return pool.mapInArrow(placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema) + ", shard long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids (``tokenizers`` file; default: the public byte
    BPE) without special tokens, then id 0; a null text is empty, so its
    document is the one id 0. Every id lies in exactly one piece; pieces of one
    sequence_id lie without gaps from offset 0 up to ``window``, or to a lower
    power of two in the last windows of a shard. Rows that repeat a doc_id are
    documents of their own; null doc_ids stay null. An empty table gives no
    rows; other columns take no part.
    """
    ship(docs.sparkSession)
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    parts = written(cut(slim, tokenizer, window).withColumn("key", F.monotonically_increasing_id()), "pieces")
    full = parts.where("ids is null").withColumn("sequence_id", F.col("key") * KINDS).withColumn("offset", F.lit(0).cast("long"))
    out = full.select(NAMES)
    pool = parts.where("ids is not null").select("key", "doc_id", "start", "doc_tokens", "ids")
    # as many rows as the tokenizer has tokens, at most
    df = {r["token"]: r["n"] for r in pool.select("ids").mapInArrow(document_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, tokens = df.pop(-1, 0), df.pop(-2, 0)
    terms = sorted(df)
    statistics = Statistics(n, tokens / max(1, n), np.array(terms, np.uint32), np.array([df[t] for t in terms], float))
    rows = dealt(pool, statistics, n).repartition("shard").sortWithinPartitions("shard", "key")
    return out.unionByName(rows.mapInArrow(packed(window, statistics), ", ".join(f"{c} long" for c in NAMES)))
