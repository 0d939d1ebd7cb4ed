"""Shared helpers: tables, shared storage, words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship, written

U64 = np.uint64
#: Odd multipliers (fixed values) of the 64-bit mixers below.
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
#: Entries a worker keeps in one word cache before it starts afresh.
CACHE_WORDS = 400_000


__all__ = ["written"]  # for the modules beside this one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: Iterable[str], name: str) -> str:
    """``name``, longer by underscores as far as one of ``taken`` has it (Spark's names have no case)."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * MIX_A
        x = (x ^ (x >> U64(29))) * MIX_B
        return x ^ (x >> U64(32))


class WordIds(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordIds()


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z lowered (``bytes`` methods do just that)."""
    return text.lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, ws), U64, len(ws))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; all the words as one when fewer."""
    ws = words(text)
    if not ws:
        return np.empty(0, U64)
    h = word_hashes(ws)
    with np.errstate(over="ignore"):
        n = min(k, len(h))
        out = np.full(len(h) - n + 1, U64(n))
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * (MIX_A if i % 2 else MIX_C)
            out ^= out >> U64(31)
    return np.unique(mixed(out))


def as_bytes(column) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


#: Bytes of a record batch's part, if it has more rows than one.
PIECE_BYTES = 8 << 20


def pieces(batches: Iterable, rows: int = 512):
    """Record batches cut to at most ``rows`` rows, and as far as rows allow to about PIECE_BYTES, so that long texts stay bounded."""
    for b in batches:
        if not b.num_rows:
            continue
        some = max(1, min(rows, b.num_rows * PIECE_BYTES // max(1, b.nbytes)))
        for i in range(0, b.num_rows, some):
            c = b.slice(i, some)
            # a few long texts among short ones: rows one by one
            if c.num_rows > 1 and c.nbytes > 2 * PIECE_BYTES:
                for j in range(c.num_rows):
                    yield c.slice(j, 1)
            else:
                yield c


def filtered(docs: DataFrame, text: str, keep: Callable[[list[str | None]], list[bool] | np.ndarray], rows: int = 512) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``keep`` marks: rows pass through the workers, nothing is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(docs.select(docs[text]).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows):
            yield b.filter(pa.array(keep(b.column(at).cast(pa.large_string()).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
