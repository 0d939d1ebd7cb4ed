"""BAM files read in splits: byte ranges of blocked gzip, each decoded where it is read.

A split owns the records whose first byte lies in a block that begins in its
range. A block is found by its header and that of the next; the first record of
a split by a chain of records that are plausible one after another. Files
sorted by coordinate are cut to the splits that can hold a wanted contig by a
binary search over the splits' first records, so a region needs no index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of a split; most of a block, packed or not; inflated bytes in which a split's first record is looked for, and records that must follow it.
SPLIT, BLOCK, LOOK, CHAIN = 32 << 20, 1 << 16, 1 << 18, 5
#: Inflated bytes that are decoded at a time, as far as records allow.
RUN = 4 << 20


def opened(path: str):
    """A file by its path or URI, for reading at any place."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")  # noqa: SIM115
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def block_size(b: bytes, i: int = 0) -> int | None:
    """Bytes of the block whose header begins at ``i``; None if none does."""
    if b[i : i + 4] != MAGIC or len(b) < i + 12:
        return None
    j, end = i + 12, i + 12 + struct.unpack_from("<H", b, i + 10)[0]
    while j + 4 <= min(end, len(b)):
        n = struct.unpack_from("<H", b, j + 2)[0]
        if b[j : j + 2] == b"BC" and n == 2 and j + 6 <= len(b):
            return struct.unpack_from("<H", b, j + 4)[0] + 1
        j += 4 + n
    return None


def find_block(f, at: int, size: int) -> int:
    """Offset of the first block that begins at ``at`` or later; ``size`` if none does."""
    f.seek(at)
    b, i = f.read(3 * BLOCK), -1
    while (i := b.find(MAGIC, i + 1)) >= 0:
        n = block_size(b, i)
        if n and (at + i + n == size or b[i + n : i + n + 4] == MAGIC):
            return at + i
    return size


class Blocks:
    """Inflated blocks from a block's offset on."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def take(self) -> bytes | None:
        self.f.seek(self.at)
        head = self.f.read(18)
        if len(head) < 18:
            return None
        n = block_size(head)
        if n is None:  # other subfields stand before the size
            n = block_size(head + self.f.read(BLOCK))
            if n is None:
                raise ValueError(f"no block at byte {self.at}")
            self.f.seek(self.at + 18)
        self.at += n
        return zlib.decompress(head + self.f.read(n - 18), 31)


@dataclass(frozen=True)
class Header:
    """Contig names and lengths, whether sorted by coordinate, and the first record: its block's offset and its place there."""

    contigs: list[str]
    lengths: list[int]
    is_sorted: bool
    block: int
    inside: int


def header(f, name: str) -> Header | None:
    """The header of a BAM file; None if its blocks do not tell their sizes, so that it can't be split."""
    f.seek(0)
    if block_size(f.read(BLOCK)) is None:
        return None
    blocks, d, starts = Blocks(f, 0), b"", []

    def more(n: int) -> None:
        nonlocal d
        while len(d) < n:
            starts.append((len(d), blocks.at))
            x = blocks.take()
            if x is None:
                raise ValueError(f"{name} is not a BAM file")
            d += x

    more(8)
    if d[:4] != b"BAM\1":
        raise ValueError(f"{name} is not a BAM file")
    i = 8 + struct.unpack_from("<i", d, 4)[0]
    more(i + 4)
    text = d[8:i]
    contigs, lengths = [], []
    n = struct.unpack_from("<i", d, i)[0]
    i += 4
    for _ in range(n):
        more(i + 4)
        k = struct.unpack_from("<i", d, i)[0]
        more(i + 8 + k)
        contigs.append(d[i + 4 : i + 3 + k].decode())
        lengths.append(struct.unpack_from("<i", d, i + 4 + k)[0])
        i += 8 + k
    for begin, at in reversed(starts):
        if begin <= i and (begin < i or i == 0):
            return Header(contigs, lengths, b"SO:coordinate" in text, at, i - begin)
    return Header(contigs, lengths, False, 0, i)


def plausible(d: bytes, i: int, contigs: int) -> int | None:
    """Where the record at ``i`` ends, if its fixed fields and name are those of a record."""
    if i + 36 > len(d):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mref, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", d, i)
    if not (-1 <= ref < contigs and -1 <= mref < contigs and pos >= -1 and mpos >= -1 and l_name > 0 and l_seq >= 0):
        return None
    if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return None
    name = d[i + 36 : i + 36 + l_name]
    if len(name) < l_name or name[-1] != 0 or any(not 33 <= x <= 126 for x in name[:-1]):
        return None
    return i + 4 + size


def first_record(d: bytes, limit: int, contigs: int, ended: bool) -> int | None:
    """Place of the first record in ``d`` that begins before ``limit``: CHAIN records follow one another, or as many as there are bytes."""
    for i in range(limit):
        at, n = i, 0
        while n < CHAIN:
            end = plausible(d, at, contigs)
            if end is None:
                break
            at, n = end, n + 1
            if at >= len(d) - 36:  # the next one's fields are not there; at the file's end it must be the end itself
                n = CHAIN if at == len(d) or not ended and n > 1 or at > len(d) and not ended else n
                break
        if n == CHAIN:
            return i
    return None


@dataclass(frozen=True)
class Run:
    """Whole records in a row: inflated bytes, where each record begins, where the last one ends, and (place, offset) of the blocks."""

    data: bytes
    at: np.ndarray
    end: int
    blocks: list[tuple[int, int]]

    def virtual(self, at: np.ndarray) -> np.ndarray:
        """Virtual offsets (a block's offset, 16 bits of place in it) of places in ``data``."""
        place, offset = (np.array(x, np.int64) for x in zip(*self.blocks, strict=True))
        k = np.searchsorted(place, at, "right") - 1
        return offset[k] << 16 | (at - place[k])


def runs(f, size: int, begin: int, end: int, head: Header, exact: int | None = None, limit: int | None = None, least: int = RUN) -> Iterator[Run]:
    """The records that the split ``begin`` to ``end`` of a file of ``size`` bytes owns, some ``least`` bytes at a time.

    exact: virtual offset at which the split's first record is known to begin;
    limit: virtual offset from which on records are left out.
    """
    if exact is not None:
        at = exact >> 16
    else:
        at = max(head.block, find_block(f, begin, size) if begin else 0)
    if at >= end:
        return
    blocks, d, own = Blocks(f, at), b"", 0  # own: bytes of d in own blocks
    marks: list[tuple[int, int]] = []

    def more() -> bool:
        nonlocal d, own
        mine = blocks.at < end
        marks.append((len(d), blocks.at))
        x = blocks.take()
        if x is None:
            marks.pop()
            return False
        d += x
        own += len(x) if mine else 0
        return True

    if exact is not None:
        i = exact & 0xFFFF
    elif at == head.block:
        i = head.inside
    else:
        ended = False
        while len(d) < LOOK and not ended:
            ended = not more()
        while (i := first_record(d, own, len(head.contigs), ended)) is None:
            # long records: the chain does not fit what is there
            if ended or len(d) > 256 * LOOK:
                return
            ended = not more()
    sizes = struct.Struct("<i").unpack_from
    while True:
        while len(d) - i < least and blocks.at < end and more():
            pass
        starts, n = [], len(d)
        begun = i
        while i < own and i + 4 <= n:
            stop = i + 4 + sizes(d, i)[0]
            if stop > n:
                break
            starts.append(i)
            i = stop
        if starts:
            run = Run(d, np.array(starts, np.int64), i, [*marks, (n, blocks.at)])
            if limit is not None:
                inside = run.at[run.virtual(run.at) < limit]
                if len(inside) < len(run.at):
                    if len(inside):
                        yield Run(d, inside, int(run.at[len(inside)]), run.blocks)
                    return
            yield run
        if i >= own and blocks.at >= end:
            return
        if begun == i and not more():
            return
        # keep what is left, and the block it begins in
        k = max((j for j, (place, _) in enumerate(marks) if place <= i), default=0)
        if marks and (cut := marks[k][0]):
            d, own, i = d[cut:], own - cut, i - cut
            marks[:] = [(place - cut, offset) for place, offset in marks[k:]]


def records(f, size: int, begin: int, end: int, head: Header) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, begin, end) of the records that the split ``begin`` to ``end`` of a file of ``size`` bytes owns."""
    for run in runs(f, size, begin, end, head):
        for i, stop in zip(run.at.tolist(), [*run.at[1:].tolist(), run.end], strict=True):
            yield run.data, i, stop


def splits(f, size: int, head: Header, tid: int | None = None, split: int = SPLIT) -> list[tuple[int, int]]:
    """Byte ranges of ``split`` bytes; of a sorted file those that can hold records of contig ``tid``."""
    cuts = [(x, min(size, x + split)) for x in range(0, size, split)]
    if tid is None or not head.is_sorted or tid < 0:
        return cuts

    def contig(k: int) -> int:
        """Of the first record in split k or a later one; unplaced records are last."""
        for b, e in cuts[k:]:
            for run in runs(f, size, b, e, head, least=1):
                ref = struct.unpack_from("<i", run.data, int(run.at[0]) + 4)[0]
                return ref if ref >= 0 else 1 << 31
        return 1 << 31

    def reach(limit: int) -> int:
        """The first split that begins with contig ``limit`` or a later one."""
        low, high = 0, len(cuts)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if contig(middle) < limit else (low, middle)
        return low

    return cuts[max(0, reach(tid) - 1) : reach(tid + 1)]
