"""Indices of coordinate-sorted BAM files: which stretches of a file hold the records of a region.

A record lies in the smallest bin that holds its bases; bins are nested, eight
in each, down to 16384 bases. Chunks of a bin are pairs of virtual offsets. The
linear index tells for each 16384 bases where the first record that reaches them
begins, so earlier chunks are left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import bam, bam_columns

# Fixed values of the format: first bin of each level with the bases of a bin as a shift; the window of the linear index.
LEVELS, WINDOW, BINS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)), 14, 37449
#: Packed bytes between two chunks that are read as well, to save a seek.
NEAR = 1 << 16


@dataclass
class Reference:
    """Index of one contig."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)

    def chunks(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Disjoint stretches of virtual offsets, in order, that hold every record which overlaps ``begin`` to ``end``."""
        end = min(end, 1 << 29)
        if begin >= end:
            return []
        w = min(begin >> WINDOW, len(self.linear) - 1)
        least = self.linear[w] if w >= 0 else 0
        found = sorted(c for first, shift in LEVELS for k in self._bins(first + (begin >> shift), first + (end - 1 >> shift)) for c in self.bins[k] if c[1] > least)
        out: list[tuple[int, int]] = []
        for b, e in found:
            b = max(b, least)
            if out and b >> 16 <= (out[-1][1] >> 16) + NEAR:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((b, e))
        return out

    def _bins(self, low: int, high: int) -> list[int]:
        return [k for k in range(low, high + 1) if k in self.bins] if high - low < len(self.bins) else [k for k in self.bins if low <= k <= high]


def smallest_bin(begin: int, end: int) -> int:
    """The bin of bases ``begin`` to ``end``."""
    return next(first + (begin >> shift) for first, shift in reversed(LEVELS) if begin >> shift == max(begin, end - 1) >> shift)


def smallest_bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``smallest_bin`` of many; 0 where no bin is large enough."""
    out, last = np.zeros(len(begin), np.int64), np.maximum(begin, end - 1)
    for first, shift in LEVELS:
        out = np.where(begin >> shift == last >> shift, first + (begin >> shift), out)
    return out


class Builder:
    """An index from the records of a file in their order."""

    def __init__(self, contigs: int):
        self.references = [Reference() for _ in range(contigs)]
        self.unplaced, self.last = 0, (-1, -1)

    def add(self, tid: int, pos: int, end: int, begins: int, ends: int) -> None:
        """A record: its place, and the virtual offsets at which it begins and ends."""
        if tid < 0:
            self.unplaced += 1
            self.last = (len(self.references), -1)
            return
        if (tid, pos) < self.last:
            raise ValueError("records are not in order of their coordinates")
        self.last, r = (tid, pos), self.references[tid]
        end = max(end, pos + 1)
        at = max(pos, 0)
        chunks = r.bins.setdefault(smallest_bin(at, end), [])
        if chunks and chunks[-1][1] == begins:
            chunks[-1] = (chunks[-1][0], ends)
        else:
            chunks.append((begins, ends))
        last = max(end - 1, at) >> WINDOW
        if len(r.linear) <= last:
            # windows that no record has reached begin where this one does
            r.linear += [begins] * (last + 1 - len(r.linear))

    def add_all(self, tid: np.ndarray, pos: np.ndarray, end: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """``add`` for records in a row: a step for each chunk and each window that is reached first."""
        key = np.where(tid < 0, len(self.references), tid)
        pos = np.where(tid < 0, -1, pos)
        before = self.last
        if len(key) and ((int(key[0]), int(pos[0])) < before or ((key[1:] < key[:-1]) | (key[1:] == key[:-1]) & (pos[1:] < pos[:-1])).any()):
            raise ValueError("records are not in order of their coordinates")
        if len(key):
            self.last = (int(key[-1]), int(pos[-1]))
        placed = int(np.searchsorted(key, len(self.references)))
        self.unplaced += len(key) - placed
        key, pos, end, begins, ends = (x[:placed] for x in (key, pos, end, begins, ends))
        if not placed:
            return
        end, at = np.maximum(end, pos + 1), np.maximum(pos, 0)
        bins = smallest_bins(at, end)
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (bins[1:] != bins[:-1]) | (begins[1:] != ends[:-1])))
        k = np.flatnonzero(first)
        for t, n, b, e in zip(key[k].tolist(), bins[k].tolist(), begins[k].tolist(), ends[np.append(k[1:], placed) - 1].tolist(), strict=True):
            chunks = self.references[t].bins.setdefault(n, [])
            if chunks and chunks[-1][1] == b:
                chunks[-1] = (chunks[-1][0], e)
            else:
                chunks.append((b, e))
        last = np.maximum(end - 1, at) >> WINDOW
        for t, own in ((t, slice(*np.searchsorted(key, [t, t + 1]))) for t in np.unique(key).tolist()):
            linear = self.references[t].linear
            upto = np.maximum.accumulate(last[own])
            fresh = np.flatnonzero(np.concatenate(([True], upto[1:] != upto[:-1])))
            for w, b in zip(upto[fresh].tolist(), begins[own][fresh].tolist(), strict=True):
                # windows that no record has reached begin where this one does
                linear += [b] * (w + 1 - len(linear))

    def packed(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.references))]
        for r in self.references:
            out.append(struct.pack("<i", len(r.bins)))
            for k, chunks in sorted(r.bins.items()):
                out.append(struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<i", len(r.linear)) + struct.pack(f"<{len(r.linear)}Q", *r.linear))
        return b"".join(out) + struct.pack("<Q", self.unplaced)


def unpacked(data: bytes, name: str) -> list[Reference]:
    """The contigs' indices from an index file's bytes."""
    try:
        if data[:4] != b"BAI\1":
            raise ValueError
        n, i, out = struct.unpack_from("<i", data, 4)[0], 8, []
        for _ in range(n):
            r = Reference()
            bins, i = struct.unpack_from("<i", data, i)[0], i + 4
            for _ in range(bins):
                k, m = struct.unpack_from("<Ii", data, i)
                if k < BINS:  # a further one holds totals
                    r.bins[k] = list(struct.iter_unpack("<QQ", data[i + 8 : i + 8 + 16 * m]))
                i += 8 + 16 * m
            m, i = struct.unpack_from("<i", data, i)[0], i + 4
            r.linear, i = list(struct.unpack_from(f"<{m}Q", data, i)), i + 8 * m
            out.append(r)
        return out
    except (struct.error, ValueError):
        raise ValueError(f"{name} is not an index of a BAM file") from None


def load(path: str) -> list[Reference]:
    """The index of the BAM file ``path``: ``path.bai``, or ``.bai`` instead of ``.bam``."""
    for name in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        try:
            with bam.opened(name) as f:
                return unpacked(f.read(), name)
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"failed to load the index of {path}")


def built(f, name: str) -> bytes:
    """The index of an open coordinate-sorted BAM file."""
    head = bam.header(f, name)
    if head is None:
        raise ValueError(f"{name} has no blocks that an index could point to")
    out = Builder(len(head.contigs))
    size = f.seek(0, 2)
    for run in bam.runs(f, size, 0, size, head):
        b = np.frombuffer(run.data + bytes(8), np.uint8)
        fixed = np.ascontiguousarray(b[run.at[:, None] + np.arange(36)]).view(bam_columns.FIXED).ravel()
        v = run.virtual(np.append(run.at, run.end)).tolist()
        ends = fixed["pos"] + np.maximum(1, bam_columns.reference_lengths(b, run.at, fixed))
        for x in zip(fixed["tid"].tolist(), fixed["pos"].tolist(), ends.tolist(), v[:-1], v[1:], strict=True):
            out.add(*x)
    return out.packed()


def place(text: str, contigs: list[str], name: str) -> tuple[int, int, int]:
    """(tid, begin, end) of ``contig``, ``contig:begin`` or ``contig:begin-end`` (from 1, both ends belong to it)."""
    contig, begin, end = text, 0, 1 << 29
    if text not in contigs:
        contig, _, span = text.rpartition(":")
        first, dash, last = span.replace(",", "").partition("-")
        if contig not in contigs or not first.isdigit() or (dash and not last.isdigit()):
            raise ValueError(f"failed to parse the region {text!r} of {name}")
        begin, end = max(0, int(first) - 1), int(last) if dash else 1 << 29
        if begin >= end:
            raise ValueError(f"failed to parse the region {text!r} of {name}")
    return contigs.index(contig), begin, end
