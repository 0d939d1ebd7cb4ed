"""BAM output: records packed into blocks by each task, files that appear when the job commits."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from . import bam_columns, bam_index

#: Inflated bytes of a block, and the packed empty block that ends a file (fixed by the format).
BLOCK = 65_280
#: Rows that are encoded at a time, and bytes of their columns as far as rows allow.
ROWS, COLUMN_BYTES = 16_384, 16 << 20
_CODE = np.full(256, 255, np.uint8)
for _i, _x in enumerate(bam_columns.BASES):
    _CODE[[ord(_x), ord(_x.lower())]] = _i
_INTS = {"flag": (0, 65_535), "pos": (-(1 << 31), (1 << 31) - 1), "mapq": (0, 255), "mpos": (-(1 << 31), (1 << 31) - 1), "isize": (-(1 << 31), (1 << 31) - 1)}


def store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def block(data: bytes, level: int = 6) -> bytes:
    """One block of blocked gzip."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockFile:
    """Blocks of inflated bytes, with virtual offsets."""

    def __init__(self, f, level: int = 6):
        self.f, self.level, self.held, self.at = f, level, b"", 0

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        held = self.held + data
        full = len(held) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            self._put(held[i : i + BLOCK])
        self.held = held[full:]

    def write_records(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes records that lie one after another; the virtual offsets at which each begins and ends. They are not cut where they fit a block of their own."""
        begins, stops = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
        k, at = 0, 0  # the next record and its place
        while k < len(ends):
            # records that fit what is left of the block
            n = int(np.searchsorted(ends, at + BLOCK - len(self.held), "right"))
            if n == k:
                if self.held:
                    self.flush()
                    continue
                n = k + 1  # longer than a block
            stop, first = int(ends[n - 1]), self.tell()
            # all but the first begin where another ends, in the block that is open now
            begins[k] = first
            begins[k + 1 : n] = first + (ends[k : n - 1] - at)
            self.write(data[at:stop])
            stops[k : n - 1] = begins[k + 1 : n]
            stops[n - 1] = self.tell()
            k, at = n, stop
        return begins, stops

    def flush(self) -> None:
        if self.held:
            self._put(self.held)
            self.held = b""

    def _put(self, data: bytes) -> None:
        packed = block(data, self.level)
        self.f.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        self.flush()
        self._put(b"")


def header(contigs: list[tuple[str, int]], in_order: bool, text: str = "") -> bytes:
    """A file's header: ``text`` (lines of further kinds), the order and the contigs."""
    lines = f"@HD\tVN:1.6\tSO:{'coordinate' if in_order else 'unsorted'}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs) + text
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(lines.encode())) + lines.encode() + struct.pack("<i", len(contigs)) + names


class _Operations(dict):
    """cigar text -> (packed operations, bases of the reference)."""

    def __missing__(self, cigar: str) -> tuple[bytes, int]:
        ops = [] if cigar == "*" else [(int(n), k) for n, k in re.findall(r"(\d+)(.)", cigar)]
        if cigar != "*" and "".join(f"{n}{k}" for n, k in ops) != cigar:
            raise ValueError(f"not a cigar text: {cigar!r}")
        packed = b"".join(struct.pack("<I", n << 4 | bam_columns.CIGAR.index(k)) for n, k in ops)
        out = self[cigar] = (packed, sum(n for n, k in ops if k in bam_columns.ON_REFERENCE))
        return out


@dataclass(frozen=True)
class Records:
    """Packed records one after another: their bytes and where each ends there; contig, begin and end of each on it."""

    data: bytes
    ends: np.ndarray
    tid: np.ndarray
    pos: np.ndarray
    stop: np.ndarray


def _whole(b: pa.RecordBatch, name: str, low: int, high: int) -> np.ndarray:
    x = b.column(name)
    if x.null_count:
        raise ValueError(f"{name} is null in a record")
    x = x.cast(pa.int64()).to_numpy()
    if len(x) and (x.min() < low or x.max() > high):
        raise ValueError(f"a {name} of {int(x.min())} to {int(x.max())} does not fit a record")
    return x


def _texts(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins, lengths and which are not null (these have no length) of a column of texts or bytes."""
    there = x.is_valid().to_numpy(zero_copy_only=False)
    x = x.cast(pa.large_binary())
    if x.null_count:
        x = x.fill_null(b"")
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets), there


def _coded(x: pa.Array) -> tuple[np.ndarray, list]:
    """For each row the number of its value, and the values; null is one of them."""
    d = x.dictionary_encode("encode")
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def _numbers(x: pa.Array, number: dict) -> np.ndarray:
    at, names = _coded(x)
    if missing := [n for n in names if n not in number]:
        raise ValueError(f"the header has no contig {missing[0]!r}")
    return np.array([number[n] for n in names], np.int64)[at]


def packed(b: pa.RecordBatch, number: dict[str | None, int], ops: _Operations) -> Records:
    """The records of a batch, all columns at once."""
    have, n = set(b.schema.names), b.num_rows
    flag, pos, mapq, mpos, isize = (_whole(b, k, *v) for k, v in _INTS.items())
    tid, mtid = (_numbers(b.column(k), number) for k in ("contig", "mcontig"))
    names, name_at, name_n, there = _texts(b.column("qname"))
    at, cigars = _coded(b.column("cigar"))
    cigars = [ops[x or "*"] for x in cigars]
    bad = ~there | (name_n < 1) | (name_n > 254) | np.array([len(x) > 4 * 65_535 for x, _ in cigars], bool)[at]
    if bad.any():
        raise ValueError(f"the name or cigar of {b.column('qname')[int(np.argmax(bad))].as_py()!r} does not fit a record")
    cigar_n = np.array([len(x) for x, _ in cigars], np.int64)
    cigar_at, cigar_data = np.cumsum(cigar_n) - cigar_n, np.frombuffer(b"".join(x for x, _ in cigars), np.uint8)
    stop = pos + np.maximum(1, np.array([x for _, x in cigars], np.int64)[at])
    cigar_at, cigar_n = cigar_at[at], cigar_n[at]
    none = lambda kind: pa.nulls(n, kind)
    seq, seq_at, seq_n, _ = _texts(b.column("seq") if "seq" in have else none(pa.string()))
    qual, qual_at, qual_n, has_qual = _texts(b.column("qual") if "qual" in have else none(pa.binary()))
    rg, rg_at, rg_n, has_rg = _texts(b.column("rg") if "rg" in have else none(pa.string()))
    bad = has_qual & (qual_n != seq_n)
    if bad.any():
        i = int(np.argmax(bad))
        raise ValueError(f"{b.column('qname')[i].as_py()!r} has {seq_n[i]} bases and {qual_n[i]} qualities")
    tags = [(k, b.column(m)) for k, m in (("AM", "am"), ("Aq", "aq")) if m in have]
    tags = [(k, x.is_valid().to_numpy(zero_copy_only=False), x.cast(pa.int64()).fill_null(0).to_numpy()) for k, x in tags]
    bases_n = (seq_n + 1) // 2
    rg_size = np.where(has_rg, rg_n + 4, 0)
    size = 36 + name_n + 1 + cigar_n + bases_n + seq_n + rg_size + sum(7 * there for _, there, _ in tags)
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]), 255, np.uint8)  # so qualities that are missing are there already
    spread = bam_columns.spread

    fixed = np.empty(n, bam_columns.FIXED)
    fixed["size"], fixed["tid"], fixed["pos"], fixed["l_name"], fixed["mapq"] = size - 4, tid, pos, name_n + 1, mapq
    # a bin's number has 16 bits; places beyond those of the bins have no number of their own
    fixed["bin"] = np.where(pos >= 0, bam_index.smallest_bins(np.maximum(pos, 0), stop), 4680) & 0xFFFF
    fixed["n_cigar"], fixed["flag"], fixed["qlen"], fixed["mtid"], fixed["mpos"], fixed["isize"] = cigar_n // 4, flag, seq_n, mtid, mpos, isize
    to = ends - size
    out[to[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    to = to + 36
    out[spread(to, name_n)] = names[spread(name_at, name_n)]
    to = to + name_n
    out[to] = 0
    to = to + 1
    out[spread(to, cigar_n)] = cigar_data[spread(cigar_at, cigar_n)]
    to = to + cigar_n
    codes = _CODE[seq[spread(seq_at, seq_n)]]
    if (codes == 255).any():
        raise ValueError("a base that the format has not")
    if (seq_n & 1).any():  # half a byte more than there are bases
        even = np.zeros(2 * int(bases_n.sum()), np.uint8)
        even[spread(2 * (np.cumsum(bases_n) - bases_n), seq_n)] = codes
        codes = even
    out[spread(to, bases_n)] = codes[::2] << 4 | codes[1::2]
    to = to + bases_n
    if has_qual.any():
        of = np.where(has_qual, seq_n, 0)
        x = qual[spread(qual_at, of)]
        out[spread(to, of)] = np.where(x < 33, 0, x - 33)
    to = to + seq_n
    if has_rg.any():
        k = np.flatnonzero(has_rg)
        out[to[k, None] + np.arange(3)] = np.frombuffer(b"RGZ", np.uint8)
        out[spread(to[k] + 3, rg_n[k])] = rg[spread(rg_at[k], rg_n[k])]
        out[to[k] + 3 + rg_n[k]] = 0
    to = to + rg_size
    for name, there, value in tags:
        k = np.flatnonzero(there)
        if len(k):
            if value[k].min() < -(1 << 31) or value[k].max() >= 1 << 31:
                raise ValueError(f"a tag {name} does not fit a record")
            out[to[k, None] + np.arange(3)] = np.frombuffer(f"{name}i".encode(), np.uint8)
            out[to[k, None] + np.arange(3, 7)] = value[k].astype("<i4").view(np.uint8).reshape(-1, 4)
        to = to + 7 * there
    return Records(out.tobytes(), ends, tid, pos, stop)


def encoded(batches: Iterator[pa.RecordBatch], contigs: list[tuple[str, int]]) -> Iterator[Records]:
    """Records of rows with the columns of the alignment schema; contigs are numbered by name.

    seq, qual, rg, am and aq may be null or missing; a null cigar is ``*``. A
    contig that the header has not is an error, as is a record beyond the
    format's sizes.
    """
    number = {n: i for i, (n, _) in enumerate(contigs)} | {"*": -1, None: -1}
    ops = _Operations()
    needed = ["qname", "flag", "contig", "pos", "mapq", "cigar", "mcontig", "mpos", "isize"]
    for b in batches:
        if missing := [n for n in needed if n not in b.schema.names]:
            raise ValueError(f"columns {missing} are missing")
        some = max(1, min(ROWS, b.num_rows * COLUMN_BYTES // max(1, b.nbytes)))
        for i in range(0, b.num_rows, some):
            yield packed(b.slice(i, some), number, ops)


@dataclass
class Written(WriterCommitMessage):
    """A task's files (none without rows), below the job's folder."""

    names: list[str]


class BamWriter(DataSourceArrowWriter):
    """Options: ``contigs`` (JSON list of [name, length], the header's order), ``sorted`` (true: the rows of each task are in order of their coordinates, and each file gets an index), ``header`` (further header lines), ``level`` of compression.

    Tasks write into a folder of the job; the commit moves their files to the
    target, in the order of the tasks, and the folder goes. A task that fails
    removes what it wrote, an abort removes the folder.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.contigs = [(str(n), int(size)) for n, size in json.loads(options["contigs"])]
        self.in_order, self.text, self.level = options.get("sorted", "false") == "true", options.get("header", ""), int(options.get("level", 6))
        self.job = uuid.uuid4().hex
        self.folder = f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bam"
        files, at = store(f"{self.folder}/{name}")
        out, index, made = None, bam_index.Builder(len(self.contigs)), []
        try:
            for x in encoded(iterator, self.contigs):
                if out is None:
                    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    stream = files.open_output_stream(at, compression=None)
                    made.append(at)
                    out = BlockFile(stream, self.level)
                    out.write(header(self.contigs, self.in_order, self.text))
                    out.flush()
                begins, ends = out.write_records(x.data, x.ends)
                if self.in_order:
                    index.add_all(x.tid, x.pos, x.stop, begins, ends)
            if out is None:
                return Written([])
            out.close()
            stream.close()
            if self.in_order:
                made.append(at + ".bai")
                with files.open_output_stream(at + ".bai", compression=None) as f:
                    f.write(index.packed())
        except BaseException:
            for x in made:
                files.delete_file(x)
            raise
        return Written([name, name + ".bai"] if self.in_order else [name])

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, top = store(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith((".bam", ".bai"))] if self.overwrite else []
        files.create_dir(top, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        for n in names:
            files.move(f"{top}/_temporary-{self.job}/{n}", f"{top}/{self._final(n)}")
        if not names:  # a header alone, so that the output can be read
            with files.open_output_stream(f"{top}/part-000000-{self.job}.bam", compression=None) as f:
                out = BlockFile(f, self.level)
                out.write(header(self.contigs, self.in_order, self.text))
                out.close()
        for x in old:
            files.delete_file(x)
        self._clear(files, top)

    def _final(self, name: str) -> str:
        return f"{name[:11]}-{self.job}{name[name.index('.') :]}"

    def abort(self, messages: list) -> None:
        self._clear(*store(self.path))

    def _clear(self, files, top: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{top}/_temporary-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/_temporary-{self.job}")
