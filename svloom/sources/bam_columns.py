"""BAM records to Arrow columns: fields of many records at once, tested before anything else of them is read."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

# Fixed values of the format: four-bit base codes, cigar operations and which of them use the reference, sizes of tag types.
BASES, CIGAR, ON_REFERENCE = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", "MDN=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_KINDS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
FIXED = np.dtype([("size", "<i4"), ("tid", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("qlen", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("isize", "<i4")])
TESTED = ("tid", "pos", "mapq", "flag", "mtid", "mpos", "isize", "qlen")
OPS = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in "bam_file string, qname string, flag int, contig string, tid int, pos int, mapq int, cigar string, mcontig string, mtid int, mpos int, isize int, qlen int, seq string, qual binary, rg string, am int, mate int, aq int".split(", "))])
_SIZE = np.zeros(256, np.int64)
for _k, _n in TAG_BYTES.items():
    _SIZE[ord(_k)] = _n
_USES = np.array([x in ON_REFERENCE for x in CIGAR.ljust(16)])
_TWO = np.frombuffer("".join(x + y for x in BASES for y in BASES).encode(), "<u2")


@dataclass
class Tests:
    """What a record must pass: (field, operator, value) or (field, "in", values), flag bits all set and none set, a stretch of a contig that it overlaps.

    seen and decoded count the records that were tested and those that passed.
    """

    fields: list[tuple] = field(default_factory=list)
    flags_all: int = 0
    flags_none: int = 0
    region: tuple[int, int, int] | None = None
    seen: int = 0
    decoded: int = 0

    def passed(self, b: np.ndarray, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        ok = np.ones(len(at), bool)
        for name, op, value in self.fields:
            x = fixed[name].astype(np.int64)
            ok &= np.isin(x, np.array(value, np.int64)) if op == "in" else OPS[op](x, value)
        flag = fixed["flag"].astype(np.int64)
        ok &= ((flag & self.flags_all) == self.flags_all) & ((flag & self.flags_none) == 0)
        if self.region is not None:
            tid, begin, end = self.region
            ok &= (fixed["tid"] == tid) & (fixed["pos"] < end)
            k = np.flatnonzero(ok)
            ok[k] = fixed["pos"][k] + np.maximum(1, reference_lengths(b, at[k], fixed[k])) > begin
        self.seen += len(at)
        self.decoded += int(ok.sum())
        return ok


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 and (not n or int(starts.max()) < 1 << 31) else np.int64
    return np.arange(n, dtype=kind) - np.repeat((ends - lengths - starts).astype(kind), lengths)


def numbers(b: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(b[at[:, None] + np.arange(n)]).view(kind).ravel()


def reference_lengths(b: np.ndarray, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Bases of the reference that each record's operations use."""
    n = fixed["n_cigar"].astype(np.int64)
    ops = numbers(b, spread(at + 36 + fixed["l_name"], 4 * n)[::4], "<u4").astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(np.where(_USES[ops & 15], ops >> 4, 0))))
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


def text(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType, there: np.ndarray | None = None) -> pa.Array:
    """An Arrow array of texts that lie one after another in ``data``; there: which are not null."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    valid = None if there is None else pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(kind, len(lengths), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class _Cigars(dict):
    def __missing__(self, ops: bytes) -> str:
        t = self[ops] = "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in np.frombuffer(ops, "<u4").tolist()) or "*"
        return t


def tags(b: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Begin and length (-1: none) of each record's RG, and its AM and Aq; all records go from tag to tag side by side."""
    begin, length = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    values = {n: (np.zeros(len(at), np.int64), np.zeros(len(at), bool)) for n in ("AM", "Aq")}
    code = {n: ord(n[0]) << 8 | ord(n[1]) for n in ("RG", "AM", "Aq")}
    zeros = np.flatnonzero(b == 0)
    cur, live = at.copy(), np.flatnonzero(at + 3 <= end)
    while len(live):
        i = cur[live]
        name, kind = b[i].astype(np.int64) << 8 | b[i + 1], b[i + 2]
        size = _SIZE[kind]
        ends = i + 3 + size
        is_text, is_list = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        ends[is_text] = zeros[np.searchsorted(zeros, i[is_text] + 3)] + 1
        if is_list.any():
            j = i[is_list]
            ends[is_list] = j + 8 + numbers(b, j + 4, "<i4") * _SIZE[b[j + 3]]
        if ((size == 0) & ~is_text & ~is_list).any():
            raise ValueError("a tag of an unknown type")
        own = is_text & (name == code["RG"])
        begin[live[own]], length[live[own]] = i[own] + 3, ends[own] - 1 - (i[own] + 3)
        for n, (value, there) in values.items():
            own = np.flatnonzero(name == code[n])
            for k in np.unique(kind[own]).tolist():
                mine = own[kind[own] == k]
                if chr(k) in TAG_KINDS:
                    x = numbers(b, i[mine] + 3, TAG_KINDS[chr(k)]).astype(np.int64)
                else:
                    x = [int(b[p + 3 : e].tobytes().rstrip(b"\0")) for p, e in zip(i[mine].tolist(), ends[mine].tolist(), strict=True)]
                value[live[mine]], there[live[mine]] = x, True
        cur[live] = ends
        live = live[ends + 3 <= end[live]]
    return begin, length, {n: pa.array(v, pa.int32(), mask=~t) for n, (v, t) in values.items()}


def decoded(data: bytes, at: np.ndarray, name: str, contigs: list[str], with_seq: bool = True, tests: Tests | None = None) -> pa.RecordBatch:
    """Rows of SCHEMA from the records that begin at ``at``, as far as they pass the tests."""
    b = np.frombuffer(data + bytes(8), np.uint8)
    fixed = np.ascontiguousarray(b[at[:, None] + np.arange(36)]).view(FIXED).ravel()
    if tests is not None:
        ok = tests.passed(b, at, fixed)
        at, fixed = at[ok], fixed[ok]
    n = len(at)
    wide = {k: fixed[k].astype(np.int64) for k in ("l_name", "n_cigar", "qlen", "size")}
    names = at + 36
    ops = names + wide["l_name"]
    bases = ops + 4 * wide["n_cigar"]
    quals = bases + (wide["qlen"] + 1) // 2
    rg, rg_length, more = tags(b, quals + wide["qlen"], at + 4 + wide["size"])
    known, cigars = pa.array([*contigs, "*"], pa.string()), _Cigars()
    called = {k: known.take(pa.array(np.where(fixed[k] >= 0, fixed[k], len(contigs)))) for k in ("tid", "mtid")}
    out = {
        "bam_file": pa.array([name], pa.string()).take(pa.array(np.zeros(n, np.int8))),
        "qname": text(b[spread(names, wide["l_name"] - 1)], wide["l_name"] - 1, pa.string()),
        "contig": called["tid"], "mcontig": called["mtid"],
        "cigar": pa.array([cigars[data[i:j]] for i, j in zip(ops.tolist(), bases.tolist(), strict=True)], pa.string()),
        "rg": text(b[spread(rg, np.maximum(rg_length, 0))], np.maximum(rg_length, 0), pa.string(), rg_length >= 0),
        "am": more["AM"], "aq": more["Aq"],
        "mate": pa.array(np.where(fixed["flag"] & 128, 2, 1), pa.int32()),
    }
    if with_seq:
        have = wide["qlen"] > 0
        two = _TWO[b[spread(bases, quals - bases)]].view(np.uint8)
        odd = wide["qlen"] & 1 == 1
        if odd.any():  # half a byte more than there are bases
            two = np.delete(two, 2 * np.cumsum(quals - bases)[odd] - 1)
        out["seq"] = text(two, wide["qlen"], pa.string(), have)
        first = np.full(n, 255, np.uint8)
        first[have] = b[quals[have]]
        lengths = np.where(first != 255, wide["qlen"], 0)
        out["qual"] = text(b[spread(quals, lengths)] + np.uint8(33), lengths, pa.binary(), first != 255)
    else:
        out |= {"seq": pa.nulls(n, pa.string()), "qual": pa.nulls(n, pa.binary())}
    columns = [out[f.name] if f.name in out else pa.array(fixed[f.name].astype(np.int32), pa.int32()) for f in SCHEMA]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)
