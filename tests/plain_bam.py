"""A plain decoder of BAM records, one by one, that the tests hold the columnar one against."""

import struct
from collections.abc import Iterator

from svloom.sources.alignments import inflated

# Four-bit base codes and cigar operations of the format.
BASES, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def _tags(b: bytes) -> dict[str, object]:
    size = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    code = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out, i = {}, 0
    while i + 3 <= len(b):
        name, kind = b[i : i + 2].decode(), chr(b[i + 2])
        i += 3
        if kind in "ZH":
            end = b.index(0, i)
            out[name], i = b[i:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(b[i]), struct.unpack_from("<i", b, i + 1)[0]
            i += 5 + n * size[sub]
        else:
            out[name], i = struct.unpack_from("<" + code[kind], b, i)[0], i + size[kind]
    return out


def row(d: bytes, i: int, end: int, name: str, contigs: list[str], with_seq: bool) -> tuple:
    """A row of SCHEMA from the record at ``i``."""
    _, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mref, mpos, isize = struct.unpack_from("<iiiBBHHHiiii", d, i)
    contig = lambda t: contigs[t] if t >= 0 else "*"
    j = i + 36
    qname = d[j : j + l_name - 1].decode()
    j += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", d, j)
    j += 4 * n_cigar
    packed, qual = d[j : j + (l_seq + 1) // 2], d[j + (l_seq + 1) // 2 : j + (l_seq + 1) // 2 + l_seq]
    t = _tags(d[j + (l_seq + 1) // 2 + l_seq : end])
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] if with_seq and l_seq else None
    text = bytes(q + 33 for q in qual) if with_seq and l_seq and qual[0] != 255 else None
    am, aq = t.get("AM"), t.get("Aq")
    return (name, qname, flag, contig(ref), ref, pos, mapq, "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in ops) or "*", contig(mref), mref, mpos, isize, l_seq, seq, text, t.get("RG"), int(am) if am is not None else None, 2 if flag & 128 else 1, int(aq) if aq is not None else None)


def decode_bam(data: bytes, name: str, tid: int | None = None, with_seq: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA from the bytes of one BAM file; others than contig ``tid`` are skipped before they are decoded."""
    d = inflated(data)
    if d[:4] != b"BAM\1":
        raise ValueError(f"{name} is not a BAM file")
    i = 8 + struct.unpack_from("<i", d, 4)[0]
    n = struct.unpack_from("<i", d, i)[0]
    i += 4
    contigs = []
    for _ in range(n):
        k = struct.unpack_from("<i", d, i)[0]
        contigs.append(d[i + 4 : i + 3 + k].decode())
        i += 8 + k
    while i < len(d):
        end = i + 4 + struct.unpack_from("<i", d, i)[0]
        if tid is None or struct.unpack_from("<i", d, i + 4)[0] == tid:
            yield row(d, i, end, name, contigs, with_seq)
        i = end
