"""Blocked gzip for tests."""

import struct
import zlib


def blocked(data: bytes, sizes) -> bytes:
    """Blocked gzip whose blocks hold ``sizes`` bytes in turn, and the empty block at the end."""
    out, i, k = [], 0, 0
    while True:
        x = data[i : i + sizes[k % len(sizes)]]
        i, k = i + len(x), k + 1
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(x) + z.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(x), len(x)))
        if not x:
            return b"".join(out)
