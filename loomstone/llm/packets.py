"""Packed arrays that travel through Spark's shuffle, and how many ways a shuffle of them fans out.

Data dealt by hash in one step, with parts of bounded size, need parts in proportion to the data, so the number of packets
(inputs times parts) grows with its square. Here a step fans out into ``2 ** STEP_BITS`` parts at most; where that is too
few, a further step deals each part again, over groups of at most as many inputs. So packets grow in proportion to the
data, times the number of steps, its logarithm.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: The most bits that one step deals by.
STEP_BITS = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, bytes of equal weight side by side."""
    press, out = zstandard.ZstdCompressor(level=1), [struct.pack("<B", len(arrays))]
    for x in arrays:
        data = press.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
        out.append(struct.pack("<2sQQ", x.dtype.str[1:].encode(), len(x), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out, open_ = 1, [], zstandard.ZstdDecompressor()
    for _ in range(data[0]):
        kind, count, size = struct.unpack_from("<2sQQ", data, at)
        at += 18
        dtype = np.dtype("<" + kind.decode())
        flat = np.frombuffer(open_.decompress(data[at : at + size], max_output_size=max(1, count * dtype.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, count).T).view(dtype).reshape(-1))
        at += size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def bits_for(n: int) -> int:
    """The least number of bits whose values number ``n`` or more."""
    return max(0, int(n) - 1).bit_length()


def steps(bits: int, most: int = STEP_BITS) -> list[int]:
    """``bits`` as a list of steps of at most ``most`` bits, as equal as they go."""
    count = max(1, -(-bits // most))
    return [bits // count + (i < bits % count) for i in range(count)]


def hash_bits(items: int) -> int:
    """As many hash bits (48 to 62) as let at most about one in a million of ``items`` distinct things share a hash."""
    return min(62, max(48, bits_for(items) + 20))
