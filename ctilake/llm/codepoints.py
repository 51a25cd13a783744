"""Arrow text as numpy arrays of code points, and back, without a call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of ``array`` of about ``limit`` bytes of text each; a longer text comes alone and whole.

    The arrays derived from a slice take some thirty bytes per code point, so this bounds a
    worker's memory however many rows the batch has.
    """
    array = array.cast(pa.large_binary())
    if not len(array):
        return
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield array.slice(at, to - at)
        at = to


def utf8(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 of all rows in one piece, and the byte offset of every row and of the end."""
    array = array.cast(pa.large_binary())
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    blob = data.to_pybytes()[off[0] : off[-1]] if data is not None and len(off) else b""
    off = off - off[0]
    try:
        blob.decode("utf-8")
    except UnicodeDecodeError:  # broken bytes become replacement marks, row by row
        rows = [blob[a:b].decode("utf-8", "replace").encode() for a, b in zip(off, off[1:])]
        blob, off = b"".join(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return blob, off


def decode(blob: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``blob``, the byte offset of each and of the end, and the code point offset of every row and of the end."""
    raw = np.frombuffer(blob, np.uint8)
    lead = (raw & 0xC0) != 0x80
    cps = np.frombuffer(blob.decode("utf-8", "strict").encode("utf-32-le"), np.uint32)
    at = np.append(np.flatnonzero(lead), len(blob))
    return cps, at, np.concatenate(([0], np.cumsum(lead)))[off]


def encode(cps: np.ndarray, starts: np.ndarray, null: np.ndarray) -> pa.Array:
    """A string array of code points cut at ``starts``; rows where ``null`` holds are null."""
    widths = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    off = np.concatenate(([0], np.cumsum(widths)))[starts]
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data), valid).cast(pa.string())
