"""Content-defined chunking: cut points depend on a rolling hash of the bytes, so an insertion moves few of them.

A gear hash of the last 64 bytes is computed for all positions of a window of a text at once; a chunk ends at the first position,
after the minimal size, where the hash has enough zero bits (more up to the normal size, fewer beyond), at the maximal
size at last. The table of byte values comes from a generator with a fixed seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minimal, normal and maximal bytes of a chunk.
SIZES = (512 * 1024, 1024 * 1024, 8 * 1024 * 1024)

#: Bytes that are hashed at once; temporaries are 16 times as large.
WINDOW = 1 << 20

_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear" + bytes([i])).digest()[:8] for i in range(256)), "<u8")


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 64 table values, each doubled once per later byte."""
    value = _GEAR[np.frombuffer(data, np.uint8)].copy()
    step = 1
    while step < 64:  # each round doubles the bytes that a hash covers
        value[step:] = value[step:] + (value[:-step] << np.uint64(step))
        step *= 2
    return value


def _zero_ends(data: bytes, bits: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each number of bits the ends at which a hash has so many zeros; windows overlap by the bytes that a hash covers."""
    out: list[list[np.ndarray]] = [[] for _ in bits]
    for start in range(0, len(data), WINDOW):
        before = min(start, 63)
        value = gear_hashes(data[start - before : start + WINDOW])[before:]
        for found, b in zip(out, bits, strict=True):
            found.append(np.flatnonzero(value >> np.uint64(64 - b) == 0) + start + 1)
    return out


def cut_points(data: bytes, minimal: int, normal: int, maximal: int) -> list[int]:
    """Ends of the chunks of data."""
    bits = int(normal).bit_length() - 1
    strict, loose = (np.concatenate(x) if x else np.empty(0, np.int64) for x in _zero_ends(data, (bits + 1, max(bits - 1, 1))))
    ends, start = [], 0
    while len(data) - start > minimal:
        limit, middle = min(start + maximal, len(data)), min(start + normal, len(data))
        i = np.searchsorted(strict, start + minimal)
        if i < len(strict) and strict[i] < middle:
            end = int(strict[i])
        else:
            j = np.searchsorted(loose, max(middle, start + minimal))
            end = int(loose[j]) if j < len(loose) and loose[j] < limit else limit
        ends.append(end)
        start = end
    return [*ends, len(data)] if start < len(data) else ends


_CHUNKS = "id string, pos int, chunk_ref string, size long, data binary"


def chunks(files: DataFrame, id_column: str, data: str, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """id, pos, chunk_ref (SHA-256), size, data of the chunks of every file; an empty or null file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, start, rows = body or b"", 0, []
                for pos, end in enumerate(cut_points(body, *sizes)):
                    part = body[start:end]
                    rows.append((name, pos, hashlib.sha256(part).hexdigest(), len(part), part))
                    start = end
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "pos", "chunk_ref", "size", "data"])

    return files.select(F.col(id_column).cast("string").alias("id"), F.col(data).cast("binary").alias("data")).mapInArrow(run, _CHUNKS)
