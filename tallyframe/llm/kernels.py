"""Words of many texts at once, by Arrow kernels, and CRC-32 over joined byte strings.

A CRC is linear: the checksum of ``a + b`` is that of ``a`` moved past ``len(b)`` zero
bytes, exclusive-or that of ``b``. So checksums of joined words come from those of the
words by table look-ups on whole columns, and no joined text is ever built.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TEXT_BYTES = 4 << 20  # texts are gathered to about so many bytes before the kernels run


class Words(NamedTuple):
    """The words of some texts: ``distinct`` ones, and ``index``, ``row`` of every word in order."""

    distinct: pa.Array
    index: np.ndarray
    row: np.ndarray


def gathered(batches: Iterator[pa.RecordBatch], names: list[str], limit: int = TEXT_BYTES) -> Iterator[list[pa.Array]]:
    """The named columns, batches put together or cut until a piece holds about ``limit`` bytes of text (the last name).

    Cuts fall between rows, so a single row may be larger.
    """
    held, size = [], 0
    for batch in batches:
        batch = batch.select(names)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[names[-1]]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if size >= limit or start < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.Table.from_batches(held).columns]


def split(texts: pa.Array, gaps: str) -> Words:
    """Lower-cased (A-Z only) words between matches of the pattern ``gaps``; of a null text none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), gaps)
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)  # texts may begin or end in a gap
    coded = words.filter(real).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), row.filter(real).to_numpy().astype(np.int64))


HASHED_BYTES = 64
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which hangs on all bits of the given ones (the last step of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``starts`` of ``data``, which has eight bytes more after the last one.

    Words are taken up eight bytes at a time, all words side by side; long ones by XXH64.
    """
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mixed((eight[starts] & _KEPT[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for at in range(8, HASHED_BYTES, 8):
        more = np.flatnonzero(sizes > at)
        if not len(more):
            return out
        out[more] = mixed(out[more] ^ (eight[starts[more] + at] & _KEPT[np.minimum(sizes[more] - at, 8)]))
    for at in np.flatnonzero(sizes > HASHED_BYTES):
        out[at] = xxhash.xxh64_intdigest(data[starts[at]:starts[at] + sizes[at]].tobytes())
    return out


def checksums(words: pa.Array, before: bytes = b"") -> np.ndarray:
    """CRC-32 of each word with some bytes put before it."""
    start = zlib.crc32(before)
    return np.fromiter((zlib.crc32(w, start) for w in words.cast(pa.binary()).to_pylist()), np.uint32, len(words))


def appended(sums: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of two byte strings joined, from the first's, the second's and the second's length."""
    kinds, which = np.unique(lengths, return_inverse=True)
    if not len(kinds):
        return np.zeros(0, np.uint32)
    # one row of 1,024 entries a length: 256 for each byte of a checksum
    table, at = np.stack([_past(int(n)) for n in kinds]).reshape(-1), which.reshape(-1).astype(np.int64) * 1024
    out = more.astype(np.uint32)
    for byte in range(4):
        out = out ^ table.take(at + 256 * byte + ((sums >> np.uint32(8 * byte)) & np.uint32(255)))
    return out


_PAST: dict[int, np.ndarray] = {}


def _past(zeros: int) -> np.ndarray:
    """What every value of each of a checksum's four bytes becomes past so many zero bytes."""
    if zeros not in _PAST:
        if len(_PAST) > 1024:  # a table is 4 KB
            _PAST.clear()
        if zeros == 0:
            table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
        else:
            half = _past(zeros // 2)
            table = _apply(half, half)
            table = _one(table) if zeros % 2 else table
        _PAST[zeros] = table
    return _PAST[zeros]


def _one(values: np.ndarray) -> np.ndarray:
    for _ in range(8):  # the reflected polynomial of CRC-32, bit by bit
        values = (values >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (values & np.uint32(1)))
    return values


def _apply(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for byte in range(4):
        out ^= table[byte][(values >> np.uint32(8 * byte)) & np.uint32(255)]
    return out
