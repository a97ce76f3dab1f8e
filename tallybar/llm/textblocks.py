"""Vectorised text kernels: Arrow columns as byte arrays, tokens with 64-bit hashes, rolling hashes, window minima."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; a single longer text is a step of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
#: Odd multipliers, fixed so that every task hashes alike.
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_INVERSE = pow(_BASE, -1, 1 << 64)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[str, np.ndarray] = {}


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what a batch needed goes back to the system before the next one is read."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(_MIX1)
    x = (x ^ (x >> _U(27))) * _U(_MIX2)
    return x ^ (x >> _U(31))


#: A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, wrapping at 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * base**t for i <= t < j."""
    up, _ = _power_table(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that depends on nothing else."""
    _, down = _power_table(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(prefix: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    """The hash of each k consecutive values; ``prefix`` may be a slice that begins at place ``first``."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    _, down = _power_table(first + len(prefix))
    return mix((prefix[k:] - prefix[:-k]) * down[first : first + n] + _U(k))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_array(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: a column of its own, or a field of the struct column ``row``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def text_column(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return byte_column(text_array(batch))


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` rows that hold at most ``limit`` bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + (most or n), n)
        yield lo, hi
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; runs end at the end of a row.

    is_word: 256 booleans.
    """
    n = len(data)
    word = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    before &= ~edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each token's bytes."""
    return span_hash(prefix_hash(values[data]), starts, ends)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    if len(values) < w:
        return values[:0]
    out, size = values, 1
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def word_table(text: str) -> np.ndarray:
    """256 booleans: word bytes of one of the two word definitions in use ("ascii" or "space")."""
    table = np.ones(256, dtype=bool)
    if text == "space":  # [^\x20\x09-\x0D]
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif text == "ascii":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased
        table[:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
        table[0x41:0x5B] = True
    else:
        raise ValueError(text)
    return table


#: Each byte, A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
