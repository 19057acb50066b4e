"""Words, lines and their hashes over whole Arrow text columns.

Python tasks get texts as Arrow columns. Everything here works on the UTF-8 bytes of a whole
column at once, so that no Python code runs per word. A text is never cut: columns are taken
apart between texts only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Rows of an Arrow batch at most: batches of whole texts, long ones too, stay small.
_BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Bytes of text worked on at a time; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
# Spans up to this many bytes are hashed in vectorised lanes, longer ones one by one.
_LANES = 64

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))

_every = np.arange(256)
_space = (_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D))
#: Bytes of a word [^\x20\x09-\x0D]+.
SPACED = ~_space
#: Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased.
PLAIN = (_every >= 0x80) | ((_every >= 0x30) & (_every <= 0x39)) | ((_every >= 0x61) & (_every <= 0x7A))
#: A-Z to a-z, all else as it is.
LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over small batches, so that a worker never holds many texts."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= _BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(_BATCH_ROWS))
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = x + _A
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets between them. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """``LOWER`` of bytes."""
    return data | ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most ``limit`` bytes together, or of one text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each slice of a column."""
    data, offsets = texts(column)
    for low, high in slices(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the n + 1 word numbers between texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    # Spaces are told without the table, which is slower.
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4) if kind is SPACED else kind[data]
    full = offsets[:-1] < offsets[1:]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first], closes[last] = inside[first], inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, never 0."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    low = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    live = np.flatnonzero(lengths <= _LANES)
    at, left, state = starts[live], lengths[live], out[live]
    while len(live):
        state = mix(state ^ (words[at] & low[np.minimum(left, 8)]))
        out[live] = state
        more = left > 8
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    held = memoryview(padded)
    for i in np.flatnonzero(lengths > _LANES):
        digest = hashlib.blake2b(held[starts[i] : ends[i]], digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return np.maximum(out, np.uint64(1))


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours, whatever texts they lie in."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out ^ (hashes[k : k + n] * _C))
    return np.maximum(out, np.uint64(1))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n + 1 bounds between texts.

    A text with fewer words than ``width``, but some, has its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    runs = chained(hashes, width)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(hashes))
    whole = first + width <= bounds[owner + 1]
    keys, rows = runs[first[whole]], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        alone = np.array([chained(hashes[bounds[i] : bounds[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        # The length enters, so that a short text equals no run of another length.
        keys = np.concatenate([keys, np.maximum(mix(alone ^ counts[short].astype(np.uint64)), np.uint64(1))])
        rows = np.concatenate([rows, short])
    order = np.argsort(keys)
    order = order[np.argsort(rows[order], kind="stable")]
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], np.searchsorted(rows[new], np.arange(len(counts) + 1))


def crc_mod(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``modulus``; -1 for a null."""
    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) % modulus for x in ids], np.int64)


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))
