"""The best texts for each of many queries, by the needles their fields hold, for Arrow columns at a time.

A needle is looked up by a hash of up to 32 of its bytes at every place of the fields, then compared; so
work grows with the texts and what they hold, not with texts times needles. A batch of texts brings its
best few for a query alone; all others would lose against these. Queries travel to the tasks in blocks,
each with all its needles, of like lengths, since a length is a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from limitlens.plans.sizing import broadcast_limit
from limitlens.plans.spots import SLICE_BYTES, padded_slices

# Bytes that needles are looked up by: the most that a needle has.
_KEYS = np.array([*range(1, 17), 20, 24, 28, 32])
# Bytes of a needle of a query in a task's memory, beside its text, and of a block, in broadcasts.
_ROW_BYTES, _BLOCK = 80, 2
# Lengths from here on are of one kind for the blocks.
_LONG = 64
# Texts that are gathered before their best are picked.
_GATHERED_ROWS, _GATHERED_BYTES = 1 << 14, 8 << 20
_SPREAD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _hashed(word, size: int) -> np.ndarray:
    """Hash of ``size`` bytes, one to one up to eight; ``word(j)`` are the j-th eight of them."""
    out = None
    for j in range(-(-size // 8)):
        left = size - 8 * j
        part = word(j) if left >= 8 else word(j) & np.uint64((1 << (8 * left)) - 1)
        out = (part if out is None else (out ^ (out >> _FOLD)) ^ part) * _SPREAD
    return out


def _groups(n: np.ndarray) -> np.ndarray:
    """Numbers of a run of ``n`` things each, end to end, from 0 on in each run."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _summed(key: np.ndarray, values: Sequence[np.ndarray], how=np.add) -> tuple[np.ndarray, ...]:
    """Distinct keys ascending, and their values combined."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new], *[how.reduceat(v[order], new) if len(new) else v[order] for v in values]


class Needles:
    """Queries and the needles that bring them points: a table of form, query, whole and times."""

    def __init__(self, rows: pa.Table):
        coded = rows["form"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int32)
        order = np.argsort(code, kind="stable")
        forms = coded.dictionary.cast(pa.large_string())
        self.count = len(forms)
        self.many = np.bincount(code, minlength=self.count).astype(np.int32)
        self.first = (np.cumsum(self.many) - self.many).astype(np.int32)
        self.numbers, query = np.unique(rows["query"].to_numpy(), return_inverse=True)
        self.query, self.whole, self.times = query.astype(np.int32)[order], rows["whole"].to_numpy()[order], rows["times"].to_numpy()[order]
        ends = np.frombuffer(forms.buffers()[1], np.int64, len(forms) + 1, forms.offset * 8)
        chars = np.frombuffer(forms.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        length = np.diff(ends)
        words = -(-length // 8)
        word_at = np.cumsum(words) - words
        held, mask = np.zeros(8 * int(words.sum()), np.uint8), np.zeros(8 * int(words.sum()), np.uint8)
        at = np.repeat(8 * word_at, length) + _groups(length)
        held[at], mask[at] = chars, 255
        self.held, self.mask = held.view("<u8"), mask.view("<u8")
        keyed = _KEYS[np.searchsorted(_KEYS, length, side="right") - 1]
        self.length, self.word_at = length.astype(np.int32), word_at.astype(np.int32)
        self.words = np.where((keyed == length) & (length <= 8), 0, words).astype(np.int32)
        self.keys = []
        for size in np.unique(keyed):
            own = np.flatnonzero(keyed == size)
            key = _hashed(lambda j: self.held[word_at[own] + j], int(size))
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            shift = np.uint64(64 - max(12, len(distinct).bit_length() + 4))
            flags = np.zeros(1 << (64 - int(shift)), bool)
            flags[distinct >> shift] = True
            self.keys.append((int(size), shift, flags, distinct, np.append(first, len(own)).astype(np.int32), own[order].astype(np.int32)))

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle): which texts hold which needles, each pair once."""
        out = [np.zeros(0, np.int64)]
        for first, data, at in padded_slices(column):
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
            # A longer text goes in windows.
            for low in range(int(at[0]), int(at[-1]), SLICE_BYTES):
                high = min(low + SLICE_BYTES, int(at[-1]))
                for start, needle in self._met(words, low, high):
                    row = owner[start - at[0]]
                    inside = start + self.length[needle] < at[row + 1]
                    out.append((row[inside] + first) * self.count + needle[inside])
        pairs = np.concatenate(out)
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        return pairs // max(1, self.count), pairs % max(1, self.count)

    def _met(self, words: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for size, shift, flags, distinct, bounds, own in self.keys:
            key = _hashed(lambda j: words[low + 8 * j : high + 8 * j], size)
            at = np.flatnonzero(flags[key >> shift])
            key = key[at]
            slot = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
            same = distinct[slot] == key
            at, slot = at[same] + low, slot[same]
            many = bounds[slot + 1] - bounds[slot]
            needle = own[np.repeat(bounds[slot], many) + _groups(many)]
            start = np.repeat(at, many)
            for i in range(int(self.words[needle].max(initial=0))):
                more = self.words[needle] > i
                n = self.word_at[needle] + np.where(more, i, 0)
                kept = ~more | ((words[start + np.where(more, 8 * i, 0)] & self.mask[n]) == self.held[n])
                start, needle = start[kept], needle[kept]
            yield start, needle

    def best(self, order: pa.Array, variants: pa.ListArray, weights: np.ndarray, term_weights: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, text, points): the ``k`` best texts of each query, by points and then ``order``.

        A text has the greatest points of its variants for a needle.
        """
        texts, held = len(variants), variants.flatten()
        n = len(held)
        fields = pa.concat_arrays([held.field(i).cast(pa.large_string()) for i in range(len(weights))])
        at, needle = self.found(fields)
        field, variant = at // max(1, n), at % max(1, n)
        key, whole, term = _summed(variant * self.count + needle, (weights[field], term_weights[field]))
        if n != texts:
            of = np.repeat(np.arange(texts), pc.list_value_length(variants).to_numpy())
            key, whole, term = _summed(of[key // self.count] * self.count + key % self.count, (whole, term), np.maximum)
        text, needle = key // max(1, self.count), key % max(1, self.count)
        many = self.many[needle]
        row = np.repeat(self.first[needle], many) + _groups(many)
        points = self.whole[row] * np.repeat(whole, many) + self.times[row] * np.repeat(term, many)
        some = points > 0
        place = pc.sort_indices(order).to_numpy()
        rank = np.empty(texts, np.int64)
        rank[place] = np.arange(texts)
        key, points = _summed(self.query[row[some]].astype(np.int64) * texts + rank[np.repeat(text, many)[some]], (points[some],))
        query, text = key // max(1, texts), key % max(1, texts)
        top = int(points.max(initial=0))
        bits, low = top.bit_length(), max(1, texts).bit_length()
        if bits + low + len(self.numbers).bit_length() < 63:
            packed = (query << (bits + low)) | ((top - points) << low) | text
            packed.sort()
            query, points, text = packed >> (bits + low), top - ((packed >> low) & ((1 << bits) - 1)), packed & ((1 << low) - 1)
        else:
            sorted_ = np.lexsort((text, -points, query))
            query, points, text = query[sorted_], points[sorted_], text[sorted_]
        new = np.append(True, query[1:] != query[:-1]) if len(query) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        chosen = _groups(np.diff(np.append(first, len(query)))) < k
        return self.numbers[query[chosen]], place[text[chosen]], points[chosen]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _GATHERED_ROWS or sum(b.nbytes for b in held) >= _GATHERED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(asked: DataFrame) -> Iterator[DataFrame]:
    """Parts of ``asked`` that fit a task's memory, each query in one of them, queries of like lengths together."""
    size = F.coalesce(F.sum(F.octet_length("form") + _ROW_BYTES), F.lit(0)).alias("bytes")
    held = asked.groupBy(F.least("length", F.lit(_LONG)).alias("length")).agg(size).orderBy("length").collect()  # a row per length
    limit = _BLOCK * broadcast_limit(asked)
    groups: list[tuple[list[int], int]] = []
    for row in held:
        if groups and groups[-1][1] + row["bytes"] <= limit:
            groups[-1] = ([*groups[-1][0], row["length"]], groups[-1][1] + row["bytes"])
        else:
            groups.append(([row["length"]], row["bytes"]))
    for lengths, total in groups:
        part, parts = asked.filter(F.least("length", F.lit(_LONG)).isin(lengths)), max(1, -(-total // limit))
        for b in range(parts):
            yield part if parts == 1 else part.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == b)


def best_texts(texts: DataFrame, weights: Sequence[int], term_weights: Sequence[int], asked: DataFrame, k: int, points: str = "score") -> DataFrame:
    """(query, key columns, points): texts that may be among the ``k`` best of a query, these among them.

    ``texts`` has a row per key and, last, an array of structs of folded fields; by the first column of
    the key equals are told apart. ``asked`` is stored: (query, length, form, whole, times), a row per query and
    folded needle with how often it counts as the whole query and as a term; ``length`` is the query's own.
    """
    names, variants = texts.columns[:-1], texts.columns[-1]
    own, own_terms = np.array(weights, np.int64), np.array(term_weights, np.int64)
    schema = StructType([asked.schema["query"], *texts.drop(variants).schema.fields]).add(points, "integer")

    def scored(part: DataFrame) -> DataFrame:
        rows = part.select("form", "query", F.col("whole").cast("int").alias("whole"), F.col("times").cast("int").alias("times")).toArrow()
        held = texts.sparkSession.sparkContext.broadcast(Needles(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _gathered(batches):
                columns = [table.column(i).combine_chunks() for i in range(table.num_columns)]
                query, at, score = held.value.best(columns[0], columns[-1], own, own_terms, k)
                if len(query):
                    kept = [c.take(pa.array(at)) for c in columns[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(query), *kept, pa.array(score.astype(np.int32))], names=["query", *names, points])

        return texts.mapInArrow(run, schema)

    found = [scored(part) for part in _blocks(asked)]
    return reduce(DataFrame.unionAll, found) if found else texts.sparkSession.createDataFrame([], schema)
