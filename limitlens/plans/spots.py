"""First matches of many plain patterns in texts, for whole Arrow columns at a time.

Each alternative is looked up by up to eight bytes of its longest run of characters: the bytes at
every place of the texts are one integer, and a table of flags tells where such an integer is some
pattern's. The rest of the alternative is compared there. Work grows with the texts and with the places
that begin like a pattern, not with texts times patterns. Python code runs per slice, not per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.functions.plain import LONGEST, MOST, STEP
from limitlens.plans.local import local_table

# Bytes of text worked on at a time, in whole texts; a longer text goes in windows.
SLICE_BYTES = 1 << 20
# Rows of an Arrow batch at most.
_BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Letters besides their own cases that a regex ignoring case takes for S, K and I.
_TWINS = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})
_TWIN = "[ſKİı]"
# NUL parts the texts: no plain pattern holds it.
_PART = "\0"
_PAD = LONGEST + 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ALTERNATIVE_BITS, _START_BITS = (MOST - 1).bit_length(), 31

_every = np.arange(256)
_LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)


def word_characters(spark: SparkSession) -> np.ndarray:
    """For each code point, whether the regex engine counts it to a word."""
    step = 4096
    rows = [("".join(chr(c) for c in range(low, low + step) if not 0xD800 <= c <= 0xDFFF),) for low in range(0, 0x110000, step)]
    kept = local_table(spark, rows, "chars string").select(F.regexp_replace("chars", r"(?U)\W+", "").alias("chars")).collect()  # 272 rows
    out = np.zeros(0x110000, bool)
    for row in kept:
        out[np.frombuffer(row["chars"].encode("utf-32-le"), "<u4")] = True
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists end to end, and how many each list has."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy().astype(np.int64)


def padded_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts, each ended by NUL, between two paddings of NULs."""
    kind = pa.large_string()
    parted = pc.binary_join_element_wise(column.cast(kind), pa.scalar("", kind), pa.scalar(_PART, kind))
    offsets = np.frombuffer(parted.buffers()[1], np.int64, len(parted) + 1, parted.offset * 8) if len(parted) else np.zeros(1, np.int64)
    bytes_of = np.frombuffer(parted.buffers()[2], np.uint8) if parted.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(parted):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
        at = offsets[low : high + 1] - offsets[low] + _PAD
        data = np.zeros(int(at[-1]) + _PAD, np.uint8)
        data[_PAD : at[-1]] = bytes_of[offsets[low] : offsets[high]]
        yield low, data, at
        low = high


class Spotter:
    """Patterns ready to be looked for: a table of ``number`` and ``functions.plain.ENCODED``."""

    def __init__(self, rules: pa.Table, word: np.ndarray):
        self.word, self.number = word, rules["number"].to_numpy()
        self.length, many = _lists(rules["sizes"])
        self.first = np.append(0, np.cumsum(many))
        self.rule = np.repeat(np.arange(len(many)), many)
        self.alternative = np.arange(len(self.rule)) - self.first[self.rule]
        # Characters in words of eight bytes, which begin anew with each alternative.
        chars = np.frombuffer("".join(rules["held"].to_pylist()).encode(), np.uint8)
        words = -(-self.length // 8)
        self.word_at = np.cumsum(words) - words
        held = np.zeros(8 * int(words.sum()), np.uint8)
        held[np.arange(len(chars)) + np.repeat(8 * self.word_at - (np.cumsum(self.length) - self.length), self.length)] = chars
        self.held, self.mask = held.view("<u8"), np.where(held > 0, 255, 0).astype(np.uint8).view("<u8")
        self.anchor, keyed = _lists(rules["anchors"])[0], _lists(rules["keys"])[0]
        # Words to compare: none where the key says it all.
        self.words = np.where((self.anchor == 0) & (keyed == self.length), 0, words)
        low, high = _lists(rules["low"])[0], _lists(rules["high"])[0]
        classes, number = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        self.classes = np.zeros((len(classes), 256), bool)
        for half in (0, 1):
            self.classes[:, 64 * half : 64 * half + 64] = (classes[:, half, None].view("<u8") >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        self.sets, self.set_at, self.set_n = self._places(*_lists(rules["sets"]))
        self.set_class = number.reshape(-1)
        self.bounds, self.bound_at, self.bound_n = self._places(*_lists(rules["bounds"]))
        self.keys = [(int(k), *self._table(np.flatnonzero(keyed == k), int(k), held)) for k in np.unique(keyed)]

    def _places(self, values: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places within their alternatives, and of each alternative the first one and how many."""
        of = np.repeat(self.first[:-1], many) + values // STEP
        n = np.bincount(of, minlength=len(self.rule))
        return values % STEP, np.cumsum(n) - n, n

    def _table(self, own: np.ndarray, size: int, held: np.ndarray) -> tuple:
        """Flags by hash, distinct keys ascending, bounds of each key's alternatives, and these."""
        key = np.zeros((len(own), 8), np.uint8)
        key[:, :size] = held[(8 * self.word_at + self.anchor)[own][:, None] + np.arange(size)]
        key = key.view("<u8")[:, 0]
        order = np.argsort(key, kind="stable")
        distinct, first = np.unique(key[order], return_index=True)
        shift = np.uint64(64 - max(12, len(distinct).bit_length() + 4))
        flags = np.zeros(1 << (64 - int(shift)), bool)
        flags[(distinct * _SPREAD) >> shift] = True
        return shift, flags, distinct, np.append(first, len(order)), own[order]

    def _spots(self, folded: np.ndarray, inside: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, alternative) of all matches whose key lies from ``low`` to ``high``."""
        words = np.ndarray((len(folded) - 7,), "<u8", folded, strides=(1,))
        starts, numbers = [], []
        for size, shift, flags, distinct, bounds, own in self.keys:
            key = words[low:high] & np.uint64((1 << (8 * size)) - 1)
            at = np.flatnonzero(flags[(key * _SPREAD) >> shift])
            key = key[at]
            slot = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
            same = distinct[slot] == key
            at, slot = at[same] + low, slot[same]
            many = bounds[slot + 1] - bounds[slot]
            ends = np.cumsum(many)
            number = own[np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[slot] - ends + many, many)]
            start = np.repeat(at, many) - self.anchor[number]
            for i in range(int(self.words.max())):
                some = np.flatnonzero(self.words[number] > i)
                if not len(some):
                    break
                n = self.word_at[number[some]] + i
                start, number = self._without(some[(words[start[some] + 8 * i] & self.mask[n]) != self.held[n]], start, number)
            for i in range(int(self.set_n.max())):
                some = np.flatnonzero(self.set_n[number] > i)
                n = self.set_at[number[some]] + i
                start, number = self._without(some[~self.classes[self.set_class[n], folded[start[some] + self.sets[n]]]], start, number)
            for i in range(int(self.bound_n.max())):
                some = np.flatnonzero(self.bound_n[number] > i)
                place = start[some] + self.bounds[self.bound_at[number[some]] + i]
                start, number = self._without(some[inside[place - 1] == inside[place]], start, number)
            starts.append(start)
            numbers.append(number)
        return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(numbers or [np.zeros(0, np.int64)])

    @staticmethod
    def _without(wrong: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(wrong):
            return arrays
        kept = np.ones(len(arrays[0]), bool)
        kept[wrong] = False
        return tuple(a[kept] for a in arrays)

    def _inside(self, data: np.ndarray) -> np.ndarray:
        """For each byte, whether its character counts to a word."""
        ascii_word = np.zeros(256, bool)
        ascii_word[:128] = self.word[:128]
        out = ascii_word[data]
        leads = np.flatnonzero(data >= 0xC0)
        if len(leads):
            tail = lambda i: data[leads + i].astype(np.int64) & 0x3F
            lead, one, two = data[leads].astype(np.int64), tail(1), tail(2)
            size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
            point = np.select([size == 2, size == 3], [(lead & 0x1F) << 6 | one, (lead & 0x0F) << 12 | one << 6 | two], (lead & 0x07) << 18 | one << 12 | two << 6 | tail(3))
            word = self.word[np.minimum(point, 0x10FFFF)]
            for i in range(4):
                more = size > i
                out[leads[more] + i] = word[more]
        return out

    def first_matches(self, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, rule, position, matched) arrays: the first match of each rule in each text."""
        for low, data, at in padded_slices(column):
            for row, *found in self._firsts(data, at):
                yield row + low, *found

    def _firsts(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        folded, inside = _LOWER[data], self._inside(data)
        units = None
        if (data >= 0x80).any():
            # Places are counted in UTF-16 units: a unit per character, two from U+10000 on.
            units = np.zeros(len(data) + 1, np.int64)
            np.cumsum(((data & 0xC0) != 0x80).astype(np.int8) + (data >= 0xF0), out=units[1:])
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at)) if len(at) > 2 else None
        seen = np.zeros(len(self.number), bool)
        for low in range(int(at[0]), int(at[-1]), SLICE_BYTES):
            start, number = self._spots(folded, inside, low, min(low + SLICE_BYTES, int(at[-1])))
            packed = (self.rule[number] << (_START_BITS + _ALTERNATIVE_BITS)) | (start << _ALTERNATIVE_BITS) | self.alternative[number]
            packed.sort()
            rule = packed >> (_START_BITS + _ALTERNATIVE_BITS)
            start = (packed >> _ALTERNATIVE_BITS) & ((1 << _START_BITS) - 1)
            row = owner[start - at[0]] if owner is not None else np.zeros(len(start), np.int64)
            new = np.ones(len(rule), bool)
            new[1:] = (rule[1:] != rule[:-1]) | (row[1:] != row[:-1])
            if owner is None:
                new &= ~seen[rule]
                seen[rule] = True
            rule, start, row = rule[new], start[new], row[new]
            size = self.length[self.first[rule] + (packed[new] & ((1 << _ALTERNATIVE_BITS) - 1))]
            ends = np.cumsum(size)
            taken = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
            text = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])
            place = start - at[row] if units is None else units[start] - units[at[row]]
            yield row, self.number[rule], place.astype(np.int32), text


def _found(spotter: Spotter, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    body = batch.column(batch.num_columns - 1)
    twins = pc.match_substring_regex(body, _TWIN)
    if not pc.any(twins).as_py():
        yield from spotter.first_matches(body)
        return
    flags = twins.to_numpy(zero_copy_only=False)
    for rows in (np.flatnonzero(~flags), np.flatnonzero(flags)):
        texts = body.take(pa.array(rows))
        if len(rows) and flags[rows[0]]:
            # Each of these letters is one UTF-16 unit, as the one that stands in for it.
            texts, was = pa.array([t.translate(_TWINS) for t in texts.to_pylist()], pa.string()), [t.encode("utf-16-le") for t in texts.to_pylist()]
            for row, rule, place, matched in spotter.first_matches(texts):
                spans = zip(row, place, pc.binary_length(matched).to_numpy())
                yield rows[row], rule, place, pa.array([was[r][2 * p : 2 * (p + n)].decode("utf-16-le") for r, p, n in spans], pa.string())
        else:
            for row, *found in spotter.first_matches(texts):
                yield rows[row], *found


def first_matches(texts: DataFrame, text: str, rules: DataFrame, rule: str, matched: str, position: str) -> DataFrame:
    """All columns of ``texts`` but the text with the rule's number, its first match in the text and the match's place, for each that matches.

    ``rules`` (number and the columns of ``functions.plain.ENCODED``) fit a broadcast.
    Positions are those of ``regexp_instr``, less one. A text that is null has none.
    """
    spark, names = texts.sparkSession, [c for c in texts.columns if c != text]
    held = spark.sparkContext.broadcast(Spotter(rules.toArrow(), word_characters(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, place, found in _found(held.value, batch):
                if len(row):
                    kept = [batch.column(i).take(pa.array(row)) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(number), found, pa.array(place)], names=[*names, rule, matched, position])

    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= _BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(_BATCH_ROWS))
    schema = texts.drop(text).schema
    for name, kind in ((rule, "long"), (matched, "string"), (position, "integer")):
        schema = schema.add(name, kind)
    # Texts are dealt out once: a file may hold all in one piece.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bodies = texts.select(*names, F.make_valid_utf8(text).alias(text)).filter(F.col(text).isNotNull())
    return bodies.repartition(parts).mapInArrow(run, schema)
