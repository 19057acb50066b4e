"""Benchmark decontamination with suffix arrays of the training texts.

The benchmark is the stated query set: its words are broadcast behind a size check. Every
slice of documents is a shard with a suffix array of its own. Every suffix of every item is
binary-searched in every shard, which gives the longest verbatim matches and where they lie.
A shard's array holds the suffixes that can match at all: those that begin with as many
words of the benchmark as the shortest window has. No shuffle takes place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limitlens.llm import words as W

WINDOW = 10
#: Largest benchmark, in bytes of text. A larger one is an error, never cut.
MAX_BENCHMARK_BYTES = 256 << 20
# Matches enumerated at a time.
_BLOCK = 1 << 20


@dataclass
class TestSet:
    """Items as word numbers 1..n of the sorted vocabulary, laid end to end with 0 between."""

    ids: list[str]  # as text, one per distinct item that has words
    vocabulary: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    window: int

    @property
    def shortest(self) -> int:
        return int(np.minimum(self.lengths, self.window).min()) if len(self.lengths) else 1


def test_set(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> TestSet:
    """The benchmark's items. A null id reads as "null"; equal rows count once."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id")), F.lit(0)).alias("b")).first()["b"]
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {size} bytes; decontaminate in parts of at most {MAX_BENCHMARK_BYTES}")
    rows = items.orderBy("id", "text").toArrow()
    data, offsets = W.texts(rows["text"])
    data = W.LOWER[data]
    starts, ends, bounds = W.spans(data, offsets, W.PLAIN)
    hashes = W.span_hashes(data, starts, ends)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    tokens = np.zeros(len(numbers) + len(lengths) + 1, np.int32)
    tokens[np.arange(len(numbers)) + owner] = numbers + 1
    full = lengths > 0
    ids = [x for x, f in zip(rows["id"].to_pylist(), full) if f]
    return TestSet(ids, vocabulary, tokens, (bounds[:-1] + np.arange(len(lengths)))[full], lengths[full], window)


def _gather(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return tokens[np.minimum(at, len(tokens) - 1)]


def suffix_array(tokens: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """``positions`` ordered by the words that follow, up to ``depth`` words.

    Groups of equal beginnings are refined by the next words until each has one member or
    ``depth`` is reached.
    """
    bits = max(1, int(tokens.max(initial=0)).bit_length())
    lane = max(1, 62 // bits)

    def key(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(lane):
            out = (out << bits) | _gather(tokens, at + k)
        return out

    order = positions.copy()
    group = np.zeros(len(order), np.int64)
    open_, done = np.arange(len(order)), 0
    while len(open_) and done < depth:
        at = order[open_]
        now = key(at + done)
        by = np.lexsort((now, group[open_]))
        order[open_], now, was = at[by], now[by], group[open_][by]
        new = np.ones(len(by), bool)
        new[1:] = (now[1:] != now[:-1]) | (was[1:] != was[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(by)))
        group[open_] = np.repeat(open_[first], size)
        # A run that met the end of a text or an unknown word compares equal beyond it.
        open_ = open_[np.repeat(size > 1, size) & ((now & ((1 << bits) - 1)) != 0)]
        done += lane
    return order


def _bound(tokens, order, items, at, width, upper: bool) -> np.ndarray:
    """First place in ``order`` whose suffix is not below (or is above) each query of ``width`` words."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    want = items[at[:, None] + np.arange(width)]
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        seen = _gather(tokens, order[mid][:, None] + np.arange(width))
        unlike = seen != want[live]
        first = unlike.argmax(axis=1)
        rows = np.arange(len(live))
        less = seen[rows, first] < want[live][rows, first]
        right = less | (~unlike.any(axis=1) if upper else False)
        low[live] = np.where(right, mid + 1, low[live])
        high[live] = np.where(right, high[live], mid)


def _matches(tokens: np.ndarray, tests: TestSet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal matches of at least a window: (place in the shard, item, start in the item, words)."""
    if not len(tests.lengths):
        return
    unknown = np.flatnonzero(tokens == 0)
    run = unknown[np.searchsorted(unknown, np.arange(len(tokens)))] - np.arange(len(tokens))
    positions = np.flatnonzero(run >= tests.shortest)
    if not len(positions):
        return
    order = suffix_array(tokens, positions, int(tests.lengths.max()))
    widths = np.minimum(tests.lengths, tests.window)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        count = tests.lengths[chosen] - width + 1
        item = np.repeat(chosen, count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        for cut in range(0, len(item), 1 << 15):
            its, offs = item[cut : cut + (1 << 15)], start[cut : cut + (1 << 15)]
            at = tests.starts[its] + offs
            low = _bound(tokens, order, tests.tokens, at, int(width), False)
            high = _bound(tokens, order, tests.tokens, at, int(width), True)
            hits = high - low
            ends = np.cumsum(hits)
            done = 0
            while done < len(hits):
                # Blocks of queries with at most _BLOCK matches, or one query.
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _BLOCK, side="right")))
                n = hits[done:upto]
                q = np.repeat(np.arange(done, upto), n)
                place = order[np.repeat(low[done:upto], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
                done = upto
                before = np.where(place > 0, tokens[place - 1], 0)
                left = (offs[q] > 0) & (before == tests.tokens[at[q] - 1]) & (before > 0)
                q, place = q[~left], place[~left]
                length = np.full(len(q), width, np.int64)
                live = np.arange(len(q))
                while len(live):
                    nxt = _gather(tokens, place[live] + length[live])
                    more = (nxt > 0) & (nxt == tests.tokens[at[q[live]] + length[live]])
                    live = live[more]
                    length[live] += 1
                if len(q):
                    yield place, its[q], offs[q], length


def _shards(column, tests: TestSet):
    """(first row, row after the last, word bounds, tokens, matches) of each slice of documents."""
    for low, high, data, offsets in W.text_slices(column, 8 << 20):
        data = W.LOWER[data]
        starts, ends, bounds = W.spans(data, offsets, W.PLAIN)
        hashes = W.span_hashes(data, starts, ends)
        tokens = np.zeros(len(hashes) + high - low + 1, np.int32)
        if len(hashes) and len(tests.vocabulary):
            # Most words are not in the benchmark: a bit table first, then the exact lookup.
            table = np.zeros(1 << 20, bool)
            slot = lambda h: (h >> np.uint64(44)).astype(np.int64)
            table[slot(tests.vocabulary)] = True
            maybe = np.flatnonzero(table[slot(hashes)])
            at = np.minimum(np.searchsorted(tests.vocabulary, hashes[maybe]), len(tests.vocabulary) - 1)
            maybe, at = maybe[tests.vocabulary[at] == hashes[maybe]], at[tests.vocabulary[at] == hashes[maybe]]
            owner = np.searchsorted(bounds, maybe, side="right") - 1
            tokens[maybe + owner] = at + 1
        yield low, high, bounds, tokens


def _digest(bounds, tokens, tests: TestSet) -> tuple[np.ndarray, list[set]]:
    """Hit words and matching items of each document of a shard."""
    n = len(bounds) - 1
    base = bounds + np.arange(n + 1)
    change = np.zeros(len(tokens) + 1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for place, item, _, length in _matches(tokens, tests):
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
        owner = np.searchsorted(base, place, side="right") - 1
        found.append(np.unique(np.stack([owner, item], axis=1), axis=0))
    total = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    items: list[set] = [set() for _ in range(n)]
    for owner, item in np.concatenate(found):
        items[owner].add(tests.ids[item])
    return total[base[1:]] - total[base[:-1]], items


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A window is
    ``window`` consecutive words of an item; an item of fewer words, but some, is one window.
    n_hit counts the words inside any occurrence of any window, n_items the distinct item ids
    with one. A null or empty text has no words and no hits. An empty benchmark, and items
    without words, hit nothing. Repeated rows each return a row; further columns are ignored.
    """
    tests = docs.sparkSession.sparkContext.broadcast(test_set(benchmark, item_key, item_text, window))

    def run(batches):
        held = tests.value
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for low, high, bounds, tokens in _shards(column, held):
                hit, items = _digest(bounds, tokens, held)
                sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(np.diff(bounds)), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return W.map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), 
        run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every verbatim match of at least a window that can be extended to neither side.

    (doc_id, doc_word, item_id, item_word, n_words): where it begins in the document and in
    the item, in words from 0, and its length. Texts, nulls and words as for ``contamination``.
    """
    tests = docs.sparkSession.sparkContext.broadcast(test_set(benchmark, item_key, item_text, window))

    def run(batches):
        held = tests.value
        names = np.array(held.ids, object)
        for batch in batches:
            ids = batch.column(0)
            for low, _, bounds, tokens in _shards(batch.column(1), held):
                base = bounds + np.arange(len(bounds))
                for place, item, start, length in _matches(tokens, held):
                    owner = np.searchsorted(base, place, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(owner + low)), pa.array(place - base[owner]), pa.array(names[item], pa.string()), pa.array(start), pa.array(length)],
                        ["doc_id", "doc_word", "item_id", "item_word", "n_words"],
                    )

    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return W.map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), 
        run, f"doc_id {kind}, doc_word long, item_id string, item_word long, n_words long"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of the rows without any hit, in one pass and without a join."""
    tests = docs.sparkSession.sparkContext.broadcast(test_set(benchmark, item_key, item_text, window))
    at = docs.columns.index(text)

    def run(batches):
        held = tests.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for low, high, bounds, tokens in _shards(batch.column(at), held):
                clean[low:high] = _digest(bounds, tokens, held)[0] == 0
            yield batch.filter(pa.array(clean))

    return W.map_batches(docs, run, docs.schema)
