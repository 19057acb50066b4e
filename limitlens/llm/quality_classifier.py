"""Quality classifier: random-indexing word vectors and a small neural network.

Every token has a sparse random index vector, made from hashes of the token and of its shape.
A word's vector is the sum of the index vectors around all its occurrences in the corpus. The
frequent words' vectors are summed over all texts and broadcast; any other word takes its
vector from its occurrences in the text at hand, which is all it has where a word lies in one
text alone. Word vectors are pooled per document, and a network of two layers, trained in
numpy on a bounded sample of labelled rows, gives probabilities calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

#: Entries of a vector, entries that one hash sets, tokens on each side that count as context.
WIDTH, MARKS, WINDOW = 32, 4, 2
#: Words whose vectors are summed over the corpus and broadcast: 4 bytes an entry.
HEAD_WORDS = 1 << 15
#: Labelled rows that the network is fitted on, about: beyond, those whose id hashes below their share.
FIT_ROWS = 40_000
#: Network: hidden units, passes, rows of a step, rate, decay of the weights; share kept for the temperature.
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY, CALIBRATE = 24, 60, 128, 0.01, 1e-4, 0.2
#: Score from which on a document is predicted 1.
THRESHOLD = 0.3

_BLOCK = 256  # words whose sums travel together
_HELD_WORDS = 1 << 20
# Bytes of text worked on together: what is made of them stays in cache.
_NEAR_BYTES = 1 << 17
_FEATURES = 2 * WIDTH + 3

_every = np.arange(256)
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, np.int8)
_CLASS[~W.SPACED] = _SPACE
_CLASS[(_every >= 0x30) & (_every <= 0x39)] = _DIGIT
_CLASS[(_every >= 0x80) | ((_every | 32) >= 97) & ((_every | 32) <= 122)] = _LETTER
_UPPER = (_every >= 65) & (_every <= 90)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, runs of letters, digits or marks, and token numbers between texts."""
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    keep = kind[starts] != _SPACE
    starts = starts[keep]
    return starts, ends[keep], np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token; a run of one and the same mark is a token whatever its length."""
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    return W.span_hashes(data, starts, np.where(_CLASS[first] == _MARK, starts + 1, ends))


def _index_table(hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Index vectors, a column for each pair: marks of the token and of its shape."""
    table = np.zeros((WIDTH, len(hashes)), np.int16)
    column = np.arange(len(hashes))
    for source in (hashes, shapes):
        state = W.mix(source)
        for _ in range(MARKS):
            sign = np.where(state >> np.uint64(40) & np.uint64(1), 1, -1)
            # A mark for each column, so none of these places is named twice.
            table[(state % np.uint64(WIDTH)).astype(int), column] += sign.astype(np.int16)
            state = W.mix(state)
    return table


def _kinds(hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair of hash and shape, and each token's pair."""
    _, first, kind = np.unique(hashes ^ W.mix(shapes), return_index=True, return_inverse=True)
    return first, kind


def _index_vectors(hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Index vector of each token, one row per entry."""
    first, kind = _kinds(hashes, shapes)
    return _index_table(hashes[first], shapes[first]).take(kind, axis=1)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of the first byte, capitals at the beginning and end, and length on a rough scale."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind, first, last = _CLASS[data[starts]].astype(np.uint64), _UPPER[data[starts]], _UPPER[data[ends - 1]]
    length = np.minimum(np.log2(ends - starts), 4).astype(np.uint64)
    return kind + np.uint64(4) * first.astype(np.uint64) + np.uint64(8) * last.astype(np.uint64) + np.uint64(16) * length


def _around(index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the tokens around each, within its text."""
    n = index.shape[1]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros_like(index)
    for k in range(1, min(WINDOW, n - 1) + 1):
        out[:, k:] += index[:, :-k]
        out[:, :-k] += index[:, k:]
        # Neighbours in two texts are taken out again.
        apart = np.flatnonzero(owner[k:] != owner[:-k])
        out[:, apart + k] -= index[:, apart]
        out[:, apart] -= index[:, apart + k]
    return out


@dataclass
class _Slice:
    """Texts ``low`` to ``high`` of a column: tokens, their distinct kinds, index vectors and sums around."""

    low: int
    high: int
    hashes: np.ndarray
    bounds: np.ndarray
    kind: np.ndarray  # of each token, as a number
    kind_hashes: np.ndarray
    table: np.ndarray  # index vectors of the kinds, in columns
    index: np.ndarray
    around: np.ndarray


def _contexts(column):
    for low, high, data, offsets in W.text_slices(column, _NEAR_BYTES):
        starts, ends, bounds = _tokens(data, offsets)
        hashes, shapes = _hashes(data, starts, ends), _shapes(data, starts, ends)
        first, kind = _kinds(hashes, shapes)
        table = _index_table(hashes[first], shapes[first])
        index = table.take(kind, axis=1)
        yield _Slice(low, high, hashes, bounds, kind, hashes[first], table, index, _around(index, bounds))


def _find(head: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are in the sorted head, and where."""
    if not len(head):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), int)
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return head[at] == hashes, at


def head_words(texts: DataFrame, words: int = HEAD_WORDS) -> np.ndarray:
    """Hashes, ascending, of the ``words`` most frequent tokens; of equally frequent ones the smaller hashes."""

    def count(batches):
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            for cut in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[cut : cut + (1 << 16)].view(np.int64)), pa.array(n[cut : cut + (1 << 16)])], ["word", "n"])

        for batch in batches:
            some, counts = [key], [n]
            for _, _, data, offsets in W.text_slices(batch.column(0), _NEAR_BYTES):
                starts, ends, _ = _tokens(data, offsets)
                more, times = np.unique(_hashes(data, starts, ends), return_counts=True)
                some.append(more)
                counts.append(times)
            key, at = np.unique(np.concatenate(some), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
            if len(key) > _HELD_WORDS:
                yield from rows()
                key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from rows()

    counted = W.map_batches(texts.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow()
    return np.sort(top["word"].to_numpy().view(np.uint64))


def _add_around(total: np.ndarray, head: np.ndarray, part: _Slice) -> None:
    """Adds the sums around the slice's tokens to the rows of the head's words."""
    known, at = _find(head, part.kind_hashes)
    # The words of the slice, and last those that are not in the head.
    held, word = np.unique(np.where(known, at, len(total)), return_inverse=True)
    word = word[part.kind]
    sums = np.array([np.bincount(word, row, len(held)) for row in part.around])
    inside = held < len(total)
    total[held[inside]] += sums[:, inside].T.astype(np.int64)


def word_vectors(texts: DataFrame, head: np.ndarray) -> np.ndarray:
    """Unit vectors of the head's words: sums of whole numbers over all texts, whatever their partitions."""
    held = texts.sparkSession.sparkContext.broadcast(head)
    blocks = -(-len(head) // _BLOCK)

    def add(batches):
        words = held.value
        total = np.zeros((blocks * _BLOCK, WIDTH), np.int64)
        for batch in batches:
            for part in _contexts(batch.column(0)):
                _add_around(total, words, part)
        for b in range(blocks):
            part = total[b * _BLOCK : (b + 1) * _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                total[b] = total[b] + part if b in total else part
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])

    vectors = np.zeros((blocks * _BLOCK, WIDTH))
    if blocks:
        schema = "block int, sums binary"
        # A row per block and task, streamed through the adding task of the block.
        partial = W.map_batches(texts.select("text"), add, schema)
        parts = min(blocks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        for row in W.map_batches(partial.repartition(parts, "block"), merge, schema).collect():  # a row per block
            vectors[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(_BLOCK, WIDTH)
    vectors = vectors[: len(head)]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column, head: np.ndarray, vectors: np.ndarray):
    """(first row, row after the last, features): pooled word vectors of each text.

    Mean and spread of the word vectors, length of the mean, agreement of neighbouring index
    vectors, log of the tokens. A text without tokens has zeros.
    """
    for part in _contexts(column):
        hashes, bounds, kind = part.hashes, part.bounds, part.kind
        n, count = part.high - part.low, np.diff(bounds)
        owner = np.repeat(np.arange(n), count)
        known, at = _find(head, part.kind_hashes)
        each = (vectors[at] if len(head) else np.zeros((len(known), WIDTH), np.float32)).take(kind, axis=0)
        rare = np.flatnonzero(~known[kind])
        if len(rare):
            order = rare[np.lexsort((hashes[rare], owner[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            sums = np.add.reduceat(part.around.take(order, axis=1).astype(np.float32), np.flatnonzero(new), axis=1).T
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            each[order] = sums[np.cumsum(new) - 1]
        size = np.maximum(count, 1)[:, None]
        mean, square = np.zeros((2, n, WIDTH))
        squares = each * each
        for i in np.flatnonzero(count):
            np.add.reduce(each[bounds[i] : bounds[i + 1]], axis=0, dtype=np.float64, out=mean[i])
            np.add.reduce(squares[bounds[i] : bounds[i + 1]], axis=0, dtype=np.float64, out=square[i])
        mean, square = mean / size, square / size
        # Sums of small whole numbers: exact.
        length = np.maximum(np.sqrt(np.einsum("ij,ij->j", part.table, part.table).astype(np.float32)), np.float32(1e-9))[kind]
        same = owner[1:] == owner[:-1]
        agree = np.einsum("ij,ij->j", part.index[:, 1:], part.index[:, :-1]).astype(np.float32) / (length[1:] * length[:-1]) * same
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        yield part.low, part.high, np.column_stack([
            mean, spread, np.linalg.norm(mean, axis=1), np.bincount(owner[1:], agree, n) / np.maximum(count - 1, 1), np.log1p(count),
        ]).astype(np.float32)


def document_vectors(docs: DataFrame, head: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features) per row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((head, vectors))

    def run(batches):
        for batch in batches:
            for low, high, features in pooled(batch.column(1), *held.value):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * _FEATURES), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["doc_id", "features"])

    return W.map_batches(docs.select("doc_id", "text"), run, "doc_id long, features array<float>")


@dataclass
class Network:
    """Two layers over scaled features; the logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # One order of sums per row, so that a score does not depend on its batch.
        z = (x - self.mean) / self.scale
        return np.einsum("ij,j->i", np.tanh(np.einsum("ij,jk->ik", z, self.hidden) + self.hidden_bias), self.out) + self.out_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy, by golden section over its logarithm."""
    loss = lambda t: np.mean(np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / np.exp(t)))
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(x: np.ndarray, y: np.ndarray, seed: int = 13) -> Network:
    """Adam on cross-entropy; the last CALIBRATE share of the rows sets the temperature alone."""
    rng = np.random.default_rng(seed)
    cut = len(x) - int(len(x) * CALIBRATE)
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(x[:cut].mean(axis=0), np.maximum(x[:cut].std(axis=0), 1e-3), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    z, target = (x[:cut] - net.mean) / net.scale, y[:cut].astype(float)
    values = [net.hidden, net.hidden_bias, rng.normal(0, 0.1, HIDDEN), np.array([net.out_bias])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(cut), max(1, cut // STEP_ROWS)):
            h = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -30, 30))) - target[rows]) / len(rows)
            back = np.outer(error, values[2]) * (1 - h * h)
            slopes = (z[rows].T @ back + DECAY * values[0], back.sum(axis=0), h.T @ error + DECAY * values[2], np.array([error.sum()]))
            step += 1
            for v, g, a, b in zip(values, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.hidden, net.hidden_bias, net.out, net.out_bias = values[0], values[1], values[2], float(values[3][0])
    if cut < len(x) and len(set(y[cut:].tolist())) == 2:
        net.temperature = temperature(net.logits(x[cut:]), y[cut:])
    return net


def fit(features: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Network:
    """Network over (doc_id, features); only labels of rows that ``learn``, a condition on doc_id, lets through.

    Label rows without id or with another label than 0 and 1 are ignored; of repeated ones the
    largest counts. With rows of one label or none every text scores the smoothed share.
    """
    known = materialized(
        labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)").filter(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    share = min(1.0, fit_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    told = lookup_join(features, sample, ["doc_id"], "inner")
    # A row per sampled id: the bounded sample.
    rows = told.groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    order = np.argsort(W.mix(rows["doc_id"].to_numpy().view(np.uint64)))
    y = rows["label"].to_numpy()[order]
    x = np.asarray(rows["features"].combine_chunks().flatten(), np.float64).reshape(-1, _FEATURES)[order]
    if len(set(y.tolist())) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros((_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    return train(x, y)


def held_out_fifth(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def scored(features: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of document vectors."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, _FEATURES)
            score = net.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return W.map_batches(features.select("doc_id", "features"), run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    score is the calibrated probability of label 1, predicted is 1 from 0.3 on. Word vectors
    come from all texts, labels only from rows outside the held-out fifth (and that ``learn``
    lets through). Null and empty texts have the vector of no words and a score like any
    other. Texts of any length are read whole. Rows without id are scored and never learned
    from; repeated rows each return a row, and further columns are ignored. An empty table
    gives no rows.
    """
    usable = ~held_out_fifth("doc_id") if learn is None else ~held_out_fifth("doc_id") & learn
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    head = head_words(texts)
    features = materialized(document_vectors(texts, head, word_vectors(texts, head)))
    net = fit(features, labels, usable)
    return scored(features, net).select("doc_id", held_out_fifth("doc_id").alias("held_out"), "score", "predicted")
