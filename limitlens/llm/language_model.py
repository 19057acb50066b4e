"""Log-bilinear language model with noise-contrastive estimation, and corpus word counts.

Every word of the corpus is a leaf's word in a tree of three levels: classes by word ending, in
them classes by word beginning, in them leaves by hash. The leaves grow with the distinct words
of the corpus. A token's probability is the product of the model's probabilities of its class, its
subclass and its leaf, given the words before, and of the share that the word's count has of
its leaf. Context and predicted vectors belong to the nodes of the tree, so rare and unseen words
have vectors too: a context word's vector is the sum of those on its path.

The model starts as the unigram model of the counts and is trained in numpy inside Spark
tasks, on all training texts, several times over. Texts are dealt to shards by a hash of id and
text and learned from in the order of that hash, so the result does not depend on how the
rows are stored or split, and a task that is run again learns the same. In each round every
shard starts from the same parameters; each parameter row is then averaged over the shards, by
the tokens that moved it. Normalisers are exact sums over a node's children, by matrix
products.

A bounded number of frequent words is broadcast with their counts. The rest, rare by
choice, is joined, so no key of that join is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.reuse import materialized

#: Words of context, entries of a vector, tokens of a batch.
CONTEXT, WIDTH, BATCH = 4, 16, 4096
#: Noise classes for each batch; noise children for each token and level below.
NOISE_CLASSES, NOISE = 16, 2
#: Rounds of training, each over all training texts.
ROUNDS, RATE = 2, 0.1
#: Words broadcast with their counts: 16 bytes each.
HEAD_WORDS = 1 << 20
#: Shards at least; each learns from this many tokens per leaf or more, beyond that many shards.
SHARDS, LEAF_TOKENS = 8, 32
# Bits of a word's key that name its class and, in that, its subclass; the others are a hash.
_CLASS = 6
# The key of a text's end; no word of a text has it but by chance of 2^-64.
END = 0x243F6A8885A308D3
# Distinct words a counting task holds before it hands them on.
_HELD_WORDS = 1 << 21
# Bytes of text taken apart together: what is made of them stays in cache.
_NEAR_BYTES = 1 << 18
# Parameter rows handed on together.
_BLOCK = 256
# Rows of a run that are added one of every run at a time.
_SHORT = 4


def held_out_seventh(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of words: 6 bits from the last two bytes, 6 from the first two, 52 from the whole."""
    pair = lambda one, two: data[one].astype(np.uint64) | (np.where(starts < ends - 1, data[two], 0).astype(np.uint64) << np.uint64(8))
    if not len(starts):
        return np.zeros(0, np.int64)
    top = np.uint64(64 - _CLASS)
    ending = W.mix(pair(ends - 1, np.maximum(ends - 2, 0))) >> top
    beginning = W.mix(pair(starts, np.minimum(starts + 1, len(data) - 1)) | np.uint64(1 << 16)) >> top
    rest = W.span_hashes(data, starts, ends) & np.uint64((1 << (64 - 2 * _CLASS)) - 1)
    return ((ending << top) | (beginning << np.uint64(64 - 2 * _CLASS)) | rest).view(np.int64)


def _words(column, limit: int = W.SLICE_BYTES):
    """(first row, row after the last, word keys, word bounds) of each slice."""
    for low, high, data, offsets in W.text_slices(column, limit):
        keys, bounds = [], [np.zeros(1, np.int64)]
        for first, last in W.slices(offsets, _NEAR_BYTES):
            part = W.lowered(data[offsets[first] : offsets[last]])
            starts, ends, at = W.spans(part, offsets[first : last + 1] - offsets[first], W.SPACED)
            keys.append(word_keys(part, starts, ends))
            bounds.append(bounds[-1][-1] + at[1:])
        yield low, high, np.concatenate(keys), np.concatenate(bounds)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    distinct, at = np.unique(key, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word, as a key, occurs in all texts."""

    def count(batches):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def rows():
            key, n = _merged(keys, counts)
            for cut in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[cut : cut + (1 << 16)]), pa.array(n[cut : cut + (1 << 16)])], ["word", "n"])

        for batch in batches:
            for _, _, hashes, _ in _words(batch.column(0)):
                key, n = np.unique(hashes, return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 2 * _HELD_WORDS:
                    key, n = _merged(keys, counts)
                    keys, counts = [key], [n]
                    if len(key) > _HELD_WORDS:
                        yield from rows()
                        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield from rows()

    return W.map_batches(texts.select(F.col(text).cast("string").alias("text")), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Totals of the training texts and the frequent words, by key."""

    table: DataFrame  # (word, n), stored
    tokens: int
    types: int
    texts: int
    head: np.ndarray
    head_n: np.ndarray
    head_least: int  # words counted at least so often are in the head


def count_corpus(training: DataFrame, text: str = "text", head_words: int = HEAD_WORDS) -> Counts:
    table = materialized(word_counts(training, text))
    texts = training.count()
    # Counts in steps of an eighth of a power of two: a few hundred rows.
    step = F.floor(F.log2("n") * 8)
    steps = table.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, np.iinfo(np.int64).max
    for row in steps:
        held += row["words"]
        if held > head_words:
            break
        least = row["least"]
    head = table.filter(F.col("n") >= int(least)).toArrow()
    order = np.argsort(head["word"].to_numpy())
    tokens, types = sum(r["n"] for r in steps) + texts, sum(r["words"] for r in steps) + (texts > 0)
    return Counts(table, int(tokens), int(types), texts, head["word"].to_numpy()[order], head["n"].to_numpy()[order], int(least))


def leaf_bits(types: int) -> int:
    """Bits of a leaf within its subclass: leaves grow with the root of the distinct words."""
    return max(0, int(np.log2(max(types, 1)) / 2 - 5))


def _sorted_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places by their number, then by place, and the numbers: both are sorted as one."""
    low = len(ids).bit_length()
    both = np.sort(ids.astype(np.int64) << low | np.arange(len(ids)))
    return both & ((1 << low) - 1), both >> low


def _firsts(numbers: np.ndarray) -> np.ndarray:
    """The first places of the runs of equal numbers."""
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return np.flatnonzero(new)


class LogBilinear:
    """Vectors of context and of predicted nodes, as rows of one matrix; the last column is the bias.

    A leaf's number holds class and subclass in its upper bits. Number ``leaves`` stands for
    the places before a text.
    """

    def __init__(self, n: np.ndarray, types: np.ndarray, width: int = WIDTH, seed: int = 11):
        """``n`` and ``types`` count tokens and distinct words of each leaf, 2^(12 + bits) in all."""
        self.leaves, self.width = len(n), width
        self.bits = int(np.log2(self.leaves)) - 2 * _CLASS
        # One unseen word more per leaf.
        self.mass = n + types + 1.0
        nodes = (1 << _CLASS, 1 << 2 * _CLASS, self.leaves)
        self.into = tuple(np.cumsum((0,) + nodes))
        self.out = tuple(self.into[3] + 1 + x for x in self.into[:3])
        self.near = self.out[0] + self.into[3]
        rng = np.random.default_rng(seed)
        rows = self.rows = np.zeros((self.near + CONTEXT, width + 1), np.float32)
        rows[: self.into[2], :-1] = rng.normal(0, 0.3, (self.into[2], width))
        rows[self.near :, :-1] = 0.5
        above = np.array([self.mass.sum()])
        for level in range(3):
            mass = self.mass.reshape(nodes[level], -1).sum(axis=1)
            fan = nodes[level] // len(above)
            rows[self.out[level] : self.out[level] + nodes[level], -1] = np.log(mass / np.repeat(above, fan))
            above = mass

    def shift(self, level: int) -> int:
        """What a leaf's number is shifted by to give its node."""
        return (_CLASS + self.bits, self.bits, 0)[level]

    def fan(self, level: int) -> int:
        return (1 << _CLASS, 1 << _CLASS, 1 << self.bits)[level]

    def numbers(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Leaves of the tokens of the texts, ends included, with places before each text."""
        n = len(bounds) - 1
        ids = np.full(len(keys) + (CONTEXT + 1) * n, self.leaves, np.int32)
        down = np.uint64(64 - 2 * _CLASS - self.bits)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        ids[np.arange(len(keys)) + (CONTEXT + 1) * owner + CONTEXT] = (keys.view(np.uint64) >> down).astype(np.int32)
        ids[bounds[1:] + (CONTEXT + 1) * np.arange(n) + CONTEXT] = int(np.uint64(END) >> down)
        return ids

    def context(self, ids: np.ndarray) -> np.ndarray:
        """The vector of each token as context."""
        leaf = np.minimum(ids, self.leaves - 1)
        out = self.rows.take(self.into[2] + leaf, axis=0)
        for level in (0, 1):
            out += self.rows.take(self.into[level] + (leaf >> self.shift(level)), axis=0)
        out[ids == self.leaves] = self.rows[self.into[3]]
        return out

    def predicted(self, vectors: np.ndarray, near: list[np.ndarray] | None = None) -> np.ndarray:
        """What the vectors before each place predict there; the last entry, for the bias, is 1.

        ``near`` has the row of each place before, as often as it is needed.
        """
        out = np.zeros_like(vectors)
        for back in range(CONTEXT):
            out[back + 1 :] += vectors[: -back - 1] * (self.rows[self.near + back] if near is None else near[back])
        out[:, -1] = 1
        return out

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's leaf given the words before; 0 before a text."""
        out = np.zeros(len(ids))
        for cut in range(0, len(ids), 1 << 18):
            low = max(0, cut - CONTEXT)
            order, leaf = _sorted_places(ids[low : cut + (1 << 18)])
            # Equal tokens have one vector.
            first = _firsts(leaf)
            each, of = self.context(leaf[first]), np.empty(len(order), np.int64)
            of[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(leaf)))
            q = np.empty((len(of), self.width + 1), np.float32)
            for at in range(0, len(of), BATCH):
                begin = max(0, at - CONTEXT)
                q[at : at + BATCH] = self.predicted(each.take(of[begin : at + BATCH], axis=0))[at - begin :]
            kept = np.flatnonzero(order[: np.searchsorted(leaf, self.leaves)] >= cut - low)
            order, leaf = order[kept], leaf[kept]
            q = q.take(order, axis=0)
            total = np.zeros(len(leaf))
            for level in range(3):
                if self.fan(level) > 1:
                    logits = np.empty((max(1, (1 << 18) // self.fan(level)), self.fan(level)), np.float32)
                    for at in range(0, len(leaf), len(logits)):
                        s = slice(at, at + len(logits))
                        total[s] += self._among_siblings(level, leaf[s] >> self.shift(level), q[s], logits)
            out[low + order] = total
        return out

    def _among_siblings(self, level: int, node: np.ndarray, q: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Log probability of each node, in ascending order, among its parent's children."""
        fan, logits = self.fan(level), space[: len(node)]
        parent = node // fan
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))

        def fill():
            for s, e in zip(first, np.append(first[1:], len(node))):
                at = self.out[level] + int(parent[s]) * fan
                np.matmul(q[s:e], self.rows[at : at + fan].T, out=logits[s:e])
            return logits[np.arange(len(node)), node % fan].astype(np.float64)

        own = fill()
        with np.errstate(over="ignore"):
            sums = np.exp(logits, out=logits) @ np.ones(fan, np.float32)
        if len(sums) and not (1e-30 < sums.min() and sums.max() < 1e30):
            # Beyond the range of the numbers: again, less each row's largest.
            fill()
            top = logits.max(axis=1)
            logits -= top[:, None]
            return own - top - np.log(np.exp(logits, out=logits).sum(axis=1))
        return own - np.log(sums)


class _Runs:
    """Runs of equal numbers, the longest first, and sums of rows over them."""

    def __init__(self, node: np.ndarray):
        first = _firsts(node)
        sizes = np.diff(first, append=len(node))
        by = np.argsort(-np.minimum(sizes, _SHORT + 1).astype(np.int8), kind="stable")
        first, sizes = first[by], sizes[by]
        # Each place's run; the number of each run.
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        self.of, self.node = np.repeat(rank, sizes[rank]), node.take(first)
        # Rows that are added to the first, one of every run that has one, and what is left of long runs.
        some = len(by) - np.cumsum(np.bincount(np.minimum(sizes, _SHORT + 1), minlength=_SHORT + 2))
        self.places = [first] + [first[: some[k]] + k for k in range(1, _SHORT) if some[k]]
        left = sizes[: some[_SHORT]] - _SHORT
        self.begin = np.cumsum(left) - left
        self.rest = np.arange(left.sum()) + np.repeat(first[: len(left)] + _SHORT - self.begin, left)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """A row for each run."""
        out = x.take(self.places[0], axis=0)
        for at in self.places[1:]:
            out[: len(at)] += x.take(at, axis=0)
        if len(self.begin):
            out[: len(self.begin)] += np.add.reduceat(x.take(self.rest, axis=0), self.begin, axis=0)
        return out


def _wide(weights: np.ndarray, width: int) -> np.ndarray:
    """Each weight in a row of its own, for products of whole matrices."""
    return np.repeat(weights, width).reshape(-1, width)


class _Trainer:
    """AdaGrad steps of noise-contrastive estimation on one shard's tokens."""

    def __init__(self, model: LogBilinear, seed, rate: float = RATE):
        self.model, self.rng, self.rate = model, np.random.default_rng(seed), rate
        self.squares = np.ones(len(model.rows), np.float32)
        self.moved = np.zeros(len(model.rows), np.float32)
        self.held = [np.full(CONTEXT, model.leaves, np.int32)]
        self.waiting = 0
        self.ones = np.ones(model.rows.shape[1], np.float32)
        # The same rows as single items, which are written faster.
        self.items = model.rows.view(f"V{model.rows.strides[0]}").ravel()

    def _apply(self, at: np.ndarray, gradient: np.ndarray, tokens=None) -> None:
        """A step of the distinct rows ``at``; uses up ``gradient``."""
        squares = self.squares.take(at)
        squares += (gradient * gradient) @ self.ones / np.float32(len(self.ones))
        self.squares[at] = squares
        gradient *= _wide(self.rate / np.sqrt(squares), len(self.ones))
        gradient += self.model.rows.take(at, axis=0)
        self.items[at] = gradient.view(self.items.dtype).ravel()
        if tokens is not None:
            self.moved[at] += tokens

    def learn(self, ids: np.ndarray) -> None:
        """Takes the shard's tokens in order, however they are cut."""
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH:
            ids = np.concatenate(self.held)
            whole = self.waiting // BATCH * BATCH
            for cut in range(0, whole, BATCH):
                self._step(ids[cut : cut + BATCH + CONTEXT])
            self.held, self.waiting = [ids[whole:]], self.waiting - whole

    def finish(self) -> None:
        if self.waiting:
            self._step(np.concatenate(self.held))
            self.held, self.waiting = [self.held[-1][:0]], 0

    def _step(self, ids: np.ndarray) -> None:
        """One batch; its first places are context only."""
        m, n = self.model, len(ids)
        order, leaf = _sorted_places(ids)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # Places before a text come last.
        real = int(np.searchsorted(leaf, m.leaves))
        order, leaf = order[:real], leaf[:real]
        runs = {level: _Runs(leaf >> m.shift(level)) for level in (1, 2)} if real else {}
        # Equal tokens have one vector; the last one is that before a text.
        each = m.context(np.append(runs[2].node, m.leaves)) if real else m.context(np.array([m.leaves]))
        held = np.full(n, len(each) - 1)
        if real:
            held[:real] = runs[2].of
        vectors = each.take(held.take(rank), axis=0)
        near_rows = [np.tile(m.rows[m.near + back], (n - back - 1, 1)) for back in range(CONTEXT)]
        q = m.predicted(vectors, near_rows)
        wanted = np.zeros_like(q)
        if real:
            sorted_q = q.take(order, axis=0)
            learned = (order >= CONTEXT).astype(np.float32)
            # A weight of nothing where the exponential is beyond the numbers.
            with np.errstate(over="ignore"):
                self._classes(leaf >> m.shift(0), sorted_q, learned, wanted[:real])
                for level in (1, 2):
                    if m.fan(level) > 1:
                        self._level(m.out[level], runs[level], m.fan(level), sorted_q, learned, wanted[:real])
            wanted[:, -1] = 0
        pull = wanted.take(rank, axis=0)
        # Contexts: each place gives to those before it.
        give, near = np.zeros_like(pull), np.zeros((CONTEXT, pull.shape[1]), np.float32)
        ones = np.ones(n, np.float32)
        for back in range(CONTEXT):
            give[: -back - 1] += np.multiply(pull[back + 1 :], near_rows[back], out=near_rows[back])
            near[back] = ones[back + 1 :] @ np.multiply(pull[back + 1 :], vectors[: -back - 1], out=near_rows[back])
        if real:
            given = give.take(order, axis=0)
            sums = {level: runs[level].sums(given) for level in (1, 2)}
            # Those of the classes from those of their subclasses.
            above = runs[1].node >> _CLASS
            order = np.argsort(above, kind="stable")
            first = _firsts(above[order])
            self._apply(m.into[0] + above[order[first]], np.add.reduceat(sums[1].take(order, axis=0), first, axis=0), np.diff(_firsts(leaf >> m.shift(0)), append=real))
            for level in (1, 2):
                self._apply(m.into[level] + runs[level].node, sums[level], np.bincount(runs[level].of))
        before = np.flatnonzero(ids == m.leaves)
        if len(before):
            self._apply(np.array([m.into[3]]), give[before].sum(axis=0, keepdims=True), len(before))
        self._apply(m.near + np.arange(CONTEXT), near, real)

    def _classes(self, node: np.ndarray, q, learned, wanted) -> None:
        """True classes against noise classes that the batch shares, drawn evenly."""
        m = self.model
        fan = m.fan(0)
        table = m.rows[m.out[0] : m.out[0] + fan]
        noise = self.rng.integers(0, fan, NOISE_CLASSES)
        even = np.float32(np.log(NOISE_CLASSES / fan))
        drawn = table[noise]
        own = table.take(node, axis=0)
        up = learned / (1 + np.exp((q * own) @ self.ones - even))
        # A row for each noise class.
        down = drawn @ q.T
        np.subtract(even, down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(learned, down, out=down)
        wide = _wide(up, len(self.ones))
        own *= wide
        wanted += own
        wanted -= down.T @ drawn
        gradient, tokens = np.zeros_like(table), np.zeros(fan, np.float32)
        wide *= q
        first = _firsts(node)
        gradient[node[first]] = np.add.reduceat(wide, first, axis=0)
        tokens[node[first]] = np.add.reduceat(learned, first)
        np.subtract.at(gradient, noise, down @ q)
        self._apply(m.out[0] + np.arange(fan), gradient, tokens)

    def _level(self, start: int, runs: _Runs, fan: int, q, learned, wanted) -> None:
        """True children against noise children drawn evenly from their siblings."""
        m = self.model
        even, steps = np.float32(np.log(NOISE / fan)), []
        tokens = np.bincount(runs.of, learned)
        for turn, by in enumerate([0, *self.rng.integers(0, fan, NOISE)]):
            # One step for all tokens maps siblings to siblings, so the rows stay distinct.
            at = start + ((runs.node & -fan) | ((runs.node + by) & (fan - 1)))
            rows = m.rows.take(at, axis=0).take(runs.of, axis=0)
            score = (rows * q) @ self.ones
            score -= even
            weight = learned / (1 + np.exp(score)) if turn == 0 else -learned / (1 + np.exp(-score))
            wide = _wide(weight, len(self.ones))
            rows *= wide
            wanted += rows
            wide *= q
            steps.append((at, runs.sums(wide), tokens if turn == 0 else None))
        # All scores are those of the rows as they were.
        for step in steps:
            self._apply(*step)


def leaf_counts(counts: Counts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each leaf, ends included."""
    n, types = np.zeros(1 << (2 * _CLASS + bits)), np.zeros(1 << (2 * _CLASS + bits))
    leaf = F.shiftrightunsigned("word", 64 - 2 * _CLASS - bits)
    found = counts.table.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    at = found["leaf"].to_numpy()
    n[at], types[at] = found["n"].to_numpy(), found["types"].to_numpy()
    if counts.texts:
        end = END >> (64 - 2 * _CLASS - bits)
        n[end] += counts.texts
        types[end] += 1
    return n, types


def _mean_rows(shares: DataFrame, width: int) -> DataFrame:
    """(block, at, v) of (block, shard, at, v, w): rows averaged by weight, added in order of shards."""

    def run(batches):
        held, sums, weights = None, None, None

        def result():
            at = np.flatnonzero(weights > 0)
            mean = (sums[at] / weights[at, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "at", "v"])

        for batch in batches:
            for block, at, v, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != held:
                    if held is not None:
                        yield result()
                    held, sums, weights = block, np.zeros((_BLOCK, width)), np.zeros(_BLOCK)
                at, w = np.frombuffer(at, np.int16), np.frombuffer(w, np.float32).astype(np.float64)
                sums[at] += np.frombuffer(v, np.float32).reshape(-1, width) * w[:, None]
                weights[at] += w
        if held is not None:
            yield result()

    ordered = shares.repartition("block").sortWithinPartitions("block", "shard").select("block", "at", "v", "w")
    return W.map_batches(ordered, run, "block int, at binary, v binary")


def train(training: DataFrame, counts: Counts, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, bits: int | None = None) -> LogBilinear:
    """The model after ``rounds`` passes over all training texts."""
    bits = leaf_bits(counts.types) if bits is None else bits
    model = LogBilinear(*leaf_counts(counts, bits))
    shards = max(SHARDS, counts.tokens // (LEAF_TOKENS * model.leaves))
    context = training.sparkSession.sparkContext
    plain = LogBilinear.__new__(LogBilinear)
    plain.leaves, plain.bits = model.leaves, model.bits

    def number(batches):
        for batch in batches:
            for low, high, keys, bounds in _words(batch.column(1)):
                ids = plain.numbers(keys, bounds)
                cuts = bounds + (CONTEXT + 1) * np.arange(len(bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))], ["place", "ids"])

    texts = training.select(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")).alias("place"), F.col(text).cast("string").alias("text"))
    tokens = materialized(W.map_batches(texts, number, "place long, ids array<int>"))
    tokens = tokens.withColumn("shard", F.pmod("place", F.lit(int(shards))).cast("int"))
    for turn in range(rounds):
        held = context.broadcast(model)

        def learn(batches, held=held, turn=turn):
            import copy

            shard, trainer = None, None

            def result():
                trainer.finish()
                touched = np.flatnonzero(trainer.moved > 0)
                for block in np.unique(touched // _BLOCK):
                    at = touched[np.searchsorted(touched, block * _BLOCK) : np.searchsorted(touched, (block + 1) * _BLOCK)]
                    parts = [(at - block * _BLOCK).astype(np.int16), trainer.model.rows[at], trainer.moved[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "shard", "at", "v", "w"]
                    )

            for batch in batches:
                numbers, lists = batch.column(0).to_numpy(), batch.column(1)
                values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]]) if len(numbers) else [0]
                for s, e in zip(cuts[:-1], cuts[1:]):
                    if numbers[s] != shard:
                        if trainer is not None:
                            yield from result()
                        shard = int(numbers[s])
                        trainer = _Trainer(copy.deepcopy(held.value), [turn, shard], RATE / (turn + 1))
                    trainer.learn(values[offsets[s] : offsets[e]])
            if trainer is not None:
                yield from result()

        ordered = tokens.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "place", "ids").select("shard", "ids")
        shares = W.map_batches(ordered, learn, "block int, shard int, at binary, v binary, w binary")
        means = _mean_rows(materialized(shares), model.rows.shape[1]).toArrow()
        for block, at, v in zip(*(means[c].to_pylist() for c in ("block", "at", "v"))):
            model.rows[block * _BLOCK + np.frombuffer(at, np.int16).astype(np.int64)] = np.frombuffer(v, np.float32).reshape(-1, model.rows.shape[1])
    return model


def score_texts(docs: DataFrame, counts: Counts, model: LogBilinear, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row."""
    held = docs.sparkSession.sparkContext.broadcast((counts.head, counts.head_n, model))
    end_n = counts.texts
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, counted double, modelled double, word long, times long"

    def run(batches):
        head, head_n, model = held.value
        ln10 = np.log(10)
        logs, shares = np.log10(head_n + 1.0), np.log(np.append(model.mass, 1.0))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0)
            for low, high, hashes, bounds in _words(batch.column(1)):
                n = high - low
                rows = number + np.arange(n)
                number += n
                words = np.diff(bounds)
                owner = np.repeat(np.arange(n), words)
                # Each distinct word is looked up once.
                distinct, word = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(head, distinct), max(0, len(head) - 1))
                found = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
                known, counted = found[word], (np.where(found, logs[at], 0.0) if len(head) else np.zeros(len(distinct)))[word]
                ids = model.numbers(hashes, bounds)
                ends = np.cumsum(words + CONTEXT + 1)
                model_sum = np.concatenate([[0], np.cumsum(model.log_probabilities(ids) - shares[ids])])
                columns = [
                    pa.array(rows), doc_ids.slice(low, n), pa.array(words + 1), pa.array(np.bincount(owner, known, n).astype(np.int64) + (end_n > 0)),
                    pa.array(np.bincount(owner, counted, n) + np.log10(end_n + 1.0)), pa.array((model_sum[ends] - model_sum[ends - words - CONTEXT - 1]) / ln10),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, _names)
                # Words that aren't broadcast, once for each text.
                rare = np.flatnonzero(~known)
                if len(rare):
                    order = rare[np.lexsort((hashes[rare], owner[rare]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                    first = np.flatnonzero(new)
                    none = [pa.nulls(len(first), t) for t in (doc_ids.type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[owner[order[first]]]), *none, pa.array(hashes[order[first]]), pa.array(np.diff(np.append(first, len(order))))], _names
                    )

    _names = [x.split()[0] for x in schema.split(", ")]
    found = materialized(W.map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema))
    rest = counts.table.filter(F.col("n") < counts.head_least)
    rare = (
        found.filter("word is not null").select("row", "word", "times").join(rest, "word")
        .groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_counted"))
    )
    whole = found.filter("word is null").drop("word", "times").join(rare, "row", "left")
    extra = F.coalesce("rare_counted", F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + extra - F.col("n_tokens") * float(np.log10(counts.tokens + counts.types + 1))).alias("base_score"),
        # The unseen words of a leaf are one type with count 0.
        (F.col("counted") + extra + F.col("modelled")).alias("score"),
    )


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS, bits: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are the words of the lower-cased text and one end. base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the text.
    A null text is empty: its only token is the end. A null id is never held out. Repeated
    rows each count and return a row; one with both id and text is learned from in one shard. Long
    texts are scored and learned from as a whole, a batch of tokens at a time. Ties cannot matter: the tree follows from the words alone. An
    empty table gives an empty result; without training texts every count is 0 and the model is
    uniform. Further columns are ignored, whatever their names.
    """
    training = docs.filter(~held_out_seventh(key))
    counts = count_corpus(training, text, head_words)
    model = train(training, counts, key, text, rounds, bits)
    return score_texts(docs, counts, model, key, text).select(
        "doc_id", held_out_seventh().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
