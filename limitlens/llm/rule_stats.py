"""Quality rules with an isolation forest over rule statistics.

Each whole text gives a few statistics. Fixed rules reject the plainly unfit. An isolation
forest - random splits of random samples of all documents, one forest for each family of rules -
gives every document a path length; short paths are anomalies. The scores from which a document is
rejected are calibrated on histograms of all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.reuse import materialized

#: Trees, and documents that each is grown from.
TREES, SAMPLE = 100, 256
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# A good document rejected costs as much as this many bad ones kept.
_CARE = 3
_BINS = 1000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_ends")
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _counted(column):
    """(first row, row after the last, counts per text) of each slice."""
    for low, high, data, offsets in W.text_slices(column):
        n = high - low
        starts, ends, bounds = W.spans(data, offsets, W.SPACED)
        hashes = W.span_hashes(data, starts, ends)
        words = np.diff(bounds)
        owner = np.repeat(np.arange(n), words)
        salt = W.mix(np.arange(n).astype(np.uint64))
        # Windows of three words, told apart by text.
        runs = W.chained(hashes, 3)
        whole = np.arange(len(runs)) + 3 <= bounds[owner[: len(runs)] + 1] if len(runs) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        keys = W.mix(runs[at] ^ salt[owner[at]])
        order = np.argsort(keys)
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        again = at[order[same[1:] | same[:-1]]]
        repeated = np.zeros(len(hashes) + 2, bool)
        for k in range(3):
            repeated[again + k] = True
        # Lines between \n; those with a word that equal an earlier one of their text.
        breaks = np.flatnonzero(data == 10)
        # A break at the end of a text starts an empty line that belongs to it, not to the next.
        text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        head = np.concatenate([offsets[:-1], breaks + 1])
        line_owner = np.concatenate([np.arange(n), text_of_break])
        by = np.lexsort((head, line_owner))
        head, line_owner = head[by], line_owner[by]
        tail = offsets[1:][line_owner].copy()
        inner = np.flatnonzero(line_owner[1:] == line_owner[:-1])
        tail[inner] = head[inner + 1] - 1
        worded = np.searchsorted(starts, tail) > np.searchsorted(starts, head)
        line_keys = W.mix(W.span_hashes(data, head[worded], tail[worded]) ^ salt[line_owner[worded]])
        first = np.unique(line_keys, return_index=True)[1]
        lines = np.bincount(line_owner[worded], minlength=n)
        points = (data & 0xC0) != 0x80
        yield low, high, np.stack([
            words, W.counts_between(W.SPACED[data] & points, offsets), W.counts_between(_SYMBOLS[data], offsets),
            lines - np.bincount(line_owner[worded][first], minlength=n), W.counts_between(repeated[: len(hashes)], bounds),
            lines, W.counts_between((data >= 48) & (data <= 57), offsets), W.counts_between((data >= 65) & (data <= 90), offsets),
            W.counts_between(_ENDS[data], offsets),
        ], axis=1)


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of ``COUNTS`` per row; a null text counts as an empty one."""

    def run(batches):
        for batch in batches:
            for low, high, counts in _counted(batch.column(1)):
                columns = [pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in counts.T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], ["doc_id", *COUNTS])

    return W.map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), 
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )


#: A forest of its own for each family of rules, so that each gets its own threshold.
FAMILIES = ("symbols", "repetition", "shape")


def _features(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Shares, drawn to nought where a text is short: few words make no anomaly by themselves."""
    words, chars, symbols, dup, repeat, lines, digits, upper, ends = counts.T.astype(float)
    return {
        "symbols": np.column_stack([symbols / (chars + 20), symbols / (words + 5)]),
        "repetition": np.column_stack([dup / (lines + 5), repeat / (words + 50)]),
        "shape": np.column_stack([(chars + 150) / (words + 30), digits / (chars + 200), upper / (chars + 200), ends / (words + 50)]),
    }


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: split column (-1: leaf), threshold, left child (right is next), path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for anomalies, below 0.5 for the usual."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, threshold, child, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = column[at] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(column[at], 0)] >= threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_usual_path(self.sample), 1e-9))


def grow_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """Random trees, each over its own ``sample`` rows of ``x`` (of all rows where there are fewer)."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    if size < 2:
        return Forest([], size)
    limit = int(np.ceil(np.log2(size)))
    grown = []
    for t in range(trees):
        rows = x[t * size : (t + 1) * size] if len(x) >= trees * size else x[rng.choice(len(x), size, replace=False)]
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        work = [(0, rows, 0)]
        while work:
            node, own, depth = work.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(own) < 2 or not len(wide):
                nodes[node][3] = depth + _usual_path(len(own))
                continue
            column = int(rng.choice(wide))
            threshold = float(rng.uniform(low[column], high[column]))
            right = own[:, column] >= threshold
            if right.all() or not right.any():
                threshold = float(high[column])
                right = own[:, column] >= threshold
            child = len(nodes)
            nodes[node] = [column, threshold, child, 0.0]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            work += [(child, own[~right], depth + 1), (child + 1, own[right], depth + 1)]
        grown.append((np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])))
    return Forest(grown, size)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _scored(stats: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forests)
    kind = stats.schema

    def run(batches):
        for batch in batches:
            features = _features(np.column_stack([np.asarray(batch.column(c)) for c in COUNTS]))
            scores = [pa.array(held.value[f].scores(features[f])) for f in FAMILIES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], [*kind.names, *FAMILIES])

    return W.map_batches(stats, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind) + "".join(f", {f} double" for f in FAMILIES))


def known_quality(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, good), good 0 or 1; other rows are ignored, of repeated ids the lower counts."""
    rows = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good"))
    return rows.filter("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))


def calibrated_thresholds(scored: DataFrame, known: DataFrame) -> dict[str, float]:
    """The score of each family from which rejecting pays, over all labelled rows that pass the rules.

    Errors are good documents rejected, weighed threefold, and bad ones kept; of equal
    choices the highest. Without labels, or where rejecting never pays, above every score.
    """
    scores = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.floor(F.col(f) * _BINS).cast("int").alias("bin")) for f in FAMILIES])).alias("s")
    bins = (
        scored.filter(~base_failed()).join(known, "doc_id").select("good", scores)
        .groupBy("s.family", "s.bin", "good").agg(F.count("*").alias("n")).toArrow().to_pylist()
    )  # at most 2 * 1001 rows for each family
    out = {}
    for family in FAMILIES:
        table = np.zeros((2, _BINS + 2), np.int64)
        for row in bins:
            if row["family"] == family:
                table[row["good"], row["bin"]] += row["n"]
        # Rejecting from bin t on: good at or above t is lost, bad below t is kept.
        lost = np.cumsum(table[1][::-1])[::-1]
        kept = np.concatenate([[0], np.cumsum(table[0])[:-1]])
        errors = _CARE * lost + kept
        out[family] = float(len(errors) - 1 - np.argmin(errors[::-1])) / _BINS
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the anomaly score of each family of rules.

    base_failed: under 50 words, or over half of the words in three-word windows that occur
    twice or more. kept is false for those, and for documents one of whose scores reaches its
    calibrated threshold. Null and empty texts have no words and fail; repeated rows each
    return a row; a null id is judged like others and matches no label. An empty table gives
    no rows. The forests are grown from trees * sample documents at most, chosen by a hash of
    all that pass the rules.
    """
    stats = materialized(rule_statistics(docs, key, text))
    known = materialized(known_quality(labels))
    passed = stats.filter(~base_failed())
    rows = passed.orderBy(F.xxhash64("doc_id", F.lit(1)), *COUNTS).limit(trees * sample).select(*COUNTS).toArrow()
    features = _features(np.column_stack([rows[c].to_numpy() for c in COUNTS]).reshape(-1, len(COUNTS)))
    scored = _scored(stats, {f: grow_forest(x, trees, sample) for f, x in features.items()})
    fine = ~base_failed()
    for family, threshold in calibrated_thresholds(scored, known).items():
        fine &= F.col(family) < threshold
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        fine.alias("kept"), *FAMILIES,
    )
