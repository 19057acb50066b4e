"""Language identification by rank-order n-gram profiles.

The most frequent letter n-grams of a language, in order, are its profile. A text gets the
language to whose profile its own most frequent n-grams have the smallest total
out-of-place distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from limitlens.llm import words as W

#: N-grams of one to three letters, and how many of a profile or a text are ranked.
PROFILE, LENGTH = 300, 3
#: Languages that profiles are kept for; more are an error.
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_GAP = 1  # no letter has this code point

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, words parted by one gap (1), and each one's text."""
    pieces = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:])]
    points = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    owner = np.concatenate([[0], owner])
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    points, letter, owner = np.where(letter, points, _GAP)[keep], letter[keep], owner[keep]
    # Two gaps in a row mean more than one non-letter between words: one is enough.
    double = np.zeros(len(points), bool)
    double[1:] = ~letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1])
    return points[~double], owner[~double]


def _grams(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams (21 bits a letter or gap) and the text of each."""
    codes, owners = [], []
    points = points.astype(np.int64)
    for n in range(1, LENGTH + 1):
        size = max(0, len(points) - n + 1)
        code = np.zeros(size, np.int64)
        use = np.full(size, n > 1) if n > 1 else points[:size] > _GAP
        for k in range(n):
            part = points[k : k + size]
            code = (code << 21) | part
            if k:
                use &= owner[k : k + size] == owner[:size]
            if 0 < k < n - 1:
                use &= part > _GAP  # no n-gram goes across a gap
        if n == 2:
            use &= code != (_GAP << 21 | _GAP)
        codes.append(code[use])
        owners.append(owner[:size][use])
    return np.concatenate(codes), np.concatenate(owners)


def _counted(codes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the distinct n-grams of each text."""
    distinct = np.unique(codes) if len(codes) else codes
    span = max(1, len(distinct))
    # Codes become numbers of this slice's alphabet of n-grams, so that text and n-gram fit one key.
    key = np.sort(owners.astype(np.int64) * span + np.searchsorted(distinct, codes))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    key = key[first]
    return key // span, distinct[key % span], np.diff(np.append(first, len(codes)))


def held_out_third(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language over all its texts, most frequent first."""

    def count(batches):
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes_of = names.indices.to_numpy()
            known = names.dictionary.to_pylist()
            kept: list[tuple] = []
            for low, high, data, offsets in W.text_slices(batch.column(1)):
                grams, owners = _grams(*_coded(data, offsets))
                # Of one language all texts count together.
                kept.append(_counted(grams, codes_of[low:high][owners], high - low))
            for langs, grams, counts in kept:
                yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in langs], pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counts = (
        W.map_batches(labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        .filter("lang is not null and text is not null"), count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).limit(MAX_LANGUAGES * size + 1).toArrow()
    if top.num_rows > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    table = top.sort_by([("lang", "ascending"), ("rank", "ascending")])
    langs, grams = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy()
    for name in dict.fromkeys(langs.tolist()):
        out[name] = grams[langs == name]
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) per row.

    The distance of a text to a profile is the sum, over the text's ``size`` most frequent
    n-grams, of how far each is out of place, ``size`` for one that the profile lacks. score
    is one less the distance over the largest possible. Ties: the first language by name.
    """
    names = sorted(learned)
    known = np.unique(np.concatenate(list(learned.values()))) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(known) + 1), -1, np.int64)
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(known, learned[name])] = np.arange(len(learned[name]))
    held = docs.sparkSession.sparkContext.broadcast((names, known, ranks))

    def run(batches):
        names, known, ranks = held.value
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in W.text_slices(batch.column(1), 2 << 20):
                n = high - low
                owner, gram, count = _counted(*_grams(*_coded(data, offsets)), n)
                bounds = np.searchsorted(owner, np.arange(n + 1))
                # Most frequent first; equal counts by code. One sortable number each.
                top = int(count.max(initial=1)) + 1
                bits = max(1, int(len(owner)).bit_length())
                order = np.sort(((owner * top + (top - 1 - count)) << bits) | np.arange(len(owner))) & ((1 << bits) - 1)
                rank = np.arange(len(owner)) - bounds[owner[order]]
                order, rank = order[rank < size], rank[rank < size]
                at = np.minimum(np.searchsorted(known, gram[order]), max(0, len(known) - 1))
                found = (known[at] == gram[order]) if len(known) else np.zeros(len(order), bool)
                at = np.where(found, at, len(known))
                used = np.bincount(owner[order], minlength=n)
                best = np.full(n, np.inf)
                choice = np.full(n, -1)
                for i in range(len(names)):
                    place = ranks[i][at]
                    distance = np.bincount(owner[order], np.where(place < 0, size, np.abs(place - rank)), n)
                    closer = (distance < best) & (used > 0)
                    best[closer], choice[closer] = distance[closer], i
                label = [names[c] if c >= 0 else UNDETERMINED for c in choice]
                score = np.where(choice >= 0, 1 - np.where(choice >= 0, best, 0) / np.maximum(used * size, 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(low, n), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return W.map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), 
        run, "doc_id long, lang_pred string, score double"
    )


def language_predictions(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; profiles come from rows that aren't held out.

    lang_pred is "und" with score 0 for a text that is null, has no letter, or where nothing
    was learned. Rows without language are not learned from; null ids are not held out and
    not learned from; repeated rows each count and return a row. Further columns are ignored.
    """
    learned = profiles(docs.filter(~held_out_third(key) & F.col(key).isNotNull()), text, lang)
    return identify(docs, learned, key, text).select("doc_id", held_out_third().alias("held_out"), "lang_pred", "score")
