"""Similarity join on word shingles: rare-first prefixes, length, positional and suffix filters.

1. A count sketch of fixed size over all shingles of the corpus gives every shingle a place
   in one global order, rare ones first. Any order shared by all documents is exact; the
   sketch only decides how few candidates there are.
2. A document's prefix is so long that two linked documents share a shingle in theirs.
   Equal sets are one class from here on. Classes with a common prefix shingle form a bucket.
3. Each bucket first links its members with its first one: candidates grow with the bucket,
   not with its square. Length and positional filters apply before pairs leave the bucket,
   the suffix filter once per pair, and pairs left are verified once on their whole texts.
4. Members of a bucket that are then in different components are compared too, all but
   those that the largest component holds among themselves. So every pair that could link
   is either verified or already connected; no partner is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.llm.components import connected_components
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

#: Words of a shingle, and the similarity in percent from which two documents link.
WIDTH, PERCENT = 5, 80
#: log2 of the counters of the sketch: a table of 4 MB whatever the corpus.
SKETCH_BITS = 19


def _sets(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for low, high, data, offsets in W.text_slices(column):
        data = W.LOWER[data]
        starts, ends, bounds = W.spans(data, offsets, W.SPACED)
        keys, cuts = W.shingles(W.span_hashes(data, starts, ends), bounds, width)
        yield low, high, keys, cuts


def shingle_sketch(docs: DataFrame, text: str = "text", width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many shingles of all documents fall on each of 2**bits counters."""
    shift = np.uint64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, keys, _ in _sets(batch.column(0), width):
                total += np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    rows = (
        W.map_batches(docs.select(F.col(text).alias("text")), count, "slot int, n long")
        .groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    )  # at most 2**bits rows
    sketch = np.zeros(1 << bits, np.int64)
    sketch[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return sketch


_PREPARED = "doc long, n long, sig_a long, sig_b long, prefix array<long>, bits array<long>"


def _prepare(docs: DataFrame, sketch: np.ndarray, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Per document: size and signature of its set, its prefix rarest first, its bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - int(np.log2(len(sketch))))

    def run(batches):
        order_of = held.value
        for batch in batches:
            ids = batch.column(0)
            for low, high, keys, cuts in _sets(batch.column(1), width):
                n = np.diff(cuts)
                owner = np.repeat(np.arange(high - low), n)
                place = order_of[(keys >> shift).astype(np.int64)]
                order = np.lexsort((keys, place, owner))
                rank = np.arange(len(keys)) - cuts[owner]
                take = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                prefix = keys[order][rank < take[owner]]
                # Bitmap: one bit per shingle in 2 to 4 bits a shingle, as 64-bit words.
                size = np.maximum(64, 1 << (np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1))
                base = np.concatenate([[0], np.cumsum(size // 64)])
                bit = (W.mix(keys) & (size[owner] - 1).astype(np.uint64)).astype(np.int64)
                flags = np.zeros(base[-1] * 64, np.uint8)
                flags[base[owner] * 64 + bit] = 1
                bitmap = np.packbits(flags, bitorder="little").view(np.int64)
                scrambled = W.mix(keys)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (keys, scrambled)]
                sig = [(s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums]
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(prefix.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(bitmap)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(sig[0]), pa.array(sig[1]), *lists],
                    ["doc", "n", "sig_a", "sig_b", "prefix", "bits"],
                )

    return W.map_batches(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), run, _PREPARED)


def _may_link(left: str, right: str, percent: int) -> Column:
    """Length and positional filter on (n << 32 | position) of a common prefix shingle.

    For the first shingle that two sets share, in the global order, only those from there on
    can be common. For later ones the bound may be too low, but a pair that can link passes
    in the bucket of its first.
    """
    n_a, n_b = F.expr(f"{left} div 4294967296"), F.expr(f"{right} div 4294967296")
    p_a, p_b = F.expr(f"{left} & 4294967295"), F.expr(f"{right} & 4294967295")
    most = F.least(n_a - p_a, n_b - p_b)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (
        most * (100 + percent) >= (n_a + n_b) * percent
    )


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose sets differ in too many bits, i.e. in at least as many shingles."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    only = lambda x, y: F.aggregate(
        F.zip_with(f"bits_{x}", f"bits_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v
    )
    most = F.least(F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    return both.filter(
        (F.size("bits_a") != F.size("bits_b")) | (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    ).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose texts link, each compared once on whole shingle sets."""
    pairs = materialized(pairs)
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    needed = materialized(lookup_join(texts, ends, ["doc"], "left_semi"))

    def compare(batches):
        for batch in batches:
            sides = [[], []]
            for k in (0, 1):
                for _, _, keys, cuts in _sets(batch.column(2 + k), width):
                    sides[k] += np.split(keys, cuts[1:-1])
            sizes = [np.array([len(x) for x in side]) for side in sides]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)], np.int64)
            linked = common * 100 >= (sizes[0] + sizes[1] - common) * percent
            if len(linked):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))

    full = pairs.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b")
    return materialized(W.map_batches(full.select("a", "b", "text_a", "text_b"), compare, "a long, b long"))


def ngram_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: near-duplicate classes of whole texts.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    shingles of lower-cased words. component_id is the smallest doc_id reachable by links.

    A null text or one without words has an empty set and links with nothing. A null id
    links with nothing and gets a null component. Rows that share an id are one document,
    linked by the text of any of them; repeated rows each return a row. Texts of fewer words
    than a shingle are compared as a whole. Further columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = shingle_sketch(docs, "text", width, sketch_bits)
    prepared = materialized(_prepare(docs, sketch, "doc_id", "text", width, percent))
    full = prepared.filter("n > 0 and doc is not null")

    # Equal sets are one class, kept by its smallest document.
    copies = materialized(
        full.groupBy("sig_a", "sig_b", "n").agg(F.min("doc").alias("first"), F.count("*").alias("c")).filter("c > 1")
    )
    moved = materialized(
        full.select("doc", "sig_a", "sig_b", "n").join(copies, ["sig_a", "sig_b", "n"]).filter("doc != first").select("doc", "first", "sig_a", "sig_b", "n").distinct()
    )
    # Only the moved set leaves; another text of the same id stays.
    same = ["doc", "sig_a", "sig_b", "n"]
    classes = lookup_join(full, moved.select(*same), same, "left_anti", bound=moved).select("doc", "n", "prefix", "bits")
    postings = classes.select("doc", "n", F.posexplode("prefix").alias("pos", "g")).select(
        "g", "doc", F.expr("shiftleft(n, 32) | pos").alias("np")
    )
    buckets = materialized(
        postings.groupBy("g").agg(
            F.count("*").alias("c"), F.min("doc").alias("a"), F.min_by("np", "doc").alias("np_a"),
            F.max("doc").alias("b"), F.max_by("np", "doc").alias("np_b"),
        ).filter("c > 1 and a != b")
    )
    crowded = materialized(
        lookup_join(postings, buckets.filter("c > 2").select("g", "a", "np_a"), ["g"], "inner").select("g", "a", "np_a", "doc", "np")
    )
    two = buckets.filter("c = 2").filter(_may_link("np_a", "np_b", percent)).select("a", "b")
    star = crowded.filter("doc != a").filter(_may_link("np_a", "np", percent)).select("a", F.col("doc").alias("b"))
    classes_bits = full.select("doc", "n", "bits")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")
    first_pairs = materialized(two.union(star).distinct())
    edges = _verified(_suffix_filter(first_pairs, classes_bits, percent), texts, width, percent)
    found = connected_components(edges)

    # Members of one bucket that are not connected yet.
    placed = crowded.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        "g", "doc", "np", F.coalesce("component", "doc").alias("component")
    )
    placed = materialized(placed)
    mixed = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("g")
    # The component with most members in a bucket; the others are compared with all members.
    main = (
        placed.join(mixed, "g").groupBy("g", "component").count()
        .groupBy("g").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    )
    apart = materialized(placed.join(main, "g"))
    minor = apart.filter("component != main").select("g", F.col("doc").alias("x"), F.col("np").alias("np_x"), F.col("component").alias("c_x"))
    rest = (
        minor.join(apart, "g")
        .filter("component != c_x and (component = main or x < doc)")
        .filter(_may_link("np_x", "np", percent))
        .select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b"))
        .distinct()
        .join(first_pairs, ["a", "b"], "left_anti")
    )
    more = _verified(_suffix_filter(materialized(rest), classes_bits, percent), texts, width, percent)
    links = edges.union(more).union(moved.select(F.col("first").alias("a"), F.col("doc").alias("b")))
    found = connected_components(links)
    return (
        prepared.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
        .join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of the rows kept: of each component the row with the smallest id, once.

    Rows with a null id, without words, or linked with nothing stay.
    """
    found = materialized(ngram_components(docs, key, text, **options))
    name = W.fresh(docs, "__gone")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = lookup_join(docs.withColumn(name, F.col(key).cast("long")), gone, [name], "left_anti")
    again = found.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    again = materialized(again.select(F.col("doc_id").alias(name)))
    if not again.isEmpty():
        once = lookup_join(kept, again, [name], "left_semi", bound=again).dropDuplicates([name])
        kept = lookup_join(kept, again, [name], "left_anti", bound=again).unionByName(once)
    return kept.select(*docs.columns)
