"""Embedding whitening, the filter audit and the quality classifier against brute force."""

import collections
import itertools
import math
import re
import zlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limitlens.llm import embedding_whitening, filter_audit, quality_classifier

VECTORS = "vec_id long, embedding array<float>, n int, x string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]


def check_whitening(out, kept, dims):
    x = np.array([whole(v) for _, v in kept], float)
    n = len(x)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = collections.defaultdict(list)
    for r in out:
        got[r["vec_id"]].append(r)
    exact = np.array([whole(v) for _, v in kept], object)
    deviation = ((n * exact - exact.sum(axis=0)) ** 2).sum(axis=1)
    signs = {}
    for (i, _), row, dev in zip(kept, centred, deviation):
        assert [r["component"] for r in sorted(got[i], key=lambda r: r["component"])] == list(range(1, min(8, dims) + 1))
        for r in got[i]:
            k = r["component"] - 1
            assert (r["n"], r["deviation"], r["deviation_exact"]) == (n, int(dev), Decimal(int(dev)))
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
            want = row @ axes[:, k] / np.sqrt(values[k])
            if abs(want) > 1e-6:
                assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-8)
                assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1 + np.arange(12) / 4)]) for i in range(150)]
    rows += [(200, rows[4][1]), (201, rows[4][1])]  # equal vectors
    bad = [(300, None), (301, []), (302, [1.0] * 11 + [None]), (303, [1.0] * 11 + [float("nan")]), (304, [float("inf")] + [1.0] * 11), (305, [1.0] * 5)]
    out = embedding_whitening.whitened(vectors(spark, rows + bad)).collect()
    assert len(out) == len(rows) * 8
    check_whitening(out, rows, 12)


def test_whitening_of_few_dimensions_and_hard_values(spark):
    rows = [(None, [0.5, -3.25]), (1, [1.5, 2.0]), (2, [0.25, 8.0])]
    check_whitening(embedding_whitening.whitened(vectors(spark, rows)).collect(), rows, 2)
    one = embedding_whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {(None, None, None, 0)} and len(one) == 4
    line = embedding_whitening.whitened(vectors(spark, [(i, [float(i), 0.0, 0.0]) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 12)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    far = embedding_whitening.whitened(vectors(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 0.5])])).collect()
    top = (1 << 62) + 100000, -(1 << 62) + 100000, 100000
    exact = [[a, 100000 + b] for a, b in zip(top, (1024, 2048, 512))]
    sums = [sum(c) for c in zip(*exact)]
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(exact)}
    assert {(r["vec_id"], r["deviation"]) for r in far} == {(1, None), (2, None), (3, want[3] if want[3] < 1 << 63 else None)}
    for empty in ([], [(1, None), (2, [])]):
        found = embedding_whitening.whitened(vectors(spark, empty))
        assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_deviation_stays_exact_with_many_rows():
    centre = embedding_whitening.Centre(3_000_000_001, [3_000_000_001 * 100_000 + 17, -5])
    x = np.array([[100_400, -3], [99_999, 1 << 40]])
    want = [sum((centre.n * int(a) - s) ** 2 for a, s in zip(row, centre.sums)) for row in x]
    assert centre.deviations(x) == want


@pytest.mark.parametrize("make", ["random", "clusters", "split", "equal", "diagonal"])
def test_leading_components(make):
    rng = np.random.default_rng(7)
    d = 24
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {"random": rng.random(d) * 100, "clusters": np.repeat([9.0, 9.0 - 1e-9, 3.0], 8), "equal": np.ones(d), "diagonal": np.arange(d) + 1.0, "split": rng.random(d) * 10}[make]
    matrix = np.diag(values) if make == "diagonal" else q @ np.diag(values) @ q.T
    if make == "split":
        matrix[:12, 12:] = matrix[12:, :12] = 0
    matrix = (matrix + matrix.T) / 2
    found, axes = embedding_whitening.leading_components(matrix, 8)
    assert np.allclose(found, np.sort(np.linalg.eigvalsh(matrix))[::-1][:8], rtol=1e-12, atol=1e-12)
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
    assert np.abs(matrix @ axes - axes * found).max() < 1e-11 * np.abs(matrix).max()
    diagonal, off, _ = embedding_whitening.tridiagonal(matrix)
    at = np.array([values.mean() + 0.011, values.max() + 1, values.min() - 1])
    assert embedding_whitening.sturm_count(diagonal, off, at).tolist() == [(np.linalg.eigvalsh(matrix) < a).sum() for a in at]


def brute_audit(docs, labels):
    rows = [(r["doc_id"], r["source"] or "", r["text"] or "") for r in docs.collect()]
    told = labels.collect()
    good = {r["doc_id"] for r in told if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in told if r["toxic"] == 1 and r["doc_id"] is not None}
    judged = []
    for i, part, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and t == text for j, _, t in rows) else set()
        judged.append((i, part, fails))
    out, shapley = [], collections.Counter()
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in mine)
                shapley[part, letter] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted(tuple(r) + (shapley[r[0], r[1][r[2] - 1]],) for r in out)


def test_filter_audit_equals_brute_force(docs, labels, spark):
    more = docs.filter("doc_id < 6").withColumn("source", F.lit(None).cast("string")).unionByName(docs.filter("doc_id = 150").withColumn("doc_id", F.lit(-4).cast("long")))
    table = docs.unionByName(more).withColumn("mask", F.lit("m")).withColumn("part", F.lit(3))
    known = labels.withColumn("n", F.lit(1)).unionByName(labels.filter("doc_id < 9").withColumn("quality", F.lit(0)).withColumn("n", F.lit(2)))
    out = filter_audit.filter_audit(table, known)
    assert sorted(map(tuple, out.collect())) == brute_audit(table, known)
    spark.conf.set("limitlens.broadcastBytes", "0")
    try:
        assert sorted(map(tuple, filter_audit.filter_audit(table, known).collect())) == sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("limitlens.broadcastBytes")


def test_filter_audit_of_empty_tables_and_long_texts(docs, labels, empty, spark):
    assert filter_audit.filter_audit(empty, labels).count() == 0
    out = filter_audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(out) == (0, 0)
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000)), "s"), (2, "same " * 60_000, "s"), (3, "Ab " * 60_000 + "#", None)], "doc_id long, text string, source string")
    none = labels.limit(0)
    assert sorted(map(tuple, filter_audit.filter_audit(long, none).collect())) == brute_audit(long, none)


def test_shapley_weights_equal_all_orders():
    rng = np.random.default_rng(2)
    for players in (2, 3, 5):
        v = [0, *rng.integers(0, 1000, (1 << players) - 1).tolist()]
        want = [0] * players
        for order in itertools.permutations(range(players)):
            held = 0
            for i in order:
                want[i] += v[held | 1 << i] - v[held]
                held |= 1 << i
        assert [sum(w * x for w, x in zip(row, v)) for row in filter_audit.shapley_weights(players)] == want


def test_word_vectors_equal_brute_force(docs, spark):
    texts = docs.select("doc_id", "text")
    head = quality_classifier.head_words(texts, 50)
    counts, sums = collections.Counter(), collections.defaultdict(lambda: np.zeros(quality_classifier.WIDTH))
    for (text,) in texts.select("text").collect():
        pieces = [m for m in re.findall(r"(?:[A-Za-z]|[^\x00-\x7F])+|[0-9]+|[^\sA-Za-z0-9\x80-\U0010FFFF]+", text or "")]
        spelled = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(spelled), np.uint8)
        ends = np.cumsum([len(p) for p in spelled]).astype(np.int64)
        starts = ends - np.array([len(p) for p in spelled], np.int64)
        hashes = quality_classifier._hashes(data, starts, ends)
        index = quality_classifier._index_vectors(hashes, quality_classifier._shapes(data, starts, ends))
        counts.update(hashes.tolist())
        for i, h in enumerate(hashes.tolist()):
            for j in range(max(0, i - 2), min(len(spelled), i + 3)):
                if j != i:
                    sums[h] += index[:, j]
    least = sorted(counts.values(), reverse=True)[49]
    assert {h for h, n in counts.items() if n > least} <= set(head.tolist()) <= {h for h, n in counts.items() if n >= least} and len(head) == 50
    vectors = quality_classifier.word_vectors(texts, head)
    for h, v in zip(head.tolist(), vectors):
        assert np.allclose(v, sums[h] / np.linalg.norm(sums[h]), atol=1e-6)
    # A word outside the head that lies in one text has there the vector it would have in the head.
    one = spark.createDataFrame([(1, "alpha beta gamma beta 12 delta!! alpha")], "doc_id long, text string")
    none = np.zeros(0, np.uint64)
    all_words = quality_classifier.head_words(one, 99)
    full = quality_classifier.document_vectors(one, all_words, quality_classifier.word_vectors(one, all_words)).first()["features"]
    rare = quality_classifier.document_vectors(one, none, np.zeros((0, quality_classifier.WIDTH), np.float32)).first()["features"]
    assert np.allclose(full, rare, atol=1e-5)


def test_features_whatever_the_slices(monkeypatch):
    """Small slices give the sums and features of one slice, neighbours of other texts left out."""
    rng = np.random.default_rng(4)
    words = ["Ab", "cd", "EF", "!!!", "12", "é", "longer-word", "--"]
    texts = pa.array([None, "", *(" ".join(rng.choice(words, n)) for n in rng.integers(1, 40, 60)), "a"])

    def found(limit):
        monkeypatch.setattr(quality_classifier, "_NEAR_BYTES", limit)
        parts = list(quality_classifier._contexts(texts))
        head = np.unique(np.concatenate([p.hashes for p in parts]))[::2]
        total = np.zeros((len(head), quality_classifier.WIDTH), np.int64)
        for part in parts:
            quality_classifier._add_around(total, head, part)
            for low, high in zip(part.bounds[:-1], part.bounds[1:]):
                for i in range(low, high):
                    near = [j for j in range(i - quality_classifier.WINDOW, i + quality_classifier.WINDOW + 1) if j != i and low <= j < high]
                    assert (part.around[:, i] == part.index[:, near].sum(axis=1)).all()
        unit = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        features = list(quality_classifier.pooled(texts, head, unit))
        assert [low for low, _, _ in features[1:]] == [high for _, high, _ in features[:-1]]
        return len(parts), total, np.concatenate([x for _, _, x in features])

    (one, sums, features), (many, some_sums, some_features) = found(1 << 20), found(100)
    assert one == 1 and many > 10
    assert (sums == some_sums).all() and sums.any()
    assert features.shape == (len(texts), quality_classifier._FEATURES) and (features == some_features).all()


def test_index_vectors_are_sparse_and_repeatable():
    hashes = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    index = quality_classifier._index_vectors(hashes, np.zeros(39, np.uint64))
    again = quality_classifier._index_vectors(hashes[::-1], np.zeros(39, np.uint64))[:, ::-1]
    assert (index == again).all()
    assert np.abs(index).sum(axis=0).max() <= 2 * quality_classifier.MARKS
    assert quality_classifier._index_vectors(hashes[:0], hashes[:0]).shape == (quality_classifier.WIDTH, 0)


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    logits = rng.normal(0, 2, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-logits))).astype(int)
    assert quality_classifier.temperature(4 * logits, labels) == pytest.approx(4, rel=0.06)


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality_classifier.train(x, y)
    fresh = rng.normal(size=(2000, 4))
    assert ((net.scores(fresh) >= 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.93


def test_quality(docs, labels, empty, spark):
    junk = docs.filter("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.regexp_replace("text", r" ", " | "))
    table = docs.unionByName(junk).withColumn("score", F.lit("s")).withColumn("features", F.lit(0))
    known = labels.unionByName(junk.selectExpr("doc_id", "0 quality", "0 toxic")).withColumn("n", F.lit(2))
    out = quality_classifier.quality_scores(table, known)
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == table.count()
    right = []
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if held and (r["doc_id"] >= 1000 or r["doc_id"] < 120):
            right.append(r["predicted"] == int(r["doc_id"] < 1000))
    assert len(right) > 20 and np.mean(right) > 0.95
    # Held-out labels change nothing, nor do partitions.
    turned = known.withColumn("quality", F.when(quality_classifier.held_out_fifth(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_scores(table.repartition(7), turned).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["score"])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    assert quality_classifier.quality_scores(empty, known).count() == 0
    alone = quality_classifier.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in alone] == [0.5]


def test_quality_of_very_long_texts(spark):
    rows = [(i, f"word{i % 7} other{i % 5} end " * 30, "s") for i in range(40)] + [(90, "a b c d. " * 200_000, "s"), (91, "x" * 1_500_000, "s"), (92, "| " * 500_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_scores(docs, labels).collect()
    assert len(out) == 43 and all(np.isfinite(r["score"]) for r in out)
