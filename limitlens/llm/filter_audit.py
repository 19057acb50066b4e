"""How document filters interact: what each removes in every order, and its fair share.

Every document gets a mask of the filters it fails. Per part, the removals of all 32
coalitions of filters are tabulated from the counted masks. The Shapley share is the exact
solution of the constrained least squares problem over the coalitions: the normal equations,
weighted by the Shapley kernel and constrained to efficiency, are solved once in rationals
for the unit games, which gives whole weights that are applied to the coalition removals.
What a step of an order removes is the difference of two coalitions.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import fits_broadcast

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_ORDERS = factorial(len(FILTERS))
_STEP = "array<struct<filter_order:string,step:int,bit:int,before:int,after:int>>"


def solve_rational(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solution of ``matrix`` x = ``right`` for every column of ``right``, by exact elimination."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        scale = rows[i][i]
        rows[i] = [x / scale for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(players: int) -> list[list[int]]:
    """Weights of the values of all coalitions in each player's Shapley value, times players!.

    Minimises the sum over proper coalitions of kernel * (v(S) - v(none) - sum of the shares in
    S) ** 2, where the shares add up to v(all) - v(none). The minimum is linear in v, so the
    equations are solved for the game of each coalition alone.
    """
    size, full = 1 << players, (1 << players) - 1
    normal = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [[Fraction(0)] * size for _ in range(players + 1)]
    for s in range(1, full):
        held = s.bit_count()
        kernel = Fraction(players - 1, comb(players, held) * held * (players - held))
        inside = [i for i in range(players) if s >> i & 1]
        for i in inside:
            for j in inside:
                normal[i][j] += kernel
            right[i][s] += kernel
            right[i][0] -= kernel
    for i in range(players):  # efficiency, by a multiplier
        normal[i][players] = normal[players][i] = Fraction(1)
    right[players][full] += 1
    right[players][0] -= 1
    solved = solve_rational(normal, right)[:players]
    whole = [[x * factorial(players) for x in row] for row in solved]
    assert all(x.denominator == 1 for row in whole for x in row)
    return [[int(x) for x in row] for row in whole]


def _steps() -> list[dict]:
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step + 1, "bit": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return out


def failure_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone: A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failures = (n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) per row: the filters that its whole text fails.

    A null text is an empty one and a null part the empty string. E holds for a row whose text
    a smaller id has anywhere in the table; rows that repeat one id and text don't fail it by
    that, nor does a row without id. Texts are compared by SHA-256.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    judged = materialized(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
        .select("doc_id", "part", failure_mask(F.col("body")).alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))
    )
    shared = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return lookup_join(judged, shared, ["digest"]).select("doc_id", "part", F.when(repeated, F.col("mask") + F.lit(1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))


def coalitions(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, total, v, good, toxic): rows that each of the 32 sets of filters removes.

    ``good`` and ``toxic`` count removed rows that any row of ``labels`` gives quality 1 or
    toxic 1. Rows of one id, part and mask are counted before the join, so a repeated id is
    not a hot key.
    """
    counted = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = materialized(labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).filter("good or toxic"))
    told = counted.join(F.broadcast(known) if fits_broadcast(known) else known, "doc_id", "left")
    cells = told.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    # 32 cells of a part at most.
    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def removals(name: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.transform(
            F.sequence(F.lit(0), F.lit(_ALL)),
            lambda s: F.aggregate("cells", zero, lambda held, c: held + F.when(c["mask"].bitwiseAND(s) != 0, c[name]).otherwise(zero)),
        )

    total = F.aggregate("cells", F.lit(0).cast("long"), lambda held, c: held + c["n"])
    return grouped.select("part", total.alias("total"), removals("n").alias("v"), removals("good").alias("good"), removals("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step, with what the step does.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (removals of the
    step's filter summed over all orders) count rows of ``docs``. Repeated rows count each.
    Further columns are ignored, whatever their names; texts are judged whole, however long.
    An empty table has no parts and gives no rows; labels without rows lose nothing.
    """
    table = coalitions(failures(docs, key, text, part), labels, key)
    weights = F.from_json(F.lit(json.dumps(shapley_weights(len(FILTERS)))), "array<array<long>>")
    zero = F.lit(0).cast("long")
    shares = F.transform(weights, lambda row: F.aggregate(F.zip_with(row, F.col("v"), lambda w, v: w * v), zero, lambda held, x: held + x))
    steps = F.explode(F.from_json(F.lit(json.dumps(_steps())), _STEP))
    at = lambda c, mask: F.element_at(c, mask + 1)
    s = F.col("s")
    alone = s["after"] - s["before"]  # the bit of the step's filter
    removed = at("v", s["after"]) - at("v", s["before"])
    return table.withColumn("shares", shares).withColumn("s", steps).select(
        "part", s["filter_order"].alias("filter_order"), s["step"].alias("step"),
        (F.col("total") - at("v", s["after"])).alias("kept"),
        removed.alias("removed"),
        (at("v", alone) - removed).alias("redundant"),
        (at("v", F.lit(_ALL)) - at("v", F.lit(_ALL) - alone)).alias("unique_fails"),
        (at("good", s["after"]) - at("good", s["before"])).alias("good_lost"),
        (at("toxic", s["after"]) - at("toxic", s["before"])).alias("toxic_lost"),
        at("shares", s["bit"]).alias("shapley"),
    )
