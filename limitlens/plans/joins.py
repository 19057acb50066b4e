"""Join of a large table with a unique-key lookup, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import fits_broadcast

# Ways a hot key is split when the lookup is too large to broadcast. Only the lookup's rows of
# hot keys are copied this many times.
SALT = 32
# Keys are counted in this many buckets; a bucket with more than one row of HOT_SHARE is hot. At
# most HOT_SHARE of the buckets are, so the copies stay about as many as the lookup's rows.
HOT_BUCKETS = 8192
HOT_SHARE = 256


def salt_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("limitlens.joinSalt", str(SALT)))


def lookup_join(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", bound: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` with ``lookup``, which holds at most one row per key.

    A lookup measured below the broadcast limit is broadcast: ``big`` is not shuffled.
    Beyond it both sides are shuffled on the key, and hot keys on key + salt, so that each
    is spread over ``SALT`` tasks; adaptive skew handling may split those further.

    ``bound`` is a stored table the lookup is grouped from, hence at least as large: its
    size is measured instead. Without one the lookup is written first, since measuring and
    joining would compute it twice.
    """
    keys = list(on)
    if bound is None:
        lookup = bound = materialized(lookup)
    if fits_broadcast(bound):
        return big.join(F.broadcast(lookup), keys, how)
    return salted_join(big, lookup, keys, how)


def salted_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """The join by shuffle. ``big`` is read once more before it, for the counts of its keys.

    Never a broadcast: the files of a lookup may be far smaller than its rows.
    """
    keys = list(on)
    n = salt_count(big)
    alike = _hash_alike(big, lookup, keys)
    hot = hot_buckets(big, keys) if n > 1 and alike else []
    if n <= 1 or (alike and not hot):
        return big.join(lookup.hint("merge"), keys, how)
    # The salt is a hash of the row, so a re-run task sends its rows where they went before.
    none, is_hot = F.lit(0), _key_bucket(big, keys).isin(hot) if alike else F.lit(True)
    salted = big.withColumn("__salt", F.when(is_hot, row_bucket(big, n)).otherwise(none))
    every = F.when(is_hot, F.sequence(none, F.lit(n - 1))).otherwise(F.array(none))
    copies = lookup.withColumn("__salt", F.explode(every))
    return salted.join(copies.hint("merge"), keys + ["__salt"], how).drop("__salt")


def hot_buckets(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Buckets of keys that hold more than one row of ``HOT_SHARE``: fewer than that, counted before the shuffle."""
    counts = df.groupBy(_key_bucket(df, keys).alias("bucket")).agg(F.count("*").alias("n"))
    rows = counts.collect()  # at most HOT_BUCKETS rows of two numbers
    total = sum(r["n"] for r in rows)
    return sorted(r["bucket"] for r in rows if r["n"] * HOT_SHARE > total)


def _key_bucket(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(HOT_BUCKETS)).cast("int")


def _hash_alike(big: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: of one type on both sides, and not floating."""
    kinds, own = ({f.name.lower(): f.dataType for f in d.schema.fields} for d in (big, lookup))
    return all(kinds[k.lower()] == own[k.lower()] and not isinstance(own[k.lower()], (T.FloatType, T.DoubleType)) for k in keys)


def row_bucket(df: DataFrame, n: int) -> Column:
    """Bucket 0..n-1 from the row's content; map columns cannot be hashed and are left out."""
    hashed = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int")
