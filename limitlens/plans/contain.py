"""Which texts contain which of many needles, without comparing every text with every needle.

A needle is looked up by one of its grams, the one that is rarest in a look at the texts. A
text's distinct grams are joined with the needles' by equality, and containment is tested on the
pairs that meet. Grams have up to five characters, and as many as the needles where very many
needles have the same few. A few needles are tried on every text instead, which costs less than its
grams. The needles are broadcast, in as many blocks as their measured size asks for. Texts are dealt
out once, whole, since a file may hold all of them in one piece; they are not copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.functions.text import fold
from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import broadcast_limit, measured_bytes

#: Characters of a gram: the largest that the needle has. The empty needle is in every text.
GRAMS = (0, 1, 2, 3, 5)
#: Needles that are tried on every text, without grams, where no more share a size of grams.
FEW = 48
#: Needles of one length that get grams of that length, up to so many characters: more would crowd the grams of five.
CROWD, LONGEST = 20_000, 12
#: Texts looked at for the choice of rare grams. Any choice gives the same pairs.
LOOKED_AT = 2000


def lookup_form(text: Column) -> Column:
    """Upper case, with the letters that only a regex ignoring case takes for K and I."""
    return F.translate(fold(text), "Kİ", "KI")


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_size(text: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """Characters of the grams that a needle is looked up by."""
    out = F.lit(sizes[0])
    for size in sizes[1:]:
        out = F.when(F.length(text) >= size, size).otherwise(out)
    return out


def gram_sizes(needles: DataFrame) -> list[int]:
    """The sizes of grams for the distinct (needle): 0 first, by which a needle meets every text."""
    length = F.least(F.length("needle"), F.lit(LONGEST + 1)).alias("length")
    counts = {r["length"]: r["n"] for r in needles.groupBy(length).agg(F.count("*").alias("n")).collect()}  # a row per length
    sizes = sorted({*GRAMS, *(n for n, count in counts.items() if count > CROWD and n <= LONGEST)})
    held = {size: 0 for size in sizes}
    for n, count in counts.items():
        held[max(s for s in sizes if s <= n)] += count
    return [0, *(size for size in sizes if size and held[size] > FEW)]


def _grams_of(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of all the sizes."""
    parts = [F.when(text.isNotNull(), F.array(F.lit(""))) if n == 0 else grams(text, n) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _with_key(needles: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(needle, key): the needle's rarest gram among some texts; (needle) is distinct and in lookup form."""
    own = F.array(F.lit(""))
    for size in sizes:
        if size:
            own = F.when(gram_size(F.col("needle"), sizes) == size, grams(F.col("needle"), size)).otherwise(own)
    options = needles.select("needle", F.explode(own).alias("key"))
    seen = texts.limit(LOOKED_AT).select(F.explode(_grams_of(F.col("text"), sizes)).alias("key"))
    counts = seen.join(options.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # Of grams as rare as each other any will do: by hash, so that not the same few are taken by all.
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("key").alias("h"), "key")
    return options.join(counts, "key", "left").groupBy("needle").agg(F.min(rank).alias("rarest")).select("needle", "rarest.key")


def containing(texts: DataFrame, text: Column, needles: DataFrame, needle: str = "needle", form_name: str | None = None, dealt: bool = False) -> DataFrame:
    """All columns of ``texts`` with those of ``needles``, for each pair whose text contains the needle, case aside.

    Every row of ``needles`` counts; equal needles are looked up together. The empty needle is
    in every text that is not null. Columns of the two tables must differ. ``form_name`` adds the
    text in lookup form, which is made once per text, under that name. ``dealt`` tells that the texts
    are spread over the tasks already; the result keeps their partitions.
    """
    spark = texts.sparkSession
    taken = {c.lower() for c in [*texts.columns, *needles.columns]}
    body, key, form, row = (next(n for n in (f"__{x}{'_' * i}" for i in range(99)) if n not in taken) for x in ("text", "key", "form", "needle_row"))
    held = materialized(needles.withColumn(form, lookup_form(F.col(needle))).filter(F.col(form).isNotNull()))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = texts if dealt else texts.repartition(parts)
    bodies = spread.withColumn(body, lookup_form(text))
    distinct = held.select(F.col(form).alias("needle")).distinct()
    sizes = gram_sizes(distinct) if not held.isEmpty() else []
    if not sizes:
        none = texts.limit(0).withColumn(form_name, F.lit("")) if form_name else texts.limit(0)
        return none.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in needles.schema.fields])
    keyed = _with_key(distinct, texts.select(lookup_form(text).alias("text")), sizes).toDF(form, key)
    joined = materialized(held.join(keyed, form).withColumn(row, F.struct(*[F.col(f"`{c}`") for c in needles.columns])).select(key, form, row))
    pieces = bodies.withColumn(key, F.explode(_grams_of(F.col(body), sizes)))
    blocks = max(1, -(-measured_bytes(joined) // max(1, broadcast_limit(texts))))

    def pairs(block: int) -> DataFrame:
        part = joined if blocks == 1 else joined.filter(F.pmod(F.xxhash64(form), F.lit(blocks)) == block)
        return pieces.join(F.broadcast(part), key).filter((F.col(key) == F.col(form)) | F.contains(F.col(body), F.col(form)))

    found = reduce(DataFrame.unionAll, map(pairs, range(blocks)))
    extra = [F.col(body).alias(form_name)] if form_name else []
    return found.select(*[F.col(f"`{c}`") for c in texts.columns], *extra, f"{row}.*")
