"""URL filter: rules first, then naive Bayes over segmented host and path words.

A unigram model of words, counted over the pages' own text, splits concatenated host names
by Viterbi. Multinomial naive Bayes is trained on all URLs: those whose words hold a seed
word are block examples, the others allow examples. Its tokens are the segmented words of
host and path.

All counts stay Spark tables. Of words, runs of letters and tokens the most frequent are
broadcast; the others, rare by choice, are joined, so no key of those joins is hot. Each
distinct run of letters is split once, knowing the rare words among its substrings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.reuse import materialized

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
# Words that name what a corpus should not take in.
SEEDS = (
    "adult ads advert banner bet bets betting bitcoin bonus casino cheap cialis dating escort farm free gamble gambling jackpot "
    "loan loans lottery malware payday pharma pharmacy phish pills poker porn promo replica seo sex sexy slots spam "
    "sweepstakes torrent track tracker tracking viagra warez win winner xxx"
).split()
#: Words broadcast with their counts at most, and the longest that is looked up.
VOCABULARY, LONGEST = 100_000, 24
#: Tokens, and runs of letters, broadcast at most.
TOKENS = 100_000

_WORD = re.compile("[a-z]+|[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``; both empty for a null url or one without it."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _least(table: DataFrame, size: int) -> int:
    """A count that at most ``size`` rows of (.., n) reach."""
    # Counts in steps of an eighth of a power of two: a few hundred rows.
    step = F.floor(F.log2("n") * 8)
    steps = table.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, np.iinfo(np.int64).max
    for row in steps:
        held += row["rows"]
        if held > size:
            break
        least = row["least"]
    return int(least)


def _joined(big: DataFrame, lookup: DataFrame, on: str, size: int) -> DataFrame:
    """Inner join with the stored ``lookup`` (on, n, ..), which has each key of ``big`` once.

    ``n`` counts the rows of ``big``: the most frequent keys are broadcast, the rest is joined.
    """
    least = _least(lookup, size)
    head = F.broadcast(lookup.filter(F.col("n") >= least).drop("n"))
    rest = big.join(F.broadcast(lookup.filter(F.col("n") >= least).select(on)), on, "left_anti")
    return big.join(head, on).unionByName(rest.join(lookup.filter(F.col("n") < least).drop("n"), on))


@dataclass
class WordModel:
    """Log probabilities of the frequent words and the seeds, and the counts of the others."""

    head: dict[str, float]
    rare: DataFrame  # (word, n)
    total: int


def word_model(texts: DataFrame, text: str, seeds: Sequence[str] = SEEDS, size: int = VOCABULARY) -> WordModel:
    """Unigram model of all words a-z of all texts, seeds included; at most ``size`` and the seeds are in the head.

    Markup is left out. Seeds count as often as the most frequent word of two letters or
    more, so that they are found inside names.
    """
    plain = F.regexp_replace(F.lower(F.col(text).cast("string")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    counts = materialized(
        texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?<!\p{L})[a-z]{2,24}(?!\p{L})"), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    least = _least(counts, size)
    sums = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    most, total = sums["most"] or 1, sums["n"] or 0
    top = {r["word"]: r["n"] for r in counts.filter((F.col("n") >= least) | F.col("word").isin(*seeds)).toLocalIterator()}
    for word in dict.fromkeys(seeds):
        total += most - top.get(word, 0)
        top[word] = most
    rare = counts.filter((F.col("n") < least) & ~F.col("word").isin(*seeds))
    return WordModel({w: float(np.log(n / total)) for w, n in top.items()}, rare, total)


def segment(name: str, model: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most likely split of a run of letters into words; unknown letters cost dearly."""
    unknown = -25.0
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        value, start = max(
            (best[s] + model.get(name[s:end], unknown * (end - s)), -s) for s in range(max(0, end - longest), end)
        )
        best.append(value)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _substrings(name: str, longest: int = LONGEST, step: int = 1000):
    """Sets of the substrings that begin in each ``step`` letters."""
    for low in range(0, len(name), step):
        yield {name[s:e] for s in range(low, min(low + step, len(name))) for e in range(s + 2, min(len(name), s + longest) + 1)}


def url_runs(parts: DataFrame) -> DataFrame:
    """(row, side, run) for each run of letters of host (h) and path (p); a run of digits is #."""

    def run(batches):
        for batch in batches:
            rows, sides, runs = [], [], []
            for row, *texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for side, text in zip("hp", texts):
                    for word in _WORD.findall(text.lower()):
                        rows.append(row)
                        sides.append(side)
                        runs.append("#" if word[0].isdigit() else word)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sides, pa.string()), pa.array(runs, pa.string())], ["row", "side", "run"])

    return W.map_batches(parts.select("row", "host", "path"), run, "row long, side string, run string")


def split_runs(runs: DataFrame, model: WordModel) -> DataFrame:
    """(run, n, words) of distinct runs (run, n): the words of the most likely split."""
    held = runs.sparkSession.sparkContext.broadcast(model.head)

    def candidates(batches):
        head = held.value
        for batch in batches:
            keys, words = [], []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for some in _substrings(name):
                    new = [w for w in some if w not in head]
                    keys += [key] * len(new)
                    words += new
                    if len(words) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words)], ["key", "word"])
                        keys, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["key", "word"])

    def split(batches):
        head = dict(held.value)
        for batch in batches:
            names = batch.column(0).to_pylist()
            out = []
            for name, rare in zip(names, batch.column(2).to_pylist()):
                more = {r["word"]: r["value"] for r in rare or ()}
                head.update(more)
                out.append(segment(name, head))
                for word in more:
                    del head[word]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["run", "n", "words"])

    value = F.log(F.col("n") / float(model.total))
    if model.rare.isEmpty():
        known = runs.withColumn("rare", F.expr("cast(null as array<struct<word:string,value:double>>)"))
    else:
        # At most 24 words for each letter of a run; a digest stands for the run, which may be long.
        runs = runs.withColumn("key", F.md5("run"))
        found = W.map_batches(runs.select("key", "run"), candidates, "key string, word string").join(model.rare.select("word", value.alias("value")), "word")
        known = runs.join(found.groupBy("key").agg(F.collect_set(F.struct("word", "value")).alias("rare")), "key", "left")
    return materialized(W.map_batches(known.select("run", "n", "rare"), split, "run string, n long, words array<string>"))


def url_tokens(parts: DataFrame, model: WordModel, seeds: Sequence[str] = SEEDS, size: int = TOKENS) -> DataFrame:
    """(row, tokens, block) of the rows with tokens; block is 1 where a word is a seed."""
    runs = materialized(url_runs(parts))
    split = split_runs(materialized(runs.groupBy("run").agg(F.count("*").alias("n"))), model)
    words = _joined(runs, split, "run", size).select("row", "side", F.explode("words").alias("word"))
    return materialized(
        words.groupBy("row").agg(F.collect_list(F.concat_ws(":", "side", "word")).alias("tokens"), F.max(F.col("word").isin(*seeds).cast("int")).alias("block"))
    )


def train_naive_bayes(tokens: DataFrame, urls: int) -> tuple[DataFrame, float]:
    """(token, n, odds) with log odds block : allow, and those of the prior, counted over all URLs."""
    table = materialized(
        tokens.select("block", F.explode("tokens").alias("token")).groupBy("token")
        .agg(F.sum("block").alias("b"), F.sum(1 - F.col("block")).alias("a"), F.count("*").alias("n"))
    )
    blocked = tokens.filter("block = 1").count()
    sums = table.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    base = float(np.log(((sums["a"] or 0) + sums["v"] + 1) / ((sums["b"] or 0) + sums["v"] + 1)))
    odds = F.log((F.col("b") + 1) / (F.col("a") + 1)) + base
    return table.select("token", "n", odds.alias("odds")), float(np.log((blocked + 1) / (urls - blocked + 1)))


def url_verdicts(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, head_words: int = VOCABULARY, head_tokens: int = TOKENS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row.

    verdict is that of the longest rule that fits, else block where naive Bayes gives block
    a probability (score) of one half or more. A null or schemeless url has empty host and
    path, no rule, and no tokens: the prior decides, with ties blocked. Repeated rows each
    count and return a row; null ids pass through. Further columns are ignored. The heads
    only say what is broadcast; results don't depend on them.
    """
    model = word_model(pages, text, seeds, head_words)
    host, path = host_and_path(F.col(url))
    # Rows are numbered once and stored, so that every reader sees the same numbers.
    parts = materialized(
        pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    )
    tokens = url_tokens(parts, model, seeds, head_tokens)
    odds, prior = train_naive_bayes(tokens, parts.count())
    # Added in order of size, so that the sum is the same in every run.
    total = F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda s, v: s + v)
    sums = _joined(tokens.select("row", F.explode("tokens").alias("token")), odds, "token", head_tokens).groupBy("row").agg(total.alias("total"))
    clipped = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.coalesce("total", F.lit(0.0)) + prior))
    judged = parts.join(sums, "row", "left").withColumn("score", 1 / (1 + F.exp(-clipped)))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(said, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )
