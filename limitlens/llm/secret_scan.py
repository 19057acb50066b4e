"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Patterns give candidates with their positions. Hashes of all candidates are counted over the
whole corpus by distinct repository and owner. A value at three owners or more, or at two in
more than three repositories, is a widely copied example; any other is owner-specific, so a
second copy of a document takes nothing from its secrets. Base candidates are always
reported; of the other tokens those are added that are owner-specific and look random. Only
what is owner-specific and looks random is redacted. Values leave a row only as SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limitlens.llm import words as W
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

# The base patterns, in the order their kinds sort. Runs of a character class
# are maximal, so a minimal length may stand in the pattern; for "assign" it may not.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "token")
#: Tokens that may be secrets of no known form.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 6
#: Distinct characters a live-looking value has at least.
MIN_DISTINCT = 8
#: Owners of an owner-specific value at most, and its repositories where it has several owners.
MAX_OWNERS, MAX_REPOS = 2, 3

_CHUNK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _starts(widths: Column, pieces: Column) -> Column:
    """0-based start of each match, from the lengths of the pieces before and the matches.

    Sums run over chunks, so that thousands of matches don't take their square in steps.
    """
    chunks = F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / _CHUNK).cast("int"))

    def within(sums: Column) -> Column:
        offsets = F.transform(chunks, lambda c: _sum(F.slice(sums, F.lit(1), c)))
        return _let(offsets, lambda held: F.transform(widths, lambda _, i: F.get(held, F.floor(i / _CHUNK).cast("int")) + _sum(F.slice(widths, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)) + F.length(F.get(pieces, i))))

    return _let(F.transform(chunks, lambda c: _sum(F.slice(widths, c * _CHUNK + 1, F.lit(_CHUNK)))), within)


def _found(text: Column, pattern: str, kind: int, value: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Array of (start, kind, end, hash, live) of one pattern, in code points."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>)")

    def placed(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        return _let(pieces, lambda p: _let(F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(p, i))), lambda w: _let(_starts(w, p), lambda s: F.transform(matches, lambda m, i: _let(value(m), lambda v: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), (F.get(s, i) + F.length(m)).alias("end"), F.when(keep(v), F.sha2(v, 256)).alias("hash"), live_looking(v).alias("live")))))))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, F.filter(placed(m), lambda s: s["hash"].isNotNull())).otherwise(none))


def live_looking(value: Column) -> Column:
    """Letters and digits in no evident order: enough distinct characters and both classes."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def candidates(text: Column) -> Column:
    """All candidates of a text; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    every = lambda v: F.lit(True)
    mixed = lambda v: live_looking(v) & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.concat(
        _found(text, ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.length(v) >= MIN_ASSIGNED),
        _found(text, ACCESS, 1, lambda m: m, every),
        _found(text, HEX, 2, lambda m: m, every),
        _found(text, TOKEN, 3, lambda m: m, mixed),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of candidates (hash, owner, repo): three combined aggregates.

    Null owners and repositories count as one owner and one repository named "".
    """
    repos = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, keep: Sequence[Column], text: str, owner: Column, repo: Column) -> DataFrame:
    """Thin table of all rows: ``keep``, owner, repo, candidates, digest of texts that have some."""
    empty = F.lit("")
    rows = docs.select(
        *keep, F.coalesce(owner.cast("string"), empty).alias("owner"), F.coalesce(repo.cast("string"), empty).alias("repo"),
        F.col(text).cast("string").alias("text"), F.array_sort(candidates(F.col(text))).alias("found"),
    )
    digest = F.when(F.size("found") > 0, F.sha2("text", 256))
    return materialized(rows.withColumn("digest", digest).drop("text"))


def _judged(scanned: DataFrame, max_owners: int, max_repos: int, base: bool = True) -> DataFrame:
    """Per distinct text with candidates: reported spans, merged regions, live and copied counts.

    Without ``base`` the base candidates are reported only where they are owner-specific and live-looking.
    """
    some = scanned.filter("digest is not null")
    stats = materialized(ownership(some.select("owner", "repo", F.explode("found.hash").alias("hash"))))
    rows = materialized(some.groupBy("digest").agg(F.first("found").alias("found"))).select("digest", F.inline("found"))
    known = lookup_join(rows, stats, ["hash"], "left", bound=stats)
    copied = (F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > max_repos))
    reported = known.withColumn("copied", copied).withColumn("own", F.col("live") & ~F.col("copied"))
    reported = reported.filter(F.col("own") | (F.col("kind") < 3) if base else F.col("own"))
    before = Window.partitionBy("digest").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    reported = reported.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    return materialized(
        reported.groupBy("digest").agg(
            F.array_sort(F.collect_list(F.struct("start", "kind", "end", "from"))).alias("spans"),
            F.max("end").alias("last"),
            F.count(F.when(F.col("own"), 1)).alias("n_live"),
            F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        )
    )


def _owner_columns(owner: str | Column, repo: str | Column | None) -> tuple[Column, Column]:
    named = lambda c: F.col(c) if isinstance(c, str) else c
    return named(owner), named(owner if repo is None else repo)


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repo: str | Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) per row.

    spans lists kind:start:end by start, then kind as listed, in code points with the end
    exclusive: all base matches, and tokens that look live and are owner-specific.
    n_live counts the reported spans whose value is owner-specific and live-looking, n_copied
    those of widely copied values. ``repo`` is the owner where none is given.

    Null and empty texts have no spans; repeated rows each return a row and count as one
    repository; values at the same place in several kinds are all reported. Nulls in owner
    or repo are one owner. Further columns are ignored.
    """
    owner_col, repo_col = _owner_columns(owner, repo)
    scanned = _scanned(docs, [F.col(key).alias("doc_id")], text, owner_col, repo_col)
    judged = _judged(scanned, max_owners, max_repos)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    told = judged.select("digest", _spelled(F.col("spans")).alias("spans"), "n_live", "n_copied")
    thin = scanned.select(
        "doc_id", "digest", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_spelled(base), 256).alias("base_sha256")
    )
    return lookup_join(thin, told, ["digest"], "left", bound=judged).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", owner: str | Column = "source", repo: str | Column | None = None, mark: str = "<secret>", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """All rows and columns of ``docs`` with each run of live, owner-specific spans replaced by ``mark``."""
    owner_col, repo_col = _owner_columns(owner, repo)
    digest, spans, last = (W.fresh(docs, c) for c in ("__digest", "__spans", "__last"))
    judged = _judged(_scanned(docs, [], text, owner_col, repo_col), max_owners, max_repos, base=False).select(F.col("digest").alias(digest), F.col("spans").alias(spans), F.col("last").alias(last))
    whole = F.col(text)
    pieces = F.transform(spans, lambda s: F.when(s["start"] >= s["from"], F.concat(F.substring(whole, s["from"] + 1, s["start"] - s["from"]), F.lit(mark))).otherwise(""))
    cleaned = F.concat(F.array_join(pieces, ""), F.substring(whole, F.col(last) + 1, F.length(whole)))
    marked = lookup_join(docs.withColumn(digest, F.sha2(whole.cast("string"), 256)), judged, [digest], "left")
    new = F.when(F.col(last).isNull(), whole).otherwise(cleaned)
    return marked.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
