"""Toxicity by weak supervision.

Many lexicon and pattern voters look at each text, and two voters that know words and word
beginnings learned from labels: Spark counts in how many labelled texts of each label a word
or beginning is dense, over all labelled rows that may be learned from. A generative model over their votes
estimates, by expectation maximisation over the counted vote patterns of all documents, how
each voter votes on toxic and on clean texts, and which voters depend on each other: a
voter's distribution may depend on one other voter, chosen by conditional mutual information.
Known labels of training rows enter as one more, imperfect voter. A linear classifier is then
trained on the posterior labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

# Words that insult, by what they say, in the languages of the corpus.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid stupidity imbecile dumb dumbass fool dimwit halfwit brainless retard idiota estúpido estúpida imbécil tonto crétin débile stupide dummkopf trottel blöd idiotisch",
    "worth": "loser losers worthless pathetic useless failure inútil patético perdedor minable pitoyable wertlos erbärmlich versager",
    "filth": "scum trash garbage filth filthy vermin parasite basura escoria ordure déchet vermine abschaum müll dreck",
    "disgust": "disgusting repulsive sickening revolting nasty asqueroso repugnante dégoûtant répugnant ekelhaft widerlich",
    "mockery": "clown clowns freak freaks creep jerk weirdo payaso bouffon clownesque",
    "swearing": "fuck fucking fucked shit shitty bullshit asshole bitch bastard cunt dick whore slut mierda puta cabrón putain merde connard salope scheisse scheiße arschloch hure",
    "threat": "kill murder destroy strangle muérete matar crève tuer stirb töten umbringen",
}
VOTERS = (*LEXICONS, "several", "dense", "masked", "shouting", "learned words", "learned beginnings")
#: Learned vocabulary: bytes of a word's beginning, the last stands for the whole word; share
#: of a text's words from which on one is dense; hash buckets that counts are kept in.
BEGINNINGS, DENSE, BUCKETS = (2, 3, 4, 5, 6, 8, 0), 0.005, 1 << 20
#: A bucket has evidence from so many toxic texts, and weighs its log odds less so many standard errors.
EVIDENCE, ERRORS = 3, 2.0
#: Weight from which on the learned voters vote for: odds of three.
_SURE = float(np.log(3))
#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 40_000
_VALUES = 3  # against, abstain, for

_TERMS = [(w, i) for i, text in enumerate(LEXICONS.values()) for w in text.split()]
_FEATURES = 2 * len(LEXICONS) + 6 + 2 * len(BEGINNINGS)


def _term_table() -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.texts(pa.array([w for w, _ in _TERMS]))
    hashes = W.span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], np.array([i for _, i in _TERMS])[order]


def _dense(data, starts, ends, bounds):
    """(text, bucket, share of the text's words) of the dense words or beginnings of each kind."""
    words = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), words)
    for length in BEGINNINGS:
        hashes = W.span_hashes(data, starts, np.minimum(ends, starts + length) if length else ends)
        bucket = (W.mix(hashes + np.uint64(length)) % np.uint64(BUCKETS)).astype(np.int64)
        key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
        share = n / np.maximum(words[key // BUCKETS], 1)
        at = np.flatnonzero(share >= DENSE)
        yield key[at] // BUCKETS, key[at] % BUCKETS, share[at]


def _observe(column, learned: np.ndarray):
    """(first row, row after the last, votes -1/0/1, features) of each slice of texts."""
    terms, kinds = _term_table()
    k = len(LEXICONS)
    for low, high, data, offsets in W.text_slices(column):
        n = high - low
        upper = W.counts_between((data >= 65) & (data <= 90), offsets)
        letters = W.counts_between(((data | 32) >= 97) & ((data | 32) <= 122), offsets)
        bang = W.counts_between(data == 33, offsets)
        star = np.zeros(len(data), bool)
        star[1:-1] = (data[1:-1] == 42) & ((data[:-2] | 32) >= 97) & ((data[:-2] | 32) <= 122) & ((data[2:] == 42) | (((data[2:] | 32) >= 97) & ((data[2:] | 32) <= 122)))
        masked = W.counts_between(star, offsets)
        lowered = W.LOWER[data]
        starts, ends, bounds = W.spans(lowered, offsets, W.PLAIN)
        hashes = W.span_hashes(lowered, starts, ends)
        at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == hashes)
        owner = np.searchsorted(bounds, hit, side="right") - 1
        hits = np.bincount(owner * k + kinds[at[hit]], minlength=n * k).reshape(n, k)
        pairs = np.unique(owner * len(terms) + at[hit])
        distinct = np.bincount(pairs // len(terms), minlength=n)
        total, words = hits.sum(axis=1), np.diff(bounds)
        density = total / np.maximum(words, 1)
        shout = upper / np.maximum(letters, 1)
        votes = np.zeros((n, len(VOTERS)), np.int64)
        votes[:, :k] = hits > 0
        votes[:, k] = np.where(distinct >= 2, 1, np.where(total == 0, -1, 0))
        votes[:, k + 1] = np.where(density >= 0.005, 1, np.where(total == 0, -1, 0))
        votes[:, k + 2] = masked > 0
        votes[:, k + 3] = np.where((letters >= 20) & (shout > 0.5), 1, 0)
        strongest, weighed = np.zeros((n, len(BEGINNINGS))), np.zeros((n, len(BEGINNINGS)))
        for i, (row, bucket, share) in enumerate(_dense(lowered, starts, ends, bounds)):
            np.maximum.at(strongest[:, i], row, learned[bucket])
            weighed[:, i] = np.bincount(row, learned[bucket] * np.minimum(share * 20, 1), n)
        for voter, best in ((k + 4, strongest[:, -1]), (k + 5, strongest[:, :-1].max(axis=1))):
            votes[:, voter] = np.where(best >= _SURE, 1, np.where(best == 0, -1, 0))
        features = np.concatenate([
            np.log1p(hits), hits > 0, np.stack([total > 0, np.log1p(distinct), np.minimum(density * 20, 1), np.log1p(masked), shout, np.minimum(bang / np.maximum(words, 1), 1)], axis=1),
            strongest, np.log1p(weighed),
        ], axis=1)
        yield low, high, votes, features.astype(float)


@dataclass
class Model:
    """Classifier weights (the last is the bias), and what the label model found."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    accuracy: dict[str, float]
    depends: dict[str, str]

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray, list[int]]:
    """Posterior of each vote pattern, prior, P(vote for | class) per voter, and parents.

    ``votes`` are patterns in {0, 1, 2}, the last column the label where one is known, else 1;
    ``counts`` says how many documents show each.
    """
    n, m = votes.shape
    weight = counts.astype(float)
    # Start: the share of label 1 among labelled rows with the same votes, and the prior.
    _, same = np.unique(votes[:, :-1], axis=0, return_inverse=True)
    same, label = same.ravel(), votes[:, -1]
    toxic, told = (np.bincount(same, weight * keep, same.max() + 1) for keep in (label == 2, label != 1))
    post = np.clip((toxic[same] + prior) / (told[same] + 1), 0.001, 0.999)
    parent = [-1] * m
    hot = np.stack([votes == v for v in range(_VALUES)]).astype(float)  # value, pattern, voter
    smooth = 1.0

    def fit(post):
        both = np.stack([weight * (1 - post), weight * post])
        tables = []
        for j in range(m):
            if parent[j] < 0:
                t = both @ hot[:, :, j].T + smooth  # class, value
            else:
                t = np.einsum("cn,pn,vn->cpv", both, hot[:, :, parent[j]], hot[:, :, j]) + smooth / _VALUES
            tables.append(t / t.sum(axis=-1, keepdims=True))
        # Labels name the classes: where one is given it is right in at least nine of ten cases
        # of its class, so that the classes can't drift to something else the voters share.
        given = tables[-1]
        for c, right in ((0, 0), (1, 2)):
            share = given[c, [0, 2]].sum()
            sure = max(given[c, right] / share, 0.9)
            given[c, right], given[c, 2 - right] = sure * share, (1 - sure) * share
        return both.sum(axis=1), tables

    def posterior(classes, tables):
        logs = np.tile(np.log(classes / classes.sum()), (n, 1))
        for j, t in enumerate(tables):
            logs += np.log(t[:, votes[:, j]] if t.ndim == 2 else t[:, votes[:, parent[j]], votes[:, j]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    for step in range(rounds):
        if step in (1, rounds // 2):
            parent = _parents(hot, np.stack([weight * (1 - post), weight * post]))
        classes, tables = fit(post)
        post = posterior(classes, tables)
    both = np.stack([weight * (1 - post), weight * post])
    rates = (both @ hot[2] + smooth) / (both.sum(axis=1)[:, None] + 2 * smooth)
    return post, float(classes[1] / classes.sum()), rates, parent


def _parents(hot: np.ndarray, both: np.ndarray, least: float = 0.005) -> list[int]:
    """A spanning forest over voters by mutual information given the class."""
    m = hot.shape[2] - 1  # the label depends on the class alone
    hot = hot[:, :, :m]
    joint = np.einsum("cn,pnj,vnk->cjkpv", both, hot, hot) + 1e-9
    p = joint / joint.sum(axis=(0, 3, 4), keepdims=True)
    pc = p.sum(axis=(3, 4), keepdims=True)
    information = (p * np.log(p * pc / (p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)))).sum(axis=(0, 3, 4))
    parent, reached = [-1] * (m + 1), {0}
    while len(reached) < m:
        value, a, b = max((information[a, b], -a, -b) for a in reached for b in range(m) if b not in reached)
        if value >= least:
            parent[-b] = -a
        reached.add(-b)
    return parent


def linear_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Newton steps: weights with bias, means, scales."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (target - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _known(labels: DataFrame, learn, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    return (
        labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)").filter(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def learned_weights(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weight of each bucket of words and beginnings, 0 where nothing speaks for toxic.

    All labelled rows that ``learn`` lets through are counted: in how many texts of each label
    something of the bucket is dense. The weight is the lower bound of the log odds.
    """

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for low, high, data, offsets in W.text_slices(batch.column(1)):
                lowered = W.LOWER[data]
                for row, bucket, _ in _dense(lowered, *W.spans(lowered, offsets, W.PLAIN)):
                    for v in (0, 1):
                        np.add.at(seen[v], bucket[label[low:high][row] == v], 1)
        at = np.flatnonzero(seen.any(axis=0))
        for cut in range(0, len(at), 1 << 16):
            part = at[cut : cut + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])], ["bucket", "clean", "toxic"])

    known = materialized(_known(labels, learn))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = lookup_join(texts, known, ["doc_id"], "inner", bound=known).select("label", "text")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    out = np.zeros(BUCKETS, np.float32)
    if len(sizes) < 2:
        return out
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / (sizes[1] + 1.0)) - F.log(c / (sizes[0] + 1.0)) - ERRORS * F.sqrt(1 / t + 1 / c)
    found = (
        W.map_batches(told, count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= EVIDENCE).select("bucket", weight.alias("weight")).filter("weight > 0").toArrow()
    )  # a row for each bucket at most
    out[found["bucket"].to_numpy()] = found["weight"].to_numpy()
    return out


def observations(docs: DataFrame, learned: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pattern, features) per row; a null text is an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        for batch in batches:
            for low, high, votes, features in _observe(batch.column(1), held.value):
                spelled = ["".join(map(str, row)) for row in (votes + 1).tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * _FEATURES), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(spelled), lists], ["doc_id", "pattern", "features"])

    return W.map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), 
        run, "doc_id long, pattern string, features array<double>"
    )


def fit(observed: DataFrame, labels: DataFrame, learn, key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Label model over the votes of all rows, and classifier on the posterior labels.

    ``learn`` is a condition on doc_id: only labels of such rows are used. Label rows without
    id or label, or with other values than 0 and 1, are ignored; of repeated ones the largest
    counts. Without usable rows every text scores the prior.
    """
    joined = materialized(observed.join(_known(labels, learn, key, label), "doc_id", "left"))
    # At most 3 rows for each pattern of votes.
    table = joined.groupBy("pattern", "label").agg(F.count("*").alias("n")).orderBy("pattern", "label").toArrow().to_pylist()
    told = {v: sum(r["n"] for r in table if r["label"] == v) for v in (0, 1)}
    prior = (told[1] + 1) / (told[0] + told[1] + 2) if told[0] + told[1] else 0.5
    zero = Model(np.append(np.zeros(_FEATURES), np.log(prior / (1 - prior))), np.zeros(_FEATURES), np.ones(_FEATURES), prior, {}, {})
    if not told[0] or not told[1]:
        return zero
    votes = np.array([[int(c) for c in r["pattern"]] + [1 if r["label"] is None else 2 * r["label"]] for r in table])
    posterior, prior, rates, parent = label_model(votes, np.array([r["n"] for r in table]), prior)
    names = (*VOTERS, "label")
    of = {(r["pattern"], r["label"]): p for r, p in zip(table, posterior)}
    rows = (
        joined.filter("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("pattern", "label", "features").toArrow()
    )  # the bounded sample of labelled rows
    x = np.array(rows["features"].to_pylist())
    target = np.array([of[p, y] for p, y in zip(rows["pattern"].to_pylist(), rows["label"].to_pylist())])
    weights, mean, scale = linear_classifier(x, target)
    accuracy = {v: float(r[1] * prior / (r[1] * prior + r[0] * (1 - prior))) for v, r in zip(names, rates.T)}
    return Model(weights, mean, scale, prior, accuracy, {names[j]: names[p] for j, p in enumerate(parent) if p >= 0})


def scored(observed: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of observations."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            x = np.asarray(column.flatten()).reshape(-1, _FEATURES)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return W.map_batches(observed.select("doc_id", "features"), run, "doc_id long, score double, predicted int")


def held_out_fifth(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    score is the classifier's probability of label 1; predicted is 1 from 0.5 on. Null and
    empty texts have no votes for and score like other texts without any. A row with a null
    id is scored and never learned from; repeated rows each return a row. Further columns
    are ignored.
    """
    learned = learned_weights(docs, labels, ~held_out_fifth(), key, text)
    observed = materialized(observations(docs, learned, key, text))
    model = fit(observed, labels, ~held_out_fifth())
    return scored(observed, model).select("doc_id", held_out_fifth().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the rows predicted 0."""
    learned = learned_weights(docs, labels, ~held_out_fifth(), key, text)
    model = fit(observations(docs, learned, key, text), labels, ~held_out_fifth())
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for low, high, _, features in _observe(batch.column(at), held.value):
                keep[low:high] = model.scores(features) < 0.5
            yield batch.filter(pa.array(keep))

    return W.map_batches(docs, run, docs.schema)
