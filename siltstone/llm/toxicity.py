"""Toxicity by weak supervision.

Many voters look at a text: word lists, patterns, and words and word beginnings mined from a bounded
sample of labelled rows. A generative label model estimates from the voters' agreement how often each
speaks and errs in either class, and how far voters repeat one another; labels choose the mined voters
and give the share of toxic rows, and no more. Its posterior labels train a linear classifier
over words and over word beginnings that occur once, twice or three times, which scores whole texts.

Defined results: null is the empty text, whose score is that of a text without features; ties cannot
arise, as a score depends on the text alone; without labelled rows every score is the prior, 0; a key
that labelled rows repeat counts once, toxic if any says so, with its smallest text; repeated rows are
scored alike; an empty table gives no rows; a column of df named `toxic_score` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mapped, staged, texts, values, widened

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Features of the linear classifier, and voters that are mined, at most.
FEATURES = 3072
MINED = 320
#: Correlation from which two voters count as repeating one another.
REPEATS = 0.6
#: A mined voter speaks so many times as often on toxic rows as on clean ones; a given one has so many toxic rows for each clean one.
CLEAR, SURE = 50, 9
#: Lengths in bytes of the word beginnings that are features.
STEMS = (3, 4, 5, 6, 7, 8)
#: How often a beginning occurs, at least: a feature each.
TIMES = (1, 2, 3)

# Word lists, each word of which is a voter.
LISTS = {
    "insult": "idiot moron fool clown loser jerk creep imbecile dunce",
    "contempt": "pathetic worthless disgusting stupid dumb useless vile",
    "filth": "scum trash garbage filth vermin",
}
# Patterns, a voter each.
PATTERNS = {
    "address": rb"\b(?:you|you're|ur) (?:\w+ ){0,2}(?:idiot|moron|fool|clown|loser|stupid|pathetic|scum|trash)",
    "dismiss": rb"\b(?:shut up|go away|get lost|nobody likes you)\b",
    "shout": rb"!{3,}",
}

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_PATTERNS = [re.compile(p, re.I) for p in PATTERNS.values()]
_WORDS = [w for x in LISTS.values() for w in x.encode().split()]


def count_words(text: bytes) -> Counter:
    return Counter(text.translate(_LETTERS).split())


def stems_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings."""
    return [b"=" + word, *[b"^" + word[:n] for n in STEMS if len(word) >= n]]


def feature(stem: bytes, times: int) -> int:
    return zlib.crc32(b"%d" % times, zlib.crc32(stem))


def features(found: Counter) -> np.ndarray:
    """The sorted, distinct hashes of the features that a text's words make."""
    n: Counter = Counter()
    for w, k in found.items():
        for s in stems_of(w):
            n[s] += k
    return np.unique(np.array([feature(s, t) for s, k in n.items() for t in TIMES if k >= t], np.uint32))


def fixed_votes(text: bytes, found: Counter) -> list[bool]:
    return [w in found for w in _WORDS] + [bool(p.search(text)) for p in _PATTERNS]


def first_guess(votes: np.ndarray, balance: float) -> np.ndarray:
    """Posteriors to start from, by the votes alone: high for the rows with the most votes for class 1, as many as its share `balance` says."""
    support = (votes > 0).sum(1)
    line = np.sort(support)[::-1][min(len(votes) - 1, max(0, round(balance * len(votes)) - 1))] if len(votes) else 0
    return np.where(support >= max(1, line), 0.9, 0.1 * balance)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50, balance: float | None = None) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of votes (-1, 0 for abstaining, 1), and the estimates.

    Expectation maximisation over the voters' agreement alone, from the posterior `start`; no row's
    label plays a part, only the share `balance` of class 1 (by default that of the start). Each voter
    has, in each class, a probability of each vote: its propensity and accuracy. Voters that correlate
    within a class share their evidence: a voter's weight is one over one plus the sum of its
    correlations above REPEATS, estimated anew in the first rounds.
    """
    q = np.clip(start, 1e-3, 0.98)
    m = votes.shape[1]
    prior = float(np.clip(q.mean() if balance is None else balance, 1e-4, 1 - 1e-4))
    tables, corr, weight = np.zeros((2, m, 3)), np.zeros((m, m)), np.ones(m)
    votes = votes.astype(np.int8)
    for t in range(rounds):
        if t < 5:  # what correlates settles early
            corr = np.zeros((m, m))
            for w in (np.maximum(1 - q, 1e-9), np.maximum(q, 1e-9)):
                # The covariance from sums of products, so that no centred copy of the votes is held.
                part = votes * np.sqrt(w)[:, None].astype(np.float32)
                mean = (w @ votes) / w.sum()
                cov = (part.T @ part).astype(float) / w.sum() - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = np.maximum(corr, np.clip(cov / sd[:, None] / sd[None, :], 0, 1))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > REPEATS, corr, 0).sum(1))
        for c, w in ((0, 1 - q), (1, q)):
            for k, v in enumerate((-1, 0, 1)):
                tables[c, :, k] = w @ (votes == v) + 0.1
            tables[c] /= tables[c].sum(1, keepdims=True)
        ratio = (np.log(tables[1]) - np.log(tables[0])) * weight[:, None]
        score = np.log(prior / (1 - prior)) + sum((votes == v) @ ratio[:, k] for k, v in enumerate((-1, 0, 1)))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = t >= 5 and abs(new - q).max(initial=0) < 1e-4
        q = new
        if done:
            break
    return q, {"accuracy": tables, "correlation": corr, "weight": weight, "prior": prior}


def fit_linear(rows: list[np.ndarray], q: np.ndarray, size: int, steps: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Weights, the last of which is the bias, of a logistic regression on soft labels."""
    lengths = np.array([len(r) for r in rows])
    cols, owner = np.concatenate(rows) if len(rows) else np.empty(0, int), np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(size + 1)
    w[-1] = np.log(np.clip(q.mean(), 1e-4, 1 - 1e-4) / (1 - np.clip(q.mean(), 1e-4, 1 - 1e-4)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(q > 0.5, 0.5 / max(q.mean(), 1e-3), 0.5 / max(1 - q.mean(), 1e-3))
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[cols], len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) * balance / len(rows)
        grad = np.append(np.bincount(cols, g[owner], size), g.sum())
        grad[:-1] += l2 * w[:-1] / np.sqrt(len(rows))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class Model:
    """Weights of hashed features, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[bytes, tuple] = {}

    def score(self, text: bytes) -> float:
        cache, n = self.cache, {}
        for w, k in count_words(text).items():
            hit = cache.get(w)
            if hit is None:
                if len(cache) > 200_000:
                    cache.clear()
                hit = cache[w] = tuple(s for s in stems_of(w) if any(feature(s, t) in self.weights for t in TIMES))
            for s in hit:
                n[s] = n.get(s, 0) + k
        found = {feature(s, t) for s, k in n.items() for t in TIMES if k >= t}
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}


def select(counts: list[tuple[int, int, int]], toxic: int, clean: int) -> tuple[list[int], list[int]]:
    """Features for the classifier, and those that vote, from (feature, toxic rows with it, clean rows with it)."""
    if not counts:
        return [], []
    ids, pos, neg = (np.array(x) for x in zip(*sorted(counts)))
    odds = np.log((pos + 0.1) / (toxic - pos + 0.1)) - np.log((neg + 0.1) / (clean - neg + 0.1))
    z = odds / np.sqrt(1 / (pos + 0.3) + 1 / (neg + 0.3) + 1 / toxic + 1 / clean)
    keep = np.lexsort((ids, -abs(z)))[:FEATURES]
    good = np.flatnonzero((pos >= 2) & (pos / toxic > CLEAR * (neg + 0.5) / clean))
    mined = good[np.lexsort((ids[good], -pos[good]))][:MINED]
    return [int(x) for x in ids[keep]], [int(x) for x in ids[mined]]


def train(rows: list[tuple[int, list[bool], np.ndarray]], keep: list[int], mined: list[int]) -> Model:
    """rows: (label, votes of lists and patterns, distinct features among keep and mined) of labelled texts."""
    if len({r[0] for r in rows}) < 2:
        return Model({}, 30.0 if rows and rows[0][0] else -30.0)
    y = np.array([r[0] for r in rows])
    fixed = np.array([r[1] for r in rows], np.int8)
    at = {f: k for k, f in enumerate(mined)}
    own = np.zeros((len(rows), len(mined)), np.int8)
    for k, r in enumerate(rows):
        own[k, [at[f] for f in r[2].tolist() if f in at]] = 1
    toxic, clean = fixed[y == 1].sum(0, dtype=int), fixed[y != 1].sum(0, dtype=int)
    own = np.column_stack([fixed[:, (toxic >= 2) & (toxic >= SURE * clean)], own])
    votes, balance = np.column_stack([own, -(own.sum(1, dtype=int) == 0).astype(np.int8)]), float((y == 1).mean())
    q, _ = label_model(votes, first_guess(votes, balance), balance=balance)
    spot = {f: k for k, f in enumerate(keep)}
    w = fit_linear([np.array([spot[f] for f in r[2].tolist() if f in spot], int) for r in rows], q, len(keep))
    return Model({f: float(x) for f, x in zip(keep, w) if abs(x) > 1e-3}, float(w[-1]))


def fit(df: DataFrame, labels: DataFrame, train_rows: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled rows that train_rows (a condition on the key) allows: the first `sample` by a hash of the key.

    Features are counted by Spark; only the chosen ones come to the driver.
    """
    chosen = labels.filter(train_rows & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)
    rows = df.select(key, text).join(F.broadcast(chosen), key)  # `sample` rows of two numbers
    rows = rows.groupBy(key, "_label").agg(F.min(text).alias("_text"))  # a row for each key, so that the bound holds
    rows = staged(rows.select(F.col(key).cast("string").alias("key"), F.col("_label").cast("int").alias("label"), F.col("_text").alias("text")), "toxic-sample")

    def count(batches):
        for batch in batches:
            items, y = texts(batch), np.array(values(batch, "label"))
            for a in range(0, len(items), 500):
                found = [features(count_words(x)) for x in items[a : a + 500]]
                owner = np.repeat(y[a : a + 500], [len(f) for f in found])
                ids, at = np.unique(np.concatenate(found), return_inverse=True)
                pos = np.bincount(at, owner, len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(ids)).astype(np.int64) - pos)], names=["f", "pos", "neg"])

    sizes = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    toxic, clean = max(1, sizes[0]), max(1, sizes[1])
    counts = mapped(rows, count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= 2)
    lift = (F.col("pos") + 0.1) / toxic / ((F.col("neg") + 0.1) / clean)
    counts = counts.withColumn("lift", F.abs(F.log(lift)) * F.sqrt(F.col("pos") + F.col("neg") * toxic / clean)).orderBy(F.desc("lift"), "f").limit(4 * FEATURES)
    keep, mined = select([(r["f"], r["pos"], r["neg"]) for r in counts.collect()], toxic, clean)
    wanted = np.unique(np.array([*keep, *mined], np.uint32))

    def extract(batches):
        for batch in batches:
            out = []
            for x in texts(batch):
                found = count_words(x)
                out.append((fixed_votes(x, found), np.intersect1d(features(found), wanted, assume_unique=True).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in out], pa.list_(pa.bool_())), pa.array([r[1] for r in out], pa.binary())], names=["key", "label", "votes", "features"])

    got = mapped(rows, extract, "key string, label int, votes array<boolean>, features binary").toLocalIterator()
    found = sorted((r["key"], r["label"], list(r["votes"]), bytes(r["features"])) for r in got)
    model = train([(r[1], r[2], np.frombuffer(r[3], np.uint32)) for r in found], keep, mined)
    del found
    give_back()
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with toxic_score, from 0 to 1. A column of that name is replaced."""
    df = df.drop("toxic_score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(x) for x in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "toxic_score"])

    return mapped(df, run, widened(df, df.columns, "toxic_score double"))


