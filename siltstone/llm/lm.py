"""Scoring texts with a log-bilinear neural model, trained by noise-contrastive estimation.

A text is its words and one end. The model has two levels. The first predicts the class of each token
from the classes of the two before it: their vectors, each turned by its place's matrix, add up to a
predicted vector, whose product with a class's vector, plus a bias, is that class's score. The second
predicts the word within its class from the word before it, in the same way. The most frequent words
are classes of their own; all others fall into classes by their last two bytes, and in each of these
the MEMBERS most frequent words of the corpus have vectors of their own; what is left of a class is
one more entry, shared out by counts, with one added to each and one unseen word, as the base does for
the whole vocabulary.

Both levels are trained in numpy against noise, on counts over all training texts: of class trigrams,
and of pairs of a word and the member after it. Batched matrix products give the normalised
log-probabilities of both levels for every context, and a token's is the sum of the two.

Counts of frequent words, a bounded number, are looked up in place; those of all other words come
through a join.

Defined results: null is the empty text, which is one end; without training texts all probabilities
are even; equal texts have equal scores; repeated rows each give a row; an empty table gives none;
columns of df besides key and text play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mapped, staged, texts, values, widened

OWN = 66
SUFFIXES = 32
END, START = OWN + SUFFIXES, OWN + SUFFIXES + 1
CLASSES = OWN + SUFFIXES + 2
#: Words within the suffix classes that have vectors of their own, of the second level.
MEMBERS = 2048
#: Contexts of the second level: own classes, members, the rest of each suffix class, the start; and its outputs: members and rests.
CONTEXTS, OUTPUTS = OWN + MEMBERS + SUFFIXES + 1, MEMBERS + SUFFIXES
#: Words whose counts tasks look up in place; all others are joined.
FREQUENT = 100_000
HELD = 400_000
SIZE = 24
NOISE = 20
STEPS = 1200
BATCH = 2048
#: Noise words of a step's token in the second level, whose vectors are shorter.
NOISE_WITHIN, SIZE_WITHIN = 8, 16


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def suffix_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % SUFFIXES


def train(cells: np.ndarray, counts: np.ndarray, seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Vectors and biases from class trigrams: cells are (a * CLASSES + b) * CLASSES + c, with their counts.

    Noise-contrastive estimation: each step draws trigrams by their counts and learns to tell the true
    class from NOISE noise classes, drawn by their frequency; over so few classes the mean over the
    noise is taken exactly, which leaves the same objective with less variance.
    """
    rng = np.random.default_rng(seed)
    p = {"in": rng.normal(0, 0.1, (CLASSES, SIZE)), "out": rng.normal(0, 0.1, (CLASSES, SIZE)), "far": np.eye(SIZE) * 0.5, "near": np.eye(SIZE) * 0.5, "bias": np.zeros(CLASSES)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if not len(cells):
        return p
    freq = np.bincount(cells % CLASSES, counts, CLASSES) + 0.5
    noise = freq / freq.sum()
    p["bias"] = np.log(noise).astype(np.float32)
    log_kp = np.log(NOISE * noise).astype(np.float32)
    cum = np.cumsum(counts / counts.sum())
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        cell = cells[np.minimum(np.searchsorted(cum, rng.random(BATCH)), len(cells) - 1)]
        a, b, c = cell // CLASSES**2, cell // CLASSES % CLASSES, cell % CLASSES
        ra, rb = p["in"][a], p["in"][b]
        h = ra @ p["far"] + rb @ p["near"]
        s = h @ p["out"].T + p["bias"] - log_kp
        true = 1 / (1 + np.exp(-np.clip(s, -30, 30)))  # how likely a class is data, not noise
        g = true * (NOISE * noise).astype(np.float32)
        rows = np.arange(BATCH)
        g[rows, c] -= 1 - true[rows, c]
        g /= BATCH
        gh = g @ p["out"]
        grad = {"out": g.T @ h, "bias": g.sum(0), "far": ra.T @ gh, "near": rb.T @ gh, "in": np.zeros_like(p["in"])}
        np.add.at(grad["in"], a, gh @ p["far"].T)
        np.add.at(grad["in"], b, gh @ p["near"].T)
        rate = 0.02 * (1 - t / (steps + 1)) + 1e-4
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10 probabilities: a row for each pair of classes, a column for each class that may follow."""
    far, near = p["in"] @ p["far"], p["in"] @ p["near"]
    h = (far[:, None, :] + near[None, :, :]).reshape(-1, SIZE)
    s = (h @ p["out"].T + p["bias"]).astype(np.float64)
    s[:, START] = -np.inf  # nothing is followed by a start
    s -= s.max(axis=1, keepdims=True)
    return ((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


def train_within(cells: np.ndarray, counts: np.ndarray, of: np.ndarray, seed: int = 11, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Vectors and biases of the second level from pairs: cells are context * OUTPUTS + output, with their counts; of is the suffix class of each output.

    Noise words are drawn from the true word's own class, by their frequency in it.
    """
    rng = np.random.default_rng(seed)
    p = {"in": rng.normal(0, 0.1, (CONTEXTS, SIZE_WITHIN)).astype(np.float32), "out": rng.normal(0, 0.1, (OUTPUTS, SIZE_WITHIN)).astype(np.float32)}
    freq = np.bincount(cells % OUTPUTS, counts, OUTPUTS) + 0.5 if len(cells) else np.ones(OUTPUTS)
    order = np.argsort(of, kind="stable")  # outputs by class
    mass = np.bincount(of, freq, SUFFIXES)
    share = freq / mass[of]
    p["bias"] = np.log(share).astype(np.float32)
    if not len(cells):
        return p
    line = np.cumsum(freq[order])
    before = np.cumsum(mass) - mass  # what stands before each class in the line
    log_kp = np.log(NOISE_WITHIN * share).astype(np.float32)
    cum = np.cumsum(counts / counts.sum())
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        cell = cells[np.minimum(np.searchsorted(cum, rng.random(BATCH)), len(cells) - 1)]
        a, b = cell // OUTPUTS, cell % OUTPUTS
        at = before[of[b]][:, None] + rng.random((BATCH, NOISE_WITHIN)) * mass[of[b]][:, None]
        drawn = np.column_stack((b, order[np.minimum(np.searchsorted(line, at), OUTPUTS - 1)]))  # the true word, then noise
        x, y = p["in"][a], p["out"][drawn]
        s = np.einsum("bd,bkd->bk", x, y) + p["bias"][drawn] - log_kp[drawn]
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30)))).astype(np.float32)
        g[:, 0] -= 1
        g /= BATCH
        grad = {"in": np.zeros_like(p["in"]), "out": np.zeros_like(p["out"]), "bias": np.bincount(drawn.ravel(), g.ravel(), OUTPUTS).astype(np.float32)}
        gx, gy = np.einsum("bk,bkd->bd", g, y), (g[:, :, None] * x[:, None, :]).reshape(-1, SIZE_WITHIN)
        for d in range(SIZE_WITHIN):
            grad["in"][:, d] = np.bincount(a, gx[:, d], CONTEXTS)
            grad["out"][:, d] = np.bincount(drawn.ravel(), gy[:, d], OUTPUTS)
        rate = 0.02 * (1 - t / (steps + 1)) + 1e-4
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-6)).astype(np.float32)
    return p


def log_within(p: dict[str, np.ndarray], of: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of the outputs within their classes: a row for each context."""
    s = (p["in"] @ p["out"].T + p["bias"]).astype(np.float32)
    for c in range(SUFFIXES):
        own = np.flatnonzero(of == c)
        part = s[:, own].astype(np.float64)
        top = part.max(axis=1, keepdims=True)
        s[:, own] = part - top - np.log(np.exp(part - top).sum(axis=1, keepdims=True))
    return s / np.float32(np.log(10))


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, n), counted in each task first."""

    def run(batches):
        held: Counter = Counter()

        def passed():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for x in texts(batch, text):
                held.update(words(x))
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    return mapped(df.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Frequent words: their classes, their places in the second level and the log10 of their counts plus one."""

    def __init__(self, top: list[tuple[bytes, int]]):
        self.place = {w: k for k, (w, _) in enumerate(top)}
        self.classes = np.array([k if k < OWN else suffix_class(w) for k, (w, _) in enumerate(top)] + [0], np.int32)
        self.logs = np.log10(np.array([n for _, n in top] + [0], np.float64) + 1)
        #: The suffix class, from 0, of each output of the second level; of members that don't exist, any.
        self.of = np.concatenate((np.arange(MEMBERS) % SUFFIXES, np.arange(SUFFIXES)))
        own = self.classes[OWN : OWN + MEMBERS][: max(0, len(top) - OWN)] - OWN
        self.of[: len(own)] = own
        self.members = len(own)

    def classes_of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1 for other words) and classes of the words."""
        get = self.place.get
        at = np.array([get(w, -1) for w in found], np.int64)
        classes = self.classes[at]
        for k in np.flatnonzero(at < 0).tolist():
            classes[k] = suffix_class(found[k])
        return at, classes

    def is_member(self, at: np.ndarray) -> np.ndarray:
        return (at >= OWN) & (at < OWN + self.members)

    def pairs(self, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Cells (context * OUTPUTS + output) of the words of a text that have a second level, each after the word before it."""
        member = self.is_member(at)
        rest = np.where(classes < OWN, classes, OWN + MEMBERS + classes - OWN)
        before = np.concatenate(([CONTEXTS - 1], np.where(member, at, rest)))[:-1]
        output = np.where(member, at - OWN, MEMBERS + classes - OWN)
        return (before * OUTPUTS + output)[classes >= OWN]


def _cells(classes: np.ndarray) -> np.ndarray:
    """Trigram cells of a text's tokens, the end included."""
    line = np.concatenate(([START, START], classes, [END])).astype(np.int64)
    return (line[:-2] * CLASSES + line[1:-1]) * CLASSES + line[2:]


def _tallied(spark, df: DataFrame, text: str, shared) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells and counts, in order, of the class trigrams and of the pairs of the second level, over all rows of df."""
    def run(batches):
        tables = np.zeros(CLASSES**3, np.int64), np.zeros(CONTEXTS * OUTPUTS, np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                found = [shared.value.classes_of(words(x)) for x in texts(batch.slice(a, 500), text)]
                for table, cells in zip(tables, ([_cells(c) for _, c in found], [shared.value.pairs(*x) for x in found])):
                    ids, n = np.unique(np.concatenate(cells), return_counts=True)
                    table[ids] += n.astype(table.dtype)
        for k, table in enumerate(tables):
            at = np.flatnonzero(table)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int8)), pa.array(part.astype(np.int32)), pa.array(table[part].astype(np.int64))], names=["level", "cell", "n"])

    each = mapped(df.select(text), run, "level byte, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    each = staged(each, "lm-cells")
    out = []
    for k in range(2):  # CLASSES^3 and CONTEXTS * OUTPUTS rows at most
        found = each.filter(F.col("level") == k).select("cell", "n").toArrow().sort_by("cell")
        out.append((found["cell"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)))
    return out


def score(df: DataFrame, train_rows: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, _train, n_tokens, n_known, train_tokens, base_score and score of each row; the model learns from the rows that train_rows allows."""
    spark = df.sparkSession
    learning = df.filter(train_rows)
    counts = staged(count_words(learning, text), "lm-counts")
    ends = learning.count()
    most = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()  # FREQUENT rows
    top = list(zip(most["word"].to_pylist(), most["n"].to_pylist()))
    del most
    lookup = Lookup(top)
    shared = spark.sparkContext.broadcast(lookup)
    rare = counts.filter((F.col("n") < top[-1][1]) | (F.col("n") == top[-1][1]) & (F.col("word") > F.lit(bytearray(top[-1][0])))) if len(top) == FREQUENT else counts.filter("false")

    (cells, n), (pairs, m) = _tallied(spark, learning, text, shared)
    table = log_probabilities(train(cells, n))
    within = log_within(train_within(pairs, m, lookup.of), lookup.of).ravel()
    del cells, n, pairs, m
    give_back()

    # Tokens and types of each class, and of what its members leave.
    def types(batches):
        held = np.zeros((3, CLASSES), np.int64)
        for batch in batches:
            found = [bytes(w) for w in values(batch, "word")]
            at, c = shared.value.classes_of(found)
            k, rest = np.array(values(batch, "n"), np.int64), ~shared.value.is_member(at)
            held[0] += np.bincount(c, k * rest, CLASSES).astype(np.int64)
            held[1] += np.bincount(c, rest, CLASSES).astype(np.int64)
            held[2] += np.array([k.sum(), len(k), *[0] * (CLASSES - 2)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), *[pa.array(x) for x in held]], names=["c", "tokens", "types", "all"])

    per = mapped(counts, types, "c int, tokens long, types long, all long").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tokens", "types", "all")]).collect()  # CLASSES rows
    below, whole = np.ones(CLASSES), {r["c"]: r["all"] for r in per}
    for r in per:
        below[r["c"]] = r["tokens"] + r["types"] + 1
    below[END] = ends + (ends > 0) + 1
    tokens, vocabulary = whole.get(0, 0) + ends, whole.get(1, 0) + (ends > 0)
    base_below = float(np.log10(tokens + vocabulary + 1))
    model = spark.sparkContext.broadcast((table.ravel(), within, np.log10(below), float(np.log10(ends + 1))))

    def run(batches):
        look, (probability, within, below_log, end_log) = shared.value, model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out = []
                for x in texts(part, text):
                    line = words(x)
                    at, classes = look.classes_of(line)
                    other = np.flatnonzero(at < 0)
                    missing = Counter(line[k] for k in other.tolist())
                    logs = float(look.logs[at[at >= 0]].sum()) + end_log
                    # Classes, members and rests; then the shares by counts of words that are not members.
                    level = float(probability[_cells(classes)].sum(dtype=np.float64)) + float(within[look.pairs(at, classes)].sum(dtype=np.float64))
                    apart = ~look.is_member(at)
                    shares = float(look.logs[at[apart & (at >= 0)]].sum()) + end_log - float(below_log[classes[apart]].sum()) - below_log[END]
                    out.append((len(line) + 1, len(line) - len(other) + (end_log > 0), logs, level + shares, list(missing), list(missing.values())))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.select([key, "_train", "_d", "_h"]).columns, *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names=names)

    names = [key, "_train", "_d", "_h", "_n", "_known", "_logs", "_model", "_words", "_times"]
    keyed = df.select(key, F.coalesce(train_rows, F.lit(False)).alias("_train"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_d"), F.xxhash64(text).alias("_h"), text)
    rows = staged(mapped(keyed, run, widened(keyed, names[:4], "_n long, _known long, _logs double, _model double, _words array<binary>, _times array<int>")), "lm-rows")
    asked = rows.select("_d", "_h", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_d", "_h", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
    got = asked.join(rare, "word").groupBy("_d", "_h").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more"), F.sum("times").alias("_also"))
    # Rows with the same key and text ask for the same words, each once: what comes back is theirs together.
    same = staged(rows.groupBy("_d", "_h").agg(F.count(F.lit(1)).alias("_same")).filter("_same > 1"), "lm-same")
    both = rows.drop("_words", "_times").join(staged(got, "lm-rare"), ["_d", "_h"], "left").join(same, ["_d", "_h"], "left").fillna(1, ["_same"])
    more = F.coalesce(F.col("_more") / F.col("_same"), F.lit(0.0))
    known = F.col("_known") + F.coalesce((F.col("_also") / F.col("_same")).cast("long"), F.lit(0))
    return both.select(
        key, "_train", F.col("_n").alias("n_tokens"), known.alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("_logs") + more - F.col("_n") * base_below).alias("base_score"), (F.col("_model") + more).alias("score"),
    )
