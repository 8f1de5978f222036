"""Vectors: hashed embeddings, similar pairs in blocks, near-duplicate reports and greedy dropping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from .rank import normalised
from .stage import written

#: Rows of a block; two blocks meet in one task, by matrix products of TILE rows with 4 TILE rows.
BLOCK_ROWS = 16_384
TILE = 1024
#: Rows that are measured against the pivots at a time, and rows of a batch that is sent to cells.
SLICE, SENT = 512, 8192
#: What sending a row to a cell costs, in products of two vectors.
SEND_COST = 400
#: Pivots at most: they are broadcast, and every row is measured against each.
PIVOTS = 4096
#: Links that one task goes through in order.
LINKS = 1_000_000
#: What distances may be off by.
SLACK = 1e-6


@lru_cache(maxsize=200_000)
def _place(word: str) -> int:
    """The first 32 bits of a word's MD5, remembered for the words met last."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


@cache
def _hasher(size: int):
    token = re.compile(TOKEN)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.bincount([_place(w) % size for w in token.findall((t or "").lower())], minlength=size).astype(np.float32))

    return run


@dataclass(frozen=True)
class Hashed:
    """The default embedder, whose vectors add up: that of texts put together with a space is the sum of theirs."""

    size: int = 64

    def __call__(self, text: Column) -> Column:
        return hashed(text, self.size)

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row of token counts by place for each text."""
        token, places, row = re.compile(TOKEN), [], []
        for k, t in enumerate(texts):
            found = token.findall(t.lower())
            places += map(_place, found)
            row += [k] * len(found)
        at = np.array(row, np.int64) * self.size + np.array(places, np.int64) % self.size
        return np.bincount(at, minlength=len(texts) * self.size).reshape(len(texts), self.size)


def hashed(text: Column, size: int = 64) -> Column:
    """The default embedding, standing where a model would: counts of tokens by the first 32 bits of their MD5, not yet normalised."""
    return _hasher(size)(text)


class _Cells:
    """Rows of unit vectors in cells round pivots, and what must meet in each cell.

    Cosine >= t means distance <= r = sqrt(2 - 2t). A row is at home at its nearest pivot. A row x with
    home a has partners at home in b only if d(x, b) <= r + the radius of b, and if it lies no further
    than r behind the plane between a and b: (d(x, b)^2 - d(x, a)^2) / (2 d(a, b)) <= r. Both follow from
    the triangle inequality, so no pair is lost, and cells too far apart never meet.
    """

    def __init__(self, home: DataFrame, threshold: float, rows: int, pivots: int):
        self.rows, self.reach = rows, (np.sqrt(2 - 2 * min(threshold, 1.0)) if threshold > 0 else np.inf) + SLACK
        n = home.count()
        m = 1 if n <= rows else min(pivots, int(2 * np.sqrt(n)) + 1)
        # At most `pivots` vectors; equal ones would be one cell.
        found = home.orderBy(F.xxhash64("pos"), "pos").limit(m).select("vector").toPandas()["vector"]
        self.pivots = np.unique(np.stack(found.to_numpy()).astype(np.float64), axis=0) if len(found) else np.zeros((1, 1))
        self.sent = home.sparkSession.sparkContext.broadcast(self.pivots)
        self.home = written(self.placed(home), "cells")
        each = self.home.groupBy("home").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).toPandas()  # a row for each pivot
        self.radius, self.count = np.full(len(self.pivots), -np.inf), np.zeros(len(self.pivots), np.int64)
        self.radius[each["home"]], self.count[each["home"]] = each["r"], each["n"]

    def placed(self, df: DataFrame) -> DataFrame:
        """(pos, vector, home, dist): each row's nearest pivot, the first on ties, and its distance."""
        pivots = self.sent

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, SLICE):
                    part = batch.slice(k, SLICE)
                    d = _distances(_matrix(part.column(1)), pivots.value)
                    home = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])], names=["pos", "vector", "home", "dist"])

        return df.select("pos", "vector").mapInArrow(run, "pos long, vector array<double>, home int, dist double")

    def _visits(self, below: bool):
        """For some rows and their distances from the pivots: whether each must visit each cell."""
        pivots, radius, reach = self.sent, self.radius, self.reach

        def run(d: np.ndarray, home: np.ndarray) -> np.ndarray:
            own = d[np.arange(len(d)), home][:, None]
            apart = _distances(pivots.value[home], pivots.value)
            with np.errstate(invalid="ignore", divide="ignore"):
                behind = np.where(apart > 0, (d**2 - own**2) / (2 * apart), 0.0)
            out = (d <= radius + reach) & (behind <= reach)
            return out & (np.arange(d.shape[1]) < home[:, None]) if below else out

        return run

    def dealt(self, visitors: DataFrame, below: bool) -> DataFrame:
        """(cell, i, j, side, pos, vector): side 0 is a block of rows at home in the cell, side 1 another such block or one of visitors.

        Blocks have about `rows` rows at most, so that a hot cell is spread over as many tasks as it needs.
        With `below`, the visitors are the rows at home themselves, each to cells before its own only,
        and blocks at home meet each other too. Where most rows would visit most cells, so that these
        spare less than sending costs, all rows are one cell: every two blocks meet, and a row is sent once for each block.
        """
        pivots, visits, rows = self.sent, self._visits(below), self.rows

        def counted(batches):
            total = np.zeros(len(pivots.value), np.int64)
            for batch in batches:
                for part in _slices(batch):
                    total += visits(_distances(_matrix(part.column(0)), pivots.value), part.column(1).to_numpy()).sum(axis=0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

        each = visitors.select("vector", "home").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a row for each pivot
        guests = np.zeros(len(self.pivots), np.int64)
        guests[each["cell"]] = each["n"]
        columns = ("pos", "vector", "home")
        all_ = int(self.count.sum())
        others = 0 if below else visitors.count()
        if self._cost(self.count, guests, below) < self._cost(np.array([all_]), np.array([others]), below):
            return self._sent(self.home.select(*columns), visitors.select(*columns), self.count, guests, below, visits)
        whole = lambda df: df.select("pos", "vector", F.lit(0).alias("home"))
        every = None if below else lambda d, home: np.ones((len(home), 1), bool)
        return self._sent(whole(self.home), whole(visitors), np.array([all_]), np.array([others]), below, every)

    def _parts(self, count: np.ndarray, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Into how many blocks the rows at home in each cell are cut, and its visitors."""
        return -(-count // self.rows), np.where(count > 0, -(-guests // self.rows), 0)

    def _cost(self, count: np.ndarray, guests: np.ndarray, below: bool) -> int:
        """Products of two rows, and rows sent, of cells with so many rows at home and so many visitors."""
        own, guest = self._parts(count, guests)
        products = count * guests + (count * count // 2 if below else 0)
        return int((products + SEND_COST * (count * (guest + (own if below else 0)) + guests * own)).sum())

    def _sent(self, home: DataFrame, visitors: DataFrame, count: np.ndarray, guests: np.ndarray, below: bool, visits) -> DataFrame:
        """dealt() of rows (pos, vector, home) in cells with so many rows at home and so many visitors; visits says which cells, None that there are no visits."""
        pivots, (own_parts, guest_parts) = self.sent, self._parts(count, guests)
        schema = "cell int, i int, j int, side int, pos long, vector array<double>"

        def sent(batch, cell, i, j, side, at):
            for a in range(0, len(at), SENT):
                part = batch.take(pa.array(at[a : a + SENT], pa.int64()))
                numbers = [pa.array(x[a : a + SENT].astype(np.int32), pa.int32()) for x in (cell, i, j, side)]
                yield pa.RecordBatch.from_arrays([*numbers, part.column(0), part.column(1)], names=["cell", "i", "j", "side", "pos", "vector"])

        def at_home(batches):
            for batch in batches:
                for part in _slices(batch):
                    home = part.column(2).to_numpy()
                    own = own_parts[home]
                    mine = (_mixed(part.column(0).to_numpy()) % np.maximum(own, 1).astype(np.uint64)).astype(np.int64)
                    among = own if below else np.zeros_like(own)  # blocks of the cell that a row's own block meets
                    row, place = _repeated(among + guest_parts[home])
                    b, inner = mine[row], place < among[row]
                    i = np.where(inner, np.minimum(b, place), b)
                    j = np.where(inner, np.maximum(b, place), own[row] + place - among[row])
                    yield from sent(part, home[row], i, j, inner & (b > place), row)

        def visiting(batches):
            for batch in batches:
                for part in _slices(batch):
                    home = part.column(2).to_numpy()
                    row, cell = np.nonzero(visits(_distances(_matrix(part.column(1)), pivots.value), home) & (own_parts > 0))
                    g = (_mixed(part.column(0).to_numpy())[row] % np.maximum(guest_parts[cell], 1).astype(np.uint64)).astype(np.int64)
                    at, first = _repeated(own_parts[cell])
                    yield from sent(part, cell[at], first, (own_parts[cell] + g)[at], np.ones(len(at)), row[at])

        out = home.mapInArrow(at_home, schema)
        return out if visits is None else out.unionByName(visitors.mapInArrow(visiting, schema))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(a, SLICE) for a in range(0, batch.num_rows, SLICE))


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as `times` says, and the numbers from 0 of its repeats."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A number's place among blocks: its bits mixed, that neighbours be dealt apart."""
    x = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _meet(threshold: float):
    """The rows of one block against each other, or two blocks: (x, y, score), x on side 0. A tile of scores is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        side, p = group["side"].to_numpy(), group["pos"].to_numpy()
        v = _matrix(group["vector"].combine_chunks())
        alone = group["i"][0].as_py() == group["j"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side != 0)
        for a in range(0, len(left), TILE):
            x = left[a : a + TILE]
            for b in range(0, len(right), 4 * TILE):
                y = right[b : b + 4 * TILE]
                s = v[x] @ v[y].T
                near = s >= threshold
                if alone:
                    near &= p[x][:, None] < p[y][None, :]
                i, j = np.nonzero(near)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(p[x[i]]), pa.array(p[y[j]]), pa.array(s[i, j])], names=["x", "y", "score"])

    return run


def _units(df: DataFrame, pos: str, vector: str) -> DataFrame:
    """(pos, vector) with unit vectors; rows without a vector have no cosine."""
    return df.filter(F.size(vector) > 0).select(F.col(pos).cast("long").alias("pos"), normalised(F.col(vector)).alias("vector"))


def similar_pairs(df: DataFrame, threshold: float, pos: str = "pos", vector: str = "vector", rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(later, earlier, score) of every two rows whose cosine is at least the threshold: exact.

    Rows meet in cells round pivots (see _Cells); rows with a null or empty vector meet none. On rows
    without clusters, where everything is about as far from everything, each row visits many cells.
    """
    cells = _Cells(written(_units(df, pos, vector), "units"), threshold, rows, pivots)
    found = cells.dealt(cells.home, True).groupBy("cell", "i", "j").applyInArrow(_meet(threshold), "x long, y long, score double")
    return found.select(F.greatest("x", "y").alias("later"), F.least("x", "y").alias("earlier"), "score")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copies, first_id): how many rows have the same text, and the smallest key among them."""
    rows = df.select(key, F.sha2(text, 256).alias("h"))
    each = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
    return rows.join(each, "h").select(key, "copies", "first_id")


def duplicate_report(pairs: DataFrame) -> DataFrame:
    """(pos, score, match): each row's most similar earlier row, the first on ties; duplicates of duplicates count too."""
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("earlier")).alias("first"))).alias("m")
    return pairs.groupBy(F.col("later").alias("pos")).agg(F.max("score").alias("score"), best).select("pos", "score", (-F.col("m.first")).alias("match"))


def histogram(pairs: DataFrame, thresholds=(0.90, 0.95, 0.98, 0.999)) -> DataFrame:
    """(threshold, n): rows whose best earlier match reaches each threshold."""
    best = pairs.groupBy("later").agg(F.max("score").alias("best"))
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    counted = best.select("best", steps).filter(F.col("best") >= F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
    every = pairs.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return every.join(counted, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"))


def greedy_drop(df: DataFrame, pairs: DataFrame, pos: str = "pos", links: int = LINKS) -> DataFrame:
    """df's rows that a pass in order keeps, where a row goes if an earlier kept row is similar.

    Up to `links` links, one task goes through them in order and remembers which rows went. While there
    are more, rounds over all rows at once decide what they can: a row with no undecided or kept earlier
    match is kept, a row with a kept one goes. A chain a~b~c without a~c keeps a and c.
    """
    open_ = written(pairs.select("later", "earlier").distinct())
    dropped = None

    def gone_in(found: DataFrame) -> None:
        nonlocal dropped
        dropped = found if dropped is None else dropped.unionByName(found)

    while (left := open_.count()) > links:
        # The earlier row of a link is kept for certain if it has no open link to rows before it.
        kept = open_.select(F.col("earlier").alias("p")).distinct().join(open_.select(F.col("later").alias("p")).distinct(), "p", "left_anti")
        gone = written(open_.join(kept, open_["earlier"] == kept["p"]).select(F.col("later").alias("p")).distinct())
        gone_in(gone)
        g = gone.withColumnRenamed("p", "g")
        open_ = written(open_.join(g, open_["later"] == g["g"], "left_anti").join(g, open_["earlier"] == g["g"], "left_anti"))
    if left:
        gone_in(written(open_.repartition(1).sortWithinPartitions("later").mapInArrow(_passed, "p long"), "dropped"))
    return df if dropped is None else df.join(dropped.select(F.col("p").alias(pos)), pos, "left_anti")


def _passed(batches):
    """Rows that go, from links in order of the later row: all that is said of its earlier rows is known by then."""
    gone: set[int] = set()
    for batch in batches:
        for later, earlier in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if earlier not in gone:
                gone.add(later)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], names=["p"])


def skipped(pairs: DataFrame, kept: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, score, match) of what greedy_drop() drops: the kept earlier row most similar to it, the first on ties."""
    of = kept.select(F.col(pos).alias("earlier"))
    return duplicate_report(pairs.join(of, "earlier", "left_semi").join(kept.select(F.col(pos).alias("later")), "later", "left_anti"))


def against_index(batch: DataFrame, index: DataFrame, threshold: float, rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(pos, best): rows of the batch whose cosine with some indexed vector reaches the threshold.

    An indexed row lies in its own cell only; a row of the batch visits the cells that can hold a partner.
    """
    cells = _Cells(written(_units(index, "pos", "vector"), "units"), threshold, rows, pivots)
    visitors = written(cells.placed(_units(batch, "pos", "vector")), "visitors")
    hit = cells.dealt(visitors, False).groupBy("cell", "i", "j").applyInArrow(_meet(threshold), "x long, y long, score double")
    return hit.groupBy(F.col("y").alias("pos")).agg(F.max("score").alias("best"))
