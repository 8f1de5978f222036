"""Language identification with bit-sliced Bloom filters over byte trigrams.

Every slot of one table holds a mask with a bit for each language, so one look at the slots of a
trigram returns all languages whose filter contains it. A text's hits are counted per language,
corrected for the share that a filter of this fill answers falsely, and the largest decides.

Defined results: null, empty and letterless texts are `und` with score 0; a text in letters that no
filter contains gets the most frequent learned language with score 0; ties go to the first language
by name; rows without a language teach nothing; without any learned language all texts are `und`;
repeated rows each get their own result; an empty table gives no rows; columns of df named like the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, mapped, texts, values, widened

#: Byte classes: space, a to z, and each byte from 0x80.
CLASSES = 1 + 26 + 128
#: The table has so many slots at least, and SLOTS_EACH for each trigram of the language that has most.
SLOTS_LOG, SLOTS_EACH = 20, 8
HASHES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: A language's filter holds its trigrams that are at least so frequent, against the language where they are most frequent.
RELATIVE = 0.5
LEAST = 3
CHUNK = 1 << 19

_CLASS = np.zeros(256, np.int32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_CLEAN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def chunks(items: list[bytes], most: int = CHUNK) -> Iterator[slice]:
    """Runs of items of about `most` bytes."""
    first = size = 0
    for k, x in enumerate(items):
        size += len(x)
        if size >= most:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(items):
        yield slice(first, len(items))


def grams(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram codes of all items, and the item each comes from. Words are padded with one space."""
    clean = [b" %b " % b" ".join(x.translate(_CLEAN).split()) for x in items]
    c = _CLASS[np.frombuffer(b"".join(clean), np.uint8)]
    owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in clean])[: max(0, len(c) - 2)]
    a, b, d = c[:-2], c[1:-1], c[2:]
    good = ~((b == 0) & ((a == 0) | (d == 0)))
    return ((a * CLASSES + b) * CLASSES + d)[good], owner[good]


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, p): the trigrams of each language's filter, counted over all rows of df.

    Each task counts in blocks of bounded size and Spark adds up; there are at most 155^3 trigrams a
    language however large the input.
    """

    def count(batches):
        for batch in batches:
            items, langs = texts(batch, text), np.array(values(batch, lang), dtype=object)
            for name in sorted({x for x in langs if x is not None}):
                mine = [items[k] for k in np.flatnonzero(langs == name)]
                for part in chunks(mine):
                    codes, _ = grams(mine[part])
                    n = np.bincount(codes, minlength=1)
                    found = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n[found].astype(np.int64))], names=["lang", "gram", "n"])

    each = mapped(df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang), count, "lang string, gram int, n long")
    total = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("lang")
    p = total.withColumn("p", F.col("n") / F.sum("n").over(whole)).withColumn("most", F.max("p").over(Window.partitionBy("gram")))
    return p.filter((F.col("n") >= LEAST) & (F.col("p") >= RELATIVE * F.col("most"))).select("lang", "gram", "p")


def slots(codes: np.ndarray, log: int = SLOTS_LOG) -> np.ndarray:
    """One row of slots, of 2^log, for each hash."""
    return (codes.astype(np.uint32)[None, :] * HASHES[:, None]) >> np.uint32(32 - log)


class Filters:
    """Bloom filters of any number of languages in tables of masks, one table for each 64 languages."""

    def __init__(self, rows: list[tuple[str, int]], usual: str | None = None):
        self.langs = sorted({r[0] for r in rows})
        place = {x: k for k, x in enumerate(self.langs)}
        of, codes = np.array([place[r[0]] for r in rows], int), np.array([r[1] for r in rows], np.int64)
        most = int(np.bincount(of, minlength=1).max())
        self.log = max(SLOTS_LOG, int(np.ceil(np.log2(max(1, SLOTS_EACH * most)))))
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(64, len(self.langs)) <= t(0).nbytes * 8)
        self.masks = [np.zeros(1 << self.log, kind) for _ in range(0, max(1, len(self.langs)), 64)]
        self.usual = usual or (self.langs[0] if self.langs else "und")
        for k in range(len(self.langs)):
            self.masks[k // 64][slots(codes[of == k], self.log).ravel()] |= kind(1 << k % 64)
        fill = np.array([np.count_nonzero(self.masks[k // 64] & kind(1 << k % 64)) for k in range(len(self.langs))]) / (1 << self.log)
        self.false = fill ** len(HASHES)

    def languages(self, codes: np.ndarray, table: int = 0) -> np.ndarray:
        """The mask of all languages, of a table's 64, that contain each trigram."""
        masks, at = self.masks[table], slots(codes, self.log)
        found = masks[at[0]]
        for row in at[1:]:
            found = found & masks[row]
        return found

    def shares(self, items: list[bytes]) -> np.ndarray:
        """For each item and language, the corrected share of trigrams that the language contains."""
        out = np.zeros((len(items), len(self.langs)))
        codes, owner = grams(items)
        n = np.maximum(1, np.bincount(owner, minlength=len(items)))
        for k, f in enumerate(self.false):
            if k % 64 == 0:
                found = self.languages(codes, k // 64)
            hits = np.bincount(owner[(found >> found.dtype.type(k % 64)) & found.dtype.type(1) != 0], minlength=len(items))
            out[:, k] = np.clip((hits / n - f) / max(1e-9, 1 - f), 0, 1)
        return out

    def predict(self, items: list[bytes]) -> list[tuple[str, float, float]]:
        """(language, score, share of trigrams in it) of each item."""
        out = []
        for part in chunks(items):
            for x, s in zip(items[part], self.shares(items[part])):
                if not self.langs or not has_letter(x):
                    out.append(("und", 0.0, 0.0))
                elif s.max(initial=0) <= 0:
                    out.append((self.usual, 0.0, 0.0))
                else:
                    k = int(s.argmax())
                    out.append((self.langs[k], float(s[k] / s.sum()), float(s[k])))
        return out


def has_letter(x: bytes) -> bool:
    if x.isascii():
        return x.lower() != x.upper()
    return any(c.isalpha() for c in x.decode("utf-8", "replace"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows of df that have a language."""
    found = learn(df, text, lang).select("lang", "gram").toArrow()  # 155^3 rows a language at most
    rows = list(zip(found["lang"].to_pylist(), found["gram"].to_pylist()))
    usual = df.filter(F.col(lang).isNotNull()).groupBy(lang).count().orderBy(F.desc("count"), lang).select(lang).first()
    filters = Filters(rows, usual[0] if usual else None)
    del found, rows
    give_back()
    return filters


def identify(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """df with lang_pred, lang_score and lang_share. Columns of these names are replaced."""
    df = df.drop("lang_pred", "lang_score", "lang_share")
    model = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            found = model.value.predict(texts(batch, text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_share"])

    return mapped(df, run, widened(df, df.columns, "lang_pred string, lang_score double, lang_share double"))
