"""BPE encoding and decoding through a table of distinct words.

Texts are normalised and split into words as the tokenizer file says. Each distinct word of the
corpus is encoded once; ids come back by the word's place in its text. The most frequent words, a
bounded number, are looked up in place; all others are dealt out by word, and their ids meet the
texts again in one merge by row. For decoding, the distinct ids that occur are joined with the
vocabulary's table of pieces, and the pieces are put together by the place of their ids.

Defined results: null is the empty text, with no ids; special tokens written out in a text become
their ids, as in the library; repeated rows each give a row; an empty table gives none; an id that
the vocabulary does not have gives no piece, as in the library; a column of df named like the output
(`decoded`) is replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, staged, texts, values, widened

#: Words that tasks look up in place; all others are joined.
FREQUENT = 150_000
#: A task's counts are passed on when it holds so many distinct words.
HELD = 400_000
#: How often a task must have met a word to propose it as frequent.
OFTEN = 4
#: Codes of one and of two bytes; all others take three more.
ONE, TWO = 192, 192 + 63 * 256
#: Rows whose words are put together at a time.
ROWS = 200

_PLAIN = re.compile(r"[^\t-\r -~\xa1-\xac\xae-įı-ſ‐-‧€]")
_LETTER = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"


class Splitter:
    """Splits a text into the words that a tokenizer file's merges are applied to.

    Texts of characters that need no normal form are split by a plain pattern with the same meaning;
    any other goes through the library's own normaliser and pattern.
    """

    def __init__(self, file: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.exact = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        plain = pattern.replace(r"[\p{L}]", f"[{_LETTER}]").replace(r"[\p{N}]", f"[{_NUMBER}]").replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]")
        letters = f"[{_LETTER}]+"
        if f"|{letters}|" in plain:  # most words are letters; nothing else begins with one, so they may be tried first
            plain = f"{letters}|{plain.replace(f'|{letters}|', '|')}"
        self.plain = re.compile(plain)
        if r"\p" in self.plain.pattern:
            raise ValueError(f"{file}: its pattern isn't one that this splitter knows")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _words(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return self.plain.findall(text.lower())
        return [w for w, _ in self.exact.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        if self.cut and self.cut.search(text):
            out: list[str] = []
            for part in self.cut.split(text):
                out.extend([part] if part in self.special else self._words(part))
            return out
        return self._words(text)

    def ids(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.tokenizer.encode(word, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def splitter(file: str) -> Splitter:
    """The splitter of a file, once in each Python process."""
    return Splitter(file)


def _strings(batch, name: str) -> list[str]:
    return [x.decode("utf-8", "replace") for x in texts(batch, name)]


def frequent_words(df: DataFrame, file: str, text: str = "text") -> list[str]:
    """Up to FREQUENT of the words that most texts hold, the most frequent first.

    Tasks pass on only words that they have met OFTEN times. Which words are here decides how a word
    is looked up, not what is found: every other word is dealt out.
    """

    def count(batches):
        split, held = splitter(file), Counter()

        def passed():
            often = [(w, n) for w, n in held.items() if n >= OFTEN]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])

        for batch in batches:
            for x in _strings(batch, text):
                held.update(set(split.words(x)))
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    counts = mapped(df.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()["word"].to_pylist()  # FREQUENT rows


class Ids:
    """The ids of the frequent words, all in one line; the words themselves are looked up elsewhere."""

    def __init__(self, words: list[str], file: str):
        split = splitter(file)
        self.kind = "<u2" if split.tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        ids = [split.ids(w) for w in words]
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.line = np.array([k for x in ids for k in x], self.kind)


def pack(codes: np.ndarray) -> bytes:
    """Codes as compressed bytes: a first byte for each, then the second bytes of those that need one, then the rest."""
    first = np.where(codes < ONE, codes, np.where(codes < TWO, ONE + ((codes - ONE) >> 8), 255)).astype(np.uint8)
    two, more = codes[(codes >= ONE) & (codes < TWO)], codes[codes >= TWO]
    return zlib.compress(b"".join((np.array([len(codes)], "<u4").tobytes(), first.tobytes(), ((two - ONE) & 255).astype(np.uint8).tobytes(), more.astype("<u4").tobytes())), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    codes = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    two, more = (codes >= ONE) & (codes < 255), codes == 255
    at = 4 + n
    k = int(two.sum())
    codes[two] = ONE + ((codes[two] - ONE) << 8) + np.frombuffer(raw, np.uint8, k, at)
    codes[more] = np.frombuffer(raw, "<u4", int(more.sum()), at + k)
    return codes


class Put:
    """Puts ids together: the known words' line of ids, with room behind it for those of a few rows' other words."""

    def __init__(self, known: Ids):
        self.n, self.kind = len(known.sizes), known.kind
        self.line, self.sizes = known.line, known.sizes
        self.starts = np.cumsum(known.sizes) - known.sizes
        self.end = len(known.line)

    def _room(self, words: int, ids: int) -> None:
        if self.n + words > len(self.sizes):
            more = np.zeros(self.n + 2 * words - len(self.sizes), np.int64)
            self.sizes, self.starts = np.concatenate((self.sizes, more)), np.concatenate((self.starts, more))
        if self.end + ids > len(self.line):
            self.line = np.concatenate((self.line, np.zeros(self.end + 2 * ids - len(self.line), self.line.dtype)))

    def together(self, rows: list[tuple[np.ndarray, list[bytes]]]) -> list[np.ndarray]:
        """The ids of each row: of (codes, the ids of the row's other words, whose codes follow those of the known)."""
        n, lines, other = self.n, [], []
        for codes, more in rows:
            lines.append(codes + (codes >= n) * len(other) if other else codes)
            other.extend(more)
        code = np.concatenate(lines) if lines else np.empty(0, np.int64)
        more = np.frombuffer(b"".join(other), self.kind)
        self._room(len(other), len(more))
        size = np.array([len(x) for x in other], np.int64) // self.line.itemsize
        self.line[self.end : self.end + len(more)] = more
        self.sizes[n : n + len(other)] = size
        self.starts[n : n + len(other)] = self.end + np.cumsum(size) - size
        size = self.sizes[code]
        ends = np.cumsum(size)
        ids = self.line[np.repeat(self.starts[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lines)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encoded(df: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """df's key with ids, the text's token ids as little-endian unsigned 32-bit numbers; and the distinct ids that occur (id).

    A text becomes a line of codes, of frequent words and, by the order of first use, of its other
    words. These, each once for a text, are dealt out by word and sorted, so that each distinct one is
    encoded once, wherever it occurs. Its ids, written down, are sorted together with the texts by a
    hash of the row, so that a text follows its words: what a task holds at a time is one text's words.
    A second hash keeps rows apart whose first hashes are equal; equal rows share their words' ids.
    """
    spark = df.sparkSession
    words_ = frequent_words(df, file, text)
    known = Ids(words_, file)
    n_known, kind = len(words_), known.kind
    shared, places = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast({w: k for k, w in enumerate(words_)})

    def ask(batches):
        split = splitter(file)
        codes = places.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                words, rows, at = [], [], []
                part = batch.slice(a, ROWS)
                for x, k, c in zip(_strings(part, text), values(part, "_k"), values(part, "_c")):
                    other = [w for w in dict.fromkeys(split.words(x)) if w not in codes]
                    words += other
                    rows += [k] * len(other)
                    at += range(c << 32, (c << 32) + len(other))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.int64()), pa.array(words, pa.string())], names=["_k", "_at", "word"])

    def answer(batches):
        split, last, ids, seen = splitter(file), None, b"", None
        for batch in batches:
            out, keep = [], []
            for row in zip(values(batch, "word"), values(batch, "_k"), values(batch, "_at")):
                if row[0] != last:
                    last, ids = row[0], np.array(split.ids(row[0]), kind).tobytes()
                keep.append(row != seen)  # rows that are repeated ask the same
                seen = row
                out.append(ids)
            found = pa.RecordBatch.from_arrays([*batch.select(["_k", "_at"]).columns, pa.array(out, pa.binary())], names=["_k", "_at", "_ids"])
            yield found.filter(pa.array(keep, pa.bool_()))

    def look_up(batches):
        split, n, get = splitter(file), n_known, places.value.get
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                blobs = []
                for x in _strings(batch.slice(a, ROWS), text):
                    found = split.words(x)
                    codes = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                    if len(missing := np.flatnonzero(codes < 0)):
                        other: dict[str, int] = {}
                        codes[missing] = [n + other.setdefault(found[k], len(other)) for k in missing.tolist()]
                    blobs.append(pack(codes))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, ROWS).select([key, "_k", "_c"]).columns, pa.array(blobs, pa.binary())], names=[key, "_k", "_c", "_blob"])

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keyed = df.select(key, F.xxhash64(name, text).alias("_k"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).bitwiseAND(F.lit(0xFFFF)).alias("_c"), text)
    asked = mapped(keyed.select("_k", "_c", text), ask, "_k long, _at long, word string")
    answers = mapped(asked.repartition("word").sortWithinPartitions("word", "_k", "_at"), answer, "_k long, _at long, _ids binary")
    answers = staged(answers, "bpe-words")
    rows = mapped(keyed, look_up, widened(keyed, [key, "_k", "_c"], "_blob binary")).select(F.col(key).alias("_key"), "_k", F.col("_c").alias("_at"), F.col("_blob").alias("_ids"), F.lit(True).alias("_row"))
    whole = rows.unionByName(answers.select(F.lit(None).cast(df.schema[key].dataType).alias("_key"), "_k", "_at", "_ids", F.lit(False).alias("_row")))
    whole = whole.repartition("_k").sortWithinPartitions("_k", "_row", "_at")

    def put_back(batches):
        put, n, last, got = Put(shared.value), n_known, None, {}
        keys, wait = [], []

        def done():
            ids = pa.array([x.astype("<u4").tobytes() for x in put.together(wait)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), ids], names=[key, "ids"])

        for batch in batches:
            is_row = batch.column(batch.schema.get_field_index("_row"))
            for k, at, ids, row in zip(values(batch, "_k"), values(batch, "_at"), values(batch, "_ids"), is_row.to_pylist()):
                if k != last:
                    last, got = k, {}
                if not row:
                    got.setdefault(at >> 32, []).append(ids)  # in order of their first use
                    continue
                codes = unpack(ids)
                most, more = max(0, int(codes.max(initial=-1)) - n + 1), got.get(at, [])
                if most != len(more):
                    raise ValueError(f"a text has {most} words beside the frequent ones, but ids came for {len(more)}")
                wait.append((codes, more))
            keys.append(batch.column(0).filter(is_row))
            if len(wait) >= ROWS:
                yield done()
                keys, wait = [], []
        if wait:
            yield done()

    found = mapped(whole, put_back, widened(df, [key], "ids binary"))

    def distinct(batches):
        seen = np.zeros(1 << 8 * known_size, bool)
        for batch in batches:
            seen[np.frombuffer(b"".join(texts(batch, "_ids")), kind)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["id"])

    known_size = min(known.line.itemsize, 3)
    used = mapped(answers.select("_ids"), distinct, "id int").distinct()
    own = spark.createDataFrame(pa.table({"id": pa.array(np.unique(known.line).astype(np.int32))}))
    return found, used.unionByName(own).distinct()


def encode(df: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's key with ids: the text's token ids as little-endian unsigned 32-bit numbers."""
    return encoded(df, file, key, text)[0]


def vocabulary(spark: SparkSession, file: str) -> DataFrame:
    """(id, piece) of every entry of the vocabulary."""
    found = splitter(file).tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pa.table({"id": pa.array(found.values(), pa.int32()), "piece": pa.array(found.keys(), pa.string())}))


def distinct_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """The distinct numbers (id) in df's column of ids. This reads df once; a df that is dear to compute should be written first."""

    def run(batches):
        for batch in batches:
            found = np.unique(np.frombuffer(b"".join(texts(batch, ids)), "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["id"])

    return mapped(df.select(ids), run, "id int").distinct()


def decode(df: DataFrame, file: str, ids: str = "ids", used: DataFrame | None = None) -> DataFrame:
    """df with decoded: the pieces of the ids, joined as the tokenizer's decode() does without a decoder, by spaces.

    The distinct ids (used, or those that a reading of df finds) are joined with the vocabulary's
    table; what comes of that, a row for each entry of the vocabulary at most, goes to the tasks.
    """
    if splitter(file).tokenizer.decoder is not None:
        raise ValueError("only tokenizers without a decoder are decoded")
    df = df.drop("decoded")
    spark = df.sparkSession
    found = (distinct_ids(df, ids) if used is None else used).join(vocabulary(spark, file), "id").toArrow()  # as many rows as the vocabulary has
    pieces = np.full(max(found["id"].to_pylist(), default=0) + 1, None, object)
    pieces[found["id"].to_numpy()] = found["piece"].to_pylist()
    table = spark.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                out = []
                for x in values(part, ids):
                    line = np.frombuffer(x or b"", "<u4")
                    try:
                        out.append(" ".join(table.value[line].tolist()))
                    except (IndexError, TypeError):  # an id without a piece
                        out.append(" ".join(p for p in (table.value[k] for k in line.tolist() if k < len(table.value)) if p is not None))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    return mapped(df, run, widened(df, df.columns, "decoded string"))
