"""BM25 over an inverted index that is kept: built once for a corpus and scope, extended by deltas, read in part.

Under a root there is a folder for each key (who reads what), in it generations, in each tables cut into
deltas: docs (what is indexed), postings by token and block of documents, frequency by token, sizes. Numbers
of deltas add up, so that new documents are indexed alone. A corpus of which indexed documents have changed
or gone gets a new generation. A delta counts once the last of its tables is whole.

A block of postings carries the largest frequency and the least length in it, which bound what any of its
documents can score. A search scores the most promising blocks first and then only those whose bound reaches
the k-th score found: the rows are those of a full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.text import tokens
from .access import Authorized
from .rank import DIGITS, PASSAGES, _best, counted, ranked
from .stage import written

#: Documents of a block are about as long as each other, and their doc_pos lie in the same range of so many.
BLOCK = 4096
#: Classes of length for each doubling.
CLASSES = 4
#: Blocks of a question that are scored first.
FIRST = 4
TABLES = ("docs", "postings", "frequency", "means", "sizes")
#: Tokens of a batch of questions up to which they are sent to the scan as a filter.
PUSHED = 2_000


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _counts(batches):
    """(token, scopes, doc_pos, dl, tf) of each distinct token of each document (doc_pos, scopes, t), some documents at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, PASSAGES):
            part = batch.slice(a, PASSAGES)
            words = part.column(2).flatten().dictionary_encode().dictionary
            row, at, times, size = counted(part.column(2), words)
            lines, dl = pa.array(row), pa.array(size[row].astype(np.int32))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), part.column(1).take(lines), part.column(0).take(lines), dl, pa.array(times.astype(np.int32))], names=["token", "scopes", "doc_pos", "dl", "tf"])


class KeptBm25:
    """The index of one corpus and key. open() makes or extends it; search() and idf() are those of rank.Bm25.

    tokenised counts the documents that this object has cut into tokens.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, settings: Settings = DEFAULTS, block: int = BLOCK):
        self.spark, self.settings, self.block = spark, settings, block
        self.at = f"{root.rstrip('/')}/key={hashlib.sha256(f'{key}|{block}'.encode()).hexdigest()[:24]}"
        self.generation = max(_listed(spark, self.at, "generation="), default=0)
        self.tokenised = 0

    @classmethod
    def open(cls, corpus: Authorized, root: str, key: str, settings: Settings = DEFAULTS, block: int = BLOCK) -> KeptBm25:
        """The index of a corpus (doc_pos, passage, and scopes where there are any): as kept, extended, or made anew.

        A kept index is known by its fingerprint: how many documents there are, and sums over hashes of
        them, which don't depend on order.
        """
        index = cls(corpus.df.sparkSession, root, key, settings, block)
        docs = index._prepared(corpus)
        held = index.docs()
        if held is None:
            index._append(docs)
        elif index.fingerprint(docs) != index.fingerprint(held):
            gone = held.join(docs.select("doc_pos", "hash"), ["doc_pos", "hash"], "left_anti")
            if gone.isEmpty():
                index._append(docs.join(held.select("doc_pos"), "doc_pos", "left_anti"))
            else:
                index.generation += 1
                index._append(docs)
        return index

    def _prepared(self, corpus: Authorized) -> DataFrame:
        df = corpus.df if "scopes" in corpus.df.columns else corpus.df.withColumn("scopes", F.array(F.lit("")))
        return df.select("doc_pos", "passage", "scopes", F.xxhash64(F.lit(7), "passage", "scopes").alias("hash"))

    @staticmethod
    def fingerprint(docs: DataFrame) -> tuple:
        whole = F.xxhash64("doc_pos", "hash")
        return tuple(docs.agg(F.count(F.lit(1)), F.bit_xor(whole), F.sum(F.pmod(F.xxhash64("hash", "doc_pos"), F.lit(2**31)))).first())

    # ------------------------------------------------------------ what is kept

    def deltas(self) -> list[int]:
        """Numbers of whole deltas: those whose sizes, written last, are there."""
        at = f"{self.at}/generation={self.generation}/sizes"
        fs, _ = _files(self.spark, at)
        return [n for n in _listed(self.spark, at, "delta=") if fs.exists(_files(self.spark, f"{at}/delta={n}/_SUCCESS")[1])]

    def _path(self, table: str, delta: int) -> str:
        return f"{self.at}/generation={self.generation}/{table}/delta={delta}"

    def _read(self, table: str, last: bool = False) -> DataFrame | None:
        known = self.deltas()
        return self.spark.read.parquet(*[self._path(table, n) for n in (known[-1:] if last else known)]) if known else None

    def docs(self) -> DataFrame | None:
        return self._read("docs")

    def sizes(self) -> DataFrame:
        """(scope, n, avgdl)."""
        return self._read("sizes").groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))

    def frequency(self) -> DataFrame:
        """(token, scope, df)."""
        return self._read("frequency").groupBy("token", "scope").agg(F.sum("df").alias("df"))

    def postings(self) -> DataFrame:
        return self._read("postings")

    def append(self, corpus: Authorized) -> None:
        """Index documents whose doc_pos are new."""
        self._append(self._prepared(corpus))

    def _append(self, docs: DataFrame) -> None:
        n = max(self.deltas(), default=-1) + 1
        put = lambda df, table: df.write.mode("overwrite").parquet(self._path(table, n))
        put(docs.select("doc_pos", "hash"), "docs")
        told = docs.select("doc_pos", "scopes", tokens(F.col("passage")).alias("t"))
        lengths = written(told.select("doc_pos", "scopes", F.size("t").alias("dl")), "bm25-lengths")
        self.tokenised += lengths.count()
        # A document's own counts, made where it lies; a posting for each scope that it stands in. The postings are
        # dealt once, by ranges in which the blocks are then put together.
        own = told.mapInArrow(_counts, "token string, scopes array<string>, doc_pos long, dl int, tf int")
        own = own.select("token", F.explode("scopes").alias("scope"), "doc_pos", "dl", "tf", self._block().alias("block"))
        docs_ = F.array_sort(F.collect_list(F.struct("doc_pos", "dl", "tf")))
        dealt = own.repartitionByRange("token", "scope", "block").sortWithinPartitions("token", "scope", "block")
        blocks = dealt.groupBy("token", "scope", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), docs_.alias("docs"))
        put(blocks.sortWithinPartitions("token", "scope", "block"), "postings")
        kept = self.spark.read.parquet(self._path("postings", n))
        put(kept.groupBy("token", "scope").agg(F.sum(F.size("docs")).alias("df")), "frequency")
        every = self.spark.read.parquet(*[self._path("frequency", k) for k in [*self.deltas(), n]]).groupBy("token", "scope").agg(F.sum("df").alias("df"))
        own_sizes = written(lengths.select(F.explode("scopes").alias("scope"), "dl").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")), "bm25-size")
        sizes = own_sizes if n == 0 else own_sizes.unionByName(self._read("sizes").select("scope", "n", "length"))
        total = sizes.groupBy("scope").agg(F.sum("n").alias("n"))
        put(every.join(total, "scope").groupBy("scope").agg(F.avg(self._raw()).alias("mean")), "means")
        put(own_sizes, "sizes")

    def _block(self) -> Column:
        """A document's block: its class of length and its range. Long documents have large frequencies and small scores; apart, both are bounded well."""
        return F.floor(F.log2(F.col("dl") + 1) * CLASSES) * 2**40 + F.floor(F.col("doc_pos") / self.block)

    @staticmethod
    def _raw() -> Column:
        return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    # ------------------------------------------------------------ search

    def idf(self, asked: DataFrame | None = None) -> DataFrame:
        """(token, scope, idf), of the tokens asked for (token) alone if given; a negative one becomes epsilon times the mean over the scope's vocabulary."""
        some = self.frequency() if asked is None else self._read("frequency").join(asked.select("token").distinct(), "token", "left_semi").groupBy("token", "scope").agg(F.sum("df").alias("df"))
        raw = some.join(self.sizes().select("scope", "n"), "scope").join(self._read("means", last=True), "scope").withColumn("raw", self._raw())
        return raw.select("token", "scope", F.when(F.col("raw") < 0, self.settings.bm25_epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def _part(self, tf: str, dl: str) -> Column:
        s = self.settings
        return F.col(tf) * (s.bm25_k1 + 1) / (F.col(tf) + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col(dl) / F.col("avgdl")))

    def bounds(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The weights of a batch's tokens, and (query_id, scope, block, bound): what no document of the block can exceed."""
        if "scope" not in questions.columns:
            questions = questions.withColumn("scope", F.lit(""))
        asked = questions.select("query_id", "scope", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "scope", "token").agg(F.count(F.lit(1)).alias("times"))
        asked = written(asked, "bm25-asked")
        weight = asked.join(self.idf(asked), ["token", "scope"]).join(self.sizes().select("scope", "avgdl"), "scope")
        weight = written(weight.select("query_id", "scope", "token", "avgdl", (F.col("times") * F.col("idf")).alias("weight")), "bm25-weight")
        reach = F.greatest(F.col("weight") * self._part("max_tf", "min_dl"), F.lit(0.0))
        each = self._asked(weight).select("token", "scope", "block", "max_tf", "min_dl").join(weight, ["token", "scope"])
        # A token has a row in a block for each delta: the largest bounds it, and tokens add up.
        by_token = each.groupBy("query_id", "scope", "block", "token").agg(F.max(reach).alias("reach"))
        return weight, by_token.groupBy("query_id", "scope", "block").agg(F.sum("reach").alias("bound"))

    def _asked(self, weight: DataFrame) -> DataFrame:
        """Postings of the tokens asked for: a filter on the sorted scan while they are few, a join beyond."""
        some = weight.select("token").distinct()
        few = [r[0] for r in some.limit(PUSHED + 1).collect()]
        return self.postings().filter(F.col("token").isin(few)) if len(few) <= PUSHED else self.postings().join(some, "token", "left_semi")

    def _scored(self, weight: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, scope, doc_pos, score) of the documents of chosen blocks."""
        wanted = blocks.select("query_id", "scope", "block").join(weight, ["query_id", "scope"])
        hits = self._asked(weight).select("token", "scope", "block", "docs").join(wanted, ["token", "scope", "block"]).select("query_id", "scope", "weight", "avgdl", F.explode("docs").alias("d"))
        hits = hits.select("query_id", "scope", "weight", "avgdl", "d.doc_pos", "d.dl", "d.tf")
        return hits.groupBy("query_id", "scope", "doc_pos").agg(F.sum(F.col("weight") * self._part("tf", "dl")).alias("score"))

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, scope, doc_pos, score, rank) of questions (query_id, query, and scope where there are any)."""
        weight, bounds = self.bounds(questions)
        best = [_best(), F.asc("doc_pos")]
        if k is None:
            return ranked(self._scored(weight, bounds), best, k, ["query_id", "scope"])
        order = Window.partitionBy("query_id", "scope").orderBy(F.desc("bound"), "block")
        bounds = written(bounds.withColumn("place", F.row_number().over(order)), "bm25-bounds")
        first = written(self._scored(weight, bounds.filter(F.col("place") <= FIRST)), "bm25-first")
        least = ranked(first, best, k, ["query_id", "scope"]).groupBy("query_id", "scope").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        rest = bounds.filter(F.col("place") > FIRST).join(least, ["query_id", "scope"], "left")
        open_ = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS * 2))
        return ranked(first.unionByName(self._scored(weight, open_)), best, k, ["query_id", "scope"])

    def skipped(self, questions: DataFrame, k: int) -> tuple[int, int]:
        """How many blocks a search of these questions scores, and how many hold one of their tokens."""
        _, bounds = self.bounds(questions)
        found = self.search(questions, k).groupBy("query_id", "scope").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        both = bounds.join(found, ["query_id", "scope"], "left")
        need = F.col("least").isNull() | (F.col("bound") >= F.col("least"))
        row = both.agg(F.count_if(need), F.count(F.lit(1))).first()
        return row[0], row[1]
