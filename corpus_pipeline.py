"""From raw documents to token ids: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, mixing, neardup, toxicity
from siltstone.llm.common import fold, numbered, staged, table
from siltstone.llm.queries import tokenizer_file

#: A text goes if its language holds less than this share of its trigrams: it is in none that was learned.
LEAST_SHARE = 0.1
#: A text goes from this score.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts in no learned language, go."""
    rows, new, back = numbered(docs)
    found = langid.identify(rows, langid.fit(docs), new["text"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("lang_share") >= LEAST_SHARE)).select(*back)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go; the model learns from the labels of four fifths of the documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    rows, new, back = numbered(docs)
    return toxicity.score(rows, model, new["text"]).filter(F.col("toxic_score") < TOXIC).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest doc_id."""
    return neardup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), and the hashes of the ids and of the decoded text."""
    file = tokenizer_file()
    rows, used = bpe.encoded(docs, file)
    found = bpe.decode(rows, file, used=used)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]
#: The models' decisions can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
