"""Readers: files by suffix, filings, submissions, corpora, evaluation sets and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import COMPANIES
from ..operators.filings import html_text, path_metadata
from ..schema import CHUNKS, METADATA, QUESTIONS


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.decode("content", "UTF-8"))


def _html(df: DataFrame) -> DataFrame:
    return df.withColumn("text", html_text(F.decode("content", "UTF-8")))


def _missing(library: str) -> Callable[[DataFrame], DataFrame]:
    def read(df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{library} is not installed: register a reader for this suffix")

    return read


#: Readers by suffix: from binaryFile rows to rows with `text`. Others can be put in.
LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    ".pdf": _missing("a PDF library"),
    ".docx": _missing("a DOCX library"),
    ".txt": _plain,
    ".md": _plain,
    ".html": _html,
    ".htm": _html,
}


def supported() -> list[str]:
    return list(LOADERS)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one file or of files that a pattern names, all with one suffix."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in LOADERS:
        raise ValueError(f"unsupported file type: {suffix}")
    return LOADERS[suffix](spark.read.format("binaryFile").load(path)).select("path", "text")


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a folder's files with supported suffixes, not of folders in it."""
    files = spark.read.format("binaryFile").load(path)
    out = None
    for suffix, loader in LOADERS.items():
        mine = files.filter(F.endswith(F.lower("path"), F.lit(suffix)))
        if suffix in (".pdf", ".docx") and not mine.limit(1).count():
            continue
        part = loader(mine).select("path", "text")
        out = part if out is None else out.unionByName(part)
    return out


def filings_from_disk(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, ticker, cik, company_name, filing_type, filing_date): pages with the JSON beside them, or with what the path tells."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    pages = pages.select("path", F.decode("content", "UTF-8").alias("html"), F.regexp_replace("path", r"\.html$", "").alias("stem"))
    notes = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    schema = "ticker string, cik string, company_name string, form_type string, filing_date string, accession_number string, primary_document string"
    notes = notes.select(F.regexp_replace("path", r"\.json$", "").alias("stem"), F.from_json(F.decode("content", "UTF-8"), schema).alias("m"))
    told = path_metadata(F.col("path"))
    registry = spark.createDataFrame([(t, c, n) for t, (c, n) in COMPANIES.items()], "r_ticker string, r_cik string, r_name string")
    both = pages.join(notes, "stem", "left").withColumn("ticker", F.coalesce(F.upper("m.ticker"), told["ticker"]))
    both = both.join(F.broadcast(registry), F.col("ticker") == F.col("r_ticker"), "left")  # a row for each company
    return both.select("path", "html", "ticker", F.coalesce("m.cik", "r_cik", F.lit("")).alias("cik"), F.coalesce("m.company_name", "r_name", "ticker").alias("company_name"), F.coalesce("m.form_type", told["filing_type"]).alias("filing_type"), F.coalesce("m.filing_date", told["filing_date"]).alias("filing_date"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, recent) of submissions files named by ticker."""
    parts = ", ".join(f"{n}: array<string>" for n in ("form", "accessionNumber", "filingDate", "primaryDocument", "primaryDocDescription"))
    df = spark.read.schema(f"filings struct<recent: struct<{parts}>>").json(path, multiLine=True)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("ticker"), F.col("filings.recent").alias("recent"))


def chunks(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A corpus without texts and vectors: the scan reads neither."""
    return chunks(spark, path).select(*METADATA)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path, multiLine=True).withColumn("expected_behavior", F.coalesce("expected_behavior", F.lit("answer")))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, timestamp, config, corpus, scores, per_question_scores) of evaluation runs."""
    schema = "timestamp string, config map<string,string>, corpus struct<chunk_count: long, content_digest: string>, scores map<string,double>, per_question_scores array<struct<question: string, question_type: string, expected_behavior: string, faithfulness: double, refusal_correctness: double, refusal_reason: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())
