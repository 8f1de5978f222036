"""Reference answers from whole filings: every question reads every window of the filings that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.entities import COMPANIES
from ..functions.text import stripped
from .boundary import Model, asked
from .stage import written

# What a model says of a window, or of a filing, that holds nothing.
NOT_IN_WINDOW, NOT_IN_FILING = "NOT_IN_WINDOW", "NOT_IN_FILING"


def named(filing: Column) -> Column:
    """(place, ticker) of the companies that a source_filing names, in the order of the register; all of them where it names none."""
    every = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("ticker")) for k, t in enumerate(COMPANIES)])
    found = F.filter(every, lambda x: F.rlike(F.coalesce(filing, F.lit("")), F.concat(F.lit(r"\b"), x["ticker"], F.lit(r"\b"))))
    return F.when(F.size(found) > 0, found).otherwise(every)


def filing_windows(sections: DataFrame, size: int, overlap: int) -> DataFrame:
    """(ticker, window, text): overlapping windows over all sections of a company's filings, put in a row under their headings.

    sections: ticker, filing_type, section_name, content, and by (file, place) their order. The whole text
    of a company is never put together: running lengths say which windows a section lies in, and a window
    gathers its own pieces.
    """
    step = size - overlap
    head = F.concat(F.lit("=== "), "ticker", F.lit(" "), F.coalesce("filing_type", F.lit("")), F.lit(" — "), F.coalesce("section_name", F.lit("")), F.lit(" ===\n"), F.coalesce("content", F.lit("")))
    parts = sections.filter(F.col("ticker").isNotNull()).select("ticker", "file", "place", head.alias("part"))
    lengths = parts.select("ticker", "file", "place", F.length("part").cast("long").alias("n"))
    line, all_ = Window.partitionBy("ticker").orderBy("file", "place"), Window.partitionBy("ticker")
    at = lengths.select("ticker", "file", "place", (F.sum(F.col("n") + 2).over(line) - F.col("n") - 2).alias("a"), (F.sum(F.col("n") + 2).over(all_) - 2).alias("total"))
    text = parts.join(at, ["ticker", "file", "place"])
    # Two line ends stand between sections, and go with the one before.
    text = text.withColumn("part", F.when(F.col("a") + F.length("part") < F.col("total"), F.concat("part", F.lit("\n\n"))).otherwise(F.col("part"))).withColumn("b", F.col("a") + F.length("part"))
    first = F.greatest(F.ceil((F.col("a") - size + 1) / step), F.lit(0))
    last = F.when(F.col("total") <= size, F.lit(0)).otherwise(F.floor((F.col("b") - 1) / step))
    each = text.filter("b > a").select("ticker", "a", "b", "part", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("window"))
    low, high = F.greatest(F.col("a"), F.col("window") * step), F.least(F.col("b"), F.col("window") * step + size)
    piece = F.substring("part", (low - F.col("a") + 1).cast("int"), (high - low).cast("int"))
    return each.select("ticker", "window", "a", piece.alias("piece")).groupBy("ticker", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "piece"))), lambda x: x["piece"]), "").alias("text"))


def ground_truths(questions: DataFrame, sections: DataFrame, extract: Model, compose: Model, settings: Settings = DEFAULTS, widest: int | None = None) -> DataFrame:
    """(query_id, ground_truth, windows, findings, failed) of questions (query_id, question, source_filing).

    extract reads (question, window), compose (question, material). Findings without a sentinel are put
    in the order of companies and windows; material of over `widest` characters is composed in parts
    first, and the parts' answers then, so that no call reads more than about that. Without findings the
    answer is NOT_IN_FILING and compose isn't asked. A window whose call failed is counted in `failed`,
    and a failed composition leaves the answer null.
    """
    widest = widest or settings.window_chars
    windows = written(filing_windows(sections, settings.window_chars, settings.window_overlap), "windows")
    asks = questions.select("query_id", "question", F.explode(named(F.col("source_filing"))).alias("t")).select("query_id", "question", "t.place", "t.ticker")
    read = asked(asks.join(windows, "ticker"), extract, ["question", "text"], "found").drop("text")
    found = stripped(F.coalesce("found", F.lit("")))
    useful = (found != "") & ~F.contains(found, F.lit(NOT_IN_WINDOW)) & ~F.contains(found, F.lit(NOT_IN_FILING))
    read = written(read.withColumn("found", F.when(useful, F.concat(F.lit("["), "ticker", F.lit("] "), found))), "findings")
    counts = read.groupBy("query_id").agg(F.count(F.lit(1)).alias("windows"), F.count("found").alias("findings"), F.count("found_error").alias("failed"))
    order = Window.partitionBy("query_id").orderBy("place", "window")
    left = read.filter(F.col("found").isNotNull()).select("query_id", "question", F.col("found").alias("text"), (F.row_number().over(order) - 1).alias("k"))
    answers = None
    while True:
        line = Window.partitionBy("query_id").orderBy("k")
        sized = left.withColumn("sum", F.sum(F.length("text") + 2).over(line)).withColumn("whole", F.sum(F.length("text") + 2).over(Window.partitionBy("query_id")))
        # Two at least in each part, so that rounds halve what there is.
        part = F.when(F.col("whole") <= widest, F.lit(0)).otherwise(F.least(F.floor((F.col("sum") - 1) / widest), F.floor(F.col("k") / 2)))
        material = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n")
        groups = sized.withColumn("part", part.cast("int")).groupBy("query_id", "question", F.col("part")).agg(material.alias("material")).withColumnRenamed("part", "k")
        found = asked(groups, compose, ["question", "material"], "text").select("query_id", "question", "k", stripped(F.col("text")).alias("text"))
        found = written(found.withColumn("parts", F.max("k").over(Window.partitionBy("query_id")) + 1), "composed")
        final = found.filter("parts = 1").select("query_id", F.col("text").alias("ground_truth"))
        answers = final if answers is None else answers.unionByName(final)
        # What is left of a failed part is nothing; the other parts go on.
        left = found.filter("parts > 1 AND text IS NOT NULL").drop("parts")
        left = written(left.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("k")) - 1), "parts")
        if left.isEmpty():
            break
    out = questions.select("query_id").join(counts, "query_id", "left").join(answers, "query_id", "left")
    none = F.coalesce("findings", F.lit(0)) == 0
    return out.select("query_id", F.when(none, F.lit(NOT_IN_FILING)).otherwise(F.col("ground_truth")).alias("ground_truth"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("windows", "findings", "failed")])
