"""Listings and evaluation: aggregates that skip what is unknown, runs and their differences."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import expected_tickers, figures, hit_rate
from .names import held
from .order import selected
from .stage import written

#: Bytes of text in a compressed piece: a batch of 10,000 pieces stays small.
PIECE = 1 << 15
# Markers of question types, the first that occurs counts.
QUESTION_MARKERS = [
    ("total net revenue for its most recent fiscal year", "exact_figure"),
    ("risk factors related to supply chain", "interpretive"),
    ("describe its business segments", "interpretive"),
    ("total assets and CET1 capital ratio", "exact_figure"),
    ("primary credit risk factors", "interpretive"),
    ("describe its lines of business", "interpretive"),
    ("automotive revenue and total revenue", "exact_figure"),
    ("related to production and manufacturing", "interpretive"),
    ("Intelligent Cloud segment", "exact_figure"),
    ("cybersecurity and AI-related risk factors", "interpretive"),
    ("principal business segments", "interpretive"),
    ("market risk disclosures does Goldman Sachs provide including VaR", "exact_figure"),
    ("Compare the risk factor disclosures", "comparative"),
    ("How do Apple and Microsoft compare", "comparative"),
    ("regulatory risks do JPMorgan and Goldman Sachs face", "comparative"),
    ("competition in the electric vehicle market", "interpretive"),
    ("provision for credit losses", "exact_figure"),
    ("AI strategy and investments", "interpretive"),
    ("quantitative disclosures about market risk", "exact_figure"),
    ("legal proceedings are disclosed", "interpretive"),
    ("total revenue and operating income for fiscal year 2025", "exact_figure"),
    ("spend on research and development in fiscal 2025", "exact_figure"),
    ("More Personal Computing segment revenue", "exact_figure"),
    ("gross margin percentage for fiscal 2025", "exact_figure"),
    ("total operating expenses and net income attributable", "exact_figure"),
    ("total net revenues and return on average common", "exact_figure"),
    ("competition in the productivity and business processes", "interpretive"),
    ("human capital and employee programs", "interpretive"),
    ("energy generation and storage business", "interpretive"),
    ("intellectual property and patent protection", "interpretive"),
    ("dependence on single-source suppliers", "comparative"),
    ("disclosed research and development priorities", "comparative"),
    ("capital adequacy positions", "comparative"),
    ("exposure to foreign currency risk", "comparative"),
    ("climate and environmental risk disclosures", "comparative"),
    ("iPhone units did Apple ship", "no_answer"),
    ("average selling price per vehicle", "no_answer"),
    ("Azure revenue came from its OpenAI partnership", "no_answer"),
    ("total compensation paid to JPMorgan's chief executive", "no_answer"),
    ("employees work in Goldman Sachs' Platform Solutions", "no_answer"),
    ("Netflix's total streaming revenue", "out_of_corpus"),
    ("did NVIDIA report", "out_of_corpus"),
    ("federal funds rate target range", "out_of_corpus"),
    ("Berkshire Hathaway describe its insurance float", "out_of_corpus"),
    ("internal trading desk procedures manual", "rbac_blocked"),
    ("internal AML/KYC procedures manual", "rbac_blocked"),
    ("internal credit risk management policy", "rbac_blocked"),
    ("net sales for the Americas region", "rbac_blocked"),
    ("Apple's revenue last year", "ambiguous"),
    ("Microsoft's cloud revenue", "ambiguous"),
    ("Tesla's margin in 2025", "ambiguous"),
    ("total revenue last year", "ambiguous"),
    ("the bank set aside for credit losses", "ambiguous"),
    ("the company's main risks", "ambiguous"),
]
# Configuration that two runs must share to be compared, and the strata of a summary.
INCOMPARABLE = ("eval_questions", "judge_model", "judge_provider", "judge_embedding_model")


def listing(chunks: DataFrame, order: str = "doc_pos") -> DataFrame:
    """A row for each source, sorted: first-seen department, ticker, type and date, sections in order of appearance, chunks.

    Chunks are summed up by source and section first, so that what meets is a row for each section.
    """
    source = F.coalesce("source_file", F.lit("unknown")).alias("source")
    names = ("department", "ticker", "filing_type", "filing_date")
    each = chunks.groupBy(source, "section_name").agg(F.min(F.struct(F.col(order).alias("o"), *names)).alias("first"), F.count(F.lit(1)).alias("n"))
    sections = F.transform(F.array_sort(F.collect_list(F.when(F.col("section_name").isNotNull(), F.struct(F.col("first.o").alias("o"), F.col("section_name").alias("s"))))), lambda x: x["s"])
    out = each.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("chunks"), sections.alias("sections"))
    return out.select("source", *[F.col(f"first.{c}").alias(c) for c in names], "chunks", "sections").orderBy("source")


def sections_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ticker", "section_name").agg(F.count(F.lit(1)).alias("chunks")).orderBy("ticker", "section_name")


def fingerprint(chunks: DataFrame, content: str = "content") -> DataFrame:
    """(chunk_count, digest): the first 16 digits of the SHA-256 of all sorted chunk hashes.

    The hashes are sorted in ranges of their first digits, of some ten thousand each; the digest
    reads one range after the other, so that neither a task nor the driver holds more than a few.
    """
    each = chunks.select(F.sha2(F.coalesce(content, F.lit("")), 256).alias("h"))
    n = each.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / 10_000 + 1, 16)))
    parts = each.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("s")).orderBy("p")
    digest = hashlib.sha256()
    for r in parts.select("s").toLocalIterator():
        digest.update(r["s"].encode())
    return chunks.sparkSession.createDataFrame([(n, digest.hexdigest()[:16])], "chunk_count long, digest string")


def means(df: DataFrame, metrics: list[str], by: Column | None = None) -> DataFrame:
    """The mean and the number of known values of each metric, in all or by a column."""
    aggs = [x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias(f"{m}_n"))]
    return df.agg(*aggs) if by is None else df.groupBy(by).agg(*aggs, F.count(F.lit(1)).alias("n"))


def worst(df: DataFrame, metric: str, k: int = 3, tie: str = "question") -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).orderBy(F.asc(metric), F.asc(tie)).limit(k)


def spread(runs: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean and range over runs of each metric, if all runs (run, fingerprint) measured the same thing."""
    prints = runs.select("fingerprint").distinct().limit(2).count()
    if prints > 1:
        raise ValueError("these runs don't describe the same measurement")
    known = runs.filter(F.col(value).isNotNull())
    return known.groupBy(metric).agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"), F.count(F.lit(1)).alias("runs"))


def run_difference(a: DataFrame, b: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A full join of two runs' metrics with the change from a to b, null where one lacks it."""
    x, y = a.select(F.col(key), F.col(value).alias("a")), b.select(F.col(key), F.col(value).alias("b"))
    return x.join(y, key, "full").withColumn("delta", F.col("b") - F.col("a"))


def moved(a: DataFrame, b: DataFrame, k: int, key: str = "question", value: str = "value") -> DataFrame:
    """Questions of both runs that moved, the largest changes first."""
    both = run_difference(a, b, key, value).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.filter(F.abs("delta") > 1e-9).orderBy(F.desc(F.round(F.abs("delta"), 9)), key).limit(k)


def calibration(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(label, n, least, median, most) of known scores; the median of an even number is the upper one."""
    return selected(df, label, score, lambda n: F.floor(n / 2)).withColumnRenamed("selected", "median")


def thresholds(df: DataFrame, inside: str, outside: str, label: str = "label", score: str = "score") -> DataFrame:
    """For each score as a threshold: known rows of `inside` below it and of `outside` at or above it.

    Running sums within ranges of scores, and over the ranges' totals, of which there are as many as tasks.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == inside).alias("i"), F.count_if(F.col(label) == outside).alias("o"))
    parts = written(counts.repartitionByRange("threshold").withColumn("part", F.spark_partition_id()), "thresholds")
    ranges = Window.orderBy("part")
    below = F.sum("i").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("o").over(ranges.rowsBetween(1, Window.unboundedFollowing))
    totals = parts.groupBy("part").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).select("part", F.coalesce(below, F.lit(0)).alias("below"), F.coalesce(above, F.lit(0)).alias("above"))
    line = Window.partitionBy("part").orderBy("threshold")
    refused = F.coalesce(F.sum("i").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    admitted = F.sum("o").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return parts.join(F.broadcast(totals), "part").select("threshold", (F.col("below") + refused).alias("refused"), (F.col("above") + admitted).alias("admitted"))


def keyword_overlap(truth: Column, answer: Column) -> Column:
    """The share of the truth's distinct lower-cased words that the answer has."""
    words = F.array_distinct(F.filter(F.split(F.lower(truth), r"\s+"), lambda w: w != ""))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.split(F.lower(answer), r"\s+"))) / F.size(words)).otherwise(0.0)


def question_type(question: Column, markers=QUESTION_MARKERS) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m.lower())), F.lit(t)) for m, t in markers])


def abstention_errors(df: DataFrame) -> DataFrame:
    """Rows scored 0 for refusing, with what went wrong."""
    detail = F.when(F.col("expected_behavior") == "refuse", "answered, should have declined").otherwise(F.concat(F.lit("declined ("), F.coalesce("refusal_reason", F.lit("unknown")), F.lit("), should have answered")))
    return df.filter("refusal_correctness = 0").withColumn("detail", detail)


def by_question(questions: DataFrame, *scores: DataFrame, key: str = "question_no") -> DataFrame:
    """questions with each table of scores joined by number, never by position; unscored ones stay, with nulls."""
    for s in scores:
        questions = questions.join(s, key, "left")
    return questions


def contains_evidence(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """probes (probe_id, ticker, evidence) with found: whether some chunk (ticker, content) of the ticker holds the evidence in any case."""
    hit = held(probes, chunks).withColumn("found", F.lit(True))
    return probes.join(hit, "probe_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def basic_evaluation(rows: DataFrame) -> DataFrame:
    """One row for results (answer, contexts, ground_truth): questions, those with contexts, answers of over 20 characters, mean overlap of those with a truth."""
    words = F.filter(F.split(F.lower("ground_truth"), r"\s+"), lambda w: w != "")
    return rows.agg(
        F.count(F.lit(1)).alias("questions_evaluated"),
        F.count_if(F.size("contexts") > 0).alias("answers_with_context"),
        F.count_if(F.length("answer") > 20).alias("non_empty_answers"),
        F.avg(F.when(F.size(words) > 0, keyword_overlap(F.col("ground_truth"), F.coalesce("answer", F.lit(""))))).alias("avg_keyword_overlap"),
    )


def stratum_counts(questions: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """(question_type, n): how many questions are of each type, those of none in a row without a type; and the questions of none, a row each."""
    typed = written(questions.withColumn("question_type", question_type(F.col(question))), "typed")
    return typed.groupBy("question_type").agg(F.count(F.lit(1)).alias("n")), typed.filter("question_type IS NULL").drop("question_type")


def digest(rows: DataFrame, column: str, separator: str = "\u0001") -> DataFrame:
    """One row (digest): SHA-256, in hexadecimal, of all strings of a column but nulls, in order and with the separator between them.

    A hash can't be cut up, so one task reads it all: the strings are sorted by ranges in all tasks and
    come as compressed pieces, of which a few are held at a time.
    """
    between = separator.encode()

    def pack(batches):
        held, size, at = [], 0, 0
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(x.encode())
                size += len(held[-1])
                if size >= PIECE:
                    yield piece(part, at, held)
                    held, size, at = [], 0, at + 1
        if held:
            yield piece(part, at, held)

    def piece(part: int, at: int, held: list[bytes]) -> pa.RecordBatch:
        raw = between.join(held)
        return pa.RecordBatch.from_pylist([{"part": part, "at": at, "size": len(raw), "data": pa.compress(raw, codec="zstd", asbytes=True)}], schema=kind)

    def hashed(batches):
        h, first = hashlib.sha256(), True
        for batch in batches:
            for size, data in zip(batch.column(2), batch.column(3)):
                if not first:
                    h.update(between)
                h.update(pa.decompress(data.as_buffer(), decompressed_size=size.as_py(), codec="zstd"))
                first = False
        yield pa.RecordBatch.from_pydict({"digest": [h.hexdigest()]})

    kind = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
    dealt = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("x")).repartitionByRange("x").sortWithinPartitions("x").select(F.spark_partition_id().alias("part"), "x")
    pieces = dealt.mapInArrow(pack, "part int, at long, size long, data binary")
    return pieces.repartition(1).sortWithinPartitions("part", "at").mapInArrow(hashed, "digest string")


def strata_over_runs(rows: DataFrame) -> DataFrame:
    """(question_type, n, faithfulness, refusal_correctness) of rows (run, question_type and both): questions a run, and means of what is known over all runs."""
    runs = rows.select("run").distinct().count()
    each = rows.filter(F.col("question_type").isNotNull()).groupBy("question_type").agg(F.count(F.lit(1)).alias("all"), F.avg("faithfulness").alias("faithfulness"), F.avg("refusal_correctness").alias("refusal_correctness"))
    return each.select("question_type", F.floor(F.col("all") / max(1, runs)).alias("n"), "faithfulness", "refusal_correctness")


def free_retrieval(questions: DataFrame, hits: DataFrame, gate: float) -> DataFrame:
    """Retrieval judged without a model, a row for each question that expects an answer.

    questions: query_id, question_type, source_filing, ground_truth, expected_behavior (null: answer).
    hits: query_id, rank, content, ticker, relevance. hit_rate is the share of the truth's figures
    that the passages hold, entity_purity the share of passages of an expected company; either is null
    where there is nothing to find.
    """
    asked = questions.filter(F.coalesce("expected_behavior", F.lit("answer")) == "answer").withColumn("expected_tickers", expected_tickers(F.coalesce("source_filing", F.lit(""))))
    line = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("ticker", F.lit("")).alias("ticker"))))
    found = hits.groupBy("query_id").agg(line.alias("l"), (0.6 * F.max("relevance") + 0.4 * F.avg("relevance")).alias("confidence"))
    out = asked.join(found, "query_id", "left")
    blob = F.coalesce(F.array_join(F.transform("l", lambda x: x["content"]), "\n"), F.lit(""))
    wanted = F.size(figures(F.col("ground_truth")))
    rate = hit_rate(F.col("ground_truth"), blob)
    pure = F.size(F.filter("l", lambda x: F.array_contains("expected_tickers", x["ticker"]))) / F.size("l")
    return out.select(
        "query_id", "question_type", "expected_tickers", wanted.alias("figures_wanted"), F.coalesce(F.round(rate * wanted), F.lit(0)).cast("int").alias("figures_found"), rate.alias("hit_rate"),
        F.when((F.size("l") > 0) & (F.size("expected_tickers") > 0), pure).alias("entity_purity"), "confidence", F.coalesce(F.col("confidence") < gate, F.lit(False)).alias("gate_fires"),
    )


def free_retrieval_by(rows: DataFrame, company: bool = False) -> DataFrame:
    """(grp, n, hit_rate, entity_purity, gate_fires) of free_retrieval()'s rows by stratum, or by each company that is expected."""
    grp = F.explode("expected_tickers") if company else F.coalesce("question_type", F.lit("untyped"))
    return rows.select(grp.alias("grp"), "hit_rate", "entity_purity", "gate_fires").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("hit_rate").alias("hit_rate"), F.avg("entity_purity").alias("entity_purity"), F.count_if("gate_fires").alias("gate_fires"))


def judged(results: DataFrame, scores: DataFrame, metrics: list[str], key: str = "question_no") -> tuple[DataFrame, DataFrame]:
    """The means with numbers of a judge's metrics, and a row for each question with its own.

    results: key, question, expected_behavior, error (null: none). scores: key, question and metrics of
    the questions that were sent to the judge: those that expect an answer and raised no error. A score
    that isn't a number is unknown. Raises ValueError where a score names another question than its key.
    """
    sent = results.filter((F.coalesce("expected_behavior", F.lit("answer")) == "answer") & F.col("error").isNull()).select(key, "question")
    got = scores.select(key, F.col("question").alias("_asked"), *[F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics])
    both = sent.join(got, key, "left")
    if both.filter(F.trim("_asked") != F.trim("question")).limit(1).count():
        raise ValueError("the judge's rows are out of order")
    each = results.select(key).join(both.drop("question", "_asked"), key, "left")
    return means(each, metrics), each


def incomparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b): settings in which two runs (key, value) may not differ if their scores are to be compared, and do. The corpus's digest counts as one, under `corpus`."""
    return config_delta(a, b).filter(F.col("key").isin("corpus", *INCOMPARABLE)).orderBy("key")


def require_comparable(a: DataFrame, b: DataFrame) -> None:
    """Raises ValueError with the settings in which two runs may not differ and do."""
    apart = [r["key"] for r in incomparable(a, b).collect()]  # a fixed list of keys
    if apart:
        raise ValueError(f"scores of runs that differ in {', '.join(apart)} can't be compared")


def config_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of two configurations (key, value) where they differ; null where one lacks the key."""
    x, y = a.select("key", F.col("value").alias("a")), b.select("key", F.col("value").alias("b"))
    return x.join(y, "key", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("key", "a", "b")


def weight_ratio(dense: float, sparse: float) -> str:
    if sparse == 0:
        return "dense_only" if dense else "none"
    return f"{dense / sparse:.4g}:1"
