"""Answers: contexts, claims and citations, verification, confidence, and the grounded answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions import answers as A
from ..functions.entities import is_ambiguous
from ..functions.text import describe, sentences, stripped
from .boundary import Model, asked
from .stage import written

# Marks of citations and of list items.
CITATION = r"\[\s*(?:Document\s+)?(\d+(?:\s*,\s*\d+)*)\s*\]"
BULLET = r"(?U)^\s*(?:[-*•–]|\d+[.)])\s+"

#: Stands between the blocks of a context.
BETWEEN = "\n\n---\n\n"


def context_block(rank: Column, row: dict[str, Column], content: Column) -> Column:
    """`[n] (Source: ..., ...)` and the text. row: columns by label, the first two always shown."""
    head = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("Unknown")) if label in ("Source", "Department") else c) for label, c in row.items()]
    shown = [h if label in ("Source", "Department") else F.when(row[label] != "", h) for label, h in zip(row, head)]
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), F.concat_ws(", ", *shown), F.lit(")\n"), content)


def sources(hits: DataFrame, chars: int = 200) -> DataFrame:
    """hits as an answer shows them: the first characters of the content, and source, the file that it is from."""
    return hits.withColumns({"content": F.substring("content", 1, chars), "source": F.coalesce("source_file", F.lit("unknown"))})


def contexts(blocks: DataFrame) -> DataFrame:
    """(query_id, context): each question's blocks (query_id, rank, block) in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return blocks.groupBy("query_id").agg(F.array_join(line, BETWEEN).alias("context"))


def claims(df: DataFrame, key: str = "query_id", answer: str = "answer", documents: str = "documents") -> DataFrame:
    """(key, claim_no, text, raw_text, citations, out_of_range) of answers; documents is how many blocks there were."""
    pieces = F.flatten(F.transform(F.split(F.col(answer), r"\r\n|[\n\r]"), lambda x: sentences(stripped(F.regexp_replace(x, BULLET, "")))))
    rows = df.select(key, documents, F.posexplode(pieces).alias("at", "raw_text"))
    text = F.regexp_replace(stripped(F.regexp_replace("raw_text", CITATION, "")), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"\s+([.,;:!?])", "$1")
    groups = F.regexp_extract_all("raw_text", F.lit(CITATION), 1)
    numbers = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.try_cast("int")))))
    rows = rows.withColumn("text", text).withColumn("numbers", numbers)
    inside = F.filter("numbers", lambda n: (n >= 1) & (n <= F.col(documents)))
    outside = F.filter("numbers", lambda n: ~((n >= 1) & (n <= F.col(documents))))
    rows = rows.withColumn("citations", inside).withColumn("out_of_range", outside)
    cited = F.size("numbers") > 0
    real = F.rlike("text", F.lit("[A-Za-z]")) & (cited | (~F.endswith("text", F.lit(":")) & (F.size(F.filter(F.split("text", " "), lambda w: w != "")) >= 3)))
    kept = rows.filter(real)
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("claim_no"), "text", "raw_text", "citations", "out_of_range")


def coverage(found: DataFrame, df: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, claims, cited, uncited, out_of_range, citations, coverage) for every row of df, 0 where there are no claims."""
    each = found.groupBy(key).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.size("citations") > 0).alias("cited"),
        F.count_if((F.size("citations") == 0) & (F.size("out_of_range") == 0)).alias("uncited"),
        F.sum(F.size("out_of_range")).alias("out_of_range"),
        F.sum(F.size("citations")).alias("in_range"),
    )
    out = df.select(key).join(each, key, "left").fillna(0, ["claims", "cited", "uncited", "out_of_range", "in_range"])
    return out.select(key, "claims", "cited", "uncited", "out_of_range", (F.col("in_range") + F.col("out_of_range")).alias("citations"), F.when(F.col("claims") > 0, F.col("cited") / F.col("claims")).otherwise(0.0).alias("coverage"))


def overlap_judge(claim: Column, block: Column) -> Column:
    """The default judge: by the share of the claim's words that the block holds."""
    from ..functions.text import tokens

    words = F.array_distinct(tokens(claim))
    share = F.size(F.array_intersect(words, tokens(block))) / F.greatest(F.size(words), F.lit(1))
    return F.when(share >= 0.8, "SUPPORTED").when(share >= 0.4, "PARTIAL").otherwise("UNSUPPORTED")


def verified(found: DataFrame, blocks: DataFrame, judge=overlap_judge, key: str = "query_id") -> DataFrame:
    """(key, claim_no, block, verdict): one judgement for each claim and block; invented blocks are out_of_range unjudged. blocks: key, rank, content."""
    pairs = found.select(key, "claim_no", "text", F.explode("citations").alias("block"))
    judged = pairs.join(blocks.select(key, F.col("rank").alias("block"), "content"), [key, "block"], "left")
    judged = judged.select(key, "claim_no", "block", A.verdict(judge(F.col("text"), F.col("content"))).alias("verdict"))
    invented = found.select(key, "claim_no", F.explode("out_of_range").alias("block")).withColumn("verdict", F.lit("out_of_range"))
    return judged.unionByName(invented)


def claim_verdicts(found: DataFrame, verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """claims with the verdict on their first judged citation, null where none was judged."""
    places = found.select(key, "claim_no", F.posexplode("citations").alias("place", "block"))
    judged = places.join(verdicts.filter("verdict IS NOT NULL"), [key, "claim_no", "block"])
    first = judged.groupBy(key, "claim_no").agg(F.min_by("verdict", "place").alias("verdict"))
    return found.join(first, [key, "claim_no"], "left")


def accuracy(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, accuracy, counts): the mean worth of verdicts, null if none was judged, and how many of each."""
    each = verdicts.groupBy(key, "verdict").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("counts"))
    return verdicts.groupBy(key).agg(F.avg(A.worth(F.col("verdict"))).alias("accuracy")).join(counts, key)


def retrieval_confidence(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """0.6 of the best and 0.4 of the mean relevance; null where none is known."""
    return hits.groupBy(key).agg((0.6 * F.max("relevance") + 0.4 * F.avg("relevance")).alias("retrieval"))


def unanswered(rows: DataFrame, reason: Column, detail: Column | None = None, key: str = "query_id") -> DataFrame:
    """(key, reason, summary, searched, suggested) from hits (key, rank and provenance), names in order without repeats."""
    c = F.col
    chunk = describe(c("ticker"), c("filing_type"), c("filing_date"), c("section_name"), c("source_file"))
    filing = describe(c("ticker"), c("filing_type"), c("filing_date"), None, c("source_file"))
    named = rows.select(key, "rank", chunk.alias("chunk"), filing.alias("filing"))
    line = F.array_sort(F.collect_list(F.struct("rank", "chunk", "filing")))
    out = named.groupBy(key).agg(line.alias("l"))
    summary = F.coalesce(*[F.when(reason == k, F.lit(v)) for k, v in A.REASONS.items()], F.lit("The question could not be answered from the filings."))
    if detail is not None:
        summary = F.concat_ws(" ", summary, detail)
    return out.select(key, reason.alias("reason"), summary.alias("summary"), F.array_distinct(F.transform("l", lambda x: x["chunk"])).alias("searched"), F.array_distinct(F.transform("l", lambda x: x["filing"])).alias("suggested"))


def rendered(summary: Column, searched: Column, suggested: Column) -> Column:
    """A report on an unanswered question as plain text."""
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    return F.concat_ws("\n", summary, listed("Passages consulted:", searched), listed("Worth checking manually:", suggested))


def numbered(hits: DataFrame) -> DataFrame:
    """(query_id, context, documents): each question's passages as numbered blocks with their provenance, in order of rank, and how many there are."""
    has = lambda name: F.col(name) if name in hits.columns else F.lit(None).cast("string")
    labels = {"Source": has("source_file"), "Department": has("department"), "Company": has("ticker"), "Filing": has("filing_type"), "Section": has("section_name"), "Date": has("filing_date")}
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    blocks = hits.withColumn("rank", place).select("query_id", "rank", context_block(F.col("rank"), labels, F.col("content")).alias("block"))
    depth = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"))
    return contexts(blocks).join(depth, "query_id")


#: What the default generator says where it has nothing to say, and what stands for an answer that failed.
REFUSAL = "I don't have enough information in the available documents to answer this question."


def extract_answer(question: Column, context: Column) -> Column:
    """The default generator: the first block's first sentence, cited before its end."""
    block = F.regexp_replace(F.get(F.split(context, r"\n\n---\n\n(?=\[\d+\] \()"), F.lit(0)), r"^\[1\] \([^\n]*\)\n", "")
    first = F.get(sentences(block), F.lit(0))
    return F.when(first.isNotNull(), F.regexp_replace(first, r"(?s)^(.*?)\s*([.?!]*)$", "$1 [1]$2")).otherwise(F.lit(REFUSAL))


def grounded(questions: DataFrame, hits: DataFrame, generate=extract_answer, settings: Settings = DEFAULTS, judge=None) -> DataFrame:
    """(query_id, status, answer, retrieval, coverage, completeness, accuracy, confidence, label) of questions (query_id, query).

    Ambiguous questions and those whose retrieval confidence is below the gate are split off before
    the generator, which never sees them; an unknown retrieval confidence passes the gate. The
    generator reads the question and all its passages as numbered blocks; where it is a Model, an answer
    that fails is a refusal. With a judge each citation
    is held against its block, and accuracy is the mean worth of the verdicts; without one, or without
    citations, it is null.
    """
    asks = questions.join(retrieval_confidence(hits), "query_id", "left")
    state = F.when(is_ambiguous(F.col("query")), "ambiguous_entity").when(F.col("retrieval") < settings.gate, "low_retrieval_confidence").otherwise("open")
    asks = asks.withColumn("status", state)
    shut = asks.filter("status != 'open'").select("query_id", "status", F.lit(None).cast("string").alias("answer"), "retrieval", F.lit(0).cast("long").alias("documents"))
    open_ = asks.filter("status = 'open'").join(numbered(hits), "query_id", "left")
    open_ = open_.withColumn("context", F.coalesce("context", F.lit("")))
    if isinstance(generate, Model):
        open_ = asked(open_, generate, ["query", "context"], "answer").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))
    else:
        open_ = open_.withColumn("answer", generate(F.col("query"), F.col("context")))
    answered = open_.select("query_id", "status", "answer", "retrieval", F.coalesce("documents", F.lit(0)).alias("documents"))
    both = written(answered, "generated").unionByName(shut)  # written, so that a generator is asked once
    return rated(both, hits, judge)


def rated(both: DataFrame, hits: DataFrame, judge=None) -> DataFrame:
    """The columns of grounded() for answers (query_id, status, answer, retrieval, documents) that were made from hits."""
    found = claims(both.withColumn("answer", F.coalesce("answer", F.lit(""))))
    scored = both.join(coverage(found, both), "query_id")
    complete = F.when(F.col("answer").isNull(), 0.0).otherwise(A.completeness(F.col("answer"), F.col("claims"), F.col("cited")))
    scored = scored.withColumn("completeness", complete)
    refused = A.is_refusal(F.col("answer")) & (F.col("cited") == 0)
    scored = scored.withColumn("status", F.when((F.col("status") == "open") & refused, "model_refused").when(F.col("status") == "open", "answered").otherwise(F.col("status")))
    scored = scored.withColumn("confidence", A.confidence(F.col("retrieval"), F.col("coverage"), F.col("completeness")))
    if judge is None:
        scored = scored.withColumn("accuracy", F.lit(None).cast("double"))
    else:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        verdicts = verified(found, hits.select("query_id", place.alias("rank"), "content"), judge)
        scored = scored.join(accuracy(verdicts).select("query_id", "accuracy"), "query_id", "left")
    return scored.select("query_id", "status", "answer", "retrieval", "coverage", "completeness", "accuracy", "confidence", A.label(F.col("confidence"), F.col("coverage"), F.col("completeness")).alias("label"))


def retried(rows: DataFrame, questions: DataFrame, search, generate=extract_answer, turns: int = 2, settings: Settings = DEFAULTS, judge=None) -> DataFrame:
    """rows of grounded() with attempts: up to `turns` more at questions that the model refused.

    search(questions, turn) finds other passages for what is left, within the asker's rights; an answer
    is rated against the passages it was made from, but keeps the first retrieval's confidence. What is
    refused to the end stays as it was first.
    """
    rows = written(rows.withColumn("attempts", F.lit(1)), "attempt")
    done, refused = rows.filter("status != 'model_refused'"), rows.filter("status = 'model_refused'")
    for turn in range(turns):
        left = questions.join(refused.select("query_id"), "query_id", "left_semi")
        if not left.limit(1).count():
            break
        hits = written(search(left, turn), "retry")
        tried = grounded(left, hits, generate, settings, judge).filter("status = 'answered'")
        first = refused.select("query_id", F.col("retrieval").alias("_first"))
        overall = A.confidence(F.col("_first"), F.col("coverage"), F.col("completeness"))
        tried = tried.join(first, "query_id").withColumn("retrieval", F.col("_first")).withColumn("confidence", overall).withColumn("label", A.label(overall, F.col("coverage"), F.col("completeness")))
        tried = written(tried.drop("_first").withColumn("attempts", F.lit(turn + 2)), "attempt")
        done = done.unionByName(tried)
        refused = refused.join(tried.select("query_id"), "query_id", "left_anti")
    return done.unionByName(refused)
