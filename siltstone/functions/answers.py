"""Column functions on answers: refusals, completeness, confidence, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of refusals and of partial answers.
REFUSALS = [
    "i don't have enough information",
    "i do not have enough information",
    "not enough information in the available documents",
    "the provided context does not contain",
    "the context does not contain",
    "the provided documents do not contain",
    "no relevant documents",
    "unable to answer",
    "cannot answer this question",
]
PARTIAL = ["does not specify", "do not specify", "does not provide", "do not provide", "is not disclosed", "not addressed in", "however, the context", "however, the documents"]
# What a report says for each reason.
REASONS = {
    "low_retrieval_confidence": "No sufficiently relevant passage was found in the filings you have access to, so no answer was generated.",
    "model_refused": "Relevant filings were retrieved, but they do not state what the question asks for.",
    "ambiguous_entity": "The question does not say which company it is about, and the corpus answers it differently for each one. Answering would mean picking a company the question never named.",
}
# The worth of verdicts, and marks of failures.
VERDICT_WORTH = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0, "out_of_range": 0.0}
QUOTA = ["insufficient_quota", "credit_balance", "no credits remaining", "exceeded your current quota", "rate limit", "429"]
AUTH = ["invalid_api_key", "incorrect api key", "unauthorized", "401"]


def holds_any(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def is_refusal(answer: Column) -> Column:
    return holds_any(answer, REFUSALS)


def completeness(answer: Column, claims: Column, cited: Column) -> Column:
    """0 for a full refusal or no claims, 0.5 for a partial one, else 1."""
    refused = is_refusal(answer)
    return F.when(refused & (cited == 0), 0.0).when(refused, 0.5).when(claims == 0, 0.0).when(holds_any(answer, PARTIAL), 0.5).otherwise(1.0)


def confidence(retrieval: Column, coverage: Column, complete: Column) -> Column:
    """Half retrieval, three tenths coverage, two tenths completeness; unknown retrieval shares its weight out."""
    overall = F.when(retrieval.isNull(), (0.3 * coverage + 0.2 * complete) / 0.5).otherwise(0.5 * retrieval + 0.3 * coverage + 0.2 * complete)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), overall))


def label(overall: Column, coverage: Column, complete: Column) -> Column:
    return F.when((complete == 0) | (coverage == 0), "low").when(overall >= 0.66, "high").when(overall >= 0.40, "medium").otherwise("low")


def relevance(score: Column, kind: Column) -> Column:
    """A score on a scale from 0 to 1: logistic for cross-encoders, clamped for cosines, null for anything else."""
    return F.when(kind == "cross_encoder", 1 / (1 + F.exp(-score))).when(kind == "cosine_relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def verdict(response: Column) -> Column:
    """The judge's first line, read for its verdict."""
    first = F.upper(F.trim(F.split(F.trim(F.coalesce(response, F.lit(""))), "\n")[0]))
    return F.when(F.contains(first, F.lit("UNSUPPORTED")), "unsupported").when(F.contains(first, F.lit("PARTIAL")), "partial").when(F.contains(first, F.lit("SUPPORTED")), "supported").otherwise("unjudged")


def worth(v: Column) -> Column:
    """A verdict's share of accuracy; null where nothing was judged."""
    return reduce(lambda out, kv: out.when(v == kv[0], kv[1]), list(VERDICT_WORTH.items())[1:], F.when(v == "supported", 1.0))


def refusal_correctness(error: Column, refused: Column, expected: Column, label_: Column) -> Column:
    return F.when(error, None).when(expected == "refuse", F.when(refused & (label_ == "low"), 1.0).otherwise(0.0)).otherwise(F.when(refused, 0.0).otherwise(1.0))


def failure(message: Column) -> Column:
    return F.when(holds_any(message, QUOTA), "embedding_quota_exhausted").when(holds_any(message, AUTH), "embedding_auth_failed").otherwise("other")
