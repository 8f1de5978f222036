"""Column functions that screen questions and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# Limits and patterns of the input screen.
SHORTEST, LONGEST = 2, 1000
BLOCKED = [r"(?i)(drop\s+table|delete\s+from|insert\s+into|update\s+.*\s+set)", r"<script[^>]*>", r"(?i)(exec|eval|import\s+os|subprocess)"]
BLOCKED_STRICT = [*BLOCKED[:2], r"(?i)\b(exec|eval|import\s+os|subprocess)\b"]

# Patterns and weights of prompt injection.
INJECTION = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)", 0.9),
    (r"(?i)disregard\s+(all\s+)?(previous|prior|above)", 0.9),
    (r"(?i)forget\s+(all\s+)?(previous|prior|your)\s+(instructions?|rules?|context)", 0.9),
    (r"(?i)you\s+are\s+now\s+(a|an)\s+", 0.8),
    (r"(?i)act\s+as\s+(if|a|an)\s+", 0.6),
    (r"(?i)pretend\s+(you\s+are|to\s+be)", 0.7),
    (r"(?i)system\s*prompt", 0.7),
    (r"(?i)override\s+(your|the)\s+(instructions?|rules?|safety)", 0.9),
    (r"(?i)bypass\s+(your|the|all)\s+(filters?|safety|guardrails?|restrictions?)", 0.9),
    (r"(?i)jailbreak", 0.9),
    (r"(?i)do\s+anything\s+now", 0.8),
    (r"(?i)DAN\s+mode", 0.9),
    (r"(?i)reveal\s+(your|the)\s+(system|secret|hidden)\s+(prompt|instructions?)", 0.8),
    (r"(?i)\[INST\]|\[/INST\]|<<SYS>>|<\|im_start\|>", 0.9),
]
BLOCK_FROM = 0.8

# Patterns of personal data and what replaces them, in the order of replacement.
PII = {
    "SSN": (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    "EMAIL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    "PHONE": (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    "CREDIT_CARD": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CC_REDACTED]"),
    "IP_ADDRESS": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_REDACTED]"),
}

# Patterns of unsafe output.
HALLUCINATION = [r"(?i)as an AI( language model)?", r"(?i)I don'?t have (access to|real-?time)", r"(?i)I cannot browse", r"(?i)my training data", r"(?i)as of my (last |knowledge )?cut-?off"]
UNSAFE = [r"(?i)(how to (make|build|create) (a )?(bomb|weapon|explosive))", r"(?i)(instructions for (hacking|breaking into))"]

# Patterns and texts of financial compliance.
ADVICE = [
    r"(?i)you should (buy|sell|invest|hold|short|trade|allocate)",
    r"(?i)I (recommend|suggest|advise) (buying|selling|investing|holding|trading)",
    r"(?i)(guaranteed|risk-?free) (return|profit|income|yield)",
    r"(?i)can'?t (lose|go wrong|fail)",
    r"(?i)(definitely|certainly|absolutely) (will|going to) (rise|fall|increase|decrease)",
]
GUARANTEE = r"(?i)(guaranteed|risk-?free) (return|profit)"
NON_PUBLIC = [
    r"(?i)(upcoming|pending|unannounced) (merger|acquisition|deal|takeover|IPO|offering)",
    r"(?i)(before (it'?s|the) (public|announced|disclosed))",
    r"(?i)(insider|non-?public|confidential) (information|knowledge|tip)",
    r"(?i)hasn'?t been (announced|disclosed|made public|filed) yet",
    r"(?i)(pre-?announcement|pre-?release|embargoed)",
    r"(?i)this information is (not yet|still) (public|available)",
]
FORWARD = [
    r"(?i)(will|expect|project|forecast|anticipate|estimate|believe|intend|plan)s? to",
    r"(?i)(next quarter|next year|going forward|in the future|outlook|guidance)",
    r"(?i)(target|projected|estimated) (price|revenue|earnings|growth)",
]
ADVICE_NOTE = (
    "\n\n---\n**Disclaimer**: This information is retrieved from internal documents and is provided for informational purposes only. "
    "It does not constitute investment advice, a recommendation, or a solicitation to buy or sell any security. Past performance does not guarantee future results."
)
NON_PUBLIC_NOTE = (
    "\n\n**WARNING**: This response may reference material non-public information (MNPI). Do not use this information for trading decisions. "
    "Consult Compliance before acting on any non-public information. Violations may result in civil and criminal penalties under Section 10(b) of the Securities Exchange Act of 1934."
)
FORWARD_NOTE = "\n\n*This response contains forward-looking statements that involve risks and uncertainties. Actual results may differ materially from those projected.*"
REFUSED_ADVICE = "I cannot provide guaranteed investment returns or risk-free profit projections. Please consult with a registered investment advisor for personalized advice."


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])


def violation(query: Column, strict: bool = False) -> Column:
    """Why a question is turned away; null if it isn't. strict looks for whole words of code only."""
    q = F.coalesce(query, F.lit(""))
    return (
        F.when(stripped(q) == "", "empty_input")
        .when(F.length(q) < SHORTEST, "too_short")
        .when(F.length(q) > LONGEST, "too_long")
        .when(any_of(q, BLOCKED_STRICT if strict else BLOCKED), "blocked_pattern")
    )


def injection(query: Column) -> Column:
    """struct<risk, blocked, reason, matched>: the largest weight of the patterns found, and which (from 0)."""
    risk = F.greatest(*[F.when(F.rlike(query, F.lit(p)), w).otherwise(0.0) for p, w in INJECTION])
    matched = F.array_compact(F.array(*[F.when(F.rlike(query, F.lit(p)), k) for k, (p, _) in enumerate(INJECTION)]))
    reason = F.when(risk >= BLOCK_FROM, "prompt_injection_detected").when(risk > 0, "suspicious_patterns_detected").otherwise("")
    return F.struct(risk.alias("risk"), (risk >= BLOCK_FROM).alias("blocked"), reason.alias("reason"), matched.alias("matched"))


def pii(text: Column) -> Column:
    """map<kind, matches>, without kinds that don't occur."""
    found = F.create_map(*[x for kind, (p, _) in PII.items() for x in (F.lit(kind), F.regexp_extract_all(text, F.lit(f"({p})"), 0))])
    return F.map_filter(found, lambda _, v: F.size(v) > 0)


def redact(text: Column) -> Column:
    for p, mark in PII.values():
        text = F.regexp_replace(text, p, mark)
    return text


def output_flags(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.array_compact(F.array(
        F.when(any_of(text, HALLUCINATION), "possible_hallucination"),
        F.when(any_of(text, UNSAFE), "unsafe_content_detected"),
        F.when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < 10, "response_too_short"),
        F.when((F.length(text) > 500) & (breaks > 20), "possible_context_leak"),
    ))


def compliance_flags(text: Column) -> Column:
    advice = any_of(text, ADVICE)
    return F.array_compact(F.array(
        F.when(advice, "investment_advice_detected"),
        F.when(advice & F.rlike(text, F.lit(GUARANTEE)), "prohibited_guarantee_language"),
        F.when(any_of(text, NON_PUBLIC), "potential_mnpi_detected"),
        F.when(any_of(text, FORWARD), "forward_looking_statement"),
    ))


def with_notes(text: Column) -> Column:
    """The answer with the notes its flags ask for; promised gains are replaced altogether."""
    flags = compliance_flags(text)
    notes = [("investment_advice_detected", ADVICE_NOTE), ("potential_mnpi_detected", NON_PUBLIC_NOTE), ("forward_looking_statement", FORWARD_NOTE)]
    noted = F.concat(text, *[F.when(F.array_contains(flags, f), F.lit(note)).otherwise("") for f, note in notes])
    return F.when(F.array_contains(flags, "prohibited_guarantee_language"), F.lit(REFUSED_ADVICE + ADVICE_NOTE)).otherwise(noted)
