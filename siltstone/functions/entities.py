"""Companies in questions: detection, scoping, ambiguity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Companies, in the order of the registry, and their names.
COMPANIES = {
    "AAPL": ("0000320193", "Apple Inc."),
    "JPM": ("0000019617", "JPMorgan Chase & Co."),
    "TSLA": ("0001318605", "Tesla Inc."),
    "MSFT": ("0000789019", "Microsoft Corporation"),
    "GS": ("0000886982", "The Goldman Sachs Group Inc."),
}
ALIASES = {
    "AAPL": ("Apple",),
    "MSFT": ("Microsoft",),
    "JPM": ("JPMorgan Chase", "JPMorgan", "JP Morgan", "Chase"),
    "GS": ("Goldman Sachs", "Goldman"),
    "TSLA": ("Tesla",),
}
SHORTEST_TICKER = 2
DEFINITE = r"(?i)\bthe\s+(?:company|companies|firm|firms|bank|banks)\b"
METRIC = r"(?i)\b(?:revenue|revenues|net income|profit|profits|margin|margins|earnings|credit losses)\b"
OPENER = r"(?i)^\s*(?:compare|contrast|how\s+do|how\s+does|what\s+are\s+the\s+differences\s+between|differences\s+between|which\s+of)\b[\s,]*"
CONJUNCTION = r"(?:and|or|versus|vs\.?)"


def patterns(companies=COMPANIES, aliases=ALIASES) -> dict[str, list[str]]:
    """Patterns by ticker: any alias in any case, and the ticker itself as written."""
    out = {}
    for ticker in companies:
        names = "|".join(map(re.escape, aliases.get(ticker, ())))
        out[ticker] = ([rf"(?i)\b(?:{names})\b"] if names else []) + ([rf"\b{ticker}\b"] if len(ticker) >= SHORTEST_TICKER else [])
    return out


def unmatchable(companies=COMPANIES, aliases=ALIASES) -> list[str]:
    return [t for t, p in patterns(companies, aliases).items() if not p]


def detect(query: Column) -> Column:
    """array<string>: tickers by first mention, registry order on ties."""
    found = []
    for k, (ticker, forms) in enumerate(patterns().items()):
        places = [F.regexp_instr(query, F.lit(p)) for p in forms]
        first = F.array_min(F.filter(F.array(*places), lambda x: x > 0))
        found.append(F.struct(first.alias("at"), F.lit(k).alias("k"), F.lit(ticker).alias("ticker")))
    return F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x["at"].isNotNull())), lambda x: x["ticker"])


def scope(query: Column, keep: str) -> Column:
    """The question without the other companies that it names, if it names several."""
    named, text = detect(query), query
    for ticker in COMPANIES:
        if ticker == keep:
            continue
        cut = text
        for alias in (*ALIASES.get(ticker, ()), ticker):
            name = re.escape(alias)
            cut = F.regexp_replace(cut, rf"(?i)\b{name}\b\s*,?\s*{CONJUNCTION}\s+", "")
            cut = F.regexp_replace(cut, rf"(?i)\s*,?\s*{CONJUNCTION}\s+\b{name}\b", "")
            cut = F.regexp_replace(cut, rf"(?i)\b{name}\b", "")
        text = F.when(F.array_contains(named, ticker), cut).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, OPENER, ""), r"\s{2,}", " ")
    text = F.regexp_replace(text, r"^[ ,]+|[ ,]+$", "")
    return F.when((F.size(named) < 2) | (text == ""), query).otherwise(text)


def is_ambiguous(query: Column) -> Column:
    """No company named, and either one is pointed at or a metric is asked for without any name."""
    words = F.split(F.trim(query), r"\s+")
    names = F.exists(F.slice(words, 2, 1 << 30), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    return (F.size(detect(query)) == 0) & (F.rlike(query, F.lit(DEFINITE)) | (F.rlike(query, F.lit(METRIC)) & ~names))


def clarification() -> str:
    return f"The corpus holds 10-K filings for: {', '.join(name for _, name in COMPANIES.values())}. Naming one will get an answer."
