"""Column functions on text: tokens, sentences, tables, figures, passages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"([a-z0-9]+(?:\.[0-9]+)?)"
CONTINUES = "\n[continues]\n"

# Lines of page furniture, the page number in group 1.
_TITLE = r"[^\n]{0,90}\bForm[ \t]*10-[KQ]\b[^\n]{0,25}"
_DIVIDER = r"[|•·–—]"
CONTENTS = r"^[ \t]*table of contents[ \t]*$"
PAGE_FOOTERS = [
    rf"^[ \t]*{_TITLE}[ \t]*{_DIVIDER}[ \t]*(\d{{1,4}})[ \t]*$",
    rf"^[ \t]*(\d{{1,4}})[ \t]*{_DIVIDER}[ \t]*{_TITLE}[ \t]*$",
    r"^[ \t]*page[ \t]+(\d{1,4})(?:[ \t]+of[ \t]+\d{1,4})?[ \t]*$",
]
BARE_PAGE = r"^[ \t]*(\d{1,4})[ \t]*$"
# A running header repeats so often, is so short, and stands so many lines below a page number at most.
HEADER_REPEATS, HEADER_CHARS, HEADER_LINES = 8, 60, 2

_PAGE_LINES = [re.compile(p, re.I) for p in (BARE_PAGE, *PAGE_FOOTERS)]


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def stripped(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces after `.`, `?` or `!` and white space, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+"), stripped), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")


def once(value: Column, f) -> Column:
    """f(value), for which value is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def digit_ratio(text: Column) -> Column:
    """Digits among letters and digits; 0 where there are none."""
    return once(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), lambda x: F.when(F.length(x) > 0, F.length(F.regexp_replace(x, r"[^\p{Nd}]", "")) / F.length(x)).otherwise(0.0))


def _is_row(line: Column) -> Column:
    return F.contains(line, F.lit(" | "))


def is_table(text: Column) -> Column:
    """Three lines with cell marks that are half of all lines, or mostly digits from 120 characters."""
    rows_of = once(lines(text), lambda x: F.struct(F.size(F.filter(x, _is_row)).alias("rows"), F.size(x).alias("all")))

    def told(n: Column) -> Column:
        rows, all_ = n["rows"], n["all"]
        return (all_ > 0) & (((rows >= 3) & (rows / F.greatest(all_, F.lit(1)) >= 0.5)) | ((F.length(text) >= 120) & (digit_ratio(text) >= 0.4)))

    return F.coalesce(once(rows_of, told), F.lit(False))


def prose_tail(text: Column, chars: int = 240) -> Column:
    """The last prose of a chunk, from a word's start: lines that are neither rows nor mostly digits."""
    prose = F.filter(lines(text), lambda x: ~_is_row(x) & (digit_ratio(x) < 0.3))
    tail = F.right(F.array_join(F.transform(prose, stripped), " "), F.lit(chars))
    cut = lambda x: F.locate(" ", x)
    return once(tail, lambda x: F.when((cut(x) > 0) & (cut(x) < F.length(x)), F.substring(x, cut(x) + 1, F.length(x))).otherwise(x))


def figures(text: Column) -> Column:
    """Numbers that can tell a passage apart, sorted: not years, three digits at least."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,]*\.?\d*%?)"), 1)
    trimmed = F.transform(raw, lambda x: F.regexp_replace(x, r"[.,]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: (F.length(F.regexp_replace(x, r"[,.]|%+$", "")) >= 3) & ~F.rlike(x, F.lit(r"^(19|20)\d{2}$")))))


def hit_rate(truth: Column, context: Column) -> Column:
    """The share of the truth's figures that the context holds, with or without commas; null without figures."""
    wanted = figures(truth)
    found = F.filter(wanted, lambda f: F.contains(context, f) | F.contains(context, F.replace(f, F.lit(","), F.lit(""))))
    return F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted))


def expected_tickers(text: Column, ascii_words: bool = False) -> Column:
    """Words of one to five capitals but K, sorted. ascii_words: letters beyond ASCII end a word, as in SQL's expressions."""
    word = r"(?<![A-Za-z0-9_])([A-Z]{1,5})(?![A-Za-z0-9_])" if ascii_words else r"\b([A-Z]{1,5})\b"
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(word), 1), lambda t: t != "K")))


def passage(ticker: Column, section: Column, content: Column) -> Column:
    """`ticker section: content`, without what is missing."""
    head = F.concat_ws(" ", F.when(ticker != "", ticker), F.when(section != "", section))
    return F.when(head != "", F.concat(head, F.lit(": "), content)).otherwise(content)


def describe(ticker: Column, filing: Column, date: Column, section: Column | None, source: Column) -> Column:
    """Where a chunk (or, without section, a filing) comes from, for a reader."""
    head = F.concat_ws(" ", F.when(ticker != "", ticker), F.when(filing != "", filing))
    head = F.when(date != "", F.when(head != "", F.concat(head, F.lit(" ("), date, F.lit(")"))).otherwise(date)).otherwise(head)
    if section is not None:
        head = F.when(section != "", F.when(head != "", F.concat(head, F.lit(" — "), section)).otherwise(section)).otherwise(head)
    return F.when(head != "", head).otherwise(F.coalesce(source, F.lit("unknown source")))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of `size` characters, each `size - overlap` after the one before."""
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows every size - overlap characters while more than the overlap is left, stripped, empty ones dropped."""
    last = F.greatest(F.floor((F.length(text) - overlap - 1) / (size - overlap)), F.lit(0)).cast("int")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.when(F.length(text) <= size, 0).otherwise(last))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: stripped(F.substring(text, i * (size - overlap) + 1, F.lit(size))))
    return F.filter(pieces, lambda p: p != "")


def _page_of(line: str) -> int | None:
    found = next((m for m in (p.match(line) for p in _PAGE_LINES) if m), None)
    return int(found[1]) if found else None


def headers_blanked(text: str) -> str:
    """The text with its running headers as empty lines.

    A running header is a short title that repeats; each time it counts it stands within HEADER_LINES
    lines, not counting blank ones, below a page number, and those numbers strictly ascend.
    """
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    titles = {x for x, n in Counter(bare).items() if n >= HEADER_REPEATS and 0 < len(x) <= HEADER_CHARS and "|" not in x and "A" <= x[0] <= "Z" and x[-1] not in "$," and _page_of(x) is None}
    if not titles:
        return text
    below: list[int | None] = []  # pages of the last lines, the nearest first
    marked: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, x in enumerate(bare):
        if not x:
            continue
        page = next((p for p in below if p is not None), None)
        if x in titles and page is not None:
            marked[x].append((k, page))
        below = [_page_of(x), *below][:HEADER_LINES]
    for at in marked.values():
        if len(at) >= HEADER_REPEATS and all(p < q for (_, p), (_, q) in zip(at, at[1:])):
            for k, _ in at:
                lines[k] = ""
    return "\n".join(lines)


@F.pandas_udf(StringType())
def without_running_headers(texts: pd.Series) -> pd.Series:
    return texts.map(headers_blanked, na_action="ignore")


def clean(text: Column) -> Column:
    """Page furniture out, running headers first, spaces and empty lines closed up."""
    out = without_running_headers(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    return closed_up(out)


def closed_up(out: Column) -> Column:
    """Lines of page furniture out, spaces and empty lines closed up."""
    for pattern in (CONTENTS, *PAGE_FOOTERS, BARE_PAGE):
        out = F.regexp_replace(out, f"(?imd){pattern}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return stripped(out)


def page_number(line: Column) -> Column:
    """The page that a line of paging apparatus names; null for any other line."""
    forms = [f"(?i){p}" for p in (BARE_PAGE, *PAGE_FOOTERS)]
    return F.coalesce(*[F.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, 1)) for p in forms]).cast("int")


def is_title(line: Column) -> Column:
    return F.rlike(line, F.lit("^[A-Z]")) & ~F.rlike(line, F.lit(r"[$,]$"))
