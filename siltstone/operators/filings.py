"""Filings: HTML to text, sections, running headers, submissions, metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.entities import COMPANIES
from ..functions.text import HEADER_CHARS, HEADER_LINES, HEADER_REPEATS, clean, closed_up, headers_blanked, is_title, page_number

# Sections of a 10-K, those usually wanted, and sizes.
SECTIONS = {
    "1": "Business",
    "1a": "Risk Factors",
    "1b": "Unresolved Staff Comments",
    "2": "Properties",
    "3": "Legal Proceedings",
    "7": "Management Discussion and Analysis",
    "7a": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data",
}
WANTED = ("1", "1a", "7", "7a", "8")
#: Filings of a batch whose spans are held at a time.
AT_ONCE = 20
LEAST_BODY = 100
LEAST_TAIL = 100_000

# An Item header at a line's start, its number, and a title of six characters at least.
_NUMBER = r"^\s*(?:ITEM|Item|item)\s*(\d+[aAbB]?)\s*[.:\-—–\s]*"
_TITLE_START = r"[A-Z][A-Za-z\s,&'\-]{5}"
#: The header with the rest of its title's line; and one that ends, as the title does there, after six characters.
ITEM = re.compile(rf"{_NUMBER}(?={_TITLE_START})[^\n]*\s*", re.M)
ITEM_SHORT = re.compile(rf"{_NUMBER}{_TITLE_START}\s*", re.M)


class _Reader(HTMLParser):
    """Text with a line for each piece, and tables as rows of cells between bars."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.table = 0
        self.rows: list[str] = []
        self.cells: list[str] = []
        self.cell: list[str] | None = None

    def _end_cell(self) -> None:
        if self.cell is not None:
            text = "".join(self.cell)
            if text:
                self.cells.append(text)
            self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.cells:
            self.rows.append(" | ".join(self.cells))
        self.cells = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.table += 1
        elif self.table and tag == "tr":
            self._end_row()
        elif self.table and tag in ("td", "th"):
            self._end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.table and tag in ("td", "th"):
            self._end_cell()
        elif self.table and tag == "tr":
            self._end_row()
        elif tag == "table" and self.table:
            self._end_row()
            self.table -= 1
            if not self.table:
                self.out.append("\n" + "\n".join(self.rows) + "\n")
                self.rows = []

    def handle_data(self, data):
        if self.skip:
            return
        if self.table:
            if self.cell is not None:
                self.cell.append(data.strip())
        else:
            self.out.append(data)


def text_of(page: str | None) -> str:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return "\n".join(reader.out)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def tags_removed(page: Column) -> Column:
    """Text of simple pages without tables, by patterns alone: scripts, styles, comments and tags become line breaks."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", "\n")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def item_spans(text: str, short: bool = False) -> list[tuple[str, int, int, int]]:
    """(number, header's start, body's start, body's end) of the Item headers that open a run of one number.

    A repeat of the number, as on each page's head, is inside the body, which reaches to the next other number.
    """
    heads = list((ITEM_SHORT if short else ITEM).finditer(text))
    numbers = [m[1].lower() for m in heads]
    opens = [k for k in range(len(heads)) if not k or numbers[k] != numbers[k - 1]]
    ends = [heads[k].start() for k in opens[1:]] + [len(text)]
    return [(numbers[k], heads[k].start(), heads[k].end(), e) for k, e in zip(opens, ends)]


def section_spans(df: DataFrame, key: str = "doc_id", text: str = "text", wanted=WANTED, short_titles: bool = False, whole: bool = False) -> DataFrame:
    """(key, section_id, section_name, start, content) of filings; start is the header's place in the text.

    Of an item's spans the one with the longest cleaned text counts, the first on ties; spans under
    LEAST_BODY are none. What follows the last section is one more, `incorporated`, if it is long;
    without any section that is the whole filing. A filing without any header is one section: with `whole`
    all of its text, otherwise its first LEAST_TAIL characters, as the reference behaviour has it. Titles
    are consumed as whole lines; with short_titles only their first six characters are. A text is one
    row's work: it is neither dealt out nor repeated for its headers.
    """

    @F.pandas_udf("array<struct<number: string, start: int, body: string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[dict]:
            found = item_spans(t or "", short_titles)
            out = [{"number": n, "start": a, "body": headers_blanked(t[b:e].replace("\u00a0", " "))} for n, a, b, e in found if n in wanted]
            if not found:
                return [{"number": "full", "start": 0, "body": headers_blanked((t or "")[: None if whole else LEAST_TAIL].replace("\u00a0", " "))}]
            # What may be left after any section that may turn out the last: the end of each wanted span, or the whole text.
            return out + [{"number": f"after {a}", "start": e, "body": headers_blanked(t[e:].replace("\u00a0", " "))} for a, e in [(-1, 0), *[(a, e) for n, a, _, e in found if n in wanted]] if len(t) - e >= LEAST_TAIL]

        for texts in batches:
            for a in range(0, len(texts), AT_ONCE):
                yield texts.iloc[a : a + AT_ONCE].map(one)

    cleaned = F.transform(spans(F.col(text)), lambda x: F.struct(x["number"].alias("number"), x["start"].alias("start"), closed_up(x["body"]).alias("content")))
    rows = df.select(key, cleaned.alias("_all"))
    body = F.filter("_all", lambda x: x["number"].isin(list(wanted)) & (F.length(x["content"]) >= LEAST_BODY))
    best = F.filter(F.transform(F.array(*map(F.lit, wanted)), lambda n: F.array_max(F.transform(F.filter(body, lambda x: x["number"] == n), lambda x: F.struct(F.length(x["content"]).alias("size"), (-x["start"]).alias("back"), x["content"].alias("content"), n.alias("number"))))), lambda x: x.isNotNull())
    last = F.array_max(F.transform("_best", lambda x: -x["back"]))  # the start of the last section
    rows = rows.withColumn("_best", best).withColumn("_last", F.coalesce(F.concat(F.lit("after "), last.cast("string")), F.lit("after -1")))
    tail = F.filter("_all", lambda x: (x["number"] == F.col("_last")) & (F.length(x["content"]) >= LEAST_TAIL) | (x["number"] == "full"))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    named = F.transform("_best", lambda x: F.struct(F.concat(F.lit("item_"), x["number"]).alias("section_id"), F.element_at(names, x["number"]).alias("section_name"), (-x["back"]).alias("start"), x["content"].alias("content")))
    rest = F.transform(tail, lambda x: F.struct(
        F.when(x["number"] == "full", "full").otherwise("incorporated").alias("section_id"),
        F.when(x["number"] == "full", "Full Filing").otherwise("Incorporated Annual Report (MD&A and Financial Statements)").alias("section_name"),
        x["start"].alias("start"), x["content"].alias("content"),
    ))
    return rows.select(key, F.explode(F.concat(named, rest)).alias("s")).select(key, "s.section_id", "s.section_name", "s.start", "s.content")


def running_headers(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, page) of the lines that are running headers.

    Such a line repeats, is short, looks like a title, and stands within two lines that aren't blank
    below a page number each time it counts; those pages strictly ascend.
    """
    from ..functions.text import stripped

    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw")).withColumn("line", stripped(F.col("raw"))).filter(F.col("line") != "")
    rows = rows.withColumn("own_page", page_number(F.col("line")))
    order = Window.partitionBy(key).orderBy("line_no")
    above = F.coalesce(*[F.lag("own_page", k).over(order) for k in range(1, HEADER_LINES + 1)])
    repeats = F.count(F.lit(1)).over(Window.partitionBy(key, "line"))
    likely = (F.length("line") <= HEADER_CHARS) & ~F.contains(F.col("line"), F.lit("|")) & F.col("own_page").isNull() & is_title(F.col("line"))
    marked = rows.withColumn("page", above).withColumn("n", repeats).filter(likely & (F.col("n") >= HEADER_REPEATS) & F.col("page").isNotNull())
    same = Window.partitionBy(key, "line")
    rising = F.coalesce(F.col("page") > F.lag("page").over(same.orderBy("line_no")), F.lit(True))
    checked = marked.withColumn("rising", rising)
    checked = checked.withColumn("all_rise", F.bool_and("rising").over(same)).withColumn("marked", F.count(F.lit(1)).over(same))
    return checked.filter(F.col("all_rise") & (F.col("marked") >= HEADER_REPEATS)).select(key, "line_no", "line", "page")


def without_headers(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with running headers blanked, so that the number of lines stays."""
    doomed = running_headers(df, key, text).groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.transform(F.split(F.col(text), "\n"), lambda x, k: F.when(F.array_contains("_gone", k), "").otherwise(x)), "\n")
    return df.join(doomed, key, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_gone")


def submissions(df: DataFrame, form: str = "10-K", count: int = 1) -> DataFrame:
    """Filings of a form from submissions (ticker, recent: a struct of parallel arrays), the first `count` of each ticker."""
    r = "recent."
    n = F.size(r + "form")
    rows = df.select("ticker", F.posexplode(F.arrays_zip(F.col(r + "form").alias("form"), F.col(r + "accessionNumber").alias("accession"), F.col(r + "filingDate").alias("date"), F.col(r + "primaryDocument").alias("document"), F.col(r + "primaryDocDescription").alias("description"))).alias("pos", "f"), n.alias("n"))
    rows = rows.filter((F.col("pos") < F.col("n")) & (F.col("f.form") == form)).select("ticker", "pos", "f.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("pos"))).filter(F.col("rank") <= count).withColumn("description", F.coalesce("description", F.lit(""))).drop("pos")


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    plain = F.regexp_replace(cik, "^0+", "")
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), plain, F.replace(accession, F.lit("-"), F.lit("")), document)


def section_documents(sections: DataFrame, filings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document for each section, with its filing's metadata. filings: key, ticker, filing_type, filing_date; tickers outside the registry drop out."""
    spark = sections.sparkSession
    registry = spark.createDataFrame([(t, cik, name) for t, (cik, name) in COMPANIES.items()], "ticker string, cik string, company_name string")
    both = sections.join(filings, key).withColumn("ticker", F.upper("ticker")).join(F.broadcast(registry), "ticker")  # a row for each company
    return both.withColumns({"source_file": F.concat_ws("_", "ticker", "filing_type", "filing_date"), "department": F.lit("sec_filings"), "access_roles": F.array(F.lit("admin"))})


def path_metadata(path: Column) -> dict[str, Column]:
    """Ticker, form and date that a filing's path tells: TICKER/FORM_DATE.html."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    return {"ticker": F.upper(F.element_at(F.split(path, "/"), -2)), "filing_type": parts[0], "filing_date": F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("unknown")}


def enriched(df: DataFrame, path: Column, department: str, roles: list[str]) -> DataFrame:
    return df.withColumns({"source_file": F.element_at(F.split(path, "/"), -1), "department": F.lit(department), "access_roles": F.lit(",".join(roles)), "ingested_at": F.current_timestamp()})


