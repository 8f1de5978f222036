"""WARC archives: written by Spark's text writer, read back in blocks with boundary-chain verification.

A record is its magic line, header, block and two line ends. The text source cuts a file at every magic, in
blocks that tasks read side by side. What follows a magic is a candidate; its header's Content-Length tells
where its successor would stand. Payloads may hold the magic, whole forged records even, so only candidates
that the file's start leads to are records. Within a block pointers are followed in place, so that what is
left for pointer jumping by joins is a node or a few for each block, and log2(blocks of a file) rounds.

Defined results. A null html is an empty payload, a null url no Target-URI; line ends in a url are written as
%0D and %0A. Of rows with equal payloads the response is that with the smallest page_id, nulls last, then the
smallest url, nulls last, then the first in the table, so that repeated rows are one response and revisits.
A revisit of a response without page_id has no refers_to. An empty table gives no records. Other columns of
the table play no part, whatever their names. In reading, a candidate that the start of its file doesn't lead
to, or whose end is neither a candidate nor the file's end (a cut file), is no record. pages is read twice and
must give the same rows each time, as a table does.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, staged

MAGIC = "WARC/1.1\r\n"
#: Ends a header, and a record.
GAP = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"


def base32(sha1: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits are four characters."""

    def group(k: Column) -> Column:
        v = F.conv(F.substring(sha1, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.monotonically_increasing_id().alias("place"))


def copies(pages: DataFrame, least: int = 0) -> DataFrame:
    """(sha1, first) of payloads of at least `least` bytes that several rows have: page_id, url and place of the response."""
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "place")
    rows = _rows(pages).filter(F.octet_length("html") >= least)
    return rows.groupBy("sha1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")


def _id(page: Column, place: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), place.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The text of each row's record, but for the gap at its end."""
    rows = _rows(pages)
    first = staged(copies(pages, least), "warc-copies")
    both = rows.join(first, "sha1", "left")
    again = F.col("first").isNotNull() & (F.col("place") != F.col("first.place"))
    uri = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(GAP))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("html"))
    text = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _id(F.col("page_id"), F.col("place"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(IDENTICAL)), _line("WARC-Refers-To", _id(F.col("first.page_id"), F.col("first.place"))), _line("WARC-Refers-To-Target-URI", uri(F.col("first.url"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit(HTTP)),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    return both.select(text.alias("value"))


def write(pages: DataFrame, path: str | None = None, least: int = 0) -> str:
    """WARC files of pages (page_id, url, html) in a folder; where none is given, in a new one of the shared folder. A file for each task."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records(pages, least).write.option("lineSep", GAP).text(path)
    return path


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


#: Header fields that are read, by column.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to_id": "WARC-Refers-To", "uri": "WARC-Target-URI", "stated_digest": "WARC-Payload-Digest"}


def _header(value: Column) -> Column:
    return F.substring_index(value, GAP, 1)


def parsed(value: Column) -> dict[str, Column]:
    """Columns of a record that is whole, from what follows its magic."""
    header = _header(value)
    head = F.octet_length(header) + 4
    block = F.substring(value.cast("binary"), head + 1, _field(header, "Content-Length").cast("int"))
    http = _header(block.cast("string"))
    is_http = F.coalesce(F.lower(_field(header, "Content-Type")).startswith("application/http"), F.lit(False))
    payload = F.when(is_http, F.substring(block, F.octet_length(http) + 5, F.octet_length(block))).otherwise(block)
    own = F.coalesce(_field(header, "WARC-Type") != "revisit", F.lit(True))
    stated = F.when(is_http, _field(http, "Content-Length").cast("long"))
    return {c: _field(header, name) for c, name in FIELDS.items()} | {
        "payload_bytes": F.when(own, F.octet_length(payload).cast("long")).otherwise(stated),
        "payload_sha1": F.when(own, F.sha1(payload)),
        "payload": F.when(own, payload),
    }


def pieces(spark: SparkSession, path: str, payload: bool = False, texts: bool = False) -> DataFrame:
    """What stands between magics, a row for each, with file, block and its order in the block.

    Where the piece is as long as its header says, its record is read at once; of the others the text is
    kept, with `texts` of all.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    header = _header(F.col("value"))
    size, head = F.octet_length("value").cast("long"), F.octet_length(header).cast("long") + 4
    length = F.when(F.octet_length(header) < F.octet_length("value"), F.regexp_extract(header, r"(?i)(?:^|\r\n)Content-Length[ \t]*:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", 1))
    reach = head + F.when(length != "", length).cast("long") + 4
    whole = F.coalesce(reach == size, F.lit(False))
    own = parsed(F.col("value"))
    kept = [F.when(whole, own[c]).alias(c) for c in own if payload or c != "payload"]
    return raw.select("file", "block", "k", size.alias("size"), reach.alias("reach"), whole.alias("whole"), *kept, F.when(F.lit(texts) | ~whole, F.col("value").cast("binary")).alias("text"))


def _chained(off: np.ndarray, after: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates of a block, in order: the next one's number or -1, and where the chain from each leaves the block (-1: nowhere)."""
    at = np.searchsorted(off, after)
    inside = (at < len(off)) & (off[np.minimum(at, len(off) - 1)] == after)
    onward, leaves = np.where(inside, at, -1), np.where((after >= end) & ~inside, after, -1)
    for i in range(len(off) - 1, -1, -1):
        if inside[i]:
            leaves[i] = leaves[at[i]]
    return onward, leaves


LINKS = "file string, block long, k long, off long, after long, leaves long"


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets of a block's candidates, of their successors, and of where their chains leave the block."""
    pdf = pdf.sort_values("k")
    step = pdf["size"].to_numpy() + len(MAGIC)
    off = int(pdf["base"].iloc[0]) + np.cumsum(step) - step - len(MAGIC)
    reach = pdf["reach"].fillna(-1).to_numpy().astype(np.int64)
    after = np.where((reach >= 0) & (off >= 0), off + len(MAGIC) + reach, -1)
    _, leaves = _chained(off, after, int(off[-1] + step[-1]))
    return pd.DataFrame({"file": [pdf["file"].iloc[0]] * len(off), "block": pdf["block"].to_numpy(), "k": pdf["k"].to_numpy(), "off": off, "after": after, "leaves": leaves})


MARKS = "file string, block long, k long, off long, after long, reached boolean, owner long"


def _marked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Which candidates of a block the chain from its entries visits, and the record that each piece belongs to (null: one of an earlier block)."""
    left = left.sort_values("off")
    off, after = left["off"].to_numpy(), left["after"].to_numpy()
    onward, _ = _chained(off, after, int(off[-1]) + 1) if len(off) else (np.empty(0, int), None)
    reached = np.zeros(len(off), bool)
    for entry in right["at"]:
        i = int(np.searchsorted(off, entry))
        while i >= 0 and not reached[i]:
            reached[i] = True
            i = int(onward[i])
    last = np.maximum.accumulate(np.where(reached, np.arange(len(off)), -1))
    owner = pd.Series(np.where(last >= 0, off[np.maximum(last, 0)], 0), dtype="Int64").mask(last < 0)
    return pd.DataFrame({"file": left["file"].to_numpy(dtype=object), "block": left["block"].to_numpy(), "k": left["k"].to_numpy(), "off": off, "after": after, "reached": reached, "owner": owner.array})


def reachable(links: DataFrame) -> DataFrame:
    """(file, at): where the chains from the files' starts enter blocks. Pointers double in each round."""
    starts = links.filter("off = 0").select("file", F.col("off").alias("at"))
    nodes = links.select("file", F.col("leaves").alias("at")).filter("at >= 0").unionByName(starts).distinct()
    jump = staged(nodes.join(links.select("file", F.col("off").alias("at"), F.col("leaves").alias("to")), ["file", "at"]), "warc-jump")
    seen = staged(starts, "warc-seen")
    n = seen.count()
    while True:
        found = seen.join(jump, ["file", "at"]).filter("to >= 0").select("file", F.col("to").alias("at"))
        seen = staged(seen.unionByName(found).distinct(), "warc-seen")
        grown = seen.count()
        if grown == n:
            return seen
        n = grown
        jump = staged(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("further")), ["file", "to"]).select("file", "at", F.col("further").alias("to")), "warc-jump")


def read(spark: SparkSession, path: str, payload: bool = False, texts: bool = False) -> DataFrame:
    """The records of a folder of WARC files, in no order: file, offset, the columns of FIELDS, payload_bytes, payload_sha1 (hex), and on demand the payload.

    Of a revisit payload_bytes is what its HTTP header states, and there is no payload or hash of it.
    Payloads that hold forged records of the right length make a second scan, which keeps all texts (`texts`).
    """
    rows = staged(pieces(spark, path, payload, texts), "warc-pieces")
    line = Window.partitionBy("file").orderBy("block")
    sizes = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    # A file has a row here for each of its blocks.
    base = staged(sizes.select("file", "block", (F.sum("bytes").over(line) - F.col("bytes")).alias("base"), (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("total")), "warc-blocks")
    links = staged(rows.select("file", "block", "k", "size", "reach").join(base.select("file", "block", "base"), ["file", "block"]).groupBy("file", "block").applyInPandas(_linked, LINKS), "warc-links")
    entered = staged(reachable(links).join(links.select("file", "block", F.col("off").alias("at")), ["file", "at"]), "warc-entries")
    marks = staged(links.groupBy("file", "block").cogroup(entered.groupBy("file", "block")).applyInPandas(_marked, MARKS), "warc-marks")
    ends = base.select("file", "total").distinct()
    known = marks.filter("after >= 0").select("file", F.col("off").alias("after"), F.lit(True).alias("is_candidate"))
    real = marks.filter("reached").select("file", "block", "k", "off", "after").join(ends, "file").join(known, ["file", "after"], "left")
    real = real.filter(F.col("is_candidate") | (F.col("after") == F.col("total"))).select("file", "block", "k", F.col("off").alias("offset"))
    columns = [c for c in rows.columns if c not in ("file", "block", "k", "size", "reach", "whole", "text")]
    plain = real.join(rows.filter("whole"), ["file", "block", "k"]).select("file", "offset", *columns)
    # Records with a magic inside: their pieces, of whatever block, put together. One of them is one value.
    heads = staged(real.join(rows.filter(~F.col("whole")).select("file", "block", "k"), ["file", "block", "k"]).select("file", F.col("offset").alias("owner")), "warc-heads")
    if heads.isEmpty():
        return plain
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = base.join(marks.filter("reached").groupBy("file", "block").agg(F.max("off").alias("last")), ["file", "block"], "left").select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carry"))
    inner = marks.join(carried, ["file", "block"]).select("file", "block", "k", "off", F.coalesce("owner", "carry").alias("owner"))
    parts = inner.join(heads, ["file", "owner"], "left_semi").join(rows.select("file", "block", "k", "text"), ["file", "block", "k"])
    if not texts and not parts.filter("text IS NULL").isEmpty():
        return read(spark, path, payload, True)
    joined = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "text"))), lambda x: x["text"].cast("string")), MAGIC).alias("value"))
    own = parsed(F.col("value"))
    return plain.unionByName(joined.select("file", F.col("owner").alias("offset"), *[own[c].alias(c) for c in columns]))


def resolved(found: DataFrame) -> DataFrame:
    """Records of read() with digest (base32) and payload_bytes of the whole payload; a revisit has those of the response it names, or else its own header's."""
    own = found.withColumn("digest", base32(F.col("payload_sha1")))
    first = own.filter(F.col("warc_type") == "response").select(F.col("record_id").alias("refers_to_id"), F.col("digest").alias("first_digest"), F.col("payload_bytes").alias("first_bytes"))
    again = own.filter(F.col("warc_type") == "revisit").join(first, "refers_to_id", "left")
    again = again.withColumn("digest", F.coalesce("first_digest", F.regexp_replace("stated_digest", "^sha1:", ""))).withColumn("payload_bytes", F.coalesce("first_bytes", "payload_bytes"))
    return own.filter(F.coalesce(F.col("warc_type") != "revisit", F.lit(True))).unionByName(again.select(own.columns))


def page_of(record_id: str) -> Column:
    """The page_id in a record id of write()."""
    found = F.regexp_extract(record_id, r"^<urn:page:(.*):\d+>$", 1)
    return F.when(found != "", found)
