"""Chunking: fixed, recursive, semantic, with captions for tables; provenance of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.text import fixed_chunks, is_table, once, prose_tail, sentences, stripped
from .rank import dot, normalised
from .scan import running

#: Texts of a batch whose chunks are held at a time.
AT_ONCE = 100
#: Tried in turn: the first that occurs in a text splits it.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text, each with the separator that stands before it."""
    if not separator:
        return list(text)
    return [p for p in re.split(f"(?={re.escape(separator)})", text) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces put together up to `size`, each chunk opening with up to `overlap` characters of whole pieces of the last."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held))
    return [c.strip() for c in out if c.strip()]


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of up to `size` characters, cut at the coarsest separator that serves."""
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :] if separators[at] else ()
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += _packed(short, size, overlap)
            short = []
        out += split_recursively(piece, size, overlap, finer) if finer else [piece]
    return out + (_packed(short, size, overlap) if short else [])


def recursive_chunks(size: int, overlap: int):
    """A Pandas UDF of split_recursively(), which gives back a few texts' chunks at a time."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for a in range(0, len(texts), AT_ONCE):
                yield texts.iloc[a : a + AT_ONCE].map(lambda t: split_recursively(t, size, overlap) if t else [])

    return run


def no_stubs(df: DataFrame, least: int = DEFAULTS.min_chunk_chars) -> DataFrame:
    """Chunks of `least` characters at least, white space at the ends apart; 0 or less keeps all."""
    return df if least <= 0 else df.filter(F.length(stripped(F.col("content"))) >= least)


def source_key() -> Column:
    return F.coalesce("source_file", "source", "section_name", F.lit(""))


def tagged(df: DataFrame, strategy: str, order: list[str]) -> DataFrame:
    """df with chunking_strategy, chunk_index (from 0 in each source, in order) and char_count; a source may be of any size."""
    place = (F.col("_n") - 1).cast("int")
    out = running(df, [source_key()], order)
    return out.withColumns({"chunking_strategy": F.lit(strategy), "chunk_index": place, "char_count": F.length("content")}).drop("_n")


def with_captions(df: DataFrame, order: list[str]) -> DataFrame:
    """Tables opened by the last prose before them in the same source and section, by its name or, without one, its id."""
    section = F.coalesce(*[c for c in ("section_name", "section_id") if c in df.columns])
    tail = once(prose_tail(F.col("content")), lambda x: F.when(x != "", x))
    out = running(df, [source_key(), section], order, {"_caption": tail}).drop("_n")
    out = out.withColumn("_caption", F.when(is_table(F.col("content")), F.col("_caption")))
    return out.withColumn("table_context", F.col("_caption").isNotNull()).withColumn(
        "content", F.when(F.col("_caption").isNotNull(), F.concat(F.lit("[Table — preceding text: …"), "_caption", F.lit("]\n\n"), "content")).otherwise(F.col("content"))
    ).drop("_caption")


def sentences_in_context(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence, wide): each sentence of a text, and with its neighbours."""
    sent = df.select(key, sentences(F.col(text)).alias("_s"))
    both = F.transform("_s", lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), F.array_join(F.slice("_s", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ").alias("wide")))
    return sent.select(key, F.explode(both).alias("x")).select(key, "x.pos", "x.sentence", "x.wide")


def breakpoints(df: DataFrame, key: str, order: str, percentile: float = DEFAULTS.breakpoint_percentile) -> DataFrame:
    """df (key, order, vector) with gap, the cosine distance to the key's next row, and is_cut: whether it is above the key's own percentile."""
    line = Window.partitionBy(key).orderBy(order)
    unit = df.withColumn("vector", normalised(F.col("vector")))
    gaps = unit.withColumn("gap", 1 - dot(F.col("vector"), F.lead("vector").over(line))).drop("vector")
    cut = F.percentile("gap", F.lit(percentile)).over(Window.partitionBy(key))
    return gaps.withColumn("is_cut", F.coalesce(F.col("gap") > cut + 1e-12, F.lit(False)))  # a gap at the percentile itself is none, however it was rounded


def semantic_segments(df: DataFrame, embed, key: str = "doc_id", settings: Settings = DEFAULTS) -> DataFrame:
    """(key, segment, content): sentences cut where a sentence's surroundings differ from the next one's.

    The cosine distance of neighbouring windows of three sentences is held against the document's own
    percentile; a segment over max_semantic_chars is split recursively by the caller. A text of fewer
    than two sentences is one segment as it is, unless it is blank.
    """
    single = df.filter((F.size(sentences(F.col("text"))) < 2) & (stripped(F.col("text")) != "")).select(key, F.lit(0).cast("long").alias("segment"), F.col("text").alias("content"))
    several = df.filter(F.size(sentences(F.col("text"))) >= 2)
    sent = sentences_in_context(several, key)
    marked = breakpoints(sent.select(key, "pos", "sentence", embed(F.col("wide")).alias("vector")), key, "pos", settings.breakpoint_percentile)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum(F.col("is_cut").cast("int")).over(before), F.lit(0)).alias("segment")
    islands = marked.select(key, "pos", "sentence", part)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return islands.groupBy(key, "segment").agg(text.alias("content")).unionByName(single)


def rolled(parts: list[str], counts: np.ndarray, percentile: float) -> list[str]:
    """The segments of a text's sentences, from a row of token counts for each.

    A window's counts are those of the window before, plus the sentence that comes in, less the one that
    goes out: differences of running sums.
    """
    total = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0, dtype=np.float64)])
    at = np.arange(len(parts))
    wide = total[np.minimum(at + 2, len(parts))] - total[np.maximum(at - 1, 0)]
    size = np.linalg.norm(wide, axis=1)
    unit = wide / np.where(size > 0, size, 1)[:, None]
    gaps = 1 - (unit[:-1] * unit[1:]).sum(axis=1)
    cuts = np.flatnonzero(gaps > np.percentile(gaps, 100 * percentile) + 1e-12) + 1  # a gap at the percentile itself is none, however it was rounded
    return [" ".join(parts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(parts)])]


def rolling_segments(df: DataFrame, embed, settings: Settings = DEFAULTS, size: int | None = None) -> DataFrame:
    """df with parts, the semantic segments of its text, those over max_semantic_chars split to `size` characters.

    For an embedder whose vectors add up (embed.counts(sentences)): one pass over each text where it lies,
    in which neither sentences nor vectors leave their task. A text of fewer than two sentences is one
    segment as it is; a blank or null one has none.
    """
    size = size or settings.chunk_size
    told = df.withColumn("_sentences", sentences(F.col("text"))).withColumn("_blank", F.coalesce(stripped(F.col("text")) == "", F.lit(True)))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                text, parts, blank = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "_sentences", "_blank"))
                out = []
                for t, p, b in zip(text, parts, blank):
                    found = [] if b else rolled(p, embed.counts(p), settings.breakpoint_percentile) if len(p) > 1 else [t]
                    out.append([x for s in found for x in (split_recursively(s, size, settings.chunk_overlap) if len(s) > settings.max_semantic_chars else [s])])
                kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.string()))], names=[*rest, "parts"])

    rest = [c for c in df.columns if c not in ("text", "parts")]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("parts", T.ArrayType(T.StringType()))])
    return told.mapInArrow(run, schema)


def chunk(df: DataFrame, strategy: str = "recursive", size: int | None = None, embed=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of df (doc_id, text and provenance) with provenance, by strategy: fixed, recursive, semantic or table_context.

    A size given with `semantic` means chunks by size, recorded as recursive.
    """
    if strategy == "semantic" and size:
        strategy = "recursive"
    size_ = size or settings.chunk_size
    rest = [c for c in df.columns if c != "text"]
    if strategy == "fixed":
        out = df.select(*rest, F.posexplode(fixed_chunks(F.col("text"), size_, settings.chunk_overlap)).alias("_at", "content"))
    elif strategy in ("recursive", "table_context"):
        out = df.select(*rest, F.posexplode(recursive_chunks(size_, settings.chunk_overlap)("text")).alias("_at", "content"))
    elif strategy == "semantic":
        if embed is None:
            raise ValueError("semantic chunking needs an embedder")
        if hasattr(embed, "counts"):
            out = rolling_segments(df, embed, settings, size_).select(*rest, F.posexplode("parts").alias("_at", "content"))
            return tagged(no_stubs(out, settings.min_chunk_chars), strategy, ["doc_id", "_at"]).drop("_at")
        parts = semantic_segments(df, embed, "doc_id", settings)
        split = recursive_chunks(size_, settings.chunk_overlap)
        pieces = F.when(F.length("content") > settings.max_semantic_chars, split("content")).otherwise(F.array("content"))
        parts = parts.select("doc_id", "segment", F.posexplode(pieces).alias("_in", "content"))
        at = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "_in")) - 1
        out = df.select(*rest).join(parts.withColumn("_at", at).drop("segment", "_in"), "doc_id")
    else:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    out = no_stubs(out, settings.min_chunk_chars)
    if strategy == "table_context":
        out = with_captions(out, ["doc_id", "_at"])
    return tagged(out, strategy, ["doc_id", "_at"]).drop("_at")
