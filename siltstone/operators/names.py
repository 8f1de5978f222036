"""Many names looked for at once: an Aho-Corasick automaton, built once, its size checked, and sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entities import ALIASES, COMPANIES, SHORTEST_TICKER

#: Names that one automaton holds at most, and their characters in all.
NAMES, CHARS = 1_000_000, 16_000_000

_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def folded(text: str) -> str:
    """A to Z in lower case and nothing else changed, as patterns of any case match."""
    return text.translate(_FOLD)


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    """Finds each of the words (distinct, not empty), by its place among them."""
    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        out.add_word(w, k)
    out.make_automaton()
    return out


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return word(at - 1) != word(at)


def register(spark) -> DataFrame:
    """(alias, name, place, exact) of the companies: aliases in any case, tickers as written."""
    rows = [(a, t, k, False) for k, t in enumerate(COMPANIES) for a in ALIASES.get(t, ())]
    rows += [(t, t, k, True) for k, t in enumerate(COMPANIES) if len(t) >= SHORTEST_TICKER]
    return spark.createDataFrame(rows, "alias string, name string, place int, exact boolean")


def mentioned(df: DataFrame, names: DataFrame, text: str = "text", to: str = "entities") -> DataFrame:
    """df with the array of names that a text mentions as whole words, by first mention, then by place.

    names: (alias, name, place, exact). A null text mentions none. Raises ValueError where there are more
    names than an automaton may hold.
    """
    size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("alias")), F.lit(0))).first()
    if size[0] > NAMES or size[1] > CHARS:
        raise ValueError(f"{size[0]} names of {size[1]} characters are more than one automaton holds")
    by: dict[str, list] = {}
    for r in names.filter(F.col("alias") != "").collect():  # up to NAMES rows, counted above
        by.setdefault(folded(r["alias"]), []).append((r["alias"], r["name"], r["place"], r["exact"]))
    words = sorted(by)
    shared = df.sparkSession.sparkContext.broadcast((automaton(words), [len(w) for w in words], [by[w] for w in words]))

    def found(t: str | None) -> list[str]:
        if not t or not words:
            return []
        search, sizes, owners = shared.value
        low, first = folded(t), {}
        for end, k in search.iter(low):
            start = end - sizes[k] + 1
            if _edge(t, start) and _edge(t, end + 1):
                for alias, name, place, exact in owners[k]:
                    if not exact or t[start : end + 1] == alias:
                        first[name] = min(first.get(name, (start, place)), (start, place))
        return sorted(first, key=lambda n: (*first[n], n))

    kept = [c for c in df.columns if c != to]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            held = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*held, pa.array([found(t) for t in texts], pa.list_(pa.string()))], names=[*kept, to])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField(to, T.ArrayType(T.StringType()))]))


def held(probes: DataFrame, chunks: DataFrame, chars: int = CHARS) -> DataFrame:
    """(probe_id) of probes (probe_id, ticker, evidence) of which some chunk (ticker, content) of the same ticker holds the evidence, in any case.

    One pass over the chunks for each `chars` characters of evidence; a task says each probe once.
    """
    asked = probes.filter(F.col("evidence").isNotNull() & F.col("ticker").isNotNull()).select("probe_id", "ticker", F.lower("evidence").alias("evidence"))
    told = asked.filter("evidence != ''")
    total = told.agg(F.coalesce(F.sum(F.length("evidence")), F.lit(0))).first()[0]
    parts = max(1, -(-total // chars))
    # What every text holds is held where there is a text.
    out = asked.filter("evidence = ''").join(chunks.filter(F.col("content").isNotNull()).select("ticker").distinct(), "ticker", "left_semi").select("probe_id")
    rows = chunks.select("ticker", F.lower("content").alias("content"))
    for p in range(parts):
        by: dict[str, dict[str, list]] = {}
        for r in told.filter(F.pmod(F.xxhash64("evidence"), F.lit(parts)) == p).collect():  # about `chars` characters
            by.setdefault(r["evidence"], {}).setdefault(r["ticker"], []).append(r["probe_id"])
        words = sorted(by)
        if words:
            out = out.unionByName(_held_in(rows, words, by, probes.schema["probe_id"]))
    return out.distinct()


def _held_in(rows: DataFrame, words: list[str], by: dict, key: T.StructField) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    shared = rows.sparkSession.sparkContext.broadcast((automaton(words), [by[w] for w in words]))
    kind = to_arrow_type(key.dataType)

    def run(batches):
        seen: set = set()
        for batch in batches:
            search, owners = shared.value
            new = []
            for ticker, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in {k for _, k in search.iter(text)} if text else ():
                    for probe in owners[k].get(ticker, ()):
                        if (k, probe) not in seen:
                            seen.add((k, probe))
                            new.append(probe)
            yield pa.RecordBatch.from_arrays([pa.array(new, kind)], names=["probe_id"])

    return rows.mapInArrow(run, T.StructType([T.StructField("probe_id", key.dataType)]))
