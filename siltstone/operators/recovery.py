"""A bounded second attempt at refused questions: a state row for each, a tool choice for each turn, all questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stripped
from .boundary import Model, asked
from .stage import written

#: Turns, and failed tools of a question, after which it is left as it was.
TURNS, FAILURES = 4, 2
NOTHING = "NOTFOUND"
CALLS = "calls array<struct<name: string, query: string, ticker: string>>, text string"
STEP = "struct<tool: string, argument: string, observation: string, failed: boolean>"


def sections_told(sections: DataFrame) -> DataFrame:
    """(ticker, told): the sections of each company with their numbers of passages, from (ticker, section_name, chunks)."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("section_name", F.lit("unknown")).alias("s"), "chunks"))), lambda x: F.concat(F.lit("  "), x["s"], F.lit(": "), x["chunks"].cast("string")))
    return sections.groupBy("ticker").agg(F.concat(F.first("ticker"), F.lit(": "), F.sum("chunks").cast("string"), F.lit(" passages\n"), F.array_join(line, "\n")).alias("told"))


def recovered(refused: DataFrame, contexts: DataFrame, choose: Model | None, search: Callable[[DataFrame], DataFrame] | None, sections: DataFrame, turns: int = TURNS, failures: int = FAILURES) -> DataFrame:
    """(query_id, stopped_because, answer, turns, errors, steps, search_id) of refused questions (query_id, query).

    contexts: (query_id, context) of the first attempt. In each turn the model reads (query, context, steps
    so far as JSON) and replies either with a text, which ends the question, or with JSON
    {"calls": [{"name", "query" or "ticker"}]}. search_filings is asked for all questions in one search:
    search(query_id, query) gives (query_id, context) and names each call by its query_id; list_sections
    reads `sections`. What fails comes back as an observation. stopped_because is answered, gave_up (a blank
    text or one with NOTFOUND), tool_failures (too many, or the model itself failed), iteration_cap,
    tools_unsupported (no model) or no_search_available. search_id names the last search that found
    anything; what an answer cites is numbered by it, or where it is null by the first attempt.
    """
    state = refused.select("query_id", "query").join(contexts.select("query_id", "context"), "query_id", "left")
    state = state.select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"), F.lit(0).alias("turns"), F.lit(0).alias("errors"), F.array().cast(f"array<{STEP}>").alias("steps"), F.lit(None).cast("string").alias("search_id"))
    ended = lambda df, why, answer=None: df.select("query_id", why.alias("stopped_because"), (F.lit(None).cast("string") if answer is None else answer).alias("answer"), "turns", "errors", "steps", "search_id")
    if choose is None or search is None or turns <= 0:
        return ended(state, F.lit("no_search_available" if search is None else "iteration_cap" if turns <= 0 else "tools_unsupported"))
    told = sections_told(sections)
    state, done = written(state, "recovery"), None
    for turn in range(turns):
        replied = asked(state.withColumn("_steps", F.to_json("steps")), choose, ["query", "context", "_steps"]).withColumn("turns", F.col("turns") + 1)
        parsed = F.from_json("reply", CALLS)
        replied = written(replied.withColumn("calls", parsed["calls"]).withColumn("text", stripped(F.coalesce(parsed["text"], F.when(parsed["calls"].isNull(), F.col("reply")), F.lit("")))), "replied")
        calling = F.coalesce(F.size("calls"), F.lit(0)) > 0
        over = replied.filter(F.col("reply_error").isNotNull() | ~calling)
        nothing = (F.col("text") == "") | F.contains(F.upper("text"), F.lit(NOTHING))
        why = F.when(F.col("reply_error").isNotNull(), "tool_failures").when(nothing, "gave_up").otherwise("answered")
        finished = ended(over, why, F.when(why == "answered", F.col("text")))
        done = finished if done is None else done.unionByName(finished)
        going = replied.filter(F.col("reply_error").isNull() & calling)
        calls = going.select("query_id", F.posexplode("calls").alias("place", "c")).select("query_id", "place", "c.name", stripped(F.coalesce("c.query", F.lit(""))).alias("query"), F.upper(stripped(F.coalesce("c.ticker", F.lit("")))).alias("ticker"))
        calls = written(calls.withColumn("call_id", F.concat_ws(":", F.col("query_id").cast("string"), F.lit(turn), "place")), "calls")
        searches = calls.filter("name = 'search_filings' AND query != ''")
        broken = None
        try:
            found = written(search(searches.select(F.col("call_id").alias("query_id"), "query")).select(F.col("query_id").alias("call_id"), F.col("context").alias("found")), "found")
        except Exception as e:  # noqa: BLE001  a failed search is an observation, not the end of the batch
            broken = f"search_filings failed: {type(e).__name__}"
            found = searches.select("call_id", F.lit(None).cast("string").alias("found"))
        seen = calls.join(found, "call_id", "left").join(told, "ticker", "left")
        is_search, is_list = F.col("name") == "search_filings", F.col("name") == "list_sections"
        empty = F.coalesce("found", F.lit("")) == ""
        observation = (
            F.when(is_search & (F.col("query") == ""), "search_filings needs a query")
            .when(is_search & empty, broken or "no passages found")
            .when(is_search, F.col("found"))
            .when(is_list & (F.col("ticker") == ""), "list_sections needs a ticker")
            .when(is_list, F.coalesce("told", F.concat("ticker", F.lit(" is not in the index"))))
            .otherwise(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit(""))))
        )
        failed = (is_search & ((F.col("query") == "") | F.lit(broken is not None))) | ~F.coalesce(is_search | is_list, F.lit(False))
        step = F.struct(F.coalesce("name", F.lit("")).alias("tool"), F.when(is_search, F.col("query")).otherwise(F.col("ticker")).alias("argument"), observation.alias("observation"), failed.alias("failed"))
        line = seen.select("query_id", "place", "call_id", step.alias("step"), (is_search & ~empty).alias("hit"))
        each = line.groupBy("query_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"]).alias("new"), F.count_if(F.col("step.failed")).alias("failed"),
            F.max(F.when(F.col("hit"), F.struct("place", "call_id", F.col("step.observation").alias("context")))).alias("last"),
        )
        state = going.join(each, "query_id").select("query_id", "query", F.coalesce("last.context", "context").alias("context"), "turns", (F.col("errors") + F.col("failed")).cast("int").alias("errors"), F.concat("steps", F.col("new").cast(f"array<{STEP}>")).alias("steps"), F.coalesce("last.call_id", "search_id").alias("search_id"))
        state = written(state, "recovery")
        done = done.unionByName(ended(state.filter(F.col("errors") >= failures), F.lit("tool_failures")))
        state = state.filter(F.col("errors") < failures)
        if state.isEmpty():
            return written(done, "recovered")
    return written(done.unionByName(ended(state, F.lit("iteration_cap"))), "recovered")
