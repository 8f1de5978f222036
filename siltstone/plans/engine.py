"""Batches of questions from screening to labelled answers, and the calls that a service makes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import entities, guard
from ..functions.answers import relevance
from ..functions.text import passage, stripped
from ..operators import access, answering, boundary, evaluate, lexical, rank, recovery
from ..operators.stage import written


@dataclass
class Engine:
    """Questions against a corpus (doc_pos, content, department, ticker, section_name, vector and provenance).

    embed, scorer, generate, judge, rewrite and rephrase stand where models do; the defaults are
    deterministic expressions. generate reads the question and all its numbered blocks; judge is asked
    where verification is; rephrase words a refused question anew for another search. rewrite and generate
    may be Models, whose failures stay with their rows; choose, a Model, picks the tools of recover().
    keep_question puts the question before what a Model rewrites it to.
    """

    corpus: DataFrame
    embed: object = None
    scorer: object = staticmethod(rank.overlap_score)
    generate: object = staticmethod(answering.extract_answer)
    judge: object = staticmethod(answering.overlap_judge)
    rewrite: object = None
    rephrase: object = None
    settings: Settings = field(default_factory=lambda: DEFAULTS)
    index_root: str | None = None
    keep_question: bool = False
    choose: boundary.Model | None = None
    _indexes: dict = field(default_factory=dict, init=False, repr=False)

    def lexical_index(self, corpus: access.Authorized, key: str) -> lexical.KeptBm25 | rank.Bm25:
        """The index of what a key may read: made once, then used by every call.

        Under index_root it is kept: it outlives this engine, and is extended if documents were added
        meanwhile. Without one, passages are cut into tokens once and scored where they lie, and no
        postings are made.
        """
        if key not in self._indexes:
            self._indexes[key] = rank.Bm25(corpus, self.settings) if self.index_root is None else lexical.KeptBm25.open(corpus, self.index_root, key, self.settings)
        return self._indexes[key]

    @staticmethod
    def _key(kind: str, roles: set[str], extra: Column | None = None) -> str:
        """What stands for a scope: departments, not roles, since roles that read the same share an index."""
        allowed = access.readable(roles)
        return f"{kind}|{'*' if allowed is None else ','.join(sorted(allowed))}|{'' if extra is None else extra}"

    def screened(self, questions: DataFrame) -> DataFrame:
        """questions (query_id, query) with violation, injection and the redacted query."""
        out = questions.withColumn("violation", guard.violation(F.col("query"))).withColumn("injection", guard.injection(F.col("query")))
        return out.withColumn("query", guard.redact(F.col("query")))

    def retrieve(self, questions: DataFrame, roles: set[str], mode: str = "lexical", reranked: bool = True, extra: Column | None = None, k: int | None = None) -> DataFrame:
        """(query_id, query, rank, doc_pos, score, relevance and provenance): roles first, then the ranking, then the cut, then continuations."""
        k = k or self.settings.top_k
        wide = self.settings.candidate_k if reranked else k
        allowed = access.authorized(self.corpus, roles, extra)
        text = passage(F.col("ticker"), F.col("section_name"), F.col("content"))
        searched = self._searched(questions)
        by_words = lambda: self.lexical_index(access.Authorized(allowed.df.select("doc_pos", text.alias("passage"))), self._key("passages", roles, extra)).search(searched, wide)

        def dense():
            if self.embed is None:
                raise ValueError(f"{mode} retrieval needs an embedder")
            queries = searched.select("query_id", self.embed(F.col("query")).alias("vector"))
            return rank.dense(access.Authorized(allowed.df.select("doc_pos", self.embed(F.col("content")).alias("vector"))), queries, wide, self.settings)

        if mode == "lexical":
            hits = by_words().select("query_id", "doc_pos", "rank", "score", F.lit("bm25").alias("score_type"))
        elif mode == "dense":
            hits = dense().select("query_id", "doc_pos", "rank", "score", F.lit("cosine_relevance").alias("score_type"))
        elif mode == "hybrid":
            hits = rank.hybrid(dense(), by_words(), allowed.df.select("doc_pos", "content"), wide, self.settings).select("query_id", "doc_pos", "rank", "score", "score_type")
        else:
            raise ValueError(f"unknown retrieval mode: {mode}")
        found = hits.join(questions.select("query_id", "query"), "query_id").join(allowed.df, "doc_pos").withColumn("passage", text)
        if reranked:
            # The first ranking's score stays beside the pair score that replaces it.
            found = found.withColumnsRenamed({"score": "first_score", "score_type": "first_type"})
            best = rank.rerank(found.withColumn("first_relevance", relevance(F.col("first_score"), F.col("first_type"))), k, self.scorer)
        else:
            best = found.withColumn("relevance", relevance(F.col("score"), F.col("score_type"))).filter(F.col("rank") <= k)
        return rank.continued(written(best, "hits"), allowed.df)

    def _searched(self, questions: DataFrame) -> DataFrame:
        """questions as the rewriter words them; a question itself where the rewriter gives nothing, or, as a Model, fails."""
        if self.rewrite is None:
            return questions
        if isinstance(self.rewrite, boundary.Model):
            return written(boundary.rewritten(questions, self.rewrite, self.keep_question).drop("rewrite_error"), "rewritten")
        new = self.rewrite(F.col("query"))
        return questions.withColumn("query", F.when(stripped(F.coalesce(new, F.lit(""))) != "", new).otherwise(F.col("query")))

    def by_entity(self, questions: DataFrame, roles: set[str], k: int | None = None) -> DataFrame:
        """Lexical retrieval for each company that a question names, with the question scoped to it, merged; unfiltered where it names none.

        All legs are one search: a chunk stands in the scope of everything and in that of its ticker,
        each with its own statistics.
        """
        k = k or self.settings.top_k
        named = questions.withColumn("entities", entities.detect(F.col("query")))
        place = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit("")))
        legs = named.select("query_id", "query", "entities", F.posexplode(place).alias("entity_pos", "scope"))
        scoped = F.coalesce(*[F.when(F.col("scope") == t, entities.scope(F.col("query"), t)) for t in entities.COMPANIES], F.col("query"))
        legs = written(legs.select("query_id", "entity_pos", "scope", scoped.alias("query")), "legs")
        allowed = access.authorized(self.corpus, roles)
        text = passage(F.col("ticker"), F.col("section_name"), F.col("content"))
        index = allowed.df.select("doc_pos", text.alias("passage"), F.array(F.lit(""), F.coalesce("ticker", F.lit("?"))).alias("scopes"))
        hits = self.lexical_index(access.Authorized(index), self._key("legs", roles)).search(legs, self.settings.candidate_k).select("query_id", "scope", "doc_pos")
        found = hits.join(legs, ["query_id", "scope"]).join(allowed.df.withColumn("passage", text), "doc_pos")
        best = rank.rerank(found, k, self.scorer, ["query_id", "scope"])
        return rank.continued(written(rank.merge_legs(best, k), "hits"), allowed.df)

    def ask_batch(self, questions: DataFrame, roles: set[str], verify: bool = False, retries: int = 0) -> DataFrame:
        """(query_id, status, answer, flags, accuracy, confidence, label, attempts): turned-away questions never reach retrieval, gated ones never the generator.

        verify asks the judge about every citation. retries is how often a question that the model
        refused is searched for again, with the same roles: rephrased, if there is a rephraser, and
        among more passages each time.
        """
        checked = self.screened(questions)
        turned = F.when(F.col("violation").isNotNull(), F.col("violation")).when(F.col("injection.blocked"), F.col("injection.reason"))
        checked = written(checked.withColumn("turned", turned), "screened")
        open_ = checked.filter("turned IS NULL").select("query_id", "query")
        hits = written(self.by_entity(open_, roles), "hits")
        judge = self.judge if verify else None
        out = answering.grounded(open_, hits, self.generate, self.settings, judge)

        def again(left: DataFrame, turn: int) -> DataFrame:
            if self.rephrase is not None:
                left = left.withColumn("query", self.rephrase(F.col("query")))
            return self.retrieve(left, roles, k=self.settings.top_k * (turn + 2))

        out = written(answering.retried(out, open_, again, self.generate, retries, self.settings, judge), "answers")
        answer = guard.redact(guard.with_notes(F.col("answer")))
        flags = F.concat(guard.output_flags(F.col("answer")), guard.compliance_flags(F.col("answer")))
        done = out.select("query_id", "status", answer.alias("answer"), F.coalesce(flags, F.array().cast("array<string>")).alias("flags"), "accuracy", "confidence", "label", "attempts")
        away = checked.filter("turned IS NOT NULL").select("query_id", F.col("turned").alias("status"))
        return done.unionByName(away, allowMissingColumns=True)

    def recover(self, refused: DataFrame, first: DataFrame, roles: set[str], turns: int = recovery.TURNS) -> tuple[DataFrame, DataFrame]:
        """A second attempt at refused questions (query_id, query) within the same roles: what each did, and its rated answer where it has one.

        first: the hits of the first attempt (see retrieve()), whose confidence stays.
        """
        searches: list[DataFrame] = []

        def search(asks: DataFrame) -> DataFrame:
            searches.append(written(self.retrieve(asks, roles), "hits"))
            return answering.numbered(searches[-1]).select("query_id", "context")

        sections = evaluate.sections_of(access.authorized(self.corpus, roles).df)
        did = recovery.recovered(refused, answering.numbered(first), self.choose, search, sections, turns)
        told = did.filter("stopped_because = 'answered'").join(answering.retrieval_confidence(first), "query_id", "left")
        hits = first.withColumn("search_id", F.lit(None).cast("string"))
        for found in searches:
            owner = F.element_at(F.split("query_id", ":"), 1).cast(first.schema["query_id"].dataType)
            hits = hits.unionByName(found.withColumn("search_id", F.col("query_id")).withColumn("query_id", owner), allowMissingColumns=True)
        own = hits.alias("h").join(told.select("query_id", "search_id").alias("t"), (F.col("h.query_id") == F.col("t.query_id")) & F.col("h.search_id").eqNullSafe(F.col("t.search_id"))).select("h.*")
        depth = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"))
        both = told.join(depth, "query_id", "left").select("query_id", F.lit("open").alias("status"), "answer", "retrieval", F.coalesce("documents", F.lit(0)).alias("documents"))
        return did, answering.rated(written(both, "recovered"), own)

    def probe_refusals(self, questions: DataFrame, roles: set[str]) -> DataFrame:
        """(query_id, confidence, refused, answer) with the gate open: every question reaches the generator, so that its own refusals are counted."""
        asked = questions.select("query_id", "query")
        hits = self.retrieve(asked, roles)
        settings = replace(self.settings, gate=-1.0)
        out = answering.grounded(asked, hits, self.generate, settings)
        return out.select("query_id", F.coalesce("retrieval", F.lit(0.0)).alias("confidence"), (F.col("status") == "model_refused").alias("refused"), "answer")

    def compare(self, tickers: list[str], topic: str, roles: set[str]) -> DataFrame:
        """One comparative question about several companies, answered."""
        spark = self.corpus.sparkSession
        names = " and ".join(entities.COMPANIES[t][1] for t in tickers)
        return self.ask_batch(spark.createDataFrame([(0, f"Compare {topic} of {names}")], "query_id long, query string"), roles)

    def list_documents(self, roles: set[str]) -> DataFrame:
        return evaluate.listing(access.authorized(self.corpus, roles, missing="general").df)

    def list_companies(self) -> DataFrame:
        return self.corpus.sparkSession.createDataFrame([(t, c, n) for t, (c, n) in entities.COMPANIES.items()], "ticker string, cik string, company_name string")

    def describe_access(self, roles: set[str]) -> dict:
        allowed = access.readable(roles)
        return {
            "roles": sorted(roles),
            "departments": sorted(access.ROLE_ACCESS["admin"] if allowed is None else allowed),
            "barriers": [] if "admin" in roles else sorted(n for n, _, r, _ in access.BARRIERS if r in roles),
        }
