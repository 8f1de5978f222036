"""The queries op1_ to op13_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, langid, licenses, lm, media, mixing, neardup, pages, simhash, toxicity, warc, whitening
from .common import fold, table


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm.score(docs, fold(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file()
    rows, used = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), file)
    found = bpe.decode(rows, file, used=used)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edits(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    filters = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages_.schema["page_id"].dataType
    found = warc.resolved(warc.read(spark, warc.write(pages_)))
    return found.select(
        warc.page_of("record_id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), warc.page_of("refers_to_id").cast(kind).alias("refers_to"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, 32)
    return whitening.empty(rows) if model is None else whitening.components(rows, model)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE = {
    "op1_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   sha256(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, 'null')) AS h
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, cap / weight AS full_at,
                     ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
        seeds AS (SELECT range AS seed FROM range(8)),
        c AS (
            SELECT d.doc_id, d.source, d.size, r.source_size, r.target, seed,
                   (floor(rate) + CASE WHEN ('0x' || substr(h, 1 + 8 * seed::INT, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN seeds),
        b AS (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS off FROM c GROUP BY source, seed),
        best AS (SELECT source, seed FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
        SELECT c.doc_id, c.size::BIGINT AS size, c.source_size, round(c.target, 6) AS target, (c.size * c.copies)::BIGINT AS taken
        FROM c JOIN best ON c.source IS NOT DISTINCT FROM best.source AND c.seed = best.seed""",
    "op11_warc": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
        n AS (
            SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h,
                   row_number() OVER (PARTITION BY b ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth,
                   first_value(page_id) OVER (PARTITION BY b ORDER BY page_id NULLS LAST, url NULLS LAST) AS response
            FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN nth > 1 THEN response END AS refers_to
        FROM n""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
