"""Writers: chunks, collections, audit rows, evaluation runs, users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import vectors
from ..operators.evaluate import fingerprint
from ..operators.stage import written


def add_chunks(df: DataFrame, path: str, embed=None, threshold: float = DEFAULTS.near_duplicate) -> int:
    """Append chunks whose text the collection doesn't hold yet; how many were new.

    Equal texts are found by hash. With an embedder, chunks go as well that are similar to one in the
    collection, or to an earlier chunk of df that stays.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(["content"])
    try:
        held = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    if held is not None:
        hashes = held.select(F.sha2("content", 256).alias("h")).distinct()
        new = new.withColumn("h", F.sha2("content", 256)).join(hashes, "h", "left_anti").drop("h")
    new = written(new.withColumn("_pos", F.monotonically_increasing_id()), "new-chunks")
    if embed is not None:
        vector = lambda x: x.withColumnRenamed("_pos", "pos").select("pos", embed(F.col("content")).alias("vector"))
        batch = written(vector(new), "new-vectors")
        if held is not None:
            known = vectors.against_index(batch, vector(held.withColumn("_pos", F.monotonically_increasing_id())), threshold)
            batch = written(batch.join(known, "pos", "left_anti"), "new-vectors")
        kept = vectors.greedy_drop(batch.select("pos"), vectors.similar_pairs(batch, threshold))
        new = new.join(kept.select(F.col("pos").alias("_pos")), "_pos", "left_semi")
    new = written(new.drop("_pos"), "new-chunks")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def without(df: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """df's rows but those of these ids (key)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def delete_chunks(spark: SparkSession, path: str, ids: DataFrame, to: str) -> None:
    """A collection without the chunks of these ids (chunk_id), written to another place."""
    without(spark.read.parquet(path), ids).write.mode("overwrite").parquet(to)


def reset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def copy_collection(spark: SparkSession, path: str, to: str) -> tuple[int, str]:
    """Copy a collection; raise ValueError if the copy's count or digest differs."""
    src = spark.read.parquet(path)
    src.write.mode("overwrite").parquet(to)
    a, b = (tuple(fingerprint(spark.read.parquet(p)).first()) for p in (path, to))
    if a != b:
        raise ValueError(f"the copy differs: {a} and {b}")
    return a


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows as JSON lines, a folder for each day of `timestamp` (UTC)."""
    df.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def write_run(config: dict[str, str], corpus: DataFrame, scores: DataFrame, rows: DataFrame, path: str) -> None:
    """One JSON row: config, corpus (chunk_count, digest), scores (metric, value) and rows, one for each question of the suite."""
    at = corpus.select("chunk_count", "digest").first()
    known = {r["metric"]: r["value"] for r in scores.select("metric", "value").collect()}  # a row for each metric
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    out = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("per_question_scores"))
    out = out.withColumns({
        "config": pairs(config), "corpus": F.struct(F.lit(at["chunk_count"]).alias("chunk_count"), F.lit(at["digest"]).alias("content_digest")), "scores": pairs(known),
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    })
    out.write.mode("overwrite").json(path)


def insert_users(users: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of users (username) to insert; raises ValueError on a name that is taken."""
    if users.join(held, "username", "left_semi").limit(1).count():
        raise ValueError("a username is taken")
    return users.dropDuplicates(["username"])


def seed_roles(roles: DataFrame, held: DataFrame) -> DataFrame:
    """Roles (name) that aren't there yet."""
    return roles.join(held, "name", "left_anti")


def new_files(wanted: DataFrame, held: DataFrame, key: str = "path") -> DataFrame:
    return wanted.join(held, key, "left_anti")
