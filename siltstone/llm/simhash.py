"""SimHash fingerprints and the search for all within a Hamming radius, with DataFrame operations only.

Terms are pairs of neighbouring words (a text's last word pairs with nothing). A term weighs 1 to 4,
by the letters in its words, and votes with its weight on each of 64 bits, for or against.

Defined results: null is the empty text; a text without words has fingerprint 0; equal texts have
equal fingerprints; repeated rows and ties keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, staged

BITS = 64
#: Two counters of 32 bits in each sum: no text that a string can hold overflows them.
LANE = 32


def terms(text: Column) -> Column:
    """array<bigint>: a hash of each term, with weight - 1 in its lowest two bits."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)

    def term(a: Column, b: Column) -> Column:
        long = F.least(F.lit(3), F.floor((F.length(a) + F.coalesce(F.length(b), F.lit(0))) / 6))
        return F.xxhash64(a, b).bitwiseAND(F.lit(-4)).bitwiseOR(long.cast("long"))

    return F.zip_with(words, F.slice(words, 2, 1 << 30), term)


def fingerprints(df: DataFrame, keys: list[str], arrays: dict[str, Column]) -> DataFrame:
    """keys, and for each name in arrays the fingerprint (bigint) of its terms.

    The keys must tell rows apart. A text's terms stand in one task, so the sums are combined there
    and the shuffle holds a row per text.
    """
    names = list(arrays)
    each = df.select(*keys, F.posexplode(F.array(*arrays.values())).alias("_which", "_terms"))
    each = each.select(*keys, "_which", F.explode_outer("_terms").alias("_t"))
    each = each.select(*keys, "_which", F.xxhash64("_t").alias("_h"), (F.col("_t").bitwiseAND(F.lit(3)) + 1).alias("_w"))
    lanes = F.lit(1 | 1 << LANE)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(lanes) * F.col("_w")).alias(f"_s{i}") for i in range(LANE)]
    votes = each.groupBy(*keys, "_which").agg(F.sum("_w").alias("_all"), *sums)
    bits = []
    for i in range(LANE):
        for lane in (0, 1):
            total = F.shiftrightunsigned(f"_s{i}", LANE * lane).bitwiseAND(F.lit(2**LANE - 1))
            place = i + LANE * lane
            bits.append(F.when(total * 2 > F.col("_all"), F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    found = votes.select(*keys, "_which", value.alias("_fp"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == k, F.col("_fp"))).alias(name) for k, name in enumerate(names)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Twice the radius in blocks of bits, (first bit, mask), one block at least."""
    n = max(1, 2 * radius)
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, (1 << b - a) - 1) for a, b in zip(cuts, cuts[1:])]


def near(queries: DataFrame, rows: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp): every fingerprint of rows.fp within the radius of a queries.fp, itself included.

    Both are made distinct first, so copies cost one row. Up to `radius` differing bits touch that
    many blocks at most; with 2 x radius blocks some `radius` blocks agree, and the table that puts
    these first holds both under one key. A pair counts in the first table that finds it.
    """
    blocks = _blocks(radius)
    tables = list(combinations(range(len(blocks)), max(1, radius)))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        def key(table: tuple[int, ...]) -> Column:
            parts = [F.shiftrightunsigned(name, blocks[b][0]).bitwiseAND(F.lit(blocks[b][1])) for b in table]
            return F.xxhash64(*parts)

        return df.select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(F.array(*map(key, tables))).alias("tab", "key"))

    q, r = keyed(queries, "query").alias("q"), keyed(rows, "fp").alias("r")
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    agree = [F.shiftrightunsigned(apart, a).bitwiseAND(F.lit(m)) == 0 for a, m in blocks]
    first = F.lit(len(tables))
    for k in reversed(range(len(tables))):
        both = agree[tables[k][0]]
        for b in tables[k][1:]:
            both = both & agree[b]
        first = F.when(both, F.lit(k)).otherwise(first)
    on = (F.col("q.tab") == F.col("r.tab")) & (F.col("q.key") == F.col("r.key")) & (F.bit_count(apart) <= radius) & (first == F.col("q.tab"))
    return q.join(r, on).select("query", "fp")


def in_order(df: DataFrame, key: str, rows_per_bucket: int = 1024, most: int = 1 << 14) -> DataFrame:
    """df with `bucket`, `rn` (its place in the bucket by key, then text) and `next_text`, the text of the next row by key; after the last comes the first.

    Buckets are ranges of the key between its quantiles, so no window holds the whole table; their
    number grows with the rows. The rows that open the buckets, at most `most`, are lined up apart.
    """
    n = df.count()
    many = max(1, min(most, n // rows_per_bucket))
    cuts: list = []
    if many > 1:
        cuts = sorted(set(df.agg(F.percentile_approx(key, [k / many for k in range(1, many)], max(10_000, 8 * many))).first()[0] or []))
    bucket = F.lit(0)
    if cuts:
        # How many cuts are at or below the key, by binary search in a constant array.
        line = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(line, at + step - 1) <= F.col(key)), at + step).otherwise(at))
    inside = Window.partitionBy("bucket").orderBy(F.col(key).asc_nulls_first(), "text")
    out = df.withColumn("bucket", F.when(F.col(key).isNull(), 0).otherwise(bucket)).select("*", F.row_number().over(inside).alias("rn"), F.lead("text").over(inside).alias("_lead"))
    return follow(out, "_lead", "text", "next_text")


def follow(df: DataFrame, lead: str, value: str, name: str) -> DataFrame:
    """df with `name`: column `lead`, or for the last row of a bucket the value of the next bucket's first row."""
    line = Window.orderBy("bucket")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = df.filter("rn = 1").select("bucket", value).select(F.col("bucket").alias("_b"), F.coalesce(F.lead(value).over(line), F.first(value).over(whole)).alias("_head"))
    return df.join(heads, F.col("bucket") == F.col("_b"), "left").withColumn(name, F.coalesce(F.col(lead), F.col("_head"))).drop("_b", "_head", lead)


def edits(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    The edited text has the last quarter of the characters replaced by as many of the next
    document's first. n_near, for keys that 100 divides: how many rows, itself included, have a
    fingerprint within the radius.
    """
    base = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lined = in_order(base, "doc_id")
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    lined = lined.select("bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    lined = lined.select("bucket", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("terms"), terms(F.col("edited")).alias("edited_terms"))
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(lined, keys, {"fp": F.col("terms"), "efp": F.col("edited_terms")})
    prints = staged(prints, "simhash")
    lead = F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))
    prints = follow(prints.withColumn("_lead", lead), "_lead", "fp", "next_fp")
    queries = prints.filter(F.col("doc_id") % 100 == 0).select("fp")
    sizes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    hits = near(queries, sizes, radius).join(sizes, "fp").groupBy(F.col("query").alias("_q")).agg(F.sum("n").alias("n_near"))
    out = prints.join(hits, F.col("fp") == F.col("_q"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
    )
