"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is its place in its source
divided by the source's rows. Sorted by fractional rank, any run of rows holds the sources in the proportions of the
whole, so equal cuts give shards that match the mixture. Only keys, sizes and checksums move, never texts; both sorts
are range partitions, so a source of any size spans many tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import running_total
from spanloom.staging import stage

SHARDS = 16


def with_source_number(docs: DataFrame) -> tuple[DataFrame, list]:
    """Add `_source`: the place of the row's source among the sources by code point, null last; and their list."""
    names = [r[0] for r in docs.select("source").distinct().collect()]
    names = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in str(n)]) + [None] * (None in names)
    spark, kind = docs.sparkSession, docs.schema["source"].dataType
    schema = T.StructType([T.StructField("_name", kind), T.StructField("_source", T.IntegerType())])
    table = spark.createDataFrame([(n, k) for k, n in enumerate(names)], schema)
    return docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name"), names


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 3) -> DataFrame:
    """One row (doc_id, source, size, text_crc32, law, shard, slot, grown_shard) per row of docs.

    size is the text's length in bytes plus 1, text_crc32 its checksum; a null text counts as empty. The law is `rows`:
    the shards' numbers of rows differ by one at most. slot numbers a shard's rows from 0 without gaps. grown_shard is
    null, as places depend on all rows. Null sources are a source of their own, repeated rows are placed one by one, and
    the list of sources, a setting of the mixture, is read to the driver. An empty table gives an empty table. Runs jobs.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stage(
        docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .withColumn("_mark", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text_crc32", "size"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    numbered, _ = with_source_number(rows)
    one = numbered.withColumn("_one", F.lit(1))
    ranked = running_total(one, ["_mark", "doc_id", "_row"], "_one", "_rank", group="_source")
    totals = numbered.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    spread = ranked.join(F.broadcast(totals), "_source").withColumn("_place", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    placed = running_total(spread, ["_place", "_source", "_rank"], "_one", "_at")
    total = max(1, rows.count())
    shard = F.expr(f"_at * {shards} div {total}")
    # the first place p of shard s is the least with p * shards >= s * all
    begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - begin)
        .select(
            "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
