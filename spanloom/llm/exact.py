"""Exact duplicates: groups of a 128-bit content hash, told apart by their bytes.

Built-in functions only. Rows are grouped by the hash and the normalised text together, so Spark's own aggregation compares
bytes among rows of one hash, and copies of a text are added up before they move. What comes out is one short row a hash
with the number of different texts that share it. Where that number is one, the hash alone stands for the text and no text
moves again; where it is more, the text itself becomes part of the key. A group of any size is one row of an aggregate, and
its rows are spread over many tasks when they look it up.

Every text moves once, in full: which hashes repeat is known only after all are counted, and bytes can only be compared
where they meet.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import SHARE, lookup_join
from spanloom.staging import stage

WHITE = " \t\n\x0b\f\r"


def without_white_space(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def first_128_bits(text: Column) -> Column:
    """The first half of the SHA-256 that is reported anyway."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _marked(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Each row as one struct, beside its id, text, hash and rank.

    The hash is declared without nulls, else a join on it would filter the scan by the whole expression. `best` ranks the rows of a group: code points times 2 ** 65, plus 2 ** 63 - doc_id, which is above 0 for any 64-bit
    id; a null id counts as 0 and so comes last.
    """
    return (
        docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("raw"))
        .withColumn("body", without_white_space(F.col("raw")))
        .withColumn("points", F.coalesce(F.length("raw"), F.lit(0)))
        .select(
            "row", "id", "body", F.coalesce(content_hash(F.col("body")), F.lit(b"")).alias("hash"), F.sha2("body", 256).alias("sha"),
            F.expr(
                "cast(points as decimal(38, 0)) * 36893488147419103232"
                " + coalesce(9223372036854775808 - cast(id as decimal(20, 0)), 0)"
            ).cast("decimal(38,0)").alias("best"),
        )
    )


def _classes(docs: DataFrame, content_hash: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The marked rows and the classes of equal texts, both with the key (hash, odd); a class has `size` and `best`.

    odd is empty but for hashes that different texts share; there it is `=` and the text.
    """
    marked = _marked(docs, content_hash)
    texts = marked.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("size"), F.max("best").alias("best"))
    hashes = stage(
        texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("size"), F.max("best").alias("best"))
    )
    clash = hashes.filter("texts > 1").select("hash", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return marked.withColumn("odd", F.lit("")), hashes.select("hash", F.lit("").alias("odd"), "size", "best")
    marked = marked.join(clash, "hash", "left").withColumn(
        "odd", F.when(F.col("clash"), F.concat(F.lit("="), "body")).otherwise(F.lit(""))
    ).drop("clash")
    return marked, stage(marked.groupBy("hash", "odd").agg(F.count(F.lit(1)).alias("size"), F.max("best").alias("best")))


def _id(best: str) -> Column:
    low = f"{best} % 36893488147419103232"
    return F.expr(f"case when {low} > 0 then cast(9223372036854775808 - {low} as long) end")


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = first_128_bits) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) per row of docs.

    Texts are equal when their bytes are after white space [\\x20\\x09-\\x0D] is deleted; null and empty texts are equal. Of
    a group the row with the most code points stays, then that with the smallest doc_id; a null doc_id comes last. Of rows
    that repeat the doc_id and length of the one that stays, one is kept. An empty table gives an empty table; columns
    other than doc_id and text are not read. Runs jobs.
    """
    marked, classes = _classes(docs, content_hash)
    rows = marked.groupBy("id", "hash", "odd", "sha", "best").agg(F.count(F.lit(1)).alias("copies"))
    # the class sizes are known: no need to count the rows of each key again
    total = classes.agg(F.sum("size").alias("total"))
    hot = classes.join(F.broadcast(total), F.col("size") * SHARE > F.col("total")).select(
        "hash", "odd", F.ceil(F.col("size") * SHARE / F.col("total")).cast("int").alias("weight")
    )
    told = lookup_join(rows, classes.withColumnRenamed("best", "top"), ["hash", "odd"], hot=hot)
    return told.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(
        F.col("id").alias("doc_id"),
        _id("top").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("best") == F.col("top")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, content_hash: Callable[[Column], Column] = first_128_bits) -> DataFrame:
    """The rows that stay, one a group, with all their columns, whatever these are called. Runs jobs."""
    marked, classes = _classes(docs, content_hash)
    # rows of a hot group differ in `best`, so the join spreads them
    stay = marked.join(classes.select("hash", "odd", "best"), ["hash", "odd", "best"])
    return stay.dropDuplicates(["hash", "odd", "best"]).select("row.*")
