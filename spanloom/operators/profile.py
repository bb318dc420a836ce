"""Corpus profiling: frequencies, unseen values, ambiguity, class weights."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.schemas import CONCEPT_RELATION_KEY
from spanloom.vocab import CLASSES


def triple_frequency(relations: DataFrame) -> DataFrame:
    """In how many articles each concept triple occurs, most frequent first."""
    return (
        relations.groupBy(*CONCEPT_RELATION_KEY)
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), *CONCEPT_RELATION_KEY)
    )


def top_patterns(relations: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent patterns of labels and predicate."""
    pattern = ["subject_label", "predicate", "object_label"]
    return relations.groupBy(*pattern).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *pattern).limit(n)


def list_sizes(articles: DataFrame) -> DataFrame:
    return articles.select("pmid", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


def unseen_values(dev: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """(column, n): values of dev that train lacks, with their number of rows in dev."""
    counts = dev.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(train.select(column).distinct(), column, "left_anti")


def unseen_rate(dev: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """One row (column, n_unseen, n_total) over the rows of dev."""
    seen = train.select(column).distinct().withColumn("_seen", F.lit(True))
    counts = dev.groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(seen, column, "left")
    unseen = F.coalesce(F.sum(F.when(F.col("_seen").isNull(), F.col("n"))), F.lit(0))
    return counts.agg(
        F.lit(column).alias("column"), unseen.alias("n_unseen"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total")
    )


def ambiguous_spans(entities: DataFrame) -> DataFrame:
    """(text_span, n_uris) of surfaces annotated with more than one concept."""
    return (
        entities.select("text_span", "uri").distinct()
        .groupBy("text_span")
        .agg(F.count("uri").alias("n_uris"))
        .filter(F.col("n_uris") > 1)
    )


def label_distribution(examples: DataFrame, n: int = 5) -> DataFrame:
    return examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(n)


def class_weights(examples: DataFrame) -> DataFrame:
    """(label, n, weight) for all classes: total / (classes * n), an absent class counting as one example."""
    counts = examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per class from here on.
    total = counts.agg(F.sum("n").alias("total"))
    classes = examples.sparkSession.createDataFrame([(c,) for c in CLASSES], "label string")
    filled = classes.join(counts, "label", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    weight = F.col("total") / (len(CLASSES) * F.greatest("n", F.lit(1)))
    return filled.select("label", "n", weight.alias("weight"))
