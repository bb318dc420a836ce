"""Nesting rows under their section or article, for training records and submissions."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.schemas import CONCEPT_RELATION_KEY, MENTION_RELATION_KEY, SECTION
from spanloom.staging import stage

# A cell holds so many items of a list; further ones follow in the article's next row.
PART_ITEMS = 50_000


def group_entities(entities: DataFrame) -> DataFrame:
    """(pmid, location, entities, text_span): sorted entities of a section and their texts in the same order.

    A section's list is linear in its text, which is one cell already.
    """
    item = F.struct("start_idx", "end_idx", "label", "uri", "text_span")
    grouped = entities.groupBy(*SECTION).agg(F.sort_array(F.collect_list(item)).alias("items"))
    fields = ("start_idx", "end_idx", "label", "uri")
    return grouped.select(
        *SECTION,
        F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("entities"),
        F.transform("items", lambda x: x["text_span"]).alias("text_span"),
    )


def group_relations(relations: DataFrame) -> DataFrame:
    """(pmid, location, relations): sorted annotated relations of a section, by the object's location."""
    item = F.struct("subject_start_idx", "subject_uri", "predicate", "object_start_idx", "object_uri")
    return relations.groupBy("pmid", F.col("object_location").alias("location")).agg(
        F.sort_array(F.collect_list(item)).alias("relations")
    )


def _parts_of(rows: DataFrame, columns: list[str], name: str, part_items: int) -> DataFrame:
    """(pmid, part, sorted items). Copies of an item are counted first and repeated last, so they travel as one row.

    Distinct items are range-partitioned by article and order: an article spans as many tasks as its share of the rows
    asks, and what is added up across tasks is one count per task and article.
    """
    counted = rows.groupBy("pmid", *columns).agg(F.count(F.lit(1)).alias("_n"))
    dealt = stage(counted.repartitionByRange("pmid", *columns).withColumn("_task", F.spark_partition_id()))
    earlier = Window.partitionBy("pmid").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("pmid", "_task").agg(F.sum("_n").alias("_sum"))
    base = base.select("pmid", "_task", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("pmid", "_task").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    first = F.col("_base") + F.col("_at")
    last = first + F.col("_n") - 1
    reached = F.sequence(F.floor(first / part_items), F.floor(last / part_items))
    begin, end = F.col("part") * part_items, (F.col("part") + 1) * part_items
    copies = F.least(last + 1, end) - F.greatest(first, begin)
    item = F.struct(F.struct(*columns).alias("item"), copies.cast("int").alias("copies"))
    return (
        numbered.join(base, ["pmid", "_task"])
        .select("*", F.explode(reached).alias("part"))
        .groupBy("pmid", F.col("part").cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select("pmid", "part", F.flatten(F.transform("_items", lambda x: F.array_repeat(x["item"], x["copies"]))).alias(name))
    )


def nest_lists(articles: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], part_items: int = PART_ITEMS) -> DataFrame:
    """(pmid, part, one sorted array per list): every article once, with empty arrays where it has no rows.

    `lists` gives the rows and item columns of each array. An article's items are numbered in their order and cut every
    part_items: in order of `part` (0, 1, ..) its rows hold the whole list as sorted, copies included. No task sees
    more of an article than a range of its items or one part. Articles whose lists all fit a part, most of them, are
    gathered at once; only the others' items are numbered. Rows are staged, as they are counted first. Runs a job per list.
    """
    lists = {name: (stage(rows.filter("pmid is not null").select("pmid", *columns)), columns) for name, (rows, columns) in lists.items()}
    counts = [rows.groupBy("pmid").agg(F.count(F.lit(1)).alias("n")) for rows, _ in lists.values()]
    large = stage(reduce(DataFrame.union, counts).filter(F.col("n") > part_items).select("pmid").distinct())
    nested = _nest_small(articles, lists, large)
    if large.isEmpty():
        return nested
    articles = articles.join(large, "pmid", "left_semi")
    lists = {name: (rows.join(large, "pmid", "left_semi"), columns) for name, (rows, columns) in lists.items()}
    return nested.unionByName(_nest_large(articles, lists, part_items))


def _nest_small(articles: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], large: DataFrame) -> DataFrame:
    """nest_lists of the articles that are not in `large`: every item travels once."""
    items = {name: F.struct(*columns) for name, (_, columns) in lists.items()}
    kinds = {name: rows.select(items[name].alias(name)).schema[name].dataType for name, (rows, _) in lists.items()}

    def tagged(rows: DataFrame, own: str | None) -> DataFrame:
        return rows.select("pmid", *[(items[c] if c == own else F.lit(None).cast(kinds[c])).alias(c) for c in lists])

    both = reduce(DataFrame.union, [tagged(articles, None), *[tagged(rows, name) for name, (rows, _) in lists.items()]])
    # A list of items that are not there is empty.
    gathered = both.join(large, "pmid", "left_anti").groupBy("pmid").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in lists])
    return gathered.select("pmid", F.lit(0).alias("part"), *lists)


def _nest_large(articles: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], part_items: int) -> DataFrame:
    nested = [_parts_of(rows, columns, name, part_items) for name, (rows, columns) in lists.items()]
    parts = reduce(DataFrame.union, [n.select("pmid", "part") for n in nested])
    parts = parts.union(articles.select("pmid", F.lit(0).alias("part"))).distinct()
    for (name, _), rows in zip(lists.items(), nested):
        empty = F.array().cast(rows.schema[name].dataType)
        parts = parts.join(rows, ["pmid", "part"], "left").withColumn(name, F.coalesce(name, empty))
    return parts


def entity_submission(articles: DataFrame, entities: DataFrame, with_uri: bool = True) -> DataFrame:
    """(pmid, part, entities): titles first, then abstracts, each by offset."""
    columns = ["start_idx", "end_idx", "location", "text_span", "label"] + (["uri"] if with_uri else [])
    ordered = entities.withColumn("_order", (F.col("location") != "title").cast("int"))
    nested = nest_lists(articles, {"entities": (ordered, ["_order", *columns])})
    return nested.withColumn(
        "entities", F.transform("entities", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    )


def concept_submission(articles: DataFrame, relations: DataFrame) -> DataFrame:
    return nest_lists(articles, {"concept_level_relations": (relations, CONCEPT_RELATION_KEY)})


def relation_submission(articles: DataFrame, mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    return nest_lists(articles, {
        "mention_level_relations": (mentions, MENTION_RELATION_KEY),
        "concept_level_relations": (concepts, CONCEPT_RELATION_KEY),
    })
