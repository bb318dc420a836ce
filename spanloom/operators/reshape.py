"""Projection, reshaping and filtering of annotated articles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.schemas import CONCEPT_RELATION_KEY, SECTION
from spanloom.vocab import is_entity_label


def flatten_metadata(articles: DataFrame) -> DataFrame:
    """Nested metadata to columns, without author, journal and year. Nested lists stay beside them."""
    return articles.select("pmid", "metadata.title", "metadata.abstract", "metadata.annotator", "entities", "relations")


def annotator_tier(annotator: Column) -> Column:
    """Quality tier of an annotator name."""
    return (
        F.when(annotator.startswith("expert"), "gold")
        .when(annotator.endswith("A"), "silver_a")
        .when(annotator.endswith("B"), "silver_b")
        .when(annotator == "distant", "bronze")
        .otherwise(annotator)
    )


def with_tier(articles: DataFrame) -> DataFrame:
    return articles.withColumn("annotator", annotator_tier(F.col("annotator")))


def expand_nested(articles: DataFrame, column: str, keep_empty: bool = False, end_inclusive: bool = False) -> DataFrame:
    """One row per list element with pmid and `pos`, its place in the list; (pmid, pos) identifies it.

    end_inclusive shifts end offsets of corpora that count the last character in.
    """
    if column not in articles.columns:
        raise ValueError(f"no column {column}")
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = articles.select("pmid", explode(column).alias("pos", "item")).select("pmid", "pos", "item.*")
    if end_inclusive:
        rows = rows.withColumns({c: F.col(c) + 1 for c in rows.columns if c.endswith("end_idx")})
    return rows


def unpivot_sections(articles: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Title and abstract as rows (pmid, location, text). Missing or empty ones are left out."""
    return (
        articles.unpivot(["pmid", *(keep or [])], ["title", "abstract"], "location", "text")
        .filter(F.coalesce("text", F.lit("")) != "")
    )


def article_text(articles: DataFrame) -> DataFrame:
    """Title and abstract from metadata where there is any, else from top level."""
    return articles.withColumns({c: F.coalesce(f"metadata.{c}", c) for c in ("title", "abstract")})


def with_relations(articles: DataFrame) -> DataFrame:
    return articles.filter(F.size("relations") > 0)


def same_section(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("subject_location") == F.col("object_location"))


def allowed_entities(entities: DataFrame) -> DataFrame:
    return entities.filter(is_entity_label(F.col("label")))


def complete_relations(relations: DataFrame) -> DataFrame:
    """Relations whose URIs, labels and predicate are all present and whose labels are entity labels."""
    present = [F.coalesce(F.col(c), F.lit("")) != "" for c in CONCEPT_RELATION_KEY]
    for condition in [*present, is_entity_label(F.col("subject_label")), is_entity_label(F.col("object_label"))]:
        relations = relations.filter(condition)
    return relations


def pairable_sections(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """Sections with text and two allowed entities or more, with their number."""
    counts = (
        allowed_entities(entities)
        .filter(F.col("location").isin("title", "abstract"))
        .groupBy(*SECTION)
        .agg(F.count(F.lit(1)).alias("n_entities"))
        .filter(F.col("n_entities") >= 2)
    )
    return sections.filter(F.col("text") != "").join(counts, SECTION)


def ner_flat(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """One training row per entity: the text of its section and the labelled span."""
    return entities.select(*SECTION, "start_idx", "end_idx", "label").join(sections.select(*SECTION, "text"), SECTION)


def ner_grouped(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """One training row per section with entities: its text and the sorted labelled spans.

    The list of a section is linear in the section's own text, which already is one cell. Locations other than
    title count as abstract.
    """
    spans = (
        entities.withColumn("location", F.when(F.col("location") == "title", "title").otherwise("abstract"))
        .groupBy(*SECTION)
        .agg(F.sort_array(F.collect_list(F.struct("start_idx", "end_idx", "label"))).alias("entities"))
    )
    return sections.select(*SECTION, "text").join(spans, SECTION)
