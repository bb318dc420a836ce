"""Controlled vocabularies of the annotation task (fixed values, transcribed as data)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The entity labels, alphabetical ignoring case.
ENTITY_LABELS = [
    "anatomical location",
    "animal",
    "bacteria",
    "biomedical technique",
    "chemical",
    "DDF",
    "dietary supplement",
    "drug",
    "food",
    "gene",
    "human",
    "microbiome",
    "statistical technique",
]

# The relation predicates. Class 0 of a classifier is NO_RELATION, class i is PREDICATES[i - 1].
PREDICATES = [
    "located in",
    "interact",
    "influence",
    "change expression",
    "part of",
    "impact",
    "produced by",
    "administered",
    "strike",
    "change abundance",
    "affect",
    "is a",
    "target",
    "change effect",
    "used by",
    "is linked to",
    "compared to",
]
NO_RELATION = "no_relation"
CLASSES = [NO_RELATION, *PREDICATES]

# Annotation quality tiers, best first.
TIERS = ["gold", "silver_a", "silver_b", "bronze"]

# Which objects a predicate may have, per subject label.
# One line per subject and predicate: subject | predicate | objects.
RELATION_SCHEMA = """
anatomical location | located in | human, animal
bacteria | interact | bacteria, chemical, drug
bacteria | influence | DDF
bacteria | change expression | gene
bacteria | located in | human, animal
bacteria | part of | microbiome
chemical | located in | anatomical location, human, animal
chemical | interact | chemical
chemical | part of | chemical
chemical | impact | bacteria, microbiome
chemical | produced by | microbiome
chemical | influence | DDF
chemical | change expression | gene
chemical | administered | human, animal
DDF | strike | anatomical location
DDF | change abundance | bacteria, microbiome
DDF | interact | chemical
DDF | is a | DDF
DDF | affect | DDF
DDF | target | human, animal
dietary supplement | impact | bacteria, microbiome
dietary supplement | influence | DDF
dietary supplement | change expression | gene
dietary supplement | administered | human, animal
drug | impact | bacteria, microbiome
drug | change expression | gene
drug | administered | human, animal
drug | interact | chemical, drug
drug | change effect | DDF
food | impact | bacteria, microbiome
food | influence | DDF
food | change expression | gene
food | administered | human, animal
human | used by | biomedical technique
animal | used by | biomedical technique
microbiome | used by | biomedical technique
microbiome | located in | anatomical location, human, animal
microbiome | change expression | gene
microbiome | is linked to | DDF
microbiome | compared to | microbiome
"""

# Schema triples that are valid but are not the default predicate of their label pair.
NON_DEFAULT = {
    ("DDF", "is a", "DDF"),
    ("chemical", "part of", "chemical"),
    ("chemical", "produced by", "microbiome"),
    ("chemical", "administered", "human"),
    ("chemical", "administered", "animal"),
}


def schema_triples() -> list[tuple[str, str, str, bool]]:
    """(subject label, predicate, object label, is the default for the label pair)."""
    triples = []
    for line in RELATION_SCHEMA.strip().splitlines():
        subject, predicate, objects = (part.strip() for part in line.split("|"))
        for obj in objects.split(","):
            key = (subject, predicate, obj.strip())
            triples.append((*key, key not in NON_DEFAULT))
    return triples


def relation_schema(spark: SparkSession) -> DataFrame:
    """The schema as a table of 59 rows: small by construction, so safe to broadcast."""
    return spark.createDataFrame(
        schema_triples(), "subject_label string, predicate string, object_label string, is_default boolean"
    )


def is_entity_label(label: Column) -> Column:
    return label.isin(ENTITY_LABELS)
