"""Declared schemas. Offsets are 0-based, half-open and counted in code points; pmid is a string."""

ENTITY = "start_idx int, end_idx int, location string, text_span string, label string, uri string"

_END = "{0}_start_idx int, {0}_end_idx int, {0}_location string, {0}_text_span string, {0}_label string, {0}_uri string"
RELATION = f"{_END.format('subject')}, predicate string, {_END.format('object')}"

METADATA = "title string, author string, journal string, year string, abstract string, annotator string"

MENTION_RELATION = (
    "subject_text_span string, subject_label string, predicate string, object_text_span string, object_label string"
)
CONCEPT_RELATION = (
    "subject_uri string, subject_label string, predicate string, object_uri string, object_label string"
)

# One article. Test articles have title and abstract at top level and no metadata.
# Prediction files carry only some of the lists; absent ones read as null.
ARTICLE = (
    f"metadata struct<{METADATA}>, title string, abstract string,"
    f" entities array<struct<{ENTITY}>>, relations array<struct<{RELATION}>>,"
    f" mention_level_relations array<struct<{MENTION_RELATION}>>,"
    f" concept_level_relations array<struct<{CONCEPT_RELATION}>>"
)
CORPUS_FILE = f"map<string, struct<{ARTICLE}>>"

ARTICLES_CSV = "pmid string, title string, abstract string"

GENE_RECORD = "description string, synonyms array<string>, symbol string"
SNOMED_CONCEPT = "fsn struct<term: string>"
# Attributes of an XML child make it a struct, so each child is declared with its text value.
_TEXT = "array<struct<_VALUE: string>>"
OWL_CLASS = f"`_rdf:about` string, `rdfs:label` {_TEXT}, `obo:IAO_0000115` {_TEXT}, `obo:IAO_0000118` {_TEXT}, `oboInOwl:hasExactSynonym` {_TEXT}, `oboInOwl:hasSynonym` {_TEXT}"

CONCEPT_RELATION_KEY = ["subject_uri", "subject_label", "predicate", "object_uri", "object_label"]
MENTION_RELATION_KEY = ["subject_text_span", "subject_label", "predicate", "object_text_span", "object_label"]
SECTION = ["pmid", "location"]
