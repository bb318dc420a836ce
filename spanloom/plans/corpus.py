"""The end-to-end jobs, put together from the operators. Tables read by several branches are staged on the way."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import normalise_surface
from spanloom.functions.uris import EBI_DOMAIN, EDAM_DOMAIN, OBO_DOMAIN
from spanloom.models.classifier import apply_classifier, candidate_pairs
from spanloom.models.context import Scorer, count_in_context
from spanloom.models.tagger import learn_gazetteer, tag_gazetteer
from spanloom.operators import kb as K
from spanloom.operators.linking import link_mentions, link_trigrams
from spanloom.operators.nest import group_entities, group_relations
from spanloom.operators.relations import (
    annotated_relations,
    concept_relations,
    derive_relations,
    matrix_cells,
    mention_relations,
    resolve_fresh,
)
from spanloom.operators.reshape import (
    allowed_entities,
    expand_nested,
    flatten_metadata,
    same_section,
    unpivot_sections,
    with_relations,
    with_tier,
)
from spanloom.operators.sampling import bootstrap
from spanloom.operators.skew import lookup_join
from spanloom.operators.spans import clean_entities, resolve_overlaps, snap_entities
from spanloom.schemas import CONCEPT_RELATION_KEY, MENTION_RELATION_KEY, SECTION
from spanloom.sources.concepts import concepts_of
from spanloom.staging import stage
from spanloom.vocab import NO_RELATION


def assemble_records(sections: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Training records: sections with their entities and relations. Sections lacking either are dropped."""
    return sections.join(group_entities(entities), SECTION).join(group_relations(relations), SECTION)


def preprocess(
    articles: DataFrame, fractions: dict[str, float] | None = None, seed: int = 1337, end_inclusive: bool = False
) -> DataFrame:
    """Annotated articles to training records; with `fractions` per tier, bootstrapped by tier."""
    flat = with_tier(flatten_metadata(articles))
    entities = expand_nested(flat, "entities", end_inclusive=end_inclusive)
    relations = same_section(expand_nested(with_relations(flat), "relations", end_inclusive=end_inclusive))
    sections = unpivot_sections(flat, keep=["annotator"])
    cleaned = clean_entities(entities, sections)
    fresh = resolve_fresh(relations, entities, cleaned)
    records = assemble_records(sections, cleaned, fresh)
    return bootstrap(records, "annotator", SECTION, fractions, seed) if fractions else records


def predict_concept_relations(sections: DataFrame, tagged: DataFrame, kb: DataFrame) -> DataFrame:
    """Distinct concept relations of each article implied by tagged entities linked to the vocabulary."""
    texts = sections.select(*SECTION)
    linked = link_mentions(allowed_entities(tagged).join(texts, SECTION, "left_semi"), K.surface_index(kb))
    return derive_relations(stage(linked))


def concept_relation_job(mode: str, **inputs: DataFrame) -> DataFrame:
    """mode "predictions" takes sections, tagged and kb; mode "annotations" takes relations."""
    if mode == "predictions":
        return predict_concept_relations(**inputs)
    if mode == "annotations":
        return annotated_relations(**inputs)
    raise ValueError(f"mode must be predictions or annotations, not {mode}")


def build_kb(
    uris: DataFrame, ontology_triples: DataFrame, mesh_triples: DataFrame, genes: DataFrame, mesh_texts: DataFrame,
    snomed: DataFrame, curated: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Synonyms (uri, pos, surface) and definitions (uri, definition) of the listed URIs.

    Ontologies come first; MeSH, gene, text and SNOMED records replace what they also hold, curated names and
    definitions of two domains replace either.
    """
    listed = K.classify_uris(uris)

    def of(*domains: str) -> DataFrame:
        return listed.filter(F.col("domain").isin(*domains)).select("uri").distinct()

    ontologies = of(OBO_DOMAIN, EBI_DOMAIN, EDAM_DOMAIN)
    synonyms = K.query_synonyms(ontology_triples, ontologies)
    definitions = K.query_definitions(ontology_triples, ontologies)

    mesh = K.query_mesh(mesh_triples, of("id.nlm.nih.gov"))
    ncbi = of("www.ncbi.nlm.nih.gov")
    records = concepts_of(ncbi.filter(F.col("uri").contains("gene")), genes).unionByName(
        concepts_of(ncbi.filter(F.col("uri").contains("mesh") & ~F.col("uri").contains("gene")), mesh_texts)
    ).unionByName(concepts_of(of("snomed.info"), snomed))
    new = mesh.select("uri", "definition", F.col("label").alias("surface")).unionByName(records)
    names = new.select("uri", F.lit(0).alias("pos"), "surface").distinct()
    synonyms = K.replace_synonyms(synonyms, names)
    definitions = K.upsert(definitions, new, "definition")

    chosen = K.curated_listed(curated, of("uts.nlm.nih.gov", "w3id.org"))
    named = chosen.filter(F.col("name").isNotNull()).groupBy("uri").agg(F.max("name").alias("surface"))
    synonyms = K.replace_synonyms(synonyms, named.select("uri", F.lit(0).alias("pos"), "surface"))
    return synonyms, K.upsert(definitions, chosen, "definition")


def predict_relations(entities: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """Mention and concept relations by a classifier trained with train_classifier.

    Pairs without a relation are never stored, nor columns that no relation reads.
    """
    classified = apply_classifier(model, candidate_pairs(entities)).filter(F.col("predicate") != NO_RELATION)
    classified = stage(classified.select("pmid", *dict.fromkeys([*MENTION_RELATION_KEY, *CONCEPT_RELATION_KEY])))
    return mention_relations(classified), concept_relations(classified)


def predict_relations_in_context(
    entities: DataFrame, sections: DataFrame, make_scorer: Callable[[], Scorer], counted: bool = False, **settings
) -> tuple[DataFrame, DataFrame]:
    """Mention and concept relations by any scorer of marked texts (settings as of count_in_context).

    Sections that can have pairs are taken, each pair is marked in its text and scored, and the relations of the
    classified pairs come out. They are added up by article before they are stored, once. With `counted`, equal mention
    relations are one row with their number `n`, else they are repeated.
    """
    groups = [["pmid", *MENTION_RELATION_KEY], ["pmid", *CONCEPT_RELATION_KEY]]
    mentions, concepts = count_in_context(entities, sections, make_scorer, groups, **settings)
    mentions = mentions.filter(F.col("predicate") != NO_RELATION)
    if not counted:
        mentions = mention_relations(mentions.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))))
    return mentions, concept_relations(concepts, distinct=True)


def ner_training_set(sections: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities on token boundaries without overlaps, and the filled cells of their relation matrix."""
    snapped = snap_entities(entities, sections)
    nodes = stage(resolve_overlaps(snapped.filter(F.col("start_idx").isNotNull())))
    return nodes, matrix_cells(relations, snapped, nodes)


def annotate_and_link(sections: DataFrame, train_entities: DataFrame, kb: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame] = link_trigrams) -> DataFrame:
    """Tag sections with a gazetteer of the training entities and link each mention to the nearest concept by `link`.

    A concept is represented by its first surface. Each distinct mention text is linked once.
    """
    tagged = stage(tag_gazetteer(sections, learn_gazetteer(train_entities)))
    keyed = tagged.withColumn("key", normalise_surface(F.col("text_span")))
    canonical = kb.groupBy("uri").agg(F.min_by("surface", F.struct("pos", "surface")).alias("surface"))
    concepts = canonical.select("uri", normalise_surface(F.col("surface")).alias("key"))
    linked = link(keyed.select("key").distinct(), concepts)
    return lookup_join(keyed, linked, ["key"], "left").drop("key")
