"""One query per operator, each over whole tables. Nested results are written as text so that they compare as values."""

from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views
from spanloom.functions import text as X
from spanloom.functions import uris as U
from spanloom.functions.uris import OBO
from spanloom.models import classifier as C
from spanloom.models.context import classify_in_context
from spanloom.models.tagger import learn_gazetteer, tag_gazetteer
from spanloom.operators import evaluate as G
from spanloom.operators import kb as K
from spanloom.operators import linking as L
from spanloom.operators import nest as N
from spanloom.operators import profile as P
from spanloom.operators import relations as R
from spanloom.operators import reshape as S
from spanloom.operators import sampling as H
from spanloom.operators import spans as E
from spanloom.plans import corpus as J
from spanloom.schemas import SECTION
from spanloom.sinks import submission_lines, write_frequencies, write_owl, write_table
from spanloom.sources import concepts as SC
from spanloom.sources import corpus as SD
from spanloom.staging import compute_once, stage, staging_folder
from spanloom.vocab import NO_RELATION

SEED = 1337
FRACTIONS = {"gold": 1.5, "silver_a": 1.0, "silver_b": 0.75, "bronze": 0.25}

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def flat(items: str | Column, fields: list[str]) -> Column:
    """An array of structs as text."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";")


def big(*columns: str) -> dict[str, Column]:
    return {c: F.col(c).cast("bigint") for c in columns}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


ENTITY_FIELDS = ["start_idx", "end_idx", "label", "uri"]
RELATION_FIELDS = ["subject_start_idx", "subject_uri", "predicate", "object_start_idx", "object_uri"]
CONCEPT_FIELDS = ["subject_uri", "subject_label", "predicate", "object_uri", "object_label"]
MENTION_FIELDS = ["subject_text_span", "subject_label", "predicate", "object_text_span", "object_label"]


# Sources. The texts parsed are written from the tables by Spark.


@query
def src_annotated_json(v):
    files = v.annotated.select(
        F.to_json(F.create_map("pmid", F.struct("metadata", "entities", "relations"))).alias("value")
    )
    ents = S.expand_nested(SD.parse_corpus(files), "entities")
    return ents.select("pmid", "pos", "location", "start_idx", "end_idx", "text_span", "label", "uri")


@query
def src_tier_override(v):
    tiered = S.with_tier(v.articles).select("pmid", F.col("annotator").alias("tier"), "title")
    copies = tiered.withColumn("title", F.concat(F.lit("copy "), "title")).withColumn(
        "tier", F.when(F.col("tier") == "gold", "bronze").otherwise("gold")
    )
    return SD.override_tiers(tiered.unionByName(copies), ["gold", "silver_a", "silver_b", "bronze"])


@query
def src_articles_csv(v):
    options = {"sep": "|", "quote": '"', "escape": '"'}
    lines = v.articles.select(F.to_csv(F.struct("pmid", "title", "abstract"), options).alias("value"))
    return SD.parse_article_lines(lines).select(
        "pmid", F.coalesce("title", F.lit("")).alias("title"), F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5")
    )


def _file(v, df: DataFrame, kind: str, **options) -> str:
    """A folder of files of df in the shared folder, to be read back."""
    path = f"{staging_folder(v.spark)}/spanloom-{uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query
def src_articles_file(v):
    """The articles written as pipe-separated files and read back."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    path = _file(v, v.articles.select("pmid", "title", "annotator", "abstract"), "csv", sep="|", header=True, quote='"', escape='"', **kept)
    return SD.read_articles_csv(v.spark, path).select(
        "pmid", F.coalesce("title", F.lit("")).alias("title"), F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5")
    )


@query
def kb_uri_list(v):
    """Lists with a header line each, lines ending in spaces."""
    padded = v.listed.select(F.concat("uri", F.lit("  ")).alias("uri"))
    return SC.read_uri_list(v.spark, _file(v, padded, "csv", header=True, quote="", sep="\u0001", ignoreTrailingWhiteSpace=False))


@query
def kb_owl_triples(v):
    """Triples written as classes of RDF/XML files and read back; one element may hold one triple of its class."""
    path = f"{staging_folder(v.spark)}/spanloom-{uuid4().hex}"
    write_owl(v.triples, path)
    return SC.read_owl(v.spark, path).select("s", "p", "o")


@query
def save_table(v):
    """Mentions as a table written and read back."""
    path = f"{staging_folder(v.spark)}/spanloom-{uuid4().hex}"
    write_table(v.entities, path)
    return v.spark.read.parquet(path).select(*SECTION, "pos", "start_idx", "end_idx", "text_span", "label", "uri")


@query
def frequency_file(v):
    """Triple frequencies written as semicolon-separated files and read back."""
    path = f"{staging_folder(v.spark)}/spanloom-{uuid4().hex}"
    write_frequencies(v.relations, path)
    columns = ["subject_uri", "subject_label", "predicate", "object_uri", "object_label"]
    read = v.spark.read.csv(path, sep=";", header=True, schema=", ".join(f"{c} string" for c in columns) + ", n bigint", enforceSchema=True)
    return read


@query
def src_first_n_docs(v):
    return SD.first_documents(v.articles.select("pmid", "title"), 100)


@query
def kb_ntriples(v):
    quoted = F.concat(F.lit('"'), F.replace(F.col("o"), F.lit('"'), F.lit('\\"')), F.lit('"@en'))
    lines = v.triples.select(F.format_string("<%s> <%s> %s .", "s", "p", quoted).alias("value"))
    return SC.parse_ntriples(lines)


def _gene_records(v):
    grouped = v.kb.groupBy("uri").agg(F.min("surface").alias("symbol"), F.max("surface").alias("other"))
    synonyms = F.when(F.col("symbol") != F.col("other"), F.array("other"))
    record = F.struct(F.concat(F.lit("gene "), "symbol").alias("description"), synonyms.alias("synonyms"), "symbol")
    return grouped.select(F.substring_index("uri", "/", -1).alias("id"), F.to_json(record).alias("value"))


@query
def kb_gene_json(v):
    return SC.parse_genes(_gene_records(v))


@query
def kb_mesh_text(v):
    record = F.concat_ws("\n", F.lit("record"), "title", "pmid", "annotator", F.lit("end"))
    return SC.parse_mesh_texts(v.articles.select(F.col("pmid").alias("id"), record.alias("value")))


@query
def kb_snomed_json(v):
    named = v.entities.groupBy("uri").agg(F.max("text_span").alias("term"))
    records = named.select(
        F.substring_index("uri", "/", -1).alias("id"),
        F.to_json(F.struct(F.struct("term").alias("fsn"))).alias("value"),
    )
    return SC.concepts_of(v.listed, SC.parse_snomed(records))


# Sinks, as the tables written.


@query
def sub_concept_json(v):
    nested = N.concept_submission(v.articles, R.annotated_relations(v.relations))
    return nested.select("pmid", "part", flat("concept_level_relations", CONCEPT_FIELDS).alias("relations"))


def _classified(v):
    guess = F.struct(G.argmax_class(F.col("scores")).alias("guess"))
    return stage(compute_once(v.scored_pairs, guess).withColumn("predicate", F.col("guess")).drop("guess", "scores"))


@query
def sub_re_json(v):
    pairs = _classified(v)
    nested = N.relation_submission(v.articles, R.mention_relations(pairs), R.concept_relations(pairs))
    return nested.select(
        "pmid", "part",
        flat("mention_level_relations", MENTION_FIELDS).alias("mentions"),
        flat("concept_level_relations", CONCEPT_FIELDS).alias("concepts"),
    )


@query
def sub_entities_json(v):
    nested = N.entity_submission(v.articles, v.entities)
    fields = ["start_idx", "end_idx", "location", "text_span", "label", "uri"]
    return nested.select("pmid", "part", flat("entities", fields).alias("entities"))


@query
def sub_entities_lines(v):
    """Written lines parsed again: the round trip of a submission without URIs."""
    lines = submission_lines(N.entity_submission(v.articles, v.entities, with_uri=False))
    return S.expand_nested(SD.parse_corpus(lines), "entities").select(
        "pmid", "location", "start_idx", "end_idx", "text_span", "label"
    )


# Projection, reshape, filter.


@query
def flatten_metadata(v):
    return S.flatten_metadata(v.annotated).select("pmid", "title", "abstract", "annotator")


@query
def annotator_tier(v):
    return S.with_tier(v.articles).groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))


@query
def explode_entities(v):
    return S.expand_nested(v.annotated, "entities", keep_empty=True).select(
        "pmid", "pos", "location", *ENTITY_FIELDS, "text_span"
    )


@query
def explode_drop_empty(v):
    return S.expand_nested(v.annotated, "relations").select(
        "subject_location", "subject_start_idx", "predicate", "object_location", "object_start_idx"
    )


@query
def unpivot_sections(v):
    return S.unpivot_sections(v.articles).withColumn("text", F.md5("text"))


@query
def docs_with_relations(v):
    return S.with_relations(v.annotated).select("pmid", F.size("relations").cast("bigint").alias("n_relations"))


@query
def same_section_relations(v):
    return S.same_section(v.all_relations).select("pmid", *RELATION_FIELDS)


@query
def allowed_label_filter(v):
    odd = v.entities.withColumn(
        "label", F.when(F.col("start_idx") % 5 == 0, "finding").otherwise(F.col("label"))
    )
    return S.allowed_entities(odd).select(*SECTION, "pos", "label")


@query
def complete_relations(v):
    return S.complete_relations(v.partial_relations).select("pmid", *RELATION_FIELDS)


@query
def pairable_sections(v):
    return S.pairable_sections(v.sections, v.entities).select(*SECTION, F.length("text").cast("bigint").alias("n_chars"), "n_entities")


@query
def kb_curated_semi(v):
    return K.curated_listed(v.curated, v.listed)


@query
def ner_training_grouped(v):
    grouped = S.ner_grouped(v.sections, v.entities)
    return grouped.select(*SECTION, F.md5("text").alias("text"), flat("entities", ["start_idx", "end_idx", "label"]).alias("entities"))


@query
def ner_training_flat(v):
    return S.ner_flat(v.sections, v.entities).withColumn("text", F.length("text").cast("bigint"))


# Text and span scalars.


@query
def mask_html(v):
    return v.table("pages").select("page_id", X.mask_html(F.col("html")).alias("masked"))


@query
def span_valid(v):
    spans = v.table("documents").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("span"))
    return spans.groupBy("doc_id", X.span_valid(F.col("span")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query
def span_repair(v):
    return E.clean_entities(v.noisy, v.sections).select(*SECTION, "pos", "start_idx", "end_idx", "text_span")


@query
def span_orient(v):
    turned = v.entities.withColumn("_t", F.col("pos") % 2 == 0)
    turned = turned.select(
        *SECTION, "pos",
        F.when(F.col("_t"), F.col("end_idx")).otherwise(F.col("start_idx")).alias("a"),
        F.when(F.col("_t"), F.col("start_idx")).otherwise(F.col("end_idx")).alias("b"),
    )
    return turned.select(*SECTION, "pos", X.orient_span(F.col("a"), F.col("b")).alias("s")).select(*SECTION, "pos", "s.*")


@query
def span_snap_tokens(v):
    return E.snap_entities(v.noisy, v.sections).select(*SECTION, "pos", "raw_start", "start_idx", "end_idx")


def _overlapping(v):
    """Mentions and, from every mention to the next, one span over both; all with copies."""
    both = v.relations.select(
        *SECTION, (F.col("pos") + 1_000_000).alias("pos"), F.col("subject_start_idx").alias("start_idx"),
        F.col("object_end_idx").alias("end_idx"), F.col("predicate").alias("label"),
    )
    single = v.entities.select(*SECTION, "pos", "start_idx", "end_idx", "label")
    return single.unionByName(both).unionByName(single.withColumn("pos", F.col("pos") + 2_000_000))


@query
def span_resolve_overlap(v):
    return E.resolve_overlaps(_overlapping(v))


@query
def insert_markers(v):
    """Markers in every section's text for each of its gold relations, checked by length and md5."""
    marked = C.mark_pairs(v.relations, v.sections)
    return marked.select(*SECTION, "subject_start_idx", "object_start_idx", F.md5("marked").alias("marked"))


@query
def normalise_surface(v):
    surfaces = v.articles.select("pmid", X.normalise_surface(F.concat(F.lit("\t "), "title", F.lit("\n"))).alias("surface"))
    return surfaces.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


@query
def normalise_surface_all(v):
    """Titles and mentions, each whole."""
    raw = v.articles.select("title").union(v.entities.select("text_span")).toDF("raw")
    surfaces = raw.select(X.normalise_surface(F.concat(F.lit("\t "), "raw", F.lit("\n"))).alias("surface"))
    return surfaces.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


@query
def kb_uri_domain(v):
    pages = v.table("pages").select(F.col("url").alias("uri"))
    return v.mixed_uris.union(pages).select("uri", U.uri_domain(F.col("uri")).alias("domain"))


@query
def kb_uri_rewrite(v):
    return K.classify_uris(v.mixed_uris).select("listed", "domain", "uri")


@query
def kb_ontology_prefix(v):
    return K.classify_uris(v.mixed_uris).select("listed", "ontology")


@query
def kb_mesh_rewrite(v):
    return v.mixed_uris.filter(F.col("uri").contains("/mesh/")).select("uri", U.mesh_iri(F.col("uri")).alias("iri"))


# Joins.


def _annotation_frames(v):
    ents = S.expand_nested(v.annotated, "entities")
    rels = S.same_section(S.expand_nested(v.annotated, "relations")).drop("pos")
    return ents, rels


@query
def resolve_endpoints(v):
    ents, rels = _annotation_frames(v)
    return R.resolve_endpoints(rels, ents).select("pmid", "subject_pos", "predicate", "object_pos")


@query
def refresh_offsets(v):
    noisy = v.noisy.filter("pos % 5 <> 0")
    rels = v.relations.select("pmid", "subject_location", "object_location", "predicate", F.col("pos").alias("subject_pos"), (F.col("pos") + 1).alias("object_pos"))
    cleaned = E.clean_entities(noisy, v.sections)
    return R.refresh_offsets(R.refresh_offsets(rels, cleaned, "subject"), cleaned, "object").select(
        "pmid", "subject_location", "subject_pos", "subject_start_idx", "subject_end_idx",
        "predicate", "object_pos", "object_start_idx", "object_end_idx",
    )


@query
def entity_text(v):
    return E.attach_slice(v.entities, v.sections).select(*SECTION, "pos", "slice")


@query
def training_records(v):
    records = J.assemble_records(v.sections, v.entities, v.relations)
    return records.select(
        *SECTION, F.md5("text").alias("text"), flat("entities", ENTITY_FIELDS).alias("entities"),
        F.array_join("text_span", ";").alias("text_span"), flat("relations", RELATION_FIELDS).alias("relations"),
    )


def _keys(v):
    """Distinct mention keys, also with an s put on and with other words round them."""
    key = F.col("text_span")
    forms = F.array(key, F.concat(key, F.lit("s")), F.concat(F.lit("the "), key, F.lit(" of it")))
    return v.entities.select(F.explode(forms).alias("key")).distinct()


@query
def link_exact(v):
    return L.link_exact(_keys(v), K.surface_index(v.kb))


@query
def link_plural(v):
    return L.link_plural(_keys(v), K.surface_index(v.kb))


@query
def link_substring(v):
    return L.link_substring(_keys(v), K.surface_index(v.kb))


@query
def link_dictionary(v):
    return L.link_mentions(v.entities, K.surface_index(v.kb)).select(*SECTION, "pos", "uri")


@query
def pairs_by_uri(v):
    return R.pair_counts(v.entities, ["uri"])


@query
def pairs_by_span(v):
    return R.pair_counts(v.noisy, ["start_idx", "end_idx"])


@query
def pair_predicate(v):
    return R.pair_predicates(v.relations.select("pmid", "pos", "subject_label", "object_label"))


@query
def schema_pairs(v):
    """How many ordered pairs of mentions of a section each label pair of the schema relates."""
    pairs = C.candidate_pairs(v.entities)
    return pairs.groupBy("subject_label", "object_label").agg(F.count(F.lit(1)).alias("n"))


@query
def relation_matrix(v):
    return R.matrix_shape(v.entities)


@query
def relation_schema_valid(v):
    return R.schema_valid(v.all_relations).select("pmid", "subject_label", "predicate", "object_label", "valid")


def _dev_train(v, df):
    return df.filter(v.is_dev()), df.filter(~v.is_dev())


@query
def unseen_spans(v):
    return P.unseen_values(*_dev_train(v, v.entities), "text_span")


@query
def unseen_predicates(v):
    """Predicates of dev relations that no train relation has, with strike and target renamed in dev."""
    dev, train = _dev_train(v, v.relations)
    dev = dev.withColumn(
        "predicate", F.when(F.col("predicate").isin("strike", "target"), F.concat("predicate", F.lit("s"))).otherwise(F.col("predicate"))
    )
    return P.unseen_values(dev, train, "predicate")


@query
def label_pairs(v):
    return R.positive_pairs(v.entities, v.relations)


@query
def kb_definitions(v):
    return K.query_definitions(v.triples, v.listed)


@query
def kb_synonyms(v):
    return K.query_synonyms(v.triples, v.listed)


@query
def kb_mesh_optional(v):
    return K.query_mesh(v.mesh_triples, v.mixed_uris)


@query
def kb_upsert(v):
    http = v.curated.withColumn("uri", F.regexp_replace("uri", "^https:", "http:"))
    return K.upsert(v.definitions, http, "definition")


@query
def link_cosine_top1(v):
    emb = v.table("embeddings").select("vec_id", "embedding")
    concept = F.col("vec_id") % 10 == 0
    mentions = emb.filter(~concept).select(F.col("vec_id").alias("mention_id"), F.col("embedding").alias("vector"))
    concepts = emb.filter(concept).select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector"))
    return L.link_cosine(mentions, concepts)


# Aggregation, distinct, top-k, sort.


@query
def group_entities(v):
    return N.group_entities(v.entities).select(
        *SECTION, flat("entities", ENTITY_FIELDS).alias("entities"), F.array_join("text_span", ";").alias("text_span")
    )


@query
def group_relations(v):
    return N.group_relations(v.relations).select(*SECTION, flat("relations", RELATION_FIELDS).alias("relations"))


@query
def kb_group_domain(v):
    return K.classify_uris(v.mixed_uris).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("first_uri"))


@query
def kb_group_ontology(v):
    listed = K.classify_uris(v.mixed_uris).filter(F.col("ontology").isNotNull())
    return listed.groupBy("ontology").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("first_uri"))


@query
def kb_surface_index(v):
    """Surfaces cut to eight letters, so that several concepts share them."""
    cut = v.kb.withColumn("surface", F.concat(F.lit(" "), F.upper(F.substring("surface", 1, 8))))
    return K.surface_index(cut).select("key", "uri", F.col("len").cast("bigint").alias("len"))


def _by_ending(surface):
    """A second concept of a whole surface, named after its last three letters."""
    return F.concat(F.lit(OBO), F.upper(F.substring(surface, -3, 3)), F.lit("_"), F.length(surface))


@query
def kb_surface_index_whole(v):
    """Whole surfaces, each of two concepts."""
    second = v.kb.withColumn("uri", _by_ending("surface")).withColumn("ord", F.col("uri"))
    both = v.kb.unionByName(second).withColumn("surface", F.concat(F.lit(" "), F.upper("surface")))
    return K.surface_index(both).select("key", "uri", F.col("len").cast("bigint").alias("len"))


@query
def concept_relations_pred(v):
    return R.derive_relations(v.entities)


@query
def concept_relations_gold(v):
    return R.annotated_relations(v.partial_relations)


@query
def triple_frequency(v):
    return P.triple_frequency(R.annotated_relations(v.relations))


@query
def entity_relation_counts(v):
    sizes = P.list_sizes(v.annotated)
    return sizes.withColumns(big("n_entities", "n_relations"))


@query
def top_patterns(v):
    return P.top_patterns(R.annotated_relations(v.relations))


@query
def relation_validity_counts(v):
    return R.schema_valid(v.all_relations).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query
def ambiguous_spans(v):
    """Spans cut to nine letters keep the concept of the whole word, so some have several."""
    cut = v.entities.withColumn("text_span", F.substring("text_span", 1, 9))
    return P.ambiguous_spans(cut)


@query
def ambiguous_spans_whole(v):
    """Whole spans; every other mention of a section has a second concept."""
    return P.ambiguous_spans(v.entities.withColumn("uri", F.when(F.col("pos") % 2 == 0, F.col("uri")).otherwise(_by_ending("text_span"))))


@query
def unseen_rate(v):
    dev, train = _dev_train(v, v.entities)
    rel_dev, rel_train = _dev_train(v, v.relations)
    return P.unseen_rate(dev, train, "text_span").unionByName(P.unseen_rate(rel_dev, rel_train, "predicate"))


def _examples(v):
    return H.relation_examples(v.entities, v.relations, SEED)


@query
def label_distribution(v):
    return P.label_distribution(_examples(v))


@query
def class_weights(v):
    return rounded(P.class_weights(_examples(v)))


@query
def distinct_locations(v):
    return v.entities.select("location").distinct()


@query
def re_mention_relations(v):
    return R.mention_relations(_classified(v))


@query
def re_concept_relations(v):
    return R.concept_relations(_classified(v))


def _matrix_relations(v):
    noisy = v.noisy
    sides = []
    for side in ("subject", "object"):
        sides.append(noisy.select(
            *SECTION, (F.col("pos") - (1 if side == "object" else 0)).alias("pos"),
            F.col("start_idx").alias(f"{side}_start_idx"), F.col("uri").alias(f"{side}_uri"),
        ))
    predicates = v.relations.select(*SECTION, "pos", "predicate")
    return predicates.join(sides[0], [*SECTION, "pos"]).join(sides[1], [*SECTION, "pos"])


def _matrix_inputs(v):
    snapped = E.snap_entities(v.noisy, v.sections)
    nodes = E.resolve_overlaps(snapped.filter(F.col("start_idx").isNotNull() & (F.col("pos") % 7 != 0)))
    return _matrix_relations(v), snapped, nodes


@query
def relation_matrix_filled(v):
    return R.matrix_cells(*_matrix_inputs(v))


@query
def relation_matrix_uri(v):
    return R.matrix_uri_cells(*_matrix_inputs(v))


# Evaluation.


@query
def score_per_class(v):
    return rounded(G.score_classes(v.entities, v.pred_entities, G.NER_KEY, "label"))


@query
def score_summary(v):
    return rounded(G.score_summary(G.score_classes(v.entities, v.pred_entities, G.NER_KEY, "label")))


@query
def score_ner(v):
    dev, pred = v.entities.filter(v.is_dev()), v.pred_entities.filter(v.is_dev())
    return rounded(G.score_summary(G.score_classes(dev, pred, G.NER_KEY, "label")))


@query
def score_linking(v):
    return rounded(G.score_classes(v.entities, v.pred_entities, G.LINKING_KEY, "label"))


@query
def score_mention_re(v):
    return rounded(G.score_classes(v.relations, v.pred_relations, G.MENTION_RE_KEY, "predicate"))


@query
def score_concept_re(v):
    return rounded(G.score_classes(v.relations, v.pred_relations, G.CONCEPT_RE_KEY, "predicate"))


@query
def score_classifier(v):
    pairs = v.scored_pairs.select(F.col("predicate").alias("label"), G.argmax_class(F.col("scores")).alias("prediction"))
    return rounded(G.score_classifier(pairs))


@query
def score_models(v):
    return rounded(G.score_tasks({
        "ner": (v.entities, v.pred_entities, G.NER_KEY, "label"),
        "linking": (v.entities, v.pred_entities, G.LINKING_KEY, "label"),
        "mention_re": (v.relations, v.pred_relations, G.MENTION_RE_KEY, "predicate"),
        "concept_re": (v.relations, v.pred_relations, G.CONCEPT_RE_KEY, "predicate"),
    }, v.models))


# Sampling and splitting.


@query
def bootstrap_tiers(v):
    rows = S.with_tier(v.sections).select(*SECTION, "annotator")
    return H.bootstrap(rows, "annotator", SECTION, FRACTIONS, SEED)


@query
def split_by_doc(v):
    return H.holdout_documents(v.sections, SEED)


@query
def split_rows(v):
    return H.split_rows(v.entities.select(*SECTION, "pos"), [*SECTION, "pos"], SEED)


@query
def negative_sampling(v):
    """Negatives per section beside its positives; titles are given none."""
    some = v.relations.filter("location = 'abstract'")
    examples = H.relation_examples(v.entities, some, SEED)
    negative = F.col("label") == NO_RELATION
    return examples.groupBy(*SECTION).agg(
        F.count_if(~negative).alias("n_positive"), F.count_if(negative).alias("n_negative"),
        F.min(F.when(negative, F.concat_ws("-", "s_pos", "o_pos"))).alias("first_negative"),
    )


@query
def re_examples(v):
    return _examples(v)


@query
def alias_pairs(v):
    return K.alias_pairs(v.kb)


@query
def alias_definition_pairs(v):
    return K.alias_definition_pairs(v.kb, v.definitions)


# Models and end-to-end jobs.


def _gazetteer(v):
    return learn_gazetteer(v.entities.filter(~v.is_dev()))


@query
def learn_gazetteer_labels(v):
    return _gazetteer(v)


@query
def tag_gazetteer_sections(v):
    return tag_gazetteer(v.sections, _gazetteer(v))


def _described(v):
    return C.describe_examples(_examples(v).filter(~v.is_dev()), v.entities)


def _trained(v):
    return C.train_classifier(_described(v))


@query
def train_pairs(v):
    """Classes, features and classes seen in training of the default classifier."""
    described = stage(_described(v).select(*C.FEATURE_INPUTS, "label"))
    model = C.train_classifier(described, staged=True).stages[-1]
    return described.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.lit(model.numClasses).alias("n_classes"), F.lit(model.numFeatures).alias("n_features")
    )


@query
def classify_pairs(v):
    pairs = C.candidate_pairs(v.entities)
    guessed = C.apply_classifier(_trained(v), pairs)
    return guessed.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query
def link_trigram_top1(v):
    keys = v.entities.select(X.normalise_surface(F.col("text_span")).alias("key")).distinct()
    concepts = v.kb.groupBy("uri").agg(F.min("surface").alias("key"))
    return L.link_trigrams_hashed(keys, concepts)


@query
def link_trigram_exact(v):
    """As link_trigram_top1, with each trigram a dimension of its own."""
    keys = v.entities.select(X.normalise_surface(F.col("text_span")).alias("key")).distinct()
    concepts = v.kb.groupBy("uri").agg(F.min("surface").alias("key"))
    return L.link_trigrams(keys, concepts)


@query
def annotate_and_link_exact(v):
    """As annotate_and_link, with each trigram a dimension of its own."""
    return _annotated_and_linked(v, L.link_trigrams)


@query
def annotate_and_link(v):
    return _annotated_and_linked(v, L.link_trigrams_hashed)


def _annotated_and_linked(v, link):
    linked = J.annotate_and_link(v.sections, v.entities.filter(~v.is_dev()), v.kb, link)
    nested = N.entity_submission(v.articles, linked)
    fields = ["start_idx", "end_idx", "location", "text_span", "label", "uri"]
    return nested.select("pmid", "part", flat("entities", fields).alias("entities"))


@query
def preprocess_corpus(v):
    records = J.preprocess(v.annotated)
    return records.select(
        *SECTION, "annotator", F.md5("text").alias("text"), flat("entities", ENTITY_FIELDS).alias("entities"),
        F.array_join("text_span", ";").alias("text_span"), flat("relations", RELATION_FIELDS).alias("relations"),
    )


@query
def concept_relation_report(v):
    """Frequency of the concept relations that tagged and linked articles imply."""
    tagged = v.entities.drop("uri")
    return P.triple_frequency(J.concept_relation_job("predictions", sections=v.sections, tagged=tagged, kb=v.kb))


def _kb_inputs(v):
    mesh_texts = SC.parse_mesh_texts(
        v.articles.select(F.col("pmid").alias("id"), F.concat_ws("\n", F.lit("x"), "title", "pmid", "annotator").alias("value"))
    )
    named = v.entities.groupBy("uri").agg(F.max("text_span").alias("term"))
    plain = F.replace(F.substring_index("uri", "/", -1), F.lit("_"), F.lit(""))
    genes = SC.parse_genes(named.select(
        plain.alias("id"),
        F.to_json(F.struct(F.lit("a gene").alias("description"), F.array(F.upper("term")).alias("synonyms"), F.col("term").alias("symbol"))).alias("value"),
    ))
    snomed = SC.parse_snomed(named.select(plain.alias("id"), F.to_json(F.struct(F.struct("term").alias("fsn"))).alias("value")))
    w3id = v.curated.withColumn("uri", F.replace("uri", F.lit("purl.obolibrary.org/obo"), F.lit("w3id.org")))
    uris = v.mixed_uris.unionByName(w3id.filter(F.col("name").isNotNull()).select("uri"))
    return uris, v.triples, v.mesh_triples, genes, mesh_texts, snomed, w3id


@query
def build_kb(v):
    synonyms, definitions = J.build_kb(*_kb_inputs(v))
    return synonyms.join(definitions, "uri", "left").select("uri", "pos", "surface", "definition")


@query
def predict_relations(v):
    mentions, concepts = J.predict_relations(v.entities, _trained(v))
    nested = N.relation_submission(v.articles, mentions, concepts)
    return nested.select("pmid", "part", F.size("mention_level_relations").alias("n_mentions"), F.size("concept_level_relations").alias("n_concepts"))


def _rule_scorer():
    """A scorer without training: the class follows from where the markers stand, the length and what is before [E2]."""

    def score(marked):
        out = np.zeros((len(marked), 18))
        for row, text in enumerate(marked):
            one, two = text.index("[E1]") + 1, text.index("[E2]") + 1
            before = ord(text[two - 2]) if two > 1 else 0
            out[row, (one + 3 * two + 7 * len(text) + before) % 18] = 1.0
        return out

    return score


@query
def classify_pairs_in_context(v):
    """Every ordered pair of entities of a section, marked in its text and scored, the unrelated ones included."""
    by, starts = [*SECTION, "subject_label", "object_label", "predicate"], ["subject_start_idx", "object_start_idx"]
    pairs = classify_in_context(v.entities, v.sections, _rule_scorer, window=100, related_only=False, by=by, totals=starts)
    return pairs.select(*by, "n", (F.col("sum_subject_start_idx") * 31 + F.col("sum_object_start_idx")).alias("starts"))


@query
def predict_relations_in_context(v):
    """Mention relations with their number, and concept relations (n null), of pairs classified in their text."""
    counted, concepts = J.predict_relations_in_context(v.entities, v.sections, _rule_scorer, window=100, counted=True)

    def rows(relations, kind, n):
        return relations.select(
            "pmid", F.col(f"subject_{kind}").alias("subject"), "subject_label", "predicate", F.col(f"object_{kind}").alias("object"),
            "object_label", n.alias("n"),
        )

    return rows(counted, "text_span", F.col("n")).unionByName(rows(concepts, "uri", F.lit(None).cast("long")))


@query
def ner_training_set(v):
    nodes, cells = J.ner_training_set(v.sections, v.noisy, _matrix_relations(v))
    n_cells = cells.groupBy(*SECTION).agg(F.count(F.lit(1)).alias("n_filled"))
    return R.matrix_shape(nodes).join(n_cells, SECTION, "left").na.fill(0, ["n_filled"])


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, fn=fn: fn(Views(spark, sf_dir)) for name, fn in QUERIES.items()}
