"""Building the concept vocabulary. Synonyms and definitions stay long tables, one row per surface:
a concept with very many synonyms is many rows, never one list."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import normalise_surface
from spanloom.functions.uris import as_https, mesh_iri, ontology_prefix, rewrite_uri, uri_domain

# RDF predicates and which of them holds an ontology's synonyms.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DEFINITION = "http://purl.obolibrary.org/obo/IAO_0000115"
MESH_NOTE = "http://id.nlm.nih.gov/mesh/vocab#note"
EXACT_SYNONYM = "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"
SYNONYM_PREDICATES = {
    "foodon": "http://www.geneontology.org/formats/oboInOwl#hasSynonym",
    "stato": "http://purl.obolibrary.org/obo/IAO_0000118",
}


def classify_uris(uris: DataFrame) -> DataFrame:
    """Listed URIs with their domain, ontology and rewritten form: (listed, domain, ontology, uri)."""
    listed = F.col("uri")
    return uris.select(
        listed.alias("listed"),
        uri_domain(listed).alias("domain"),
        ontology_prefix(listed).alias("ontology"),
        rewrite_uri(listed).alias("uri"),
    )


def _objects(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias("uri"), F.col("o").alias(name))


def query_definitions(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, definition) of listed URIs that have a label too; the smallest of several definitions."""
    return (
        _objects(triples, DEFINITION, "definition")
        .groupBy("uri")
        .agg(F.min("definition").alias("definition"))
        .join(_objects(triples, LABEL, "label"), "uri", "left_semi")
        .join(uris, "uri", "left_semi")
    )


def query_synonyms(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, pos, surface) of listed URIs that have a label: pos 0 is the label, pos 1 any synonym.

    `triples` has an `ontology` column, which decides the synonym predicate.
    """
    expected = reduce(
        lambda chain, item: chain.when(F.lower("ontology") == item[0], item[1]),
        SYNONYM_PREDICATES.items(),
        F.when(F.lit(False), ""),
    ).otherwise(EXACT_SYNONYM)
    labels = _objects(triples, LABEL, "surface").groupBy("uri").agg(F.min("surface").alias("surface"))
    labels = labels.join(uris, "uri", "left_semi")
    synonyms = (
        triples.filter(F.col("p") == expected)
        .select(F.col("s").alias("uri"), F.col("o").alias("surface"))
        .distinct()
        .join(labels.select("uri"), "uri", "left_semi")
    )
    return labels.select("uri", F.lit(0).alias("pos"), "surface").unionByName(
        synonyms.select("uri", F.lit(1).alias("pos"), "surface")
    )


def query_mesh(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, label, definition) of listed MeSH URIs; the note is optional and null when absent."""
    listed = uris.select(mesh_iri(F.col("uri")).alias("uri"))
    notes = _objects(triples, MESH_NOTE, "definition").groupBy("uri").agg(F.min("definition").alias("definition"))
    labels = _objects(triples, LABEL, "label").groupBy("uri").agg(F.min("label").alias("label"))
    return labels.join(listed, "uri", "left_semi").join(notes, "uri", "left")


def curated_listed(curated: DataFrame, uris: DataFrame) -> DataFrame:
    """Curated concepts whose URI is listed, compared as https on both sides. Null URIs never match."""
    listed = uris.select(as_https(F.col("uri")).alias("_https"))
    return (
        curated.withColumn("_https", as_https(F.col("uri")))
        .join(listed, "_https", "left_semi")
        .drop("_https")
    )


def upsert(current: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(uri, column) with a non-null new value replacing the current one."""
    fresh = new.filter(F.col(column).isNotNull()).groupBy("uri").agg(F.max(column).alias("_new"))
    return (
        current.join(fresh, "uri", "full_outer")
        .withColumn(column, F.coalesce("_new", column))
        .select("uri", column)
    )


def replace_synonyms(current: DataFrame, new: DataFrame) -> DataFrame:
    """Long synonym table in which a URI with new rows loses all its old ones."""
    return current.join(new, "uri", "left_anti").unionByName(new)


def surface_index(kb: DataFrame) -> DataFrame:
    """(key, uri, ord, pos, len): normalised surface to the first concept that has it.

    `kb` is (uri, ord, pos, surface), `ord` the place of the concept. Surfaces empty after normalising are dropped.
    """
    first = F.struct("ord", "pos", "uri")
    return (
        kb.withColumn("key", normalise_surface(F.col("surface")))
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.min(first).alias("first"))
        .select("key", "first.uri", "first.ord", "first.pos", F.length("key").alias("len"))
    )


def alias_pairs(kb: DataFrame) -> DataFrame:
    """Unordered pairs of distinct surfaces of one concept. A concept of many surfaces is cut in tiles."""
    from spanloom.operators.skew import tile_join

    aliases = kb.select("uri", "surface").distinct()
    return (
        tile_join(
            aliases.withColumnRenamed("surface", "alias_a"), aliases.withColumnRenamed("surface", "alias_b"), ["uri"]
        )
        .filter(F.col("alias_a") < F.col("alias_b"))
        .select("uri", "alias_a", "alias_b")
    )


def alias_definition_pairs(kb: DataFrame, definitions: DataFrame) -> DataFrame:
    """(uri, mention, context, label): every surface with its concept's definition, '' when there is none."""
    return kb.select("uri", F.col("surface").alias("mention")).join(definitions, "uri", "left").select(
        "uri", "mention", F.coalesce("definition", F.lit("")).alias("context"), F.lit(1.0).alias("label")
    )
