"""Expressions over concept URIs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

OBO = "http://purl.obolibrary.org/obo/"
MESH_YEAR = "http://id.nlm.nih.gov/mesh/2026/"
EBI_DOMAIN = "www.ebi.ac.uk"
OBO_DOMAIN = "purl.obolibrary.org"
EDAM_DOMAIN = "edamontology.org"


def uri_domain(uri: Column) -> Column:
    """Authority of the URI, '' when it has none."""
    return F.regexp_extract(uri, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def rewrite_uri(uri: Column) -> Column:
    """EBI URIs become OBO ones; they stay grouped under the domain they came with."""
    return F.when(uri_domain(uri) == EBI_DOMAIN, F.concat(F.lit(OBO), last_segment(uri))).otherwise(uri)


def ontology_prefix(uri: Column) -> Column:
    """Ontology of a listed URI, null outside the domains that hold ontologies."""
    domain = uri_domain(uri)
    return (
        F.when(domain == OBO_DOMAIN, F.regexp_extract(last_segment(uri), r"\A([^_]*)", 1))
        .when(domain == EBI_DOMAIN, "efo")
        .when(domain == EDAM_DOMAIN, "edam")
    )


def mesh_iri(uri: Column) -> Column:
    """Year-versioned IRI of a MeSH URI, by its last path segment."""
    return F.concat(F.lit(MESH_YEAR), last_segment(F.regexp_replace(uri, r"/+\z", "")))


def as_https(uri: Column) -> Column:
    return F.regexp_replace(uri, r"\Ahttp:", "https:")
