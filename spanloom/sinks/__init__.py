"""Writing results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.profile import triple_frequency
from spanloom.sources.concepts import OWL_TAGS

# The namespaces of ontology files.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "owl": "http://www.w3.org/2002/07/owl#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "obo": "http://purl.obolibrary.org/obo/",
    "oboInOwl": "http://www.geneontology.org/formats/oboInOwl#",
}


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Training records, vocabularies and arrays are kept as parquet, nested columns included."""
    df.write.mode(mode).parquet(path)


def submission_lines(nested: DataFrame) -> DataFrame:
    """(value): one JSON object {pmid: {list: [...]}} per row; the parts of a long article are rows of their own."""
    lists = F.struct(*[c for c in nested.columns if c not in ("pmid", "part")])
    return nested.select(F.to_json(F.create_map("pmid", lists)).alias("value"))


def write_submission(nested: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines as read back by read_corpus(lines=True)."""
    submission_lines(nested).write.mode(mode).text(path)


def frequency_table(relations: DataFrame) -> DataFrame:
    # The column names of the file.
    return triple_frequency(relations).toDF(
        "subjectConceptURI", "subjectCategory", "relationPredicate", "objectConceptURI", "objectCategory", "frequency"
    )


def write_frequencies(relations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Semicolon-separated files, most frequent triples first across the files in name order."""
    frequency_table(relations).write.mode(mode).csv(path, sep=";", header=True)


def write_owl(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """RDF/XML files as read back by read_owl, an owl:Class element per triple (s, p, o) of OWL_TAGS.

    Names with a prefix are no XML names to Spark's check of names, which is therefore off.
    """
    objects = [F.when(F.col("p") == p, F.col("o")).alias(tag) for tag, p in OWL_TAGS.items()]
    names = " ".join(f'xmlns:{prefix}="{uri}"' for prefix, uri in NAMESPACES.items())
    options = {"rowTag": "owl:Class", "rootTag": f"rdf:RDF {names}", "validateName": False}
    triples.select(F.col("s").alias("_rdf:about"), *objects).write.mode(mode).format("xml").options(**options).save(path)
