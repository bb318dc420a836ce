"""Reading concept vocabularies into triples and concept tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.kb import DEFINITION, EXACT_SYNONYM, LABEL, SYNONYM_PREDICATES
from spanloom.schemas import GENE_RECORD, OWL_CLASS, SNOMED_CONCEPT

SKIPPED_ONTOLOGIES = ["omit"]
# Elements of an OWL class and the predicates they state.
OWL_TAGS = {
    "rdfs:label": LABEL,
    "obo:IAO_0000115": DEFINITION,
    "obo:IAO_0000118": SYNONYM_PREDICATES["stato"],
    "oboInOwl:hasExactSynonym": EXACT_SYNONYM,
    "oboInOwl:hasSynonym": SYNONYM_PREDICATES["foodon"],
}


def read_uri_list(spark: SparkSession, path: str) -> DataFrame:
    """(uri): one whole line each, below a header line."""
    lines = spark.read.csv(path, header=True, schema="uri string", sep="\u0001", quote="", escape="")
    return lines.select(F.rtrim("uri").alias("uri"))


def _file_stem() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", "")


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """(ontology, s, p, o) of the labels, definitions and synonyms of OWL classes; one RDF/XML file per ontology."""
    classes = (
        spark.read.format("xml").option("rowTag", "owl:Class").schema(OWL_CLASS).load(path)
        .withColumn("ontology", F.lower(_file_stem()))
        .filter(~F.col("ontology").isin(SKIPPED_ONTOLOGIES))
    )
    def objects(tag: str, predicate: str):
        values = F.coalesce(f"`{tag}`", F.array())
        return F.transform(values, lambda v: F.struct(F.lit(predicate).alias("p"), v["_VALUE"].alias("o")))

    values = F.flatten(F.array(*[objects(*item) for item in OWL_TAGS.items()]))
    return (
        classes.select("ontology", F.col("`_rdf:about`").alias("s"), F.explode(values).alias("x"))
        .select("ontology", "s", "x.p", "x.o")
        .filter(F.col("s").isNotNull() & F.col("o").isNotNull())
    )


# Subject (IRI or blank node), predicate, object (IRI, blank node or literal). A literal of any length is matched without
# going back, hence without recursion.
TRIPLE = r'\A\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"\S*)\s*\.'


def _unescaped(literal: F.Column) -> F.Column:
    """Escapes decoded: backslash with t, b, n, r, f, a quote or a backslash; u with four hex digits, which may make
    surrogate pairs; U with eight."""
    pieces = F.regexp_extract_all(literal, F.lit(r"(?s)(?:\\u[0-9A-Fa-f]{4})++|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def plain(piece: F.Column) -> F.Column:
        return (
            F.when(piece.rlike(r"\A\\u[0-9A-Fa-f]{4}"), F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
            .when(piece.rlike(r"\A\\U[0-9A-Fa-f]{8}"), F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32"))
            .when(piece.startswith("\\"), F.translate(F.substring(piece, 2, 1), "tbnrf", "\t\b\n\r\f"))
            .otherwise(piece)
        )

    return F.when(literal.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(literal)


def rejected_ntriples(lines: DataFrame) -> DataFrame:
    """Lines that are neither triples nor comments nor blank, which parse_ntriples leaves out."""
    return lines.filter(~F.col("value").rlike(TRIPLE) & ~F.col("value").rlike(r"\A\s*(?:#|\z)"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o) of N-Triples lines in column `value`. Literals lose quotes, language and type; comments drop out."""

    def group(i: int):
        return F.regexp_extract("value", TRIPLE, i)

    o = F.when(group(4) != "", group(4)).when(group(5) != "", group(5)).otherwise(_unescaped(group(6)))
    return lines.filter(F.col("value").rlike(TRIPLE)).select(
        F.concat(group(1), group(2)).alias("s"), group(3).alias("p"), o.alias("o")
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): whole small files, one record each, named by id."""
    return spark.read.text(path, wholetext=True).select(_file_stem().alias("id"), "value")


def parse_genes(records: DataFrame) -> DataFrame:
    """(id, definition, surface) of gene records: one row per synonym and one for the symbol."""
    gene = records.select("id", F.from_json("value", GENE_RECORD).alias("g"))
    names = F.array_append(F.coalesce("g.synonyms", F.array()), F.col("g.symbol"))
    return gene.select("id", F.col("g.description").alias("definition"), F.explode(names).alias("surface"))


def parse_mesh_texts(records: DataFrame) -> DataFrame:
    """(id, definition, surface): line 2 is the label, lines 3 and 4 the definition."""
    line = F.split("value", "\n")

    def at(i: int):
        return F.coalesce(F.get(line, F.lit(i)), F.lit(""))

    return records.select(
        "id", F.concat(at(2), F.lit("\n"), at(3)).alias("definition"), F.trim(at(1)).alias("surface")
    )


def parse_snomed(records: DataFrame) -> DataFrame:
    """(id, definition, surface) of SNOMED concepts: the full name, no definition."""
    term = F.from_json("value", SNOMED_CONCEPT)["fsn"]["term"]
    return records.select("id", F.lit("").alias("definition"), term.alias("surface"))


def concepts_of(uris: DataFrame, parsed: DataFrame) -> DataFrame:
    """(uri, definition, surface) of listed URIs with a record named by their last segment; others are skipped."""
    ids = uris.select("uri", F.substring_index("uri", "/", -1).alias("id"))
    return ids.join(parsed, "id").select("uri", "definition", "surface")


def _promote_header(raw: DataFrame) -> DataFrame:
    """Take the names from the first record, which repeats as a row, and drop that row."""
    names = [v if v is not None else c for c, v in raw.first().asDict().items()]
    is_header = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(n)) for c, n in zip(raw.columns, names)])
    return raw.filter(~is_header).toDF(*names)


def read_curated(spark: SparkSession, start: str, custom: str, added: str) -> DataFrame:
    """(uri, name, definition, source) of the three curated lists.

    In the custom and added lists the first record below the header line holds the real header.
    """
    def read(path: str) -> DataFrame:
        return spark.read.csv(path, header=True, multiLine=True, escape='"')

    tables = {
        "start": read(start),
        "custom": _promote_header(read(custom)).na.drop(subset=["uri"]),
        "added": _promote_header(read(added)),
    }
    parts = [
        df.drop("used in document(s)", "labels").withColumn("source", F.lit(name)) for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
