"""Annotated corpora derived by rule from the given tables, over all rows and whole texts.

checks/oracle.py states the same rules in SQL. A mention is a word of nine or more lower-case letters between spaces.
"""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.uris import OBO
from spanloom.operators.kb import DEFINITION, EXACT_SYNONYM, LABEL, MESH_NOTE, SYNONYM_PREDICATES
from spanloom.operators.reshape import unpivot_sections
from spanloom.operators.spans import attach_slice, token_spans
from spanloom.schemas import SECTION
from spanloom.staging import compute_once, stage
from spanloom.vocab import CLASSES, ENTITY_LABELS, PREDICATES

MENTION = r"(?<![^ ])[a-z]{9,}(?![^ ])"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def hex_value(text: Column, digits: int) -> Column:
    """The first hex digits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("int")


_staged: dict[tuple[str, str, str], DataFrame] = {}


class Views:
    """Views of one data folder. Articles, mentions and relations are staged once per session, as an annotated corpus would lie
    on disk; the rest is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _staged:
            _staged[key] = stage(make())
        return _staged[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        return self._once("articles", self._read_articles)

    def _read_articles(self) -> DataFrame:
        """The given file is one row group and so one task; its texts are dealt out to all cores."""
        title = F.substring_index("text", "\n", 1)
        rest = F.substring(F.col("text"), F.length(title) + 2, F.length("text"))
        last = F.col("doc_id") % 5
        annotator = (
            F.when(last == 0, "expert_1").when(last == 1, "student_A").when(last == 2, "student_B").otherwise("distant")
        )
        return (
            self.table("documents")
            .repartition(self.spark.sparkContext.defaultParallelism, "doc_id")
            .select(
                F.col("doc_id").cast("string").alias("pmid"), title.alias("title"), rest.alias("abstract"),
                annotator.alias("annotator"), "source", "lang",
            )
        )

    @cached_property
    def sections(self) -> DataFrame:
        return unpivot_sections(self.articles, keep=["annotator"])

    @cached_property
    def entities(self) -> DataFrame:
        return self._once("entities", self._find_entities)

    def _find_entities(self) -> DataFrame:
        tok = F.col("token")
        uri = F.concat(F.lit(OBO), F.upper(F.substring(tok, 1, 3)), F.lit("_"), F.length(tok))
        return token_spans(self.sections, MENTION).select(
            *SECTION, "pos", tok.alias("text_span"), "start_idx", "end_idx",
            pick(ENTITY_LABELS, F.ascii(tok) + F.length(tok)).alias("label"), uri.alias("uri"),
        )

    @cached_property
    def noisy(self) -> DataFrame:
        """Mentions with offsets moved a little, their text still that of the offsets."""
        return self._once("noisy", self._move_entities)

    def _move_entities(self) -> DataFrame:
        start = F.greatest(F.col("start_idx") + F.col("pos") % 3 - 1, F.lit(0))
        end = F.col("end_idx") - (F.col("pos") % 2 == 0).cast("int")
        moved = self.entities.withColumns({"start_idx": start, "end_idx": end}).filter("start_idx < end_idx")
        return attach_slice(moved, self.sections, "text_span").select(*self.entities.columns)

    @cached_property
    def dev(self) -> DataFrame:
        """Pmids of the dev split."""
        return self.articles.filter(F.col("pmid").cast("bigint") % 10 == 0).select("pmid")

    def is_dev(self) -> Column:
        return F.col("pmid").cast("bigint") % 10 == 0

    @cached_property
    def relations(self) -> DataFrame:
        """Each mention with the next one of its section."""
        return self._once("relations", self._relate_entities)

    def _relate_entities(self) -> DataFrame:
        following = Window.partitionBy(*SECTION).orderBy("pos")
        fields = ["start_idx", "end_idx", "location", "text_span", "label", "uri"]
        nxt = F.lead(F.struct(*fields)).over(following)
        pairs = self.entities.withColumn("o", nxt).filter(F.col("o").isNotNull())
        return pairs.select(
            "pmid", "location", "pos",
            *[F.col(c).alias(f"subject_{c}") for c in fields],
            pick(PREDICATES, F.col("start_idx") + F.col("o.start_idx")).alias("predicate"),
            *[F.col(f"o.{c}").alias(f"object_{c}") for c in fields],
        )

    @cached_property
    def cross_relations(self) -> DataFrame:
        """The first mention of a title with the first one of the abstract."""
        fields = ["start_idx", "end_idx", "location", "text_span", "label", "uri"]
        first = self.entities.filter("pos = 0")
        s = first.filter("location = 'title'").select("pmid", *[F.col(c).alias(f"subject_{c}") for c in fields])
        o = first.filter("location = 'abstract'").select("pmid", *[F.col(c).alias(f"object_{c}") for c in fields])
        return s.join(o, "pmid").withColumn(
            "predicate", pick(PREDICATES, F.col("subject_start_idx") + F.col("object_start_idx"))
        )

    @cached_property
    def all_relations(self) -> DataFrame:
        return self.relations.drop("location", "pos").unionByName(self.cross_relations)

    @cached_property
    def annotated(self) -> DataFrame:
        """Articles as read from annotation files: nested metadata, entities and relations."""
        entity = F.struct("location", "start_idx", "end_idx", "text_span", "label", "uri")
        ents = self.entities.groupBy("pmid").agg(F.sort_array(F.collect_list(entity)).alias("entities"))
        key = ["subject_location", "subject_start_idx", "object_location", "object_start_idx"]
        rest = [c for c in self.all_relations.columns if c not in ("pmid", *key)]
        rels = self.all_relations.groupBy("pmid").agg(
            F.sort_array(F.collect_list(F.struct(*key, *rest))).alias("relations")
        )
        meta = F.struct(
            "title", F.col("source").alias("author"), F.col("lang").alias("journal"), F.lit("2026").alias("year"),
            "abstract", "annotator",
        )
        joined = self.articles.select("pmid", meta.alias("metadata")).join(ents, "pmid", "left")
        joined = joined.join(rels, "pmid", "left")
        return joined.withColumns({
            c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("entities", "relations")
        })

    @cached_property
    def partial_relations(self) -> DataFrame:
        """Relations with some subject URIs empty and some object labels unknown."""
        return self.relations.withColumns({
            "subject_uri": F.when(F.col("subject_start_idx") % 7 == 0, "").otherwise(F.col("subject_uri")),
            "object_label": F.when(F.col("object_start_idx") % 11 == 0, "unknown").otherwise(F.col("object_label")),
        })

    @cached_property
    def kb(self) -> DataFrame:
        """Surfaces of even length by concept, so that other mentions need the later linking stages."""
        surface = F.col("text_span")
        return self.entities.filter(F.length(surface) % 2 == 0).select(
            "uri", F.col("uri").alias("ord"), surface.alias("pos"), surface.alias("surface")
        ).distinct()

    @cached_property
    def definitions(self) -> DataFrame:
        size = F.substring_index("uri", "_", -1).cast("int")
        return self.kb.filter(size % 4 != 0).groupBy("uri").agg(
            F.concat_ws(" ", F.min("surface"), F.max("surface")).alias("definition")
        )

    @cached_property
    def listed(self) -> DataFrame:
        """URIs that distantly annotated articles use."""
        distant = self.articles.filter("annotator = 'distant'").select("pmid")
        return self.entities.join(distant, "pmid", "left_semi").select("uri").distinct()

    @cached_property
    def mixed_uris(self) -> DataFrame:
        """All concept URIs, moved to several domains by the length in them."""
        tail = F.substring_index("uri", "/", -1)
        plain = F.replace(tail, F.lit("_"), F.lit(""))
        kind = F.substring_index("uri", "_", -1).cast("int") % 6
        uri = (
            F.when(kind == 1, F.concat(F.lit("http://www.ebi.ac.uk/efo/"), tail))
            .when(kind == 2, F.concat(F.lit("http://edamontology.org/"), tail))
            .when(kind == 3, F.concat(F.lit("https://id.nlm.nih.gov/mesh/"), plain))
            .when(kind == 4, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/gene/"), plain))
            .when(kind == 5, F.concat(F.lit("http://snomed.info/id/"), plain))
            .otherwise(F.col("uri"))
        )
        return self.entities.select("uri").distinct().select(uri.alias("uri"))

    @cached_property
    def triples(self) -> DataFrame:
        """The vocabulary as triples of several ontologies; some concepts lack a label."""
        firsts = self.kb.groupBy("uri").agg(F.min("surface").alias("first"), F.max("surface").alias("last"))
        size = F.substring_index("uri", "_", -1).cast("int")
        prefix = F.substring_index(F.substring_index("uri", "/", -1), "_", 1)
        ontology = F.when(size == 10, "foodon").when(size == 12, "stato").otherwise(F.lower(prefix)).alias("ontology")
        labelled = F.ascii(F.substring(prefix, 2, 1)) % 5 != 0
        labels = firsts.filter(labelled).select(ontology, "uri", F.lit(LABEL).alias("p"), F.col("first").alias("o"))
        texts = firsts.join(self.definitions, "uri").select(
            ontology, "uri", F.lit(DEFINITION).alias("p"),
            F.explode(F.array("definition", F.concat(F.lit("z "), "last"))).alias("o"),
        )
        kind = F.ascii(F.substring("surface", -1, 1)) % 3
        p = (
            F.when(kind == 0, EXACT_SYNONYM)
            .when(kind == 1, SYNONYM_PREDICATES["foodon"])
            .otherwise(SYNONYM_PREDICATES["stato"])
        )
        others = self.kb.join(firsts, "uri").filter("surface <> first").select(
            ontology, "uri", p.alias("p"), F.col("surface").alias("o")
        )
        return labels.union(texts).union(others).withColumnRenamed("uri", "s")

    @cached_property
    def mesh_triples(self) -> DataFrame:
        """Label of each MeSH URI, and a note for some."""
        from spanloom.functions.uris import mesh_iri

        iris = self.mixed_uris.filter(F.col("uri").contains("id.nlm.nih.gov")).select(mesh_iri(F.col("uri")).alias("s"))
        name = F.lower(F.substring_index("s", "/", -1))
        labels = iris.select("s", F.lit(LABEL).alias("p"), name.alias("o"))
        notes = iris.filter(F.ascii(name) % 2 == 0).select(
            "s", F.lit(MESH_NOTE).alias("p"), F.concat(F.lit("note "), name).alias("o")
        )
        return labels.union(notes)

    @cached_property
    def curated(self) -> DataFrame:
        """Hand-kept concepts: https URIs of the vocabulary, some without name or definition."""
        names = self.entities.groupBy("uri").agg(F.max("text_span").alias("last"))
        kind = F.ascii(F.col("last")) % 3
        return names.select(
            F.regexp_replace("uri", "^http:", "https:").alias("uri"),
            F.when(kind != 0, F.concat(F.lit("curated "), "last")).alias("name"),
            F.when(kind != 1, F.concat(F.lit("about "), "last")).alias("definition"),
        )

    def _by_model(self, df: DataFrame, column: str, value: str, key: list[str]) -> DataFrame:
        """Three imperfect models: an eighth of the rows lost, a sixteenth changed, a sixteenth doubled."""
        models = F.explode(F.sequence(F.lit(0), F.lit(2)))
        digit = hex_value(F.concat_ws("|", "model", *key), 1)
        return (
            df.withColumn("model", models)
            .withColumn("_d", digit)
            .filter("_d > 1")
            .withColumn(column, F.when(F.col("_d") == 2, value).otherwise(F.col(column)))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1))))
            .drop("_d", "_copy")
        )

    @cached_property
    def models(self) -> DataFrame:
        """The three models and a fourth that predicts nothing."""
        return self.spark.range(4).select(F.col("id").cast("int").alias("model"))

    @cached_property
    def pred_entities(self) -> DataFrame:
        return self._by_model(self.entities, "label", "drug", ["pmid", "location", "pos"])

    @cached_property
    def pred_relations(self) -> DataFrame:
        return self._by_model(
            self.relations, "predicate", "interact", ["pmid", "location", "subject_start_idx"]
        )

    @cached_property
    def scored_pairs(self) -> DataFrame:
        """Relations with 18 scores each, the gold class highest in most. What all scores share is computed once a relation."""
        key = F.concat_ws("|", "pmid", "location", "subject_start_idx")
        gold = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("predicate")) - 1
        sure = hex_value(key, 1) < 10
        shared = F.struct(key.alias("_key"), F.when(sure, gold).alias("_gold"))
        scores = F.transform(
            F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)),
            lambda k: hex_value(F.concat_ws("|", "_key", k), 2) / 255 + F.when(k == F.col("_gold"), 1.0).otherwise(0.0),
        )
        scored = compute_once(compute_once(self.relations, shared), F.struct(scores.alias("scores")))
        return scored.drop("_key", "_gold")
