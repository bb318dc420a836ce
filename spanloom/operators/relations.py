"""Relations: resolving endpoints, deriving them from entity pairs, relation matrices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.reshape import complete_relations
from spanloom.operators.skew import tile_join
from spanloom.schemas import CONCEPT_RELATION_KEY, MENTION_RELATION_KEY, SECTION
from spanloom.vocab import NO_RELATION, PREDICATES, relation_schema


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with subject_pos and object_pos, the entities at their offsets.

    (pmid, pos) identifies an entity. Relations lacking an entity at either end are dropped; several entities at
    the same offsets give several rows.
    """
    at = ["location", "start_idx", "end_idx"]
    for side in ("subject", "object"):
        ends = entities.select(
            "pmid", *[F.col(c).alias(f"{side}_{c}") for c in at], F.col("pos").alias(f"{side}_pos")
        )
        relations = relations.join(ends, ["pmid", *[f"{side}_{c}" for c in at]])
    return relations


def refresh_offsets(relations: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """Offsets of one side ("subject" or "object") taken from the entities by (pmid, location, pos).

    Relations whose entity is gone, say by cleaning, are dropped.
    """
    if on not in ("subject", "object"):
        raise ValueError(f"on must be subject or object, not {on}")
    offsets = [f"{on}_start_idx", f"{on}_end_idx"]
    fresh = entities.select(
        "pmid",
        F.col("location").alias(f"{on}_location"),
        F.col("pos").alias(f"{on}_pos"),
        F.col("start_idx").alias(offsets[0]),
        F.col("end_idx").alias(offsets[1]),
    )
    return relations.drop(*offsets).join(fresh, ["pmid", f"{on}_location", f"{on}_pos"])


def resolve_fresh(relations: DataFrame, entities: DataFrame, cleaned: DataFrame) -> DataFrame:
    """As resolve_endpoints to `entities` and then refresh_offsets of both sides from `cleaned`.

    The offsets after cleaning are put beside those before once an entity, so relations are joined at either end only once.
    """
    at = ["location", "start_idx", "end_idx"]
    fresh = cleaned.select("pmid", "location", "pos", *[F.col(c).alias(f"new_{c}") for c in at[1:]])
    moved = entities.select("pmid", "pos", *at).join(fresh, ["pmid", "location", "pos"])
    for side in ("subject", "object"):
        ends = moved.select(
            "pmid", *[F.col(c).alias(f"{side}_{c}") for c in at], F.col("pos").alias(f"{side}_pos"),
            *[F.col(f"new_{c}").alias(f"new_{side}_{c}") for c in at[1:]],
        )
        relations = relations.join(ends, ["pmid", *[f"{side}_{c}" for c in at]]).drop(*[f"{side}_{c}" for c in at[1:]])
        relations = relations.withColumnsRenamed({f"new_{side}_{c}": f"{side}_{c}" for c in at[1:]})
    return relations


def schema_valid(relations: DataFrame) -> DataFrame:
    """Relations with `valid`: whether the schema lists their labels and predicate."""
    schema = relation_schema(relations.sparkSession).drop("is_default").withColumn("_listed", F.lit(True))
    return relations.join(
        F.broadcast(schema), ["subject_label", "predicate", "object_label"], "left"
    ).withColumn("valid", F.coalesce("_listed", F.lit(False))).drop("_listed")


def pair_predicates(label_pairs: DataFrame) -> DataFrame:
    """Inner join of (subject_label, object_label, ...) with the default predicate of the pair."""
    defaults = relation_schema(label_pairs.sparkSession).filter("is_default").drop("is_default")
    return label_pairs.join(F.broadcast(defaults), ["subject_label", "object_label"])


def pair_counts(entities: DataFrame, same: list[str]) -> DataFrame:
    """(pmid, location, n_pairs): ordered pairs of a section's entities that differ in `same`.

    Counted without forming a pair: the square of the section's size less the squares of its equal groups.
    """
    groups = entities.groupBy(*SECTION, *same).agg(F.count(F.lit(1)).alias("n"))
    n_pairs = F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))
    return groups.groupBy(*SECTION).agg(n_pairs.cast("bigint").alias("n_pairs"))


def _side(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*SECTION, *[F.col(c).alias(f"{side}_{c}") for c in columns])


def schema_pairs(entities: DataFrame, columns: list[str], default_only: bool) -> DataFrame:
    """Ordered entity pairs of a section whose labels the relation schema relates.

    The schema is joined to the subject first, so its object label is part of the join key and label pairs without
    a predicate are never formed. With default_only the pair carries its default `predicate`.
    """
    schema = relation_schema(entities.sparkSession)
    rule = ["subject_label", "object_label"]
    schema = schema.filter("is_default").select(*rule, "predicate") if default_only else schema.select(*rule).distinct()
    columns = list(dict.fromkeys([*columns, "label"]))
    subjects = _side(entities, "subject", columns).join(F.broadcast(schema), "subject_label")
    return tile_join(subjects, _side(entities, "object", columns), [*SECTION, "object_label"])


def derive_relations(entities: DataFrame) -> DataFrame:
    """(pmid, s_uri, s_label, predicate, o_uri, o_label): what the schema lets linked entities of a section imply.

    Entities with the same concept and label imply the same, so they are merged before pairing.
    """
    concepts = entities.filter(F.col("uri").isNotNull()).select(*SECTION, "uri", "label").distinct()
    return (
        schema_pairs(concepts, ["uri"], default_only=True)
        .filter(F.col("subject_uri") != F.col("object_uri"))
        .select("pmid", *CONCEPT_RELATION_KEY)
        .distinct()
    )


def annotated_relations(relations: DataFrame) -> DataFrame:
    """Distinct concept relations of each article among complete annotated ones."""
    return complete_relations(relations).select("pmid", *CONCEPT_RELATION_KEY).distinct()


def gold_labels(relations: DataFrame) -> DataFrame:
    """(pmid, location, s_start, o_start, label): the last relation at a pair of starts decides."""
    last = F.max_by("predicate", "pos").alias("label")
    return (
        relations.groupBy(
            "pmid",
            F.col("subject_location").alias("location"),
            F.col("subject_start_idx").alias("s_start"),
            F.col("object_start_idx").alias("o_start"),
        )
        .agg(last)
        .withColumn("label", F.when(F.col("label").isin(PREDICATES), F.col("label")).otherwise(NO_RELATION))
    )


def positive_pairs(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity pairs with a gold predicate: (pmid, location, s_pos, s_start, s_end, o_pos, o_start, o_end, label).

    Found from the gold relations through their starts, so unlabelled pairs are not formed.
    """
    def ends(side: str) -> DataFrame:
        return entities.select(
            *SECTION,
            F.col("pos").alias(f"{side}_pos"),
            F.col("start_idx").alias(f"{side}_start"),
            F.col("end_idx").alias(f"{side}_end"),
        )

    return (
        gold_labels(relations)
        .filter(F.col("label") != NO_RELATION)
        .join(ends("s"), [*SECTION, "s_start"])
        .join(ends("o"), [*SECTION, "o_start"])
        .filter((F.col("s_start") != F.col("o_start")) | (F.col("s_end") != F.col("o_end")))
        .select(*SECTION, "s_pos", "s_start", "s_end", "o_pos", "o_start", "o_end", "label")
    )


def matrix_shape(nodes: DataFrame) -> DataFrame:
    """(pmid, location, n_nodes, n_pairs, n_cells) of each section's relation matrix.

    A cell is an ordered pair of different entities and a predicate. All are 0.0 except those `matrix_cells`
    gives, so the matrix is kept sparse: its nodes, this shape and the filled cells.
    """
    return (
        nodes.groupBy(*SECTION)
        .agg(F.count(F.lit(1)).alias("n_nodes"))
        .withColumn("n_pairs", F.col("n_nodes") * (F.col("n_nodes") - 1))
        .withColumn("n_cells", F.col("n_pairs") * len(PREDICATES))
    )


def _snapped_ends(relations: DataFrame, snapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with s_token and o_token, the token starts of their entities; null where there is none.

    `snapped` maps raw starts to token starts, `nodes` are the entities left after overlap resolution.
    """
    alive = nodes.select(*SECTION, F.col("start_idx").alias("token")).distinct().withColumn("alive", F.lit(True))
    starts = snapped.filter(F.col("start_idx").isNotNull()).groupBy(*SECTION, "raw_start").agg(
        F.max_by("start_idx", "pos").alias("token")
    )
    # Which starts are nodes is looked up here, once an entity, not at both ends of every relation.
    starts = starts.join(alive, [*SECTION, "token"], "left")
    for side, short in (("subject", "s"), ("object", "o")):
        renamed = starts.select(
            *SECTION, F.col("raw_start").alias(f"{side}_start_idx"), F.col("token").alias(f"{short}_token"),
            F.col("alive").alias(f"_{short}"),
        )
        relations = relations.join(renamed, [*SECTION, f"{side}_start_idx"], "left")
    found = F.col("_s") & F.col("_o") & (F.col("s_token") != F.col("o_token"))
    return relations.withColumn("found", F.coalesce(found, F.lit(False))).drop("_s", "_o")


def matrix_cells(relations: DataFrame, snapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Filled cells (pmid, location, s_token, o_token, predicate, score 1.0) of the relation matrix.

    `relations` has location, subject_start_idx, predicate, object_start_idx.
    """
    return (
        _snapped_ends(relations, snapped, nodes)
        .filter(F.col("found"))
        .select(*SECTION, "s_token", "o_token", "predicate", F.lit(1.0).alias("score"))
        .distinct()
    )


def matrix_uri_cells(relations: DataFrame, snapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pmid, location, subject_uri, object_uri, predicate, score): 1.0 where both ends were found, else 0.0."""
    score = F.max(F.col("found").cast("double")).alias("score")
    return (
        _snapped_ends(relations, snapped, nodes)
        .groupBy(*SECTION, "subject_uri", "object_uri", "predicate")
        .agg(score)
    )


def mention_relations(classified: DataFrame) -> DataFrame:
    """Mention relations of classified pairs: every pair with a predicate, copies kept."""
    return classified.filter(F.col("predicate") != NO_RELATION).select("pmid", *MENTION_RELATION_KEY)


def concept_relations(classified: DataFrame, distinct: bool = False) -> DataFrame:
    """Distinct concept relations of classified pairs whose URIs are both there and differ; `distinct` says that pairs are that already."""
    uris = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("subject_uri", "object_uri")]
    related = (
        classified.filter(F.col("predicate") != NO_RELATION)
        .filter(uris[0] & uris[1] & (F.col("subject_uri") != F.col("object_uri")))
        .select("pmid", *CONCEPT_RELATION_KEY)
    )
    return related if distinct else related.distinct()
