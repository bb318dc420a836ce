"""Relation classification of entity pairs: a default learner, and any scoring function over Arrow batches."""

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexerModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import insert_markers_in_parts, text_parts
from spanloom.operators.evaluate import argmax_class
from spanloom.operators.profile import class_weights
from spanloom.operators.relations import schema_pairs
from spanloom.operators.reshape import allowed_entities
from spanloom.schemas import SECTION
from spanloom.staging import compute_once, stage
from spanloom.vocab import CLASSES

# What with_features reads.
FEATURE_INPUTS = [f"{side}_{c}" for side in ("subject", "object") for c in ("text_span", "label", "start_idx")]
PAIR_COLUMNS = ["pos", "start_idx", "end_idx", "text_span", "uri"]


def candidate_pairs(entities: DataFrame) -> DataFrame:
    """Ordered pairs of allowed entities of a section, at different offsets, that some predicate may relate.

    Pairs of labels no predicate relates are left out before they are formed; the schema rejects any answer on them.
    """
    return schema_pairs(allowed_entities(entities), PAIR_COLUMNS, default_only=False).filter(
        (F.col("subject_start_idx") != F.col("object_start_idx"))
        | (F.col("subject_end_idx") != F.col("object_end_idx"))
    )


def mark_pairs(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Pairs with `marked`: the section's text with markers round both entities."""
    ends = [f"{s}_{e}_idx" for s in ("subject", "object") for e in ("start", "end")]
    cut = F.struct(text_parts(F.col("text")).alias("_parts"), F.length("text").alias("_size"))
    texts = compute_once(sections.select(*SECTION, "text"), cut).drop("text")
    return pairs.join(texts, SECTION).withColumn(
        "marked", insert_markers_in_parts(F.col("_parts"), F.col("_size"), *[F.col(c) for c in ends])
    ).drop("_parts", "_size")


def classify_pairs(
    pairs: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 32,
    column: str = "marked",
) -> DataFrame:
    """Pairs with the `predicate` of highest score. `make_scorer` is called once per worker and returns a function
    from a batch of `column` to an array (batch, 18) of scores."""
    score = predict_batch_udf(make_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return pairs.withColumn("predicate", argmax_class(score(F.col(column))))


def with_features(pairs: DataFrame) -> DataFrame:
    """Pairs with `features_text`: words of both spans, the label pair, order and distance."""
    def words(side: str):
        return F.transform(
            F.split(F.lower(f"{side}_text_span"), r"\s+"), lambda w: F.concat(F.lit(f"{side}:"), w)
        )

    gap = F.abs(F.col("subject_start_idx") - F.col("object_start_idx"))
    return pairs.withColumn(
        "features_text",
        F.concat(
            words("subject"),
            words("object"),
            F.array(
                F.concat_ws(">", "subject_label", "object_label"),
                F.concat(F.lit("gap:"), F.floor(F.log2(gap + 1)).cast("string")),
                F.concat(F.lit("first:"), (F.col("subject_start_idx") < F.col("object_start_idx")).cast("string")),
            ),
        ),
    )


def train_classifier(examples: DataFrame, features: int = 1024, iterations: int = 10, staged: bool = False) -> PipelineModel:
    """Class-weighted logistic regression over hashed pair features. Classes with no example have no weight.

    `examples` are pairs as of candidate_pairs with `label`; the class weights are 18 rows. What is read of the examples
    is staged, as weighting and fitting read them several times, unless they come `staged`.
    """
    examples = examples.select(*FEATURE_INPUTS, "label")
    examples = examples if staged else stage(examples)
    weighted = with_features(examples).join(F.broadcast(class_weights(examples)).select("label", "weight"), "label")
    stages = [
        StringIndexerModel.from_labels(CLASSES, inputCol="label", outputCol="class"),
        HashingTF(inputCol="features_text", outputCol="features", numFeatures=features),
        LogisticRegression(
            labelCol="class", featuresCol="features", weightCol="weight", maxIter=iterations, predictionCol="guess"
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def term_index(term: str | None, size: int) -> int:
    """Where HashingTF puts a term: MurmurHash3 (32 bits, seed 42) of its UTF-8 bytes modulo the number of features; null is the seed."""
    if term is None:
        return 42 % size
    data, full = term.encode(), 0xFFFFFFFF
    value = 42
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & full
        value ^= (k << 15 | k >> 17) * 0x1B873593 & full
        if at + 4 <= len(data):
            value = ((value << 13 | value >> 19) * 5 + 0xE6546B64) & full
    value ^= len(data)
    value = (value ^ value >> 16) * 0x85EBCA6B & full
    value = (value ^ value >> 13) * 0xC2B2AE35 & full
    value ^= value >> 16
    return (value - (1 << 32) if value >> 31 else value) % size


def _best_class(weights: np.ndarray, intercepts: np.ndarray) -> Callable:
    """A function over Arrow batches that gives the place of the highest score of each pair.

    Scores are sums over terms, so what a span, a pair of labels or a distance adds is summed once and looked up by the pairs.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        @lru_cache(1 << 14)
        def of_span(side: str, span: str | None) -> np.ndarray:
            words = [] if span is None else re.split(r"[ \t\n\x0b\f\r]+", span)
            return of_terms(*[f"{side}:{word}" for word in words])

        def of_terms(*terms: str | None) -> np.ndarray:
            return weights[[term_index(term, len(weights)) for term in terms]].sum(axis=0)

        def coded(column: pa.Array) -> tuple[np.ndarray, list]:
            column = column.dictionary_encode(null_encoding="encode")
            return column.indices.to_numpy(), column.dictionary.to_pylist()

        for subject, object_, subject_label, object_label, gap, first in batches:
            if not len(subject):
                yield pa.array([], pa.int32())
                continue
            scores = np.tile(intercepts, (len(subject), 1))
            for side, column in (("subject", subject), ("object", object_)):
                codes, spans = coded(column)
                scores += np.stack([of_span(side, span) for span in spans])[codes]
            (s, subjects), (o, objects) = coded(subject_label), coded(object_label)
            labels = np.stack([of_terms(">".join(x for x in pair if x is not None)) for pair in product(subjects, objects)])
            scores += labels[s * len(objects) + o]
            for name, column in (("gap", gap), ("first", first)):
                codes, values = coded(column)
                named = ("false", "true") if name == "first" else range(64)
                scores += np.stack([of_terms(None if value is None else f"{name}:{named[value]}") for value in values])[codes]
            yield pa.array(scores.argmax(axis=1), pa.int32())

    return run


def apply_classifier(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with the `predicate` the trained classifier gives: the first class of highest score, as its own transform has it."""
    regression = model.stages[-1]
    weights = np.ascontiguousarray(regression.coefficientMatrix.toArray().T)
    run = _best_class(weights, regression.interceptVector.toArray())
    # Called nondeterministic so that a filter on the predicate is not turned into a second call.
    best = F.arrow_udf(run, T.IntegerType(), F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    gap = F.abs(F.col("subject_start_idx") - F.col("object_start_idx"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    place = best(
        F.lower("subject_text_span"), F.lower("object_text_span"), "subject_label", "object_label",
        F.floor(F.log2(gap + 1)).cast("int"), (F.col("subject_start_idx") < F.col("object_start_idx")).cast("int"),
    )
    return pairs.select("*", F.element_at(names, place + 1).alias("predicate"))


def describe_examples(examples: DataFrame, entities: DataFrame) -> DataFrame:
    """Sampled examples with the span texts and labels of both entities, as the classifier needs them."""
    for side, short in (("subject", "s"), ("object", "o")):
        described = entities.select(
            *SECTION,
            F.col("pos").alias(f"{short}_pos"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("start_idx", "end_idx", "text_span", "label", "uri")],
        )
        examples = examples.join(described, [*SECTION, f"{short}_pos"])
    return examples
