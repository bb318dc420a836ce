"""Exact-match scoring. Predictions of many models are scored in one job: `model` is part of the key."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from spanloom.schemas import CONCEPT_RELATION_KEY, MENTION_RELATION_KEY
from spanloom.staging import stage
from spanloom.vocab import CLASSES, NO_RELATION

# Scoring keys per task; the class is the last argument of `score_classes`.
NER_KEY = ["pmid", "location", "start_idx", "end_idx", "label"]
LINKING_KEY = ["pmid", "text_span", "label", "uri"]
MENTION_RE_KEY = ["pmid", *MENTION_RELATION_KEY]
CONCEPT_RE_KEY = ["pmid", *CONCEPT_RELATION_KEY]
# Models whose predictions are counted side by side.
MODELS_AT_ONCE = 16


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; zero where the denominator is."""
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def _models(df: DataFrame) -> list:
    """The models named in a table, which are as few as the rows of a result."""
    return [r.model for r in df.select("model").distinct().collect()]


def _counts_by_class(
    gold: DataFrame, pred: DataFrame, key: list[str], class_key: str, names: list, kind: DataType
) -> DataFrame:
    """(class, total, others, models): an array with tp, fp and matched of each named model. `others` are predictions of
    models not named.

    Gold and predictions of all these models are counted per record in one aggregation: a record travels once, not once a
    model, and is not joined.
    """
    no_model = F.lit(None).cast(kind)
    rows = gold.select(*key, no_model.alias("_model"), F.lit(True).alias("_gold")).unionByName(
        pred.select(*key, F.col("model").cast(kind).alias("_model"), F.lit(False).alias("_gold"))
    )
    literals = [F.lit(name).cast(kind) for name in names]
    is_model = [~F.col("_gold") & F.col("_model").eqNullSafe(x) for x in literals]
    records = rows.groupBy(*key).agg(
        F.count_if("_gold").alias("_g"),
        F.count_if(~F.col("_gold")).alias("_all"),
        *[F.count_if(x).alias(f"_p{i}") for i, x in enumerate(is_model)],
    )
    g, p = F.col("_g"), [F.col(f"_p{i}") for i in range(len(names))]
    sums = records.groupBy(F.col(class_key).alias("class")).agg(
        F.sum("_g").alias("total"),
        F.sum(F.col("_all") - reduce(Column.__add__, p, F.lit(0))).alias("others"),
        *[F.sum(F.when(g > 0, x).otherwise(0)).alias(f"tp{i}") for i, x in enumerate(p)],
        *[F.sum(F.when(g == 0, x).otherwise(0)).alias(f"fp{i}") for i, x in enumerate(p)],
        *[F.sum(F.when(x > 0, g).otherwise(0)).alias(f"matched{i}") for i, x in enumerate(p)],
    )
    models = [
        F.struct(x.alias("model"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "matched")]) for i, x in enumerate(literals)
    ]
    return sums.select("class", "total", "others", F.array(*models).alias("models"))


def score_classes(
    gold: DataFrame, pred: DataFrame, key: list[str], class_key: str, models: DataFrame | None = None
) -> DataFrame:
    """(model, class, tp, fp, fn, precision, recall, f1). `pred` has a `model` column; null equals null.

    Copies are counted, map-side first, so a record with very many copies is one row: predicted rows count as tp or fp
    each, gold rows as fn each. A model's fn are the gold rows of the class less those it matched. A model of the small
    table `models` (model) is scored even if it predicts nothing; where it names all there are, predictions are read once.
    MODELS_AT_ONCE models are counted at a time. Runs jobs and stages the counts, a row per class.
    """
    named = pred.select("model")
    kind = (named if models is None else named.union(models.select("model"))).schema["model"].dataType

    def counted(names: list) -> DataFrame:
        parts = [names[i : i + MODELS_AT_ONCE] for i in range(0, len(names), MODELS_AT_ONCE)] or [[None]]
        some = [_counts_by_class(gold, pred, key, class_key, part, kind) for part in parts]
        return stage(reduce(DataFrame.unionByName, some).filter(F.lit(bool(names))))

    names = _models(pred if models is None else models)
    counts = counted(names) if models is None or len(names) <= MODELS_AT_ONCE else None
    if models is not None and (counts is None or not names or not counts.filter("others > 0").isEmpty()):
        counts = counted(list(dict.fromkeys([*names, *_models(pred)])))
    rows = counts.select("class", "total", F.explode("models").alias("m")).select("class", "total", "m.*")
    rows = rows.filter("total > 0 or tp + fp > 0")
    return with_prf(rows.select("model", "class", "tp", "fp", (F.col("total") - F.col("matched")).alias("fn")))


def score_summary(classes: DataFrame) -> DataFrame:
    """One row per model: micro from pooled counts, macro as the mean over classes seen in gold or predictions."""
    pooled = classes.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )
    micro = {c: F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")}
    return with_prf(pooled).select("model", *micro.values(), "macro_precision", "macro_recall", "macro_f1")


def score_tasks(
    tasks: dict[str, tuple[DataFrame, DataFrame, list[str], str]], models: DataFrame | None = None
) -> DataFrame:
    """Summaries of several tasks and models in one table. A task is (gold, predictions, key, class column); `models`
    as in score_classes."""
    parts = [
        score_summary(score_classes(*task, models)).select(F.lit(name).alias("task"), "*") for name, task in tasks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def argmax_class(scores: Column) -> Column:
    """Class name of the first highest score."""
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position(scores, F.array_max(scores)).cast("int"))


def score_classifier(pairs: DataFrame) -> DataFrame:
    """One row (macro_f1, micro_f1) from (label, prediction) over the predicates only.

    no_relation is no class of its own but its confusions count; predicates never seen score 0 and still count.
    """
    confusion = pairs.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("label") == F.col("prediction")
    # At most 18 x 18 confusion cells reach the two explodes below.
    sides = confusion.select(
        "n",
        F.explode(
            F.when(hit, F.array(F.struct(F.col("label").alias("class"), F.lit("tp").alias("kind")))).otherwise(
                F.array(
                    F.struct(F.col("label").alias("class"), F.lit("fn").alias("kind")),
                    F.struct(F.col("prediction").alias("class"), F.lit("fp").alias("kind")),
                )
            )
        ).alias("x"),
    ).select("n", "x.class", "x.kind")
    classes = pairs.sparkSession.createDataFrame([(c,) for c in CLASSES if c != NO_RELATION], "class string")
    per_class = F.broadcast(classes).join(
        sides.groupBy("class").pivot("kind", ["tp", "fp", "fn"]).agg(F.sum("n")), "class", "left"
    ).na.fill(0)
    pooled = with_prf(per_class).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1")
    )
    return with_prf(pooled).select("macro_f1", F.col("f1").alias("micro_f1"))
