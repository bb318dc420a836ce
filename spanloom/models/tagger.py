"""Entity tagging: by a gazetteer learned from annotations, or by any model run over Arrow batches."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import WORD, normalise_surface
from spanloom.operators.skew import hot_keys, lookup_join
from spanloom.operators.spans import attach_context, resolve_overlaps, token_spans
from spanloom.schemas import SECTION
from spanloom.staging import stage

# Words and single other characters, as Python and as Java write it.
TOKEN = r"\w+|[^\w\s]"
JVM_TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x1c-\x1f\x85]"
#: Tokens whose text a token's row carries.
AHEAD = 8
#: One in so many sections is read beforehand for the most frequent tokens.
SHARE_OF = 64
TAGGED = "pmid string, location string, start_idx int, end_idx int, text_span string, label string"


def learn_gazetteer(entities: DataFrame) -> DataFrame:
    """(surface, label): the most frequent label of each annotated surface, the first by name among equals."""
    counts = (
        entities.groupBy(normalise_surface(F.col("text_span")).alias("surface"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("surface") != "")
    )
    return counts.groupBy("surface").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


def tag_gazetteer(sections: DataFrame, gazetteer: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """(pmid, location, start_idx, end_idx, text_span, label) of surfaces found at token boundaries.

    Only tokens that begin a surface are looked at, and only at the lengths such surfaces have; `max_tokens`, if given,
    leaves out longer surfaces. A token's row carries at most AHEAD tokens, however long surfaces are: of a longer
    surface the first AHEAD tokens are looked up, and only where they stand is the rest read. Overlaps are resolved
    longest first. Frequent tokens, as counted in one section of SHARE_OF, are dropped where they begin no surface and
    spread over tasks where they do; that count decides only how rows travel. Runs jobs.
    """
    words = F.regexp_extract_all("surface", F.lit(JVM_TOKEN), F.lit(0))
    entries = stage(gazetteer.select(
        "surface", "label", words[0].alias("first"), F.size(words).alias("n"), _head(words).alias("head"), F.element_at(words, -1).alias("last"),
    ))
    entries = entries.filter(F.col("first").isNotNull() & (F.lit(True) if max_tokens is None else F.col("n") <= max_tokens))
    starts = entries.filter(F.col("n") <= AHEAD).groupBy("first").agg(F.collect_set("n").alias("ns"))
    longest = entries.agg(F.max("n")).first()[0] or 1

    found = token_spans(sections, TOKEN, ahead=min(longest, AHEAD) - 1)
    tokens = found.select(
        *SECTION, "pos", "start_idx", F.lower("token").alias("first"),
        *([F.col("ends"), F.col("text")] if longest > 1 else [F.array("end_idx").alias("ends"), F.col("token").alias("text")]),
    )
    few = token_spans(sections.filter(F.pmod(F.xxhash64(*SECTION), F.lit(SHARE_OF)) == 0), TOKEN).select(F.lower("token").alias("first"))
    frequent = stage(hot_keys(few, ["first"]).join(starts.withColumn("begins", F.lit(True)).drop("ns"), "first", "left"))
    hot = frequent.filter("begins").drop("begins")
    end = F.col("ends")[F.col("n") - 1]
    useful = tokens.join(F.broadcast(frequent.filter("begins is null").select("first")), "first", "left_anti")
    spans = (
        lookup_join(useful, starts, ["first"], hot=hot)
        .withColumn("n", F.explode("ns"))
        .filter(F.col("n") <= F.size("ends"))
        .select(
            *SECTION, "pos", "start_idx", end.alias("end_idx"),
            F.substring("text", F.lit(1), end - F.col("start_idx")).alias("text_span"),
        )
    )
    if longest > AHEAD:
        spans = spans.unionByName(_long_spans(sections, tokens, entries.filter(F.col("n") > AHEAD)))
    # A frequent surface of one token is a frequent token.
    hot = hot.withColumnRenamed("first", "surface")
    surfaces = spans.withColumn("surface", F.lower("text_span"))
    tagged = lookup_join(surfaces, entries.select("surface", "label"), ["surface"], hot=hot).drop("surface")
    return resolve_overlaps(tagged).select(*SECTION, "start_idx", "end_idx", "text_span", "label")


def _head(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, AHEAD), " ")


def _long_spans(sections: DataFrame, tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Spans with the first AHEAD tokens, the last one and the number of tokens of a surface of `entries`."""
    starts = tokens.filter(F.size("ends") == AHEAD).join(entries.select("first").distinct(), "first", "left_semi")
    head = _head(F.regexp_extract_all(F.lower("text"), F.lit(JVM_TOKEN), F.lit(0)))
    begun = starts.select(*SECTION, "pos", "start_idx", head.alias("head")).join(entries.select("head", "n", "last").distinct(), "head")
    lasts = tokens.select(*SECTION, F.col("pos").alias("end_pos"), F.col("first").alias("last"), F.col("ends")[0].alias("end_idx"))
    ended = begun.withColumn("end_pos", F.col("pos") + F.col("n") - 1).join(lasts, [*SECTION, "end_pos", "last"])
    return attach_context(ended.select(*SECTION, "pos", "start_idx", "end_idx"), sections).select(
        *SECTION, "pos", "start_idx", "end_idx", F.col("span").alias("text_span")
    )


def tag_with(sections: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]]) -> DataFrame:
    """Entities tagged by a model of your own. `make_model` is called once per task and returns a function from
    texts to lists of (start, end, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame(
                [
                    (pmid, location, start, end, text[start:end], label)
                    for pmid, location, text, found in zip(batch["pmid"], batch["location"], texts, model(texts))
                    for start, end, label in found
                ],
                columns=["pmid", "location", "start_idx", "end_idx", "text_span", "label"],
            )

    return sections.select(*SECTION, "text").mapInPandas(run, TAGGED)
