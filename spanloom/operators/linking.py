"""Linking mentions to concepts: by dictionary in three stages, or by the nearest vector."""

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalise_surface
from spanloom.operators.skew import lookup_join
from spanloom.staging import stage

# Cosines are compared after rounding, so that equal vectors tie whatever the order of summation.
SCORE_DIGITS = 6
CONCEPT_BLOCK = 4096
MENTION_BLOCK = 8192
# Mentions of a block whose cosines are in memory at once.
MENTIONS_AT_ONCE = 512
TRIGRAM_KEYS_AT_ONCE = 256
# Different trigrams whose idf may be broadcast.
FEW_GRAMS = 1 << 17
# Characters of a block of keys, and of the surfaces that make one automaton.
KEY_CHARS = 1 << 20
SURFACE_CHARS = 1 << 20


def link_exact(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, uri) of keys that are surfaces."""
    return keys.join(index.select("key", "uri"), "key")


def link_plural(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, uri) of keys longer than three that are surfaces once a trailing s is cut."""
    singular = (
        keys.filter(F.col("key").endswith("s") & (F.length("key") > 3))
        .select(F.col("key").alias("plural"), F.expr("substring(key, 1, length(key) - 1)").alias("key"))
    )
    return singular.join(index.select("key", "uri"), "key").select(F.col("plural").alias("key"), "uri")


def _in_every(df: DataFrame, n: DataFrame, name: str) -> DataFrame:
    """Rows repeated for every block of the other table; `n` is its one-row table with their number."""
    slots = F.sequence(F.lit(0).cast("bigint"), F.col(f"{name}s").cast("bigint") - 1)
    return df.join(F.broadcast(n)).withColumn(name, F.explode(slots)).drop(f"{name}s")


def _longest_inside(keys: pd.DataFrame, surfaces: pd.DataFrame) -> pd.DataFrame:
    """The best surface of one block in each key of another that has any: one pass over a key by an automaton."""
    best: list[int | None] = []
    if len(keys) and len(surfaces):
        surfaces = surfaces.sort_values(["len", "ord", "pos"], ascending=[False, True, True], ignore_index=True)
        automaton = ahocorasick.Automaton()
        for rank in range(len(surfaces) - 1, -1, -1):
            automaton.add_word(surfaces["surface"][rank], rank)
        automaton.make_automaton()
        best = [min((rank for _, rank in automaton.iter(key)), default=None) for key in keys["key"]]
    hit = [i for i, rank in enumerate(best) if rank is not None]
    found = surfaces.iloc[[best[i] for i in hit]].reset_index(drop=True)
    return found.assign(key=keys["key"].iloc[hit].to_numpy())[["key", "uri", "len", "ord", "pos"]]


def link_substring(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, uri) by the longest surface inside the key, the first in the vocabulary among equally long ones.

    Keys and surfaces are cut in hash blocks of a bounded number of characters; a task builds the automaton of one block
    of surfaces and reads each key of one block once, so work is linear in keys and hits whatever lengths surfaces have,
    and a key gives one row per block of surfaces that hits it. Keys are distinct; null or empty ones have no row.
    `ord` and `pos` may be of any type that sorts and hold no nulls.
    """
    keys = keys.filter(F.col("key") != "").select("key")
    surfaces = index.filter(F.col("key") != "").select(F.col("key").alias("surface"), "uri", "len", "ord", "pos")
    left, n_left = _blocks(keys, "key", KEY_CHARS, "k_block", F.length("key"))
    right, n_right = _blocks(surfaces, "surface", SURFACE_CHARS, "s_block", F.length("surface"))
    grid = ["k_block", "s_block"]
    hits = (
        _in_every(left, n_right, "s_block").groupBy(*grid)
        .cogroup(_in_every(right, n_left, "k_block").groupBy(*grid))
        .applyInPandas(_longest_inside, "key string, " + ", ".join(f"{c} {kind}" for c, kind in surfaces.dtypes[1:]))
    )
    return hits.groupBy("key").agg(F.min_by("uri", F.struct(-F.col("len"), "ord", "pos")).alias("uri"))


def link_surfaces(surfaces: DataFrame, index: DataFrame) -> DataFrame:
    """(key, uri) of distinct keys: exact, then plural, then substring. Unlinked keys have a null uri.

    One left join each for the two cheap stages, staged; only what they leave goes to the third.
    """
    found = index.select("key", "uri")
    singular = found.select(F.col("key").alias("_singular"), F.col("uri").alias("_plural_uri"))
    cut = F.when(
        F.col("key").endswith("s") & (F.length("key") > 3), F.expr("substring(key, 1, length(key) - 1)")
    )
    cheap = stage(
        surfaces.join(found, "key", "left")
        .withColumn("_singular", F.when(F.col("uri").isNull(), cut))
        .join(singular, "_singular", "left")
        .select("key", F.coalesce("uri", "_plural_uri").alias("uri"))
    )
    rest = link_substring(cheap.filter(F.col("uri").isNull()).select("key"), index)
    return cheap.join(rest.withColumnRenamed("uri", "_sub_uri"), "key", "left").select(
        "key", F.coalesce("uri", "_sub_uri").alias("uri")
    )


def link_mentions(entities: DataFrame, index: DataFrame) -> DataFrame:
    """Entities with `uri` looked up by text_span. Each distinct surface is linked once.

    A surface may make up a large part of all mentions, hence the join back spreads hot ones.
    """
    keyed = entities.drop("uri").withColumn("key", normalise_surface(F.col("text_span")))
    linked = link_surfaces(keyed.select("key").distinct(), index)
    return lookup_join(keyed, linked, ["key"], "left").drop("key")


def _blocks(df: DataFrame, id_col: str, size: int, name: str, weight: Column | int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows with a hash block of about `size` rows, or of that much weight, and the one-row table with the number of blocks."""
    weight = F.lit(weight) if isinstance(weight, int) else weight
    n = df.agg(F.greatest(F.ceil(F.sum(weight) / size), F.lit(1)).cast("int").alias(f"{name}s"))
    return df.join(F.broadcast(n)).withColumn(name, F.pmod(F.xxhash64(id_col), F.col(f"{name}s"))).drop(f"{name}s"), n


def _unit_rows(block: pd.DataFrame, side: str, dims: int | None) -> np.ndarray:
    """Vectors of a block as rows of length one; zero vectors stay zero."""
    if dims is None:
        m = np.stack(block[f"{side}_vector"].to_numpy()).astype("float64")
    else:
        at, weights = block[f"{side}_at"], block[f"{side}_vector"]
        m = np.zeros((len(block), dims))
        m[np.repeat(np.arange(len(block)), at.map(len)), np.concatenate(at.to_numpy())] = np.concatenate(weights.to_numpy())
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _nearest(mentions: pd.DataFrame, concepts: pd.DataFrame, dims: int | None) -> pd.DataFrame:
    """Best concept of one block for each mention of another, by a matrix product for every MENTIONS_AT_ONCE."""
    if mentions.empty or concepts.empty:
        return pd.DataFrame(columns=["mention_id", "concept_id", "score"])
    concepts = concepts.sort_values("concept_id")
    names, units = concepts["concept_id"].to_numpy(), _unit_rows(concepts, "concept", dims).T
    found = []
    for at in range(0, len(mentions), MENTIONS_AT_ONCE):
        part = mentions.iloc[at:at + MENTIONS_AT_ONCE]
        scores = _unit_rows(part, "mention", dims) @ units
        np.round(scores, SCORE_DIGITS, out=scores)
        best = scores.argmax(axis=1)
        found.append(pd.DataFrame({
            "mention_id": part["mention_id"].to_numpy(), "concept_id": names[best], "score": scores[np.arange(len(best)), best],
        }))
    return pd.concat(found, ignore_index=True)


def link_cosine(mentions: DataFrame, concepts: DataFrame, dims: int | None = None) -> DataFrame:
    """(mention_id, concept_id, score): nearest concept by cosine, the lowest id among equal scores.

    Inputs are (mention_id, vector) and (concept_id, vector), unique ids. With `dims` the vectors are sparse: `vector`
    holds the values other than zero and `at` their places. Both inputs are cut in hash blocks of bounded size; a
    task multiplies one block of each and sends on one row per mention. Nothing is broadcast.
    """
    columns = ["vector"] if dims is None else ["vector", "at"]
    # Columns of their own on each side, as both may come from one table.
    mentions = mentions.select("mention_id", *[F.col(c).alias(f"mention_{c}") for c in columns])
    concepts = concepts.select("concept_id", *[F.col(c).alias(f"concept_{c}") for c in columns])
    left, n_left = _blocks(mentions, "mention_id", MENTION_BLOCK, "m_block")
    right, n_right = _blocks(concepts, "concept_id", CONCEPT_BLOCK, "c_block")

    id_types = dict(mentions.dtypes)["mention_id"], dict(concepts.dtypes)["concept_id"]
    per_block = (
        _in_every(left, n_right, "c_block")
        .groupBy("m_block", "c_block")
        .cogroup(_in_every(right, n_left, "m_block").groupBy("m_block", "c_block"))
        .applyInPandas(
            lambda m, c: _nearest(m, c, dims), f"mention_id {id_types[0]}, concept_id {id_types[1]}, score double"
        )
    )
    best = F.min(F.struct((-F.col("score")).alias("neg"), "concept_id")).alias("best")
    return per_block.groupBy("mention_id").agg(best).select(
        "mention_id", "best.concept_id", (-F.col("best.neg")).alias("score")
    )


def trigram_vectors(surfaces: DataFrame, dims: int = 256) -> DataFrame:
    """(key, at, vector): character trigram TF-IDF of each distinct key, hashed to `dims` dimensions, sparse.

    Trigrams are taken over the key with a space put on both sides. The dimension is the first four hex digits of
    the trigram's md5 modulo dims; idf = ln((1 + keys) / (1 + keys having the dimension)) + 1.
    """
    padded = F.concat(F.lit(" "), "key", F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(padded, i, F.lit(3)))
    bucket = F.conv(F.substring(F.md5(F.col("gram")), 1, 4), 16, 10).cast("int") % dims
    terms = (
        surfaces.filter(F.col("key") != "")
        .select("key", F.explode(grams).alias("gram"))
        .groupBy("key", bucket.alias("dim"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    total = surfaces.filter(F.col("key") != "").agg(F.count(F.lit(1)).alias("n"))
    # One row per dimension, so the idf table has at most `dims` rows.
    idf = (
        terms.groupBy("dim")
        .agg(F.count(F.lit(1)).alias("df"))
        .join(F.broadcast(total))
        .select("dim", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    weights = terms.join(F.broadcast(idf), "dim").select("key", "dim", (F.col("tf") * F.col("idf")).alias("w"))
    entries = weights.groupBy("key").agg(F.collect_list(F.struct("dim", "w")).alias("m"))
    return entries.select("key", F.col("m.dim").alias("at"), F.col("m.w").alias("vector"))


def link_trigrams_hashed(mention_keys: DataFrame, concepts: DataFrame, dims: int = 256) -> DataFrame:
    """(key, uri, score): nearest concept of each distinct mention key by the cosine of hashed trigrams.

    Trigrams of one dimension count as equal; link_trigrams tells all apart.

    `concepts` is (uri, key) with the canonical surface of each concept. Vectors of both come from one vocabulary.
    """
    both = mention_keys.select("key").union(concepts.select("key")).distinct()
    vectors = stage(trigram_vectors(both, dims))
    mentions = vectors.join(mention_keys.distinct(), "key", "left_semi").withColumnRenamed("key", "mention_id")
    named = concepts.join(vectors, "key").select(F.col("uri").alias("concept_id"), "at", "vector")
    return link_cosine(mentions, named, dims).select(
        F.col("mention_id").alias("key"), F.col("concept_id").alias("uri"), "score"
    )


def trigram_weights(surfaces: DataFrame) -> DataFrame:
    """(key, gram, w): character trigram TF-IDF of each distinct key, of length one, a row per trigram.

    Trigrams and idf as in trigram_vectors, each trigram a dimension of its own.
    """
    keys = surfaces.filter(F.col("key") != "")
    padded = F.concat(F.lit(" "), "key", F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(padded, i, F.lit(3)))
    terms = keys.select("key", F.explode(grams).alias("gram")).groupBy("key", "gram").agg(F.count(F.lit(1)).alias("tf"))
    terms = stage(terms)
    total = keys.agg(F.count(F.lit(1)).alias("n"))
    idf = stage(
        terms.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("df"))
        .join(F.broadcast(total))
        .select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    # Where there are few different trigrams their idf goes to the terms, not the terms to it.
    weighed = terms.join(F.broadcast(idf), "gram") if idf.count() <= FEW_GRAMS else lookup_join(terms, idf, ["gram"])
    raw = weighed.select("key", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return raw.select("key", "gram", (F.col("w") / norm).alias("w"))


def _nearest_by_trigrams(mentions: pd.DataFrame, concepts: pd.DataFrame) -> pd.DataFrame:
    """Best concept of one block for each mention of another, the lowest uri among equal scores.

    The weights of concepts are kept by trigram; a mention only meets the concepts that share one of its trigrams. Scores of
    TRIGRAM_KEYS_AT_ONCE mentions are in memory at once.
    """
    if mentions.empty or concepts.empty:
        return pd.DataFrame({"key": [], "uri": [], "score": []}, dtype=object).astype({"score": float})
    concepts = concepts.sort_values("uri", ignore_index=True)
    code = {gram: k for k, gram in enumerate(sorted({gram for grams in concepts["uri_grams"] for gram in grams}))}
    owner = np.repeat(np.arange(len(concepts)), concepts["uri_grams"].map(len))
    gram = np.array([code[g] for grams in concepts["uri_grams"] for g in grams])
    order = np.argsort(gram, kind="stable")
    owner, value = owner[order], np.concatenate(concepts["uri_ws"].to_numpy())[order]
    first = np.searchsorted(gram[order], np.arange(len(code) + 1))
    found = []
    for at in range(0, len(mentions), TRIGRAM_KEYS_AT_ONCE):
        part = mentions.iloc[at:at + TRIGRAM_KEYS_AT_ONCE]
        row = np.repeat(np.arange(len(part)), part["key_grams"].map(len))
        gram = np.array([code.get(g, -1) for grams in part["key_grams"] for g in grams])
        known = gram >= 0
        row, gram, weight = row[known], gram[known], np.concatenate(part["key_ws"].to_numpy())[known]
        n = first[gram + 1] - first[gram]
        hit = np.arange(n.sum()) + np.repeat(first[gram] - np.cumsum(n) + n, n)
        cell = np.repeat(row * len(concepts), n) + owner[hit]
        scores = np.bincount(cell, np.repeat(weight, n) * value[hit], len(part) * len(concepts)).reshape(len(part), -1)
        top = scores.max(axis=1)
        best, rounded = np.zeros(len(part), np.int64), np.round(top, SCORE_DIGITS)
        # What is below the highest score by less than a unit of the last digit may round to the same.
        near, concept = np.nonzero((scores > top[:, None] - 10.0**-SCORE_DIGITS) & (rounded > 0)[:, None])
        equal = np.round(scores[near, concept], SCORE_DIGITS) == rounded[near]
        rows, lowest = np.unique(near[equal], return_index=True)
        best[rows] = concept[equal][lowest]
        found.append(pd.DataFrame({"key": part["key"].to_numpy(), "uri": concepts["uri"].to_numpy()[best], "score": rounded}))
    return pd.concat(found, ignore_index=True)


def link_trigrams(mention_keys: DataFrame, concepts: DataFrame) -> DataFrame:
    """(key, uri, score): nearest concept of each distinct mention key by trigram cosine, the lowest uri among equal scores.

    `concepts` is (uri, key), one row with the canonical surface of each concept. Weights of both come from one
    vocabulary. A key that shares no trigram with any concept scores 0 with all, so it gets the lowest uri. Exact: keys and
    concepts are cut in hash blocks of bounded size, a row with all trigrams each; a task scores one block of each through
    the trigrams they share and sends on one row per key. Trigrams travel once a block of concepts. Runs jobs.
    """
    keys = mention_keys.select("key").filter(F.col("key") != "").distinct()
    both = keys.union(concepts.select("key")).distinct()
    terms = F.sort_array(F.collect_list(F.struct("gram", "w")))
    wide = stage(trigram_weights(both).groupBy("key").agg(terms.alias("t")).select("key", F.col("t.gram").alias("grams"), F.col("t.w").alias("ws")))

    def of(side: str, df: DataFrame) -> DataFrame:
        # Columns of their own on each side, as both come from one table.
        return df.select(side, *[F.col(c).alias(f"{side}_{c}") for c in ("grams", "ws")])

    mentions = of("key", wide.join(keys, "key", "left_semi"))
    named = of("uri", concepts.filter(F.col("uri").isNotNull()).select("uri", "key").join(wide, "key"))
    left, n_left = _blocks(mentions, "key", MENTION_BLOCK, "m_block")
    right, n_right = _blocks(named, "uri", CONCEPT_BLOCK, "c_block")
    grid = ["m_block", "c_block"]
    per_block = (
        _in_every(left, n_right, "c_block").groupBy(*grid)
        .cogroup(_in_every(right, n_left, "m_block").groupBy(*grid))
        .applyInPandas(_nearest_by_trigrams, "key string, uri string, score double")
    )
    best = F.min(F.struct((-F.col("score")).alias("neg"), "uri")).alias("best")
    return per_block.groupBy("key").agg(best).select("key", "best.uri", (-F.col("best.neg")).alias("score"))
