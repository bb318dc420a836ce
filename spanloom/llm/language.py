"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the 2- to 4-grams of letters of its lower-cased words, word ends marked (a word of one letter is a
3-gram, the letter between its ends), each hashed to one of `buckets` rows of an embedding table. Their mean goes through
a linear softmax; table and softmax are trained together by stochastic gradient descent in numpy. A part of the training
rows is held back to calibrate: a temperature makes the scores probabilities, and texts whose score is below the cut are
rejected.

Training reads a bounded sample of labelled rows, `per_label` of each language, taken by the order of a hash: its size is
a parameter, not a share of the corpus. Prediction reads every text whole, once, without a shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import chunks, give_back, tidy

GRAMS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Rows of `weights` are what a bucket adds to the logits of the labels: embedding table times softmax matrix."""

    labels: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    cut: float = 0.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(texts: list[str], buckets: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For chunks of texts: the first text's place and, for each length of gram, the buckets of all grams in order of
    place and the offsets of each text's grams."""
    size = np.cumsum([0, *(4 * len(t) for t in texts)])
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for first, last in chunks(size):
        points = np.frombuffer("\n".join(texts[first:last]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = _letters()[np.minimum(points, 0x10FFFF)]
        starts = (size[first:last] - size[first]) // 4 + np.arange(last - first)
        wide = np.zeros(len(code) + 5, np.uint64)
        wide[1 : len(code) + 1] = code
        inside = wide > 0
        found = []
        h = np.full(len(wide), 1, np.uint64)
        core = np.ones(len(wide), bool)  # letters in all places but the first and the last
        for n in range(1, max(GRAMS) + 1):
            span = len(wide) - n + 1
            h = h[:span] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 : n - 1 + span]
            if n > 2:
                core = core[:span] & inside[n - 2 : n - 2 + span]
            if n in GRAMS:
                ends = inside[:span], inside[n - 1 : n - 1 + span]
                whole = core[:span] & (ends[0] & ends[1] if n == 2 else n == 3 or ends[0] | ends[1])
                at = np.flatnonzero(whole)
                gram = ((h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64)
                found.append((gram, np.append(np.searchsorted(at, starts), len(at))))
        yield first, found


def logits(model: LanguageModel, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each text, and its number of grams."""
    texts = len(found[0][1]) - 1
    out, count = np.zeros((texts, len(model.labels))), np.zeros(texts, np.int64)
    for gram, offsets in found:
        full = np.flatnonzero(np.diff(offsets))
        count += np.diff(offsets)
        for k in range(0, len(model.labels) if len(full) else 0, 8):
            out[full, k : k + 8] += np.add.reduceat(model.weights[:, k : k + 8][gram], offsets[full], dtype=np.float64)
    return out / np.maximum(count, 1)[:, None] + model.bias, count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(
    texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, batch: int = 16,
    rate: float = 0.5, boost: float = 20.0, right: float = 0.99, least: float = 0.3, seed: int = 7,
) -> LanguageModel:
    """Train and calibrate. Every fifth row is held back for the calibration.

    A text is rejected below the cut: the lowest score, `least` at least, above which a share of `right` of the held
    rows is predicted rightly.
    """
    names = sorted(set(labels))
    if not names:
        return LanguageModel()
    rows = []
    for _, found in features(texts, buckets):
        for k in range(len(found[0][1]) - 1):
            gram, count = np.unique(np.concatenate([gram[at[k] : at[k + 1]] for gram, at in found]), return_counts=True)
            rows.append((gram.astype(np.int32), count.astype(np.float32)))
    want = np.array([names.index(x) for x in labels])
    usable = np.array([k for k, (g, _) in enumerate(rows) if len(g)], int)
    held, used = usable[::5], np.setdiff1d(usable, usable[::5])
    if not len(used):
        used = usable
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((buckets, dim)).astype(np.float32)
    soft, bias = rng.standard_normal((dim, len(names))) * 0.1, np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(used)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            share = [(g, (c / c.sum()).astype(np.float32)) for g, c in (rows[i] for i in some)]
            mean = np.stack([s @ table[g] for g, s in share]).astype(np.float64)
            error = _softmax(mean @ soft + bias)
            error[np.arange(len(some)), want[some]] -= 1
            back = error @ soft.T
            soft -= step * mean.T @ error
            bias -= step * 0.1 * error.mean(0)
            for (g, s), b in zip(share, back, strict=True):
                table[g] -= (step * boost * s[:, None] * b[None, :]).astype(np.float32)
    model = LanguageModel(names, (table @ soft).astype(np.float32), bias)
    if len(held):
        z = np.stack([(c / c.sum()) @ model.weights[g] + bias for g, c in (rows[i] for i in held)])
        truth = want[held]
        heat = np.exp(np.linspace(-2, 2, 81))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        score, hit = p.max(1), p.argmax(1) == truth
        order = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(hit[order]) >= right * np.arange(1, len(order) + 1))
        model.cut = max(least, float(score[order][good[-1]]) if len(good) and good[-1] < len(order) - 1 else 0.0)
    return model


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and rejection of each text. A text without a letter is `und`, scores 0 and is rejected."""
    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model.labels:
        for first, found in features(texts, len(model.weights)):
            z, count = logits(model, found)
            p = _softmax(z / model.temperature)
            for row in np.flatnonzero(count):
                label[first + row] = model.labels[int(p[row].argmax())]
                score[first + row] = p[row].max()
    known = np.array([x != UNKNOWN for x in label], bool)
    return label, score, ~known | (score < model.cut)


def held_out():
    """Whether crc32 of the doc_id's text leaves the remainder 1 by 3; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, per_label: int = 1000, most_labels: int = 400, **settings) -> LanguageModel:
    """Learn from rows with text, lang and doc_id that are not held out: at most `per_label` of each language.

    Rows are taken by the order of a hash of doc_id and text. The sample, of bounded size, is trained on the driver.
    Labels beyond the `most_labels` most frequent are not learned. Copies of a sampled row come along, up to
    twice the sample.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null").filter(~held_out())
    known = known.withColumn("mark", F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text"))
    names = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).select("lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    tops = (
        known.select("lang", "mark").join(F.broadcast(names), "lang").withColumn("place", place).filter(F.col("place") <= per_label)
        .groupBy("lang").agg(F.max("mark").alias("top"))
    )
    rows = known.join(F.broadcast(tops), "lang").filter("mark <= top").select("text", "lang", "mark").limit(2 * per_label * most_labels).collect()
    rows.sort(key=lambda r: (r["lang"], r["mark"], r["text"]))
    model = train([r["text"] for r in rows], [r["lang"] for r in rows], **settings)
    del rows
    give_back()
    return model


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs beside lang_pred, score and rejected, which replace columns of those names.

    A null or empty text, or one without a letter, is `und` with score 0 and is rejected. Without any labelled row all
    texts are. Rows are independent of each other, so equal texts get equal results.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([
        *fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())
    ])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score, rejected = predict(model, [t or "" for t in batch.column("text").to_pylist()])
            columns = [*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)
