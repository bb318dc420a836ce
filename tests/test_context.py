"""Pairs classified in their text, beside brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import insert_markers
from spanloom.models import context
from spanloom.models.context import classify_in_context, entity_units, mark
from spanloom.plans.corpus import predict_relations_in_context
from spanloom.vocab import CLASSES, ENTITY_LABELS

ENTITY = "pmid string, location string, pos int, start_idx int, end_idx int, text_span string, label string, uri string"
SECTIONS = "pmid string, location string, text string, annotator string"


def corpus():
    rng = random.Random(2)
    sections, entities = [], []
    for p in range(6):
        text = "".join(rng.choice("ab é𝒳\n") for _ in range(rng.choice([30, 400])))
        sections.append((str(p), "abstract", text, "x"))
        for pos in range([0, 1, 2, 9, 40, 90][p]):
            start = rng.randrange(len(text) - 8)
            end = start + rng.randint(1, 8)
            entities.append((str(p), "abstract", pos, start, end, text[start:end], rng.choice(ENTITY_LABELS), f"u:{pos % 7}"))
    entities += [
        ("3", "abstract", 50, 1, 4, "x", "no label", None), ("3", "abstract", 51, None, 4, "x", "gene", None), ("3", "title", 52, 0, 1, "x", "gene", "u"),
        ("9", "abstract", 0, 0, 1, "x", "gene", "u"), ("9", "abstract", 1, 2, 3, "x", "gene", "u"), (None, "abstract", 1, 2, 3, "x", "gene", "u"),
    ]
    return sections, entities


def scorer():
    """The function that makes a scorer; made here, so that workers need not import this module."""

    def make():
        def score(marked):
            out = np.zeros((len(marked), 18))
            for row, text in enumerate(marked):
                out[row, sum(ord(c) * (k + 1) for k, c in enumerate(text)) % 18] = 1.0
            return out

        return score

    return make


def expected(window):
    sections, entities = corpus()
    text_of = {(p, loc): t for p, loc, t, _ in sections}
    score, out = scorer()(), Counter()
    good = [e for e in entities if e[6] in ENTITY_LABELS and e[3] is not None and (e[0], e[1]) in text_of]
    for s in good:
        for o in good:
            if s[:2] == o[:2] and s[3:5] != o[3:5]:
                k = int(score([mark(text_of[s[:2]], s[3:5], o[3:5], window)]).argmax())
                out[(*s[:2], s[2], o[2], CLASSES[k])] += 1
    return out


@pytest.mark.parametrize(("tile", "units", "window"), [(64, 16, None), (5, 2, 6), (1, 1, 0)])
def test_same_as_brute_force(spark, monkeypatch, tile, units, window):
    monkeypatch.setattr(context, "TILE", tile)
    monkeypatch.setattr(context, "UNITS", units)
    sections, entities = corpus()
    frames = spark.createDataFrame(entities, ENTITY).repartition(3), spark.createDataFrame(sections, SECTIONS)
    got = classify_in_context(*frames, scorer(), batch_size=7, window=window, related_only=False)
    assert Counter((r.pmid, r.location, r.subject_pos, r.object_pos, r.predicate) for r in got.collect()) == expected(window)
    units_of = entity_units(*frames).filter("kind = 1").selectExpr("pmid", "slot", "size(left) * coalesce(size(right), size(left)) as pairs")
    if tile == 5:
        assert units_of.selectExpr("count(distinct pmid, slot)").first()[0] > 20
        assert units_of.filter("pmid = '5'").selectExpr("max(pairs)").first()[0] < 90 * 90 / 8


def test_marks_as_the_column_expression(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        text = "".join(rng.choice("abc é𝒳") for _ in range(rng.randint(4, 20)))
        s, o = (sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(2))
        rows.append((text, *s, *o))
    frame = spark.createDataFrame(rows, "text string, a int, b int, c int, d int")
    for r in frame.withColumn("marked", insert_markers(frame.text, frame.a, frame.b, frame.c, frame.d)).collect():
        assert mark(r.text, (r.a, r.b), (r.c, r.d)) == r.marked


def test_windows():
    text = "0123456789" * 3
    assert mark(text, (2, 4), (25, 27), 3) == "01[E1]23[/E1]456 … 234[E2]56[/E2]789"
    assert mark(text, (10, 12), (4, 6), 3) == "123[E2]45[/E2]6789[E1]01[/E1]234"


def test_relations_and_empty_tables(spark):
    sections, entities = corpus()
    frames = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(sections, SECTIONS)
    mentions, concepts = predict_relations_in_context(*frames, scorer())
    assert mentions.count() == sum(n for key, n in expected(None).items() if key[4] != "no_relation")
    assert 0 < concepts.count() == concepts.distinct().count()
    none = [f.limit(0) for f in frames]
    assert classify_in_context(*none, scorer()).collect() == []


def test_only_the_columns_asked_for_and_few_batches(spark, monkeypatch):
    """Pairs of several units go out together, with the columns named and no others."""
    sections, entities = corpus()
    frames = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(sections, SECTIONS)
    columns = ["object_pos", "predicate", "pmid", "subject_pos", "location"]
    want = Counter({k: n for k, n in expected(6).items() if k[4] != "no_relation"})
    for at_once in (1, 50, 4096):
        monkeypatch.setattr(context, "PAIRS_AT_ONCE", at_once)
        got = classify_in_context(*frames, scorer(), window=6, columns=columns)
        assert got.columns == columns
        assert Counter((r.pmid, r.location, r.subject_pos, r.object_pos, r.predicate) for r in got.collect()) == want


def test_marks_of_many_pairs_as_of_each():
    rng = random.Random(5)
    text = "".join(rng.choice("abc é𝒳") for _ in range(60))
    spans = [(s, s + rng.randint(-1, 9)) for s in (rng.randrange(61) for _ in range(40))]
    subject, object_ = context._ordered_pairs(np.array(spans), 25)
    assert len(subject) > 700
    for window in (None, 0, 3, 10):
        want = [mark(text, spans[s], spans[o], window) for s, o in zip(subject, object_)]
        assert [*context.marks(text, spans, subject, object_, window)] == want


def _counted(pairs, columns):
    return Counter(tuple(r[c] for c in columns) for r in pairs.collect())


@pytest.mark.parametrize(("tile", "units", "held"), [(1024, 1, 1 << 20), (5, 2, 7), (30, 1, 1)])
def test_counts_are_those_of_the_pairs(spark, monkeypatch, tile, units, held):
    """Whole articles and cut ones, counts that go out early, null texts and URIs, titles beside abstracts."""
    monkeypatch.setattr(context, "TILE", tile)
    monkeypatch.setattr(context, "UNITS", units)
    sections, entities = corpus()
    sections += [("3", "title", "a title with words", "x"), ("5", "title", "another of them", "x")]
    entities += [(p, "title", 100 + k, k, k + 2, t, "gene", u) for p in "35" for k, (t, u) in enumerate([("x", "u:1"), (None, None), ("x", "u:1"), ("y", "")])]
    frames = spark.createDataFrame(entities, ENTITY).repartition(3), spark.createDataFrame(sections, SECTIONS)
    pairs = classify_in_context(*frames, scorer(), window=6).cache()
    monkeypatch.setattr(context, "HELD", held)
    monkeypatch.setattr(context, "COUNTED_AT_ONCE", min(held, 50))
    by = ["location", "pmid", "subject_label", "predicate", "object_label"]
    got = classify_in_context(*frames, scorer(), window=6, by=by, totals=["subject_start_idx", "object_end_idx"])
    want = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("subject_start_idx"), F.sum("object_end_idx"))
    assert Counter(got.collect()) == Counter(want.collect())
    mentions, concepts = predict_relations_in_context(*frames, scorer(), window=6)
    assert _counted(mentions, mentions.columns) == _counted(pairs, mentions.columns)
    counted, _ = predict_relations_in_context(*frames, scorer(), window=6, counted=True)
    assert Counter({tuple(r)[:-1]: r.n for r in counted.collect()}) == _counted(pairs, mentions.columns)
    assert counted.count() == len(_counted(pairs, mentions.columns))
    related = pairs.filter("subject_uri <> '' and object_uri <> '' and subject_uri <> object_uri").select(*concepts.columns).distinct()
    assert _counted(concepts, concepts.columns) == _counted(related, concepts.columns)


def test_counts_of_whole_articles_are_not_shuffled(spark):
    """Counting moves the entities and texts; the groups of whole articles, many more, stay where they were counted."""
    sections, entities = corpus()
    frames = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(sections, SECTIONS)
    counted, _ = predict_relations_in_context(*frames, scorer(), window=6, counted=True)
    plan = counted._jdf.queryExecution().optimizedPlan()
    assert "Aggregate" in plan.toString() and "Aggregate" not in plan.children().head().toString()
